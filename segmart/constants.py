"""Fixed values. Results agree with existing reports only if these stay exactly as they are."""

# Item tags: tag -> substrings looked up in the lower-cased item description.
TAG_KEYWORDS = {
    "cleanser": ["cleansing", "soothing", "cleanser"],
    "kids": ["kids", "baby"],
    "set": ["set", "bundle"],
    "serum": ["serum"],
    "moisturizing": ["hydrat", "moistur", "moist"],
    "repairing": ["repair", "restor"],
    "whitening/rejuvenate": ["glow", "brighten", "radian", "whiten", "rejuvenat", "shine", "AGING"],
    "shampoo/conditioners": ["shampoo", "conditioners"],
    "wash": ["wash"],
    "volum": ["volum"],
    "lotion": ["lotion"],
    "cream": ["cream"],
    "eye": ["eye"],
    "oil": ["oil"],
    "fragrance": ["perfume", "edp", "fragrance", "edt", "parfum"],
    "lip": ["lip"],
    "candle/diffuser": ["candle", "diffuser"],
    "mask": ["mask"],
    "refill": ["refil"],
    "gwp": ["gwp"],
    "gold/diamond": ["gold", "diamond"],
    "brush/pencil": ["brush", "pencil"],
    "dental": ["tooth", "teeth"],
    "XM\\GIFT\\CHRISTMAS": ["xm", "gift", "christmas"],
    "gel": ["gel"],
    "SPRAY": ["spray", "mist"],
    "SUNSCREEN": ["sunscreen", "spf"],
    "BLUSH": ["blush"],
    "FOUNDATION": ["foundation"],
    "COUPONS": ["coupons", "cash voucher"],
    "ANTIOXIDANT": ["antioxidant"],
}

# Cluster id -> segment label; two clusters share the last label.
PERSONA_LABELS = {
    0: "Beauty Devices Lover",
    1: "Beautyholic",
    2: "Skincare Addicts",
    3: "Personal Care Enthusiasts",
    4: "Personal Care Enthusiasts",
}
SEGMENT_ORDER = [
    "Beautyholic",
    "Beauty Devices Lover",
    "Skincare Addicts",
    "Personal Care Enthusiasts",
]
OVERRIDE_FROM = "Beauty Devices Lover"
OVERRIDE_TO = "Personal Care Enthusiasts"

# Age group code -> label; any other code has no label.
AGE_LABELS = {
    "01": "< 25",
    "02": "26 - 30",
    "03": "31 - 35",
    "04": "36 - 40",
    "05": "41 - 50",
    "06": "> 51",
}
KNOWN_NATIONALITIES = ["Hong Kong", "Mainland China", "Macau"]
OTHER_NATIONALITY = "Others"
UNKNOWN_SEX = "C"

# Tenure bands: upper bound in years (inclusive) -> label, then the open band.
TENURE_BANDS = [(1, "0-1"), (3, "1-3"), (7, "3-7")]
TENURE_OPEN_BAND = "8+"

# Category clean-up before feature building: renames, then values whose rows are dropped.
FEATURE_RENAMES = {
    "maincat": {"SET": "Set", "Devices, Tool & Acc.": "Devices, Tool & Acc"},
    "subcat": {"SET": "Set"},
}
FEATURE_JUNK = {
    "maincat": ["ZZZ", "Dummy", "dummy"],
    "subcat": ["ZZZ", "Dummy", "dummy"],
    "brand": ["JBZZZ", "ZZ"],
}

# Category clean-up before profiling: renames only.
PROFILE_RENAMES = {
    "maincat": {"SET": "Set", "ZZ": "Unknown", "Dummy": "Unknown"},
    "subcat": {"ZZZ": "Unknown", "dummy": "Unknown", "Dummy": "Unknown", "SET": "Set"},
}
UNKNOWN = "Unknown"
NOT_AVAILABLE = "N/A"
CROSS_CLASS_EXCLUDED = ["Life-styled", "Unknown", "Take-In"]

# Clustering settings.
ZERO_SHARE_THRESHOLD = 0.85
FEATURE_NAME_STOPWORDS = ["brand", "SET", "Set"]
N_FACTORS = 25
N_SELECTED = 25
WCSS_MAX_K = 20
WCSS_RESTARTS = 10
FINAL_K = 5
PRICE_POINT_HIGH = 0.8
PRICE_POINT_LOW = 0.3
PRICE_POINT_ERROR = 0.01
