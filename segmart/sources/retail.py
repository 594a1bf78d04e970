"""A retail warehouse view over the star-schema sample tables.

Orders become invoices of a supplier's shop, parts become items, customers become cards. The
expressions also produce what the operators must cope with: padded and missing cards, returned
orders, item versions with ties, junk categories, unmatched brands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmart.operators.enrich import ValidRules
from segmart.plans.datamart import DatamartSettings, Warehouse
from segmart.plans.features import FeatureSettings
from segmart.plans.reports import ReportSettings
from segmart.session import materialise

HOUSE_BRAND = "HB"
WINDOW = ("2000-08-01", "2001-07-31")
AS_OF = "2001-08-01"

DATAMART = DatamartSettings(
    house_brand=HOUSE_BRAND,
    start_date="1996-08-01",
    end_date="2001-07-31",
    rules=ValidRules(
        house_brand=HOUSE_BRAND,
        regions=("AFRICA", "AMERICA", "ASIA", "EUROPE"),
        excluded_items=("P13",),
        excluded_dates=("2001-02-27",),
    ),
)
FEATURES = FeatureSettings(as_of=AS_OF, visit_start=WINDOW[0], visit_end=WINDOW[1])
REPORTS = ReportSettings(
    start_date=WINDOW[0],
    end_date=WINDOW[1],
    as_of=AS_OF,
    new_joiner_cutoff="1996-01-01",
    listed_brands=("Brand#1", "Brand#2", "Brand#3"),
    excluded_brands=("Brand#24", "Brand#25"),
)

NOUNS = [
    "Hydrating Moisture Serum",
    "Cleansing Soothing Milk",
    "Gold Lip Balm",
    "EYE CREAM 15ml",
    "Shampoo Set",
    "Baby Wash",
    "Parfum EDP Gift",
    "SPF Mist",
    "AGING Repair",
    "plain",
]


NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
Tables = dict[str, DataFrame]


def load(spark: SparkSession, folder: str) -> Tables:
    """The sample tables, each opened once."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in NAMES}


def _by_size(labels: dict[int, str | None], default: str) -> str:
    cases = " ".join(
        f"WHEN {number} THEN {'NULL' if label is None else repr(label)}" for number, label in labels.items()
    )
    return f"CASE p_size {cases} ELSE {default} END"


MAINCAT_BY_SIZE = {
    1: "ZZZ",
    2: "Dummy",
    3: "SET",
    4: None,
    5: "N/A",
    6: "ZZ",
    7: "Devices, Tool & Acc.",
    17: "Life-styled",
    18: "Take-In",
}
SUBCAT_BY_SIZE = {8: "ZZZ", 9: "dummy", 10: "SET", 11: None, 12: "N/A", 13: "Dummy", 19: "dot.ted"}
BRAND_BY_SIZE = {14: "JBZZZ", 15: "ZZ", 16: None}


def items(tables: Tables) -> DataFrame:
    """Parts with category, sub category, brand and description."""
    part = tables["part"]
    noun = F.element_at(F.array(*[F.lit(n) for n in NOUNS]), F.col("p_size") % 10 + 1)
    return part.select(
        "p_partkey",
        "p_size",
        "p_type",
        "p_retailprice",
        "p_brand",
        F.expr(_by_size(MAINCAT_BY_SIZE, "p_type")).alias("maincat"),
        F.expr(_by_size(SUBCAT_BY_SIZE, "split_part(p_name, ' ', 2)")).alias("subcat"),
        F.expr(_by_size(BRAND_BY_SIZE, "p_brand")).alias("brand"),
        F.when(F.col("p_size") != 22, F.concat_ws(" ", "p_name", noun)).alias("item_desc"),
    )


def shops(tables: Tables) -> DataFrame:
    nation, region = tables["nation"], tables["region"]
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    supplier = tables["supplier"]
    return supplier.join(places, supplier.s_nationkey == places.n_nationkey).select(
        "s_suppkey",
        "s_name",
        "s_acctbal",
        "n_name",
        "r_name",
        F.when(F.col("s_acctbal") >= 5000, F.lit(HOUSE_BRAND)).otherwise(F.lit("XX")).alias("shop_brand"),
    )


def people(tables: Tables) -> DataFrame:
    nation, region = tables["nation"], tables["region"]
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    customer = tables["customer"]
    nationalities = ["Hong Kong", "Mainland China", "Macau", "Taiwan"]
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select(
        "c_custkey",
        "c_mktsegment",
        "c_acctbal",
        "n_name",
        "r_name",
        F.get(F.array(*[F.lit(n) for n in nationalities]), F.col("c_nationkey") % 5).alias("cust_nat_cat"),
        F.get(
            F.array(F.lit("M"), F.lit("F"), F.lit("C"), F.lit(None), F.lit("")), (F.col("c_custkey") % 5).cast("int")
        ).alias("sex"),
        F.concat(F.lit("0"), (F.col("c_custkey") % 8).cast("string")).alias("age_group"),
    )


PADDED_CARD, PADDED_SHOP, RETURNED, UNSURE = 1, 2, 4, 8


def _mark(test: Column, mark: int) -> Column:
    """The mark where the test holds, else 0, also where it is unknown."""
    return F.when(test, F.lit(mark)).otherwise(F.lit(0))


def _marked(mark: int) -> Column:
    return F.col("marks").bitwiseAND(F.lit(mark)) != 0


def sales(tables: Tables) -> DataFrame:
    """Raw sales lines; every returned line is followed by its reversal."""
    line, order = tables["lineitem"], tables["orders"]
    item = items(tables).select(
        "p_partkey", "brand", F.col("p_retailprice").cast("decimal(18,2)").alias("item_list_price"), _mark(F.col("p_size") == 20, UNSURE).alias("item_marks")
    )
    shop = shops(tables).select("s_suppkey", "shop_brand", F.col("r_name").alias("shop_region"))
    # Columns that are only compared with something move as the answers, those of lines and items in one number.
    bought = order.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("sales_date"),
        (F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("voided"), (F.col("o_orderstatus") == "P").alias("pending"),
    ).join(people(tables).drop("r_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    no_card = F.when(F.col("c_acctbal").between(3000, 3200), 1).when(F.col("c_acctbal").between(3200, 3400), 2).otherwise(0)
    bought = bought.withColumn("no_card", no_card).drop("c_acctbal", "c_custkey")
    narrow = line.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount"),
        (
            _mark(F.col("l_linenumber") % 3 == 0, PADDED_CARD)
            + _mark(F.col("l_linenumber") % 2 == 1, PADDED_SHOP)
            + _mark(F.col("l_returnflag") == "R", RETURNED)
        ).alias("line_marks"),
    )
    # Lines take on little before they move to their orders; the wide columns come with the orders, which are few.
    # Shops are a small list beside the lines, so these do not move for them and meet them last.
    joined = (
        narrow.join(item, narrow.l_partkey == item.p_partkey)
        .withColumn("marks", F.col("line_marks") + F.col("item_marks"))
        .drop("line_marks", "item_marks", "p_partkey")
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(F.broadcast(shop), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    card = F.concat(F.lit("V"), F.col("o_custkey").cast("string"))
    price = F.col("price")
    share = F.lit(1).cast("decimal(4,2)") - F.col("discount")
    lines = joined.select(
        F.col("shop_region").alias("region_key"),
        F.when(F.col("no_card") == 1, F.lit(None))
        .when(F.col("no_card") == 2, F.lit(""))
        .when(_marked(PADDED_CARD), F.concat(F.lit(" "), card, F.lit(" ")))
        .otherwise(card)
        .alias("vip_no"),
        F.concat(F.col("l_suppkey").cast("string"), F.when(_marked(PADDED_SHOP), "  ").otherwise("")).alias(
            "shop_code"
        ),
        F.concat(F.lit("I"), F.col("o_orderkey").cast("string")).alias("invoice_no"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("item_code"),
        "sales_date",
        F.col("l_quantity").alias("sold_qty"),
        (price * share).alias("net_amt_hkd"),
        price.alias("net_amt"),
        "item_list_price",
        "shop_brand",
        F.col("brand").alias("prod_brand"),
        F.concat(F.lit("L"), (F.col("l_suppkey") % 7).cast("string")).alias("sale_lady_id"),
        F.concat(F.lit("K"), (F.col("l_orderkey") % 5).cast("string")).alias("cashier_id"),
        F.col("n_name").alias("customer_nat"),
        "cust_nat_cat",
        F.col("sex").alias("customer_sex"),
        F.col("age_group").alias("customer_age_group"),
        F.when(F.col("voided"), F.lit("V")).alias("void_flag"),
        F.when(F.col("pending"), "0").when(_marked(UNSURE), "Y").otherwise("1").alias("valid_tx_flag"),
        F.lit("N").alias("sales_staff_flag"),
        F.col("l_linestatus").alias("sales_type"),
        F.when(_marked(RETURNED), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1))).alias("signs"),
    )
    signed = lines.withColumn("sign", F.explode("signs")).drop("signs")
    return signed.withColumns(
        {c: (F.col(c) * F.col("sign")).alias(c) for c in ("sold_qty", "net_amt_hkd", "net_amt")}
    ).drop("sign")


def cards(tables: Tables) -> DataFrame:
    """Two cards per customer; some cards without master, some missing, some with two masters."""
    number = F.col("c_custkey")
    own = F.concat(F.lit("V"), number.cast("string"))
    shared = F.concat(F.lit("V"), (number - number % 2).cast("string"))
    masters = (
        F.when(F.col("c_acctbal") > 9000, F.array(F.lit(None).cast("string")))
        .when(F.col("c_acctbal").between(4000, 4100), F.array(shared, own))
        .otherwise(F.array(shared))
    )
    return (
        people(tables)
        .where("c_acctbal >= -600")
        .select(
            F.when(number % 3 == 1, F.concat(F.lit(" "), own, F.lit(" "))).otherwise(own).alias("vip_no"),
            F.explode(masters).alias("vip_main_no"),
            F.col("c_mktsegment").alias("vip_type"),
            F.date_add(F.lit("1994-01-01").cast("date"), (number % 700).cast("int")).alias("vip_issue_date"),
            F.col("sex").alias("vip_sex"),
            F.col("n_name").alias("vip_nation"),
            F.col("age_group").alias("vip_agegrp"),
            F.col("r_name").alias("region_key"),
            F.lit("N").alias("vip_staff_flag"),
        )
    )


def sku(tables: Tables) -> DataFrame:
    """Item versions: an old one, the current one, ties of the current date, undated ones."""
    key = F.col("p_partkey")
    current = F.date_add(F.lit("2000-06-01").cast("date"), (key % 50).cast("int"))
    versions = F.array_compact(
        F.array(
            _version("old ", "", F.lit("1999-01-01").cast("date"), F.col("p_size") != 23),
            _version("", "", current, F.col("p_size") != 23),
            _version("", "tie", current, F.col("p_size") == 24),
            _version("twin ", "", current, F.col("p_size") == 25),
            _version("undated ", "", F.lit(None).cast("date"), F.col("p_size").isin(23, 26)),
        )
    )
    return items(tables).withColumn("v", F.explode(versions)).select(
        F.concat(F.lit("P"), key.cast("string")).alias("item_code"),
        F.concat("v.prefix", "item_desc").alias("item_desc"),
        F.col("v.note").alias("item_desc_c"),
        F.col("p_type").alias("item_cat"),
        F.concat(F.lit("K-"), "maincat").alias("maincat_key"),
        F.concat(F.lit("S-"), "subcat").alias("item_sub_cat"),
        F.lit("PL").alias("item_product_line"),
        F.concat(F.lit("Line "), F.col("p_type")).alias("item_product_line_desc"),
        F.when(F.col("p_size") == 21, "Brand#99").otherwise(F.col("brand")).alias("brand_code"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("retail_price_hk"),
        (F.col("p_retailprice").cast("decimal(18,2)") * 4).cast("decimal(18,2)").alias("retail_price_tw"),
        F.col("v.modified").alias("last_modified_date"),
    )


def _version(prefix: str, note: str, modified, exists):
    return F.when(
        exists, F.struct(F.lit(prefix).alias("prefix"), F.lit(note).alias("note"), modified.alias("modified"))
    )


def maincat(tables: Tables) -> DataFrame:
    names = items(tables).select("maincat").where("maincat IS NOT NULL").distinct()
    return names.select(
        F.concat(F.lit("K-"), "maincat").alias("maincat_key"),
        F.concat(F.lit("C-"), "maincat").alias("maincat_code"),
        F.col("maincat").alias("maincat_desc"),
    )


def subcat(tables: Tables) -> DataFrame:
    """Two loads per sub category; one brand got a later load in one category only."""
    pairs = items(tables).where("brand IS NOT NULL AND subcat IS NOT NULL").select("brand", "p_type", "subcat").distinct()
    late = (F.col("brand") == "Brand#1") & (F.col("p_type") == "PROMO")
    loads = F.array(
        F.struct(F.lit("OLD ").alias("prefix"), F.lit("2000-01-01").cast("date").alias("load_date")),
        F.struct(
            F.lit("").alias("prefix"),
            F.when(late, F.lit("2001-02-01").cast("date")).otherwise(F.lit("2001-01-01").cast("date")).alias("load_date"),
        ),
    )
    return pairs.withColumn("v", F.explode(loads)).select(
        F.col("brand").alias("item_brand_key"),
        F.col("p_type").alias("item_cat"),
        F.concat(F.lit("S-"), "subcat").alias("item_sub_cat"),
        F.concat("v.prefix", "subcat").alias("item_subcat_desc"),
        F.col("v.load_date").alias("load_date"),
    )


def stores(tables: Tables) -> DataFrame:
    """An old and a current description per shop; some shops with a second district on the same day."""
    versions = F.array_compact(
        F.array(
            _version("OLD ", "", F.lit("1999-01-01").cast("date"), F.lit(True)),
            _version("", "", F.lit("2000-03-01").cast("date"), F.lit(True)),
            _version("", "TIE", F.lit("2000-03-01").cast("date"), F.col("s_acctbal") >= 8000),
        )
    )
    return shops(tables).withColumn("v", F.explode(versions)).select(
        F.col("s_suppkey").cast("string").alias("shop_code"),
        F.concat("v.prefix", "s_name").alias("shop_desc"),
        F.concat("v.note", "n_name").alias("city_district"),
        F.col("v.modified").alias("modified_date"),
        "shop_brand",
    )


def brands(tables: Tables) -> DataFrame:
    """Brand descriptions; the last brands of the list have none."""
    names = tables["part"].select("p_brand").distinct()
    return names.where(~F.col("p_brand").isin("Brand#4", "Brand#23")).select(
        F.col("p_brand").alias("brand_code"), F.concat(F.lit("Label of "), "p_brand").alias("brand_desc")
    )


def personas(tables: Tables) -> DataFrame:
    """One cluster id per card number, by market segment; some customers have none."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    position = F.array_position(F.array(*[F.lit(s) for s in segments]), F.col("c_mktsegment")) - 1
    return (
        tables["customer"]
        .where("c_acctbal NOT BETWEEN 2000 AND 2400")
        .select(F.concat(F.lit("V"), F.col("c_custkey").cast("string")).alias("vip_main_no"), position.cast("int").alias("persona"))
    )


def warehouse(tables: Tables) -> Warehouse:
    """The source tables. The sales lines are stored once, as a warehouse would hold them.

    They are written by the tasks that join them, each a piece of bounded size, without a further shuffle.
    """
    return Warehouse(
        sales=materialise(sales(tables), "sales"),
        cards=cards(tables),
        sku=sku(tables),
        maincat=maincat(tables),
        subcat=subcat(tables),
        stores=stores(tables),
        brands=brands(tables),
    )
