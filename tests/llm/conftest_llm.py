"""Small helpers of these tests."""


def edge_rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def empty(df):
    return df.where("false")
