"""Hand-written rows for the semantics that are easy to get wrong."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from segmart.constants import SEGMENT_ORDER
from segmart.functions.columns import trim_strings
from segmart.operators import cohort, cross
from segmart.operators.clean import clean_for_features, clean_for_profiling
from segmart.operators.customer import demographics, price_point, tenure, transactional, visits
from segmart.operators.encode import collect_values, count_encoding, distinct_values, one_hot, repeated_values, share_of_wallet
from segmart.operators.enrich import ValidRules, enrich, store_table, valid_lines
from segmart.operators.lines import MONEY, WHOLE_MONEY, build_lines, drop_net_zero, resolve_master
from segmart.operators.pivot import category_pivot, segment_pivot
from segmart.operators.segment import attach_segments, label_persona, override_segment
from segmart.operators.snapshot import latest_snapshot
from segmart.operators.tags import attach_tags, tag_array, tag_items

SALES_COLUMNS = [
    "region_key", "vip_no", "shop_code", "invoice_no", "item_code", "sales_date", "sold_qty", "net_amt_hkd", "net_amt",
    "item_list_price", "shop_brand", "prod_brand", "sale_lady_id", "cashier_id", "customer_nat", "cust_nat_cat",
    "customer_sex", "customer_age_group", "void_flag", "valid_tx_flag", "sales_staff_flag", "sales_type",
]


def sales(spark, *rows):
    """Text sales lines from partial dicts."""
    schema = ", ".join(f"{c} string" for c in SALES_COLUMNS)
    return spark.createDataFrame([tuple(row.get(c) for c in SALES_COLUMNS) for row in rows], schema)


def values(df, *columns):
    return sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)


def day(text):
    return dt.date.fromisoformat(text)


def test_amount_rounding_per_line(spark):
    raw = sales(spark, *[{"net_amt_hkd": a, "invoice_no": a} for a in ("12.50", "13.49", "-0.50")])
    whole = build_lines(raw, WHOLE_MONEY)
    assert sorted(int(r[0]) for r in whole.select("net_amt_hkd").collect()) == [-1, 13, 13]
    exact = build_lines(raw, MONEY)
    assert sorted(r[0] for r in exact.select("net_amt_hkd").collect()) == [Decimal("-0.50"), Decimal("12.50"), Decimal("13.49")]


def test_unreadable_numbers_become_null_and_quantities_are_cut(spark):
    lines = build_lines(sales(spark, {"sold_qty": " 12.7 ", "net_amt": "n/a", "sales_date": "2001-02-03 "}))
    row = lines.first()
    assert (row["sold_qty"], row["net_amt"], row["order_date"]) == (12, None, day("2001-02-03"))


def test_trim_keeps_types(spark):
    df = spark.createDataFrame([(" a ", 1, day("2001-01-01"))], "s string, n int, d date")
    assert trim_strings(df).dtypes == df.dtypes
    assert trim_strings(df).first()["s"] == "a"


def test_card_lookup(spark):
    raw = sales(spark, *[{"vip_no": v, "invoice_no": "1"} for v in (" A1 ", "B2", "C3", None)])
    cards = spark.createDataFrame(
        [("A1", "M1"), ("A1 ", "M1"), ("B2", None), ("C3", "M3"), ("C3", "M4")], "vip_no string, vip_main_no string"
    )
    found = values(resolve_master(build_lines(raw), cards), "vip_no", "vip_main_no")
    assert found == sorted([("A1", "M1"), ("B2", "B2"), ("C3", "M3"), ("C3", "M4"), (None, None)], key=repr)


def test_net_zero_orders(spark):
    lines = spark.createDataFrame(
        [("a", 2), ("a", -2), ("b", 1), ("c", None), (None, 3)], "sales_main_key string, sold_qty int"
    )
    assert values(drop_net_zero(lines), "sales_main_key", "sold_qty") == [("b", 1)]


def test_latest_snapshot_ties_and_nulls(spark):
    rows = [("k", "2001-01-01", 1), ("k", "2001-01-02", 2), ("k", "2001-01-02", 3), ("n", None, 4), (None, "2001-01-01", 5)]
    df = spark.createDataFrame(rows, "key string, d string, v int").withColumn("d", F.col("d").cast("date"))
    assert values(latest_snapshot(df, ["key"], "d"), "key", "v") == [("k", 2), ("k", 3)]


def test_valid_flags_under_ansi(spark):
    lines = spark.createDataFrame(
        [("1", None), ("0", None), ("Y", None), (None, None), ("1", ""), ("1", "V")], "valid_tx_flag string, void_flag string"
    )
    assert values(valid_lines(lines, ValidRules()), "valid_tx_flag", "void_flag") == [("1", None)]


def test_store_ties_collapse_in_enrichment(spark):
    stores = spark.createDataFrame(
        [("1", "Shop", "East", "2001-01-01", "HB"), ("1", "Shop", "West", "2001-01-01", "HB"), ("2", "Else", "x", "2001-01-01", "XX")],
        "shop_code string, shop_desc string, city_district string, modified_date string, shop_brand string",
    )
    store = store_table(stores, "HB")
    assert store.count() == 2
    sku = spark.createDataFrame(
        [("i", "d", "c", "s", "B", 1, 1, "l", "m")],
        "item_code string, item_desc string, item_cat string, item_sub_cat string, brand_code string, "
        "retail_price_hk int, retail_price_tw int, item_product_line_desc string, maincat_desc string",
    )
    subcat = spark.createDataFrame(
        [("B", "s", "c", "Sub")], "item_brand_key string, item_sub_cat string, item_cat string, item_subcat_desc string"
    )
    lines = spark.createDataFrame([("i", "B", "1"), ("i", "Z", "9")], "item_code string, prod_brand string, shop_code string")
    out = values(enrich(lines, sku, subcat, store), "prod_brand", "item_desc", "item_subcat_desc", "shop_desc")
    assert out == [("B", "d", "Sub", "Shop"), ("Z", None, None, None)]


def test_tag_repeats_and_capitals(spark):
    df = spark.createDataFrame([("Hydrating MOISTURE cream",), (None,), ("plain",), ("AGING",)], "item_desc string")
    tags = [r[0] for r in df.select(tag_array(F.col("item_desc"))).collect()]
    assert tags == [["MOISTURIZING", "MOISTURIZING", "MOISTURIZING", "CREAM"], [], [], []]
    once = [r[0] for r in df.select(tag_array(F.col("item_desc"), distinct_tags=True)).collect()]
    assert once[0] == ["MOISTURIZING", "CREAM"]
    lowered = [r[0] for r in df.select(tag_array(F.col("item_desc"), lower_keywords=True)).collect()]
    assert lowered[3] == ["WHITENING/REJUVENATE"]


def test_tag_fan_out(spark):
    lines = spark.createDataFrame(
        [("eye oil", "A", "x"), ("eye oil", "B", "x"), ("none", "A", "x")], "item_desc string, maincat_desc string, item_subcat_desc string"
    )
    tags = tag_items(lines)
    sold = spark.createDataFrame([("c", "eye oil", 1), ("c", "none", 1)], "vip_main_no string, item_desc string, sold_qty int")
    assert attach_tags(sold, tags).count() == 2
    assert attach_tags(sold, tags, fan_out=True).count() == 4
    kept = values(attach_tags(sold, tags, keep_untagged=True), "item_desc", "tags")
    assert kept == [("eye oil", "EYE"), ("eye oil", "OIL"), ("none", None)]


CLEAN_SCHEMA = "vip_main_no string, prod_brand string, maincat_desc string, item_subcat_desc string"


def test_two_junk_lists(spark):
    df = spark.createDataFrame([("c", "B", "ZZ", "s"), ("c", "B", "ZZZ", "s")], CLEAN_SCHEMA)
    profiled = values(clean_for_profiling(df, ["H"]), "maincat_desc_cleaned", "maincat_and_subcat")
    assert profiled == [("Unknown", "Unknown - s"), ("ZZZ", "ZZZ - s")]
    assert values(clean_for_features(df), "maincat_desc_cleaned") == [("ZZ",)]


def test_clean_up_drops_and_renames(spark):
    rows = [
        ("c", "B", "SET", "SET"), ("c", "B", "Devices, Tool & Acc.", "s"), ("", "B", "m", "s"), (None, "B", "m", "s"),
        ("c", None, "m", "s"), ("c", "JBZZZ", "m", "s"), ("c", "B", None, "s"), ("c", "B", "m", "dummy"),
    ]
    df = spark.createDataFrame(rows, CLEAN_SCHEMA)
    found = values(clean_for_features(df), "maincat_desc_cleaned", "item_subcat_desc_cleaned")
    assert found == [("Devices, Tool & Acc", "s"), ("Set", "Set")]
    profiled = clean_for_profiling(df, ["JBZZZ"])
    assert profiled.where("prod_brand IS NULL OR prod_brand = 'JBZZZ'").count() == 0
    assert profiled.where("maincat_desc IS NULL AND maincat_and_subcat IS NOT NULL").count() == 0


def segments(spark, *rows):
    return spark.createDataFrame(list(rows), "vip_main_no string, persona string, customer_tag string")


def report_lines(spark, *rows):
    schema = "vip_main_no string, cat string, net_amt_hkd int, invoice_no string, shop_code string, order_date string"
    return spark.createDataFrame(list(rows), schema).withColumn("order_date", F.col("order_date").cast("date"))


def test_unknown_categories(spark):
    s = SEGMENT_ORDER[0]
    tags = segments(spark, ("c", s, s))
    lines = report_lines(spark, *[("c", cat, amount, "i", "1", "2001-01-01") for cat, amount in ((None, 1), ("N/A", 1), ("Unknown", 5))])
    assert values(category_pivot(lines, tags, "cat", "net_amt_hkd"), "cat", s) == [("Unknown", 7)]
    assert values(category_pivot(lines, tags, "cat", "net_amt_hkd", parity=True), "cat", s) == [("Unknown", 6)]
    assert values(category_pivot(lines, tags, "cat", "vip_main_no", "distinct"), "cat", s) == [("Unknown", 1)]


def test_unseen_pivot_label_and_date_range(spark):
    s = SEGMENT_ORDER[0]
    tags = segments(spark, ("c", s, s))
    lines = report_lines(spark, ("c", "A", 2, "i", "1", "2001-01-01"), ("c", "A", 3, "i", "1", "2001-01-31"), ("c", "A", 9, "i", "1", "2001-02-01"))
    out = category_pivot(lines, tags, "cat", "net_amt_hkd", "sum", "2001-01-01", "2001-01-31", order=[s, "nobody"])
    assert values(out, "cat", s, "nobody") == [("A", 5, None)]


def test_repeat_cohort_does_not_multiply(spark):
    lines = report_lines(spark, ("c", "A", 2, "i", "1", "2001-01-01"), ("c", "A", 3, "j", "2", "2001-01-02"))
    flags = spark.createDataFrame([("c", 1)], "vip_main_no string, new_joiner_flag int")
    visited = spark.createDataFrame([("c", "S1", 2), ("c", "S2", 2)], "vip_main_no string, customer_tag string, visit long")
    assert cohort.repeat_cohort(lines, flags, visited).count() == 2


def test_orders_by_invoice_or_key(spark):
    s = SEGMENT_ORDER[0]
    tags = segments(spark, ("c", s, s))
    lines = report_lines(spark, ("c", "A", 2, "i", "1", "2001-01-01"), ("c", "A", 3, "i", "2", "2001-01-01")).withColumn(
        "sales_main_key", F.concat("shop_code", F.lit("-"), "invoice_no")
    )
    assert values(segment_pivot(lines, tags, [], "invoice_no", "distinct"), s) == [(1,)]
    assert values(segment_pivot(lines, tags, [], "sales_main_key", "distinct"), s) == [(2,)]


def test_visit_needs_a_shop(spark):
    lines = report_lines(
        spark, ("c", "A", 1, "i", "1", "2001-01-01"), ("c", "A", 1, "j", "1", "2001-01-01"), ("c", "A", 1, "k", None, "2001-01-02"), ("d", "A", 1, "k", None, "2001-01-02")
    )
    assert values(visits(lines), "vip_main_no", "visit") == [("c", 1), ("d", 0)]


def test_override_counts_listed_brands(spark):
    lines = spark.createDataFrame(
        [("one", "X"), ("one", "other"), ("two", "X"), ("two", "Y"), ("none", "other")], "vip_main_no string, prod_brand string"
    )
    personas = spark.createDataFrame([(c, "From") for c in ("one", "two", "none")] + [("one2", "Else")], "vip_main_no string, persona string")
    found = values(override_segment(lines, personas, ["X", "Y", "Z"], "From", "To"), "vip_main_no", "persona", "customer_tag")
    assert found == [("none", "From", "From"), ("one", "From", "To"), ("one2", "Else", "Else"), ("two", "From", "From")]
    moved = override_segment(lines, personas, ["X", "Y", "Z"], "From", "To")
    assert attach_segments(lines, moved).count() == lines.count()


def test_persona_labels_share_and_miss(spark):
    personas = spark.createDataFrame([("a", 3), ("b", 4), ("c", 9)], "vip_main_no string, persona int")
    found = values(label_persona(personas), "vip_main_no", "persona")
    assert found == [("a", "Personal Care Enthusiasts"), ("b", "Personal Care Enthusiasts"), ("c", None)]


def test_tenure_bands_and_unknown(spark):
    first = spark.createDataFrame(
        [("a", "2023-10-31"), ("b", "2022-05-01"), ("c", "2016-10-31"), ("d", "2016-01-01"), ("e", None)], "vip_main_no string, d string"
    ).select("vip_main_no", F.col("d").cast("date").alias("first_purchase_date"))
    found = dict(values(tenure(first, "2023-10-31"), "vip_main_no", "tenure_band"))
    assert found == {"a": "0-1", "b": "1-3", "c": "3-7", "d": "8+", "e": "8+"}


def test_demographics_of_customer_without_first_purchase(spark):
    lines = spark.createDataFrame(
        [("c", "", "Taiwan", "07"), ("c", "F", "Macau", "02")],
        "vip_main_no string, customer_sex string, cust_nat_cat string, customer_age_group string",
    )
    first = spark.createDataFrame([], "vip_main_no string, first_purchase_date date")
    row = demographics(lines, tenure(first, "2023-10-31")).first()
    assert tuple(row) == ("c", "C", "Macau", "8+", "26 - 30")


def test_new_joiner_cutoff(spark):
    first = spark.createDataFrame(
        [("a", day("2022-10-31")), ("b", day("2022-11-01")), ("c", day("2022-11-02")), ("d", None)], "vip_main_no string, first_purchase_date date"
    )
    assert values(cohort.new_joiner(first, "2022-11-01"), "vip_main_no", "new_joiner_flag") == [("a", 0), ("b", 1), ("c", 1), ("d", 0)]


def test_share_of_wallet(spark):
    lines = spark.createDataFrame(
        [("zero", "A", 5), ("zero", "B", -5), ("refund", "A", 15), ("refund", "B", -5), ("c", "A", 1), ("c", "B", 3)],
        "vip_main_no string, cat string, net_amt_hkd int",
    )
    found = values(share_of_wallet(lines, "cat", "_SOW"), "vip_main_no", "A_SOW", "B_SOW")
    assert found == [("c", 25.0, 75.0), ("refund", 150.0, -50.0), ("zero", None, None)]


def test_count_encoding_names_and_blanks(spark):
    lines = spark.createDataFrame(
        [("a", "x.y z", 2), ("a", "x.y z", 3), ("a", "`q`", 1), ("b", "", 1), ("c", None, 1)], "vip_main_no string, cat string, sold_qty int"
    )
    found = count_encoding(lines, "cat", prefix="p_")
    assert found.columns == ["vip_main_no", "p_`q`_qty", "p_x.y z_qty"]
    assert [tuple(r) for r in found.collect()] == [("a", 1, 5)]
    with pytest.raises(ValueError):
        distinct_values(lines, "cat", max_values=2)


def test_one_hot_null_sets_nothing(spark):
    df = spark.createDataFrame([("a", "M"), ("b", None)], "vip_main_no string, sex string")
    assert values(one_hot(df, {"sex": ["M", "F"]}), "vip_main_no", "sex_M", "sex_F") == [("a", True, False), ("b", False, False)]


def test_collect_values_keeps_repeats(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "y"), ("b", None)], "vip_main_no string, cat string")
    collected = collect_values(df, "cat")
    assert [(e["value"], e["lines"]) for e in collected.first()["cat"]] == [("x", 1), ("y", 2)]
    assert values(collected.withColumn("cat", repeated_values(F.col("cat"))), "vip_main_no", "cat") == [("a", ["x", "y", "y"])]


def test_price_point_borders(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (8,), (9,), (None,)], "net_amt_hkd int")
    assert [r[1] for r in price_point(df, (8, 2)).collect()] == [0, 1, 1, 1, 2, 1]


def test_transactional_zero_quantity(spark):
    lines = report_lines(spark, ("c", "A", 7, "i", "1", "2001-01-01")).withColumn("sold_qty", F.lit(0))
    row = transactional(lines, "2002-01-01", "2002-12-31").first()
    assert (row["avg_item_value"], row["visit"], row["invoice_no"]) == (None, None, 1)


def cross_lines(spark, *rows):
    return spark.createDataFrame(list(rows), "vip_main_no string, maincat_desc_cleaned string, sold_qty int")


def test_cross_class_cells_and_margins(spark):
    s = "S"
    lines = cross_lines(spark, ("1", "A", 1), ("1", "A", 2), ("1", "B", 4), ("2", "A", 8), ("3", None, 1), ("3", "Unknown", 1))
    tags = segments(spark, *[(c, s, s) for c in "123"])
    found = {(r["class_x"], r["class_y"]): r["customers"] for r in cross.cross_class(lines, tags).collect()}
    assert found == {
        ("A", "A"): 2, ("A", "B"): 1, ("B", "A"): 1, ("B", "B"): 1,
        ("A", "All"): 2, ("All", "A"): 2, ("B", "All"): 1, ("All", "B"): 1, ("All", "All"): 2,
    }
    matrix = cross.as_matrix(cross.cross_class(lines, tags), s, ["A", "B", "C"], "customers")
    assert values(matrix, "class_x", "A", "B", "C", "All") == [("A", 2, 1, 0, 2), ("All", 2, 1, 0, 2), ("B", 1, 1, 0, 1)]


def test_cross_class_sum_equals_line_pairs(spark):
    rows = [("1", "A", 1), ("1", "A", 2), ("1", "B", 4), ("2", "A", 8), ("2", "B", -3), ("2", "B", 5)]
    expected = {}
    for customer, x, v in rows:
        for other, y, w in rows:
            if customer == other:
                for key in ((x, y), (x, "All"), ("All", y), ("All", "All")):
                    expected[key] = expected.get(key, 0) + v + w
    tags = segments(spark, ("1", "S", "S"), ("2", "S", "S"))
    found = {(r["class_x"], r["class_y"]): int(r["total"]) for r in cross.cross_class_sum(cross_lines(spark, *rows), tags).collect()}
    assert found == expected


def test_cross_class_sum_of_huge_values(spark):
    big = 4_000_000_000_000_000_000
    lines = spark.createDataFrame([("1", "A", big), ("1", "B", 1), ("1", "B", 1), ("1", "B", 1)], "vip_main_no string, maincat_desc_cleaned string, sold_qty long")
    tags = segments(spark, ("1", "S", "S"))
    found = {(r["class_x"], r["class_y"]): int(r["total"]) for r in cross.cross_class_sum(lines, tags).collect()}
    assert found["A", "B"] == 3 * big + 3
    assert found["All", "All"] == 2 * 4 * (big + 3)


def test_share_of_wallet_without_with_many_and_with_unlisted_values(spark):
    lines = spark.createDataFrame(
        [("a", f"v{i}", 1.0) for i in range(3000)] + [("b", "v1", 3.0), ("b", None, 1.0)], "vip_main_no string, cat string, net_amt_hkd double"
    )
    assert share_of_wallet(lines, "cat", "_s", []).columns == ["vip_main_no"]
    assert sorted(r[0] for r in share_of_wallet(lines, "cat", "_s", []).collect()) == ["a", "b"]
    wide = {r["vip_main_no"]: r for r in share_of_wallet(lines, "cat", "_s").collect()}
    assert len(wide["a"]) == 3001 and abs(wide["a"]["v7_s"] - 100 / 3000) < 1e-9
    # The total is over all rows, listed or not, named or not.
    few = {r["vip_main_no"]: r["v1_s"] for r in share_of_wallet(lines, "cat", "_s", ["v1"]).collect()}
    assert abs(few["a"] - 100 / 3000) < 1e-9 and few["b"] == 75.0
