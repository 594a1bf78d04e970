"""Sales lines: typed columns, master customer, net-zero orders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import lenient_cast, named, trim_strings
from segmart.operators import skew
from segmart.operators.skew import FANOUT, lookup_join, spread_join
from segmart.session import materialise

MONEY = "decimal(18,2)"
# The rounding of the original reports: whole currency units per line.
WHOLE_MONEY = "decimal(10,0)"
ORDER_KEY = "sales_main_key"
# Hashes of repeated lines that are broadcast, 8 bytes each; with more of them all lines are compared.
MAX_REPEATED = 500_000
_HASH = "__line_hash"
# What tells the lines of one order apart.
LINE_FACTS = ("vip_no", "item_code", "order_date", "sold_qty", "net_amt_hkd")

CARRIED = [
    "region_key",
    "vip_no",
    "shop_code",
    "invoice_no",
    "item_code",
    "shop_brand",
    "prod_brand",
    "sale_lady_id",
    "cashier_id",
    "customer_nat",
    "cust_nat_cat",
    "customer_sex",
    "customer_age_group",
    "void_flag",
    "valid_tx_flag",
    "sales_staff_flag",
    "sales_type",
]


def typed_lines(sales: DataFrame, money_type: str = MONEY) -> DataFrame:
    """Sales lines with trimmed text, typed date, quantity and amounts, and the order key."""
    return with_order_key(typed_columns(sales, money_type))


def with_order_key(lines: DataFrame) -> DataFrame:
    return lines.withColumn(ORDER_KEY, F.concat("shop_code", F.lit("-"), "invoice_no"))


def typed_columns(sales: DataFrame, money_type: str = MONEY) -> DataFrame:
    """The typed lines without the order key, which need not move where all lines do."""
    trimmed = trim_strings(sales)
    return trimmed.select(
        *[named(c) for c in CARRIED],
        lenient_cast(trimmed, "sales_date", "date").alias("order_date"),
        lenient_cast(trimmed, "sold_qty", "int").alias("sold_qty"),
        *[
            lenient_cast(trimmed, amount, money_type).alias(amount)
            for amount in ("net_amt_hkd", "net_amt", "item_list_price")
        ],
    )


def build_lines(sales: DataFrame, money_type: str = MONEY) -> DataFrame:
    """The distinct typed lines."""
    return distinct_lines(typed_lines(sales, money_type))


def distinct_lines(lines: DataFrame, max_repeated: int | None = None) -> DataFrame:
    """The distinct rows of wide ``lines``, which move only if very many of them are repeated.

    Only hashes of whole rows are shuffled and counted. Rows whose hash occurs once are different from all others;
    the others, equal rows and rare collisions, are compared in full. Nulls and zeros of either sign are
    equal here as in a plain distinct: a hash may at most take different rows together.
    """
    hashed = lines.withColumn(_HASH, F.xxhash64(*[named(c) for c in lines.columns]))
    # Nearly all hashes differ, so they are not combined before their shuffle.
    counted = hashed.select(_HASH).repartition(_HASH).groupBy(_HASH).agg(F.count(F.lit(1)).alias("n"))
    repeated = materialise(counted.where("n > 1").select(_HASH), "repeated")
    found = repeated.count()
    if found == 0:
        return lines
    if found > (MAX_REPEATED if max_repeated is None else max_repeated):
        return lines.distinct()
    repeated = F.broadcast(repeated)
    once = hashed.join(repeated, _HASH, "left_anti").drop(_HASH)
    return once.unionByName(hashed.join(repeated, _HASH, "left_semi").drop(_HASH).distinct())


def _shop_of_order():
    return F.substring_index(ORDER_KEY, "-", 1).alias("__shop")


def shops_in_scope(lines: DataFrame, in_scope: Column) -> DataFrame:
    """The shops with a line in scope, as the text of the order key up to its first dash."""
    return lines.where(in_scope).select(_shop_of_order()).distinct()


def lines_near(lines: DataFrame, shops: DataFrame) -> DataFrame:
    """The lines that may share an order with a line in scope.

    Orders are judged by all their lines, but only orders with a line in scope matter. An order key
    starts with its shop, so the lines of other shops can go before the distinct and the order
    totals. Equal order keys agree up to the first dash whatever the codes look like.
    """
    return lookup_join(lines.select("*", _shop_of_order()), shops, ["__shop"], "left_semi").drop("__shop")


def card_masters(cards: DataFrame) -> DataFrame:
    """Distinct (card, master customer) pairs of the cards that have a master."""
    pairs = trim_strings(cards.select("vip_no", "vip_main_no"))
    return pairs.where(F.col("vip_main_no").isNotNull()).distinct()


def resolve_master(
    lines: DataFrame,
    cards: DataFrame,
    hot: Mapping[int, int] | None = None,
) -> DataFrame:
    """Add ``vip_main_no``; a card without a master stands for itself, one with two gives two lines."""
    joined = lookup_join(lines, card_masters(cards), ["vip_no"], "left", hot)
    return joined.withColumn("vip_main_no", F.coalesce("vip_main_no", "vip_no"))


def drop_net_zero(
    lines: DataFrame,
    order_key: str = ORDER_KEY,
    qty: str = "sold_qty",
    rows_per_task: int | None = None,
    judged_by: DataFrame | None = None,
) -> DataFrame:
    """Drop the orders whose total quantity over all given lines is zero or unknown.

    With ``judged_by`` the totals are over its lines, of which ``lines`` are some.

    The totals are combined before the shuffle and joined back, so one huge order is never gathered
    in a single task as a window over the order would do. The totals also count the lines, which
    tells the join which orders to spread. Sales lines are spread by their facts, so that no other
    column is read or shuffled for it.
    """
    tasks = F.ceil(F.count(F.lit(1)) / F.lit(rows_per_task or skew.ROWS_PER_TASK)).cast("int")
    totals = (lines if judged_by is None else judged_by).groupBy(order_key).agg(F.sum(qty).alias("__total"), tasks.alias(FANOUT))
    kept = totals.where("__total != 0").select(order_key, FANOUT)
    facts = LINE_FACTS if set(LINE_FACTS) <= set(lines.columns) else None
    return spread_join(lines, kept, [order_key], "left_semi", kept.where(F.col(FANOUT) > 1), [order_key], facts)
