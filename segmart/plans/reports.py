"""Stages 5 to 8: segment profiles, new joiners, cross-class matrices, lists.

``lines`` are profiling-clean sales lines, ``segments`` one row per customer with persona and
segment. Every report is lazy and reads just the columns it needs of both stored tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.constants import AGE_LABELS, SEGMENT_ORDER, UNKNOWN_SEX
from segmart.functions.columns import between_dates, named, normalised_sex, relabel, year_month
from segmart.operators import cohort, cross, distinct_states
from segmart.operators.customer import nationality_group, tenure, visits
from segmart.operators.encode import CUSTOMER
from segmart.operators.pivot import DISTINCT, SUM, attribute_pivot, category_pivot, segment_pivot, spread
from segmart.operators.skew import lookup_join
from segmart.operators.segment import SEGMENT, attach_segments, label_persona, override_segment
from segmart.operators.clean import clean_for_profiling
from segmart.operators.tags import attach_tags
from segmart.session import materialise

AMOUNT, QUANTITY = "net_amt_hkd", "sold_qty"
MEASURES = {"amount": (AMOUNT, SUM), "qty": (QUANTITY, SUM), "customers": (CUSTOMER, DISTINCT)}


@dataclass(frozen=True)
class ReportSettings:
    start_date: str
    end_date: str
    as_of: str
    new_joiner_cutoff: str
    listed_brands: Sequence[str] = ()
    excluded_brands: Sequence[str] = ()
    order: Sequence[str] = field(default_factory=lambda: list(SEGMENT_ORDER))


@dataclass(frozen=True)
class SegmentReports:
    lines: DataFrame
    segments: DataFrame
    personas: DataFrame
    first_purchase: DataFrame
    item_tags: DataFrame
    settings: ReportSettings

    @classmethod
    def prepare(
        cls,
        transaction: DataFrame,
        persona: DataFrame,
        first_purchase: DataFrame,
        item_tags: DataFrame,
        settings: ReportSettings,
    ) -> SegmentReports:
        """Label, clean and decide the segments once; the segments are stored for all reports."""
        lines = clean_for_profiling(transaction, settings.excluded_brands)
        personas = label_persona(persona)
        segments = materialise(override_segment(lines, personas, settings.listed_brands), "segments")
        return cls(lines, segments, personas, first_purchase, item_tags, settings)

    # Totals and demographics

    def in_window(self) -> DataFrame:
        return self.lines.where(
            between_dates(F.col("order_date"), self.settings.start_date, self.settings.end_date)
        )

    def customers(self) -> DataFrame:
        return self._pivot(self.lines, [], CUSTOMER, DISTINCT)

    def gender(self) -> DataFrame:
        sex = F.min(normalised_sex(F.col("customer_sex"), False, UNKNOWN_SEX))
        return self._by_attribute("customer_sex_new", sex)

    def nationality(self) -> DataFrame:
        return self._by_attribute("cust_nat_cat_new", F.min(nationality_group(F.col("cust_nat_cat"))))

    def region(self) -> DataFrame:
        return self._by_attribute("region_key", F.min("region_key"))

    def age(self) -> DataFrame:
        """Codes are counted first and relabelled after; codes without a label add up under null."""
        counted = self._by_attribute("customer_age_group", F.max("customer_age_group"))
        label = relabel(F.col("customer_age_group"), AGE_LABELS, F.lit(None).cast("string")).alias("age")
        return counted.groupBy(label).agg(*[F.sum(named(s)).alias(s) for s in self.settings.order])

    def tenure(self) -> DataFrame:
        """By the persona before the override; customers of the first-purchase table."""
        bands = (
            tenure(self.first_purchase, self.settings.as_of)
            .groupBy(CUSTOMER)
            .agg(F.max("tenure_band").alias("tenure"))
        )
        return attribute_pivot(bands, self.personas, "tenure", self.settings.order, "persona")

    def amount(self) -> DataFrame:
        return self._pivot(self.in_window(), [], AMOUNT, SUM)

    def qty(self) -> DataFrame:
        return self._pivot(self.in_window(), [], QUANTITY, SUM)

    def orders(self, order_key: str = "invoice_no") -> DataFrame:
        return self._pivot(self.in_window(), [], order_key, DISTINCT)

    def order_states(self, order_key: str = "invoice_no") -> DataFrame:
        """The orders of every segment and month (yyyyMM) as bitmaps, stored: counts of any months are found from them.

        Lines are made distinct per customer, month and order before the segment join.
        """
        dated = self.lines.select(CUSTOMER, order_key, year_month(F.col("order_date")).alias("yyyymm"))
        orders = dated.where(named(order_key).isNotNull()).distinct()
        tagged = lookup_join(orders, self.segments.select(CUSTOMER, SEGMENT).distinct(), [CUSTOMER], "inner")
        tagged = materialise(tagged.select(SEGMENT, "yyyymm", order_key).distinct(), "segment_orders")
        ids = distinct_states.value_ids(tagged, order_key, "yyyymm")
        return materialise(distinct_states.distinct_states(tagged, ids, [SEGMENT, "yyyymm"], order_key), "order_states")

    def visits(self) -> DataFrame:
        per_customer = visits(self.lines, self.settings.start_date, self.settings.end_date)
        return segment_pivot(per_customer, self.segments, [], "visit", SUM, self.settings.order)

    # Stores, months, categories

    def store(self, measure: str) -> DataFrame:
        return self._pivot(self.in_window(), ["shop_desc"], *MEASURES[measure])

    def month(self, measure: str) -> DataFrame:
        """Over all lines given, without the date range."""
        dated = self.lines.withColumn("yyyymm", year_month(F.col("order_date")))
        return self._pivot(dated, ["yyyymm"], *MEASURES[measure])

    def category(self, by: str, measure: str, parity: bool = False) -> DataFrame:
        column, how = MEASURES[measure]
        return category_pivot(self.in_window(), self.segments, by, column, how, order=self.settings.order, parity=parity)

    def tag(self, measure: str, fan_out: bool = False, parity: bool = False) -> DataFrame:
        """By item tag. Lines are summed up per item before the tags multiply them."""
        column, how = MEASURES[measure]
        keys = [CUSTOMER, "item_desc"]
        if how == SUM:
            per_item = self.in_window().groupBy(*keys).agg(F.sum(column).alias(column))
        else:
            per_item = self.in_window().select(*keys).distinct()
        tagged = attach_tags(per_item, self.item_tags, fan_out=fan_out, keep_untagged=True)
        return category_pivot(tagged, self.segments, "tags", column, how, order=self.settings.order, parity=parity)

    # New joiners

    def new_joiners(self) -> DataFrame:
        return cohort.new_joiner(self.first_purchase, self.settings.new_joiner_cutoff)

    def segment_visits(self) -> DataFrame:
        return cohort.segment_visits(self.lines, self.segments, self.settings.start_date, self.settings.end_date)

    def repeat_histogram(self) -> DataFrame:
        joined = self.new_joiners().where("new_joiner_flag = 1")
        return cohort.repeat_histogram(self.segment_visits(), joined, self.settings.order)

    def new_vs_existing(self) -> DataFrame:
        return attribute_pivot(
            self.new_joiners(), self.personas, "new_joiner_flag", self.settings.order, "persona"
        )

    def persona_visits(self, persona: str) -> DataFrame:
        """Visit histogram of one persona, before the override; not only new joiners."""
        chosen = self.personas.where(F.col("persona") == persona).select(CUSTOMER, F.col("persona").alias(SEGMENT))
        known = self.first_purchase.select(CUSTOMER)
        visited = self.segment_visits().select(CUSTOMER, "visit").join(known, CUSTOMER, "left_semi").distinct()
        counted = visited.join(chosen, CUSTOMER).groupBy("visit", SEGMENT)
        return spread(counted.agg(F.count_distinct(CUSTOMER).alias("value")), ["visit"], [persona])

    def repeat_segments(self) -> DataFrame:
        """Segments of the new joiners who came back: reports over them need no join of the lines."""
        repeaters = cohort.repeat_customers(self.new_joiners(), self.segment_visits())
        return self.segments.join(repeaters, CUSTOMER, "left_semi")

    def repeat_lines(self) -> DataFrame:
        """The segmented lines of the new joiners who came back."""
        return attach_segments(self.lines, self.repeat_segments())

    def repeat_customers(self) -> DataFrame:
        return segment_pivot(self.lines, self.repeat_segments(), [], CUSTOMER, DISTINCT, self.settings.order)

    def repeat_amount(self) -> DataFrame:
        return segment_pivot(self.lines, self.repeat_segments(), [], AMOUNT, SUM, self.settings.order)

    def repeat_category(self, order: Sequence[str] | None = None) -> DataFrame:
        return category_pivot(
            self.in_window(), self.repeat_segments(), "maincat_and_subcat", AMOUNT, SUM, order=order or self.settings.order
        )

    # Cross-class

    def cross_class(self, cls: str = "maincat_desc_cleaned") -> DataFrame:
        return cross.cross_class(self.lines, self.segments, cls)

    def cross_class_sum(self, values: str = QUANTITY, cls: str = "maincat_desc_cleaned") -> DataFrame:
        return cross.cross_class_sum(self.lines, self.segments, values, cls)

    def _pivot(self, lines: DataFrame, by: Sequence[str], measure: str, how: str) -> DataFrame:
        return segment_pivot(lines, self.segments, by, measure, how, self.settings.order)

    def _by_attribute(self, name: str, summary: Column) -> DataFrame:
        attributes = self.lines.groupBy(CUSTOMER).agg(summary.alias(name))
        return attribute_pivot(attributes, self.segments, name, self.settings.order)
