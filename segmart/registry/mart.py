"""The stages over one set of sample tables, each stored once per session as a pipeline run would."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from segmart.operators import model, sparse
from segmart.operators.cards import first_purchase
from segmart.operators.clean import clean_for_features
from segmart.operators.customer import transactional
from segmart.operators.tags import tag_items
from segmart.plans.datamart import Lookups, Warehouse, current_lookups, transactions
from segmart.plans.features import feature_values, purchase_totals
from segmart.plans.personas import PersonaResult, build_personas
from segmart.plans.reports import SegmentReports
from segmart.session import materialise
from segmart.sources import retail

class Mart:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.tables = retail.load(spark, folder)

    @cached_property
    def warehouse(self) -> Warehouse:
        return retail.warehouse(self.tables)

    @cached_property
    def lookups(self) -> Lookups:
        return current_lookups(self.warehouse, retail.DATAMART)

    @cached_property
    def transaction(self) -> DataFrame:
        return materialise(transactions(self.warehouse, self.lookups, retail.DATAMART), "transaction")

    @cached_property
    def first_purchase(self) -> DataFrame:
        source = self.warehouse
        return materialise(first_purchase(source.sales, source.cards, retail.HOUSE_BRAND), "first_purchase")

    @cached_property
    def item_tags(self) -> DataFrame:
        return materialise(tag_items(self.transaction), "item_tags")

    @cached_property
    def clean(self) -> DataFrame:
        return clean_for_features(self.transaction)

    @cached_property
    def totals(self) -> DataFrame:
        return materialise(purchase_totals(self.clean), "purchase_totals")

    @cached_property
    def spending(self) -> DataFrame:
        return materialise(transactional(self.clean, *retail.WINDOW), "spending")

    @cached_property
    def reports(self) -> SegmentReports:
        return SegmentReports.prepare(
            self.transaction, retail.personas(self.tables), self.first_purchase, self.item_tags, retail.REPORTS
        )

    @cached_property
    def order_states(self) -> DataFrame:
        return self.reports.order_states()

    @cached_property
    def values(self) -> DataFrame:
        return materialise(feature_values(self.totals, self.item_tags), "customer_values")

    @cached_property
    def features(self) -> DataFrame:
        return materialise(sparse.customer_features(self.values), "customer_features")

    @cached_property
    def dictionary(self) -> DataFrame:
        return materialise(sparse.feature_dictionary(self.features), "feature_dictionary")

    @cached_property
    def matrix(self) -> DataFrame:
        """All features of the samples as columns, stored."""
        names = [row["feature"] for row in self.dictionary.orderBy("position").collect()]
        return materialise(sparse.wide_features(self.features, names), "feature_matrix")

    @cached_property
    def result(self) -> PersonaResult:
        """Stage 4 as a whole: selection, factors, the selected features, k-means."""
        return build_personas({"customer_features": self.features})

    @cached_property
    def curve(self) -> DataFrame:
        return materialise(model.wcss_curve(self.result.vectors), "wcss_curve")


_marts: dict[tuple[str, str], Mart] = {}


def mart(spark: SparkSession, folder: str) -> Mart:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _marts:
        _marts[key] = Mart(spark, folder)
    return _marts[key]
