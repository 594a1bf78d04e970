"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the sample folder, BENCH_CPUS the number of local cores. The stages run in order,
so each query is timed on the stored output of the stage before it, as in a pipeline run.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

# The first query of a stage also stores that stage's table; its time says so.
HEADLINE = [
    "master_id_fallback",
    "net_zero_orders",
    "latest_snapshot_ties",
    "enrich_lines",
    "valid_lines",
    "first_purchase",
    "item_tags",
    "count_encode_brand",
    "count_encode_tag",
    "share_of_wallet_subcat",
    "demographics",
    "transactional",
    "price_point_exact",
    "feature_matrix_join",
    "zero_share",
    "correlation_matrix",
    "kmeans_personas",
    "segment_override",
    "segment_customers",
    "segment_orders",
    "store_amount",
    "month_customers",
    "category_amount_maincat",
    "category_customers_maincat_subcat",
    "category_amount_tag",
    "repeat_histogram",
    "repeat_cohort_amount",
    "cross_class_customers",
    "cross_class_pair_sum",
    "control_totals",
]


def main() -> None:
    from segmart.registry.mart import mart
    from segmart.registry.queries import QUERIES
    from segmart.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "segmart-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    started = time.perf_counter()
    mart(spark, folder).warehouse
    preparation = time.perf_counter() - started
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "preparation_and_headline_queries_total",
                "value": round(preparation + sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "source_tables_sec": round(preparation, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
