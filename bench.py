"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. ``BENCH_NAIVE=1`` also times
the plain plan beside the scale-critical operators.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkfield.plans.catalog import QUERIES
from larkfield.plans.queries_metrics import scored
from larkfield.plans.queries_relational import STOP_TIE, _stops
from larkfield.plans.queries_spatial import a_points, b_points
from larkfield.plans.registry import Tables
from larkfield.session import local_session

HEADLINE = [
    "bucket_table", "bucket_99", "global_row_number", "row_number_per_group", "cumulative_gain", "lift_table",
    "hit_rate_at_t", "roc_curve", "auc_rank", "best_f1_threshold", "top_k_by_score", "grid_spatial_join",
    "tessellate_cells", "fuzzy_nearest_join", "multi_batch_window_join", "skewed_join", "lead_pairs", "route_totals",
    "collect_ordered", "skew_report", "partition_max", "sparse_triplets", "quantile_bin", "clean_features",
    "interaction_features", "wide_to_long", "staged_bulk_load", "area_km2", "polygon_join_exact", "parse_wkt", "pu_relabel_rule",
]


def naive_plans(t: Tables) -> dict:
    """What one would write first: global windows and an all-pairs condition."""
    best_first = Window.orderBy(F.desc("o_totalprice"), "o_orderkey")

    def rank():
        return t.orders.select("o_orderkey", F.row_number().over(best_first).alias("rnk"))

    def gain():
        s = scored(t)
        order = Window.orderBy(F.desc("p"), "id").rowsBetween(Window.unboundedPreceding, 0)
        return s.select(F.row_number().over(Window.orderBy(F.desc("p"), "id")).alias("rn"), F.sum("y").over(order).alias("hits"))

    def lead():
        w = Window.partitionBy("route").orderBy("pt", *STOP_TIE)
        return _stops(t).select("route", "pt", F.lead("pt").over(w).alias("next_pt"))

    def boxes():
        a, b = a_points(t).alias("a"), b_points(t).alias("b")
        near = (F.abs(F.col("a.x") - F.col("b.x")) <= 0.375) & (F.abs(F.col("a.y") - F.col("b.y")) <= 0.375)
        return a.join(b, near).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))

    return {"global_row_number": rank, "cumulative_gain": gain, "lead_pairs": lead, "grid_spatial_join": boxes}


def seconds(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    seconds(lambda: QUERIES["value_counts"](spark, folder))  # start-up is not part of any query
    times = {name: seconds(lambda name=name: QUERIES[name](spark, folder)) for name in HEADLINE}
    result = {"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
              "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    if os.environ.get("BENCH_NAIVE"):
        result["naive"] = {n: seconds(make) for n, make in naive_plans(Tables(spark, folder)).items()}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
