"""Work on shapes is spread over all cores and done once."""

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from larkfield.operators import joins
from larkfield.spatial import cell_join, grid, thinning, wkt


def test_rows_of_a_small_file_are_dealt_to_all_cores(spark):
    """One input task must not read all geometry text, also where rows are equal."""
    cores = spark.sparkContext.defaultParallelism
    for texts in ([f"POINT ({i} 1)" for i in range(400)], ["POINT (1 1)"] * 400):
        one_task = spark.createDataFrame([(t,) for t in texts], "wkt string").coalesce(1)
        rows = wkt.read_geometry(one_task, "wkt").select("wkt", F.spark_partition_id().alias("task")).collect()
        assert sorted(r["wkt"] for r in rows) == sorted(texts)
        sizes = [sum(r["task"] == t for r in rows) for t in {r["task"] for r in rows}]
        assert len(sizes) >= cores and max(sizes) <= 2 * 400 / len(sizes)


def test_a_computed_shape_is_computed_once_for_text_and_bounds(spark):
    df = spark.createDataFrame([("LINESTRING (1 2, 3 5)",)], "wkt string")
    alone = df.select(wkt.parse_wkt(F.col("wkt")).alias("v"))
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString()
    for use in (wkt.to_wkt, wkt.mbr):
        used = df.select(use(wkt.parse_wkt(F.col("wkt"))).alias("v"))
        assert plan(used).count("regexp_extract(") == plan(alone).count("regexp_extract(") > 0
    assert df.select(wkt.to_wkt(wkt.parse_wkt(F.col("wkt")))).first()[0] == "LINESTRING (1 2, 3 5)"
    assert tuple(df.select(wkt.mbr(wkt.parse_wkt(F.col("wkt")))).first()[0]) == (1.0, 2.0, 3.0, 5.0)


def test_few_corners_are_measured_without_arrays(monkeypatch):
    rng = np.random.default_rng(3)
    lines = [rng.integers(0, 64, (300, 2)) / 64.0, np.cumsum(rng.normal(size=(300, 2)), 0)]
    calls, real = [], np.hypot
    monkeypatch.setattr(thinning.np, "hypot", lambda *a: calls.append(1) or real(*a))
    found = [thinning.kept_corners([line], False, t)[0] for line in lines for t in (0.05, 0.25)]
    assert len(calls) < 100  # an array for every corner would be over 1,000
    monkeypatch.setattr(thinning, "_SHORT", 0)
    arrays = [thinning.kept_corners([line], False, t)[0] for line in lines for t in (0.05, 0.25)]
    assert [k.tolist() for k in found] == [k.tolist() for k in arrays]
    assert len(calls) > 1000


def test_exact_join_counts_rows_repeated_for_blocks(spark):
    loads = spark.createDataFrame([(0, 1, 1, 10_000, 4_000), (0, 2, 1, 30, 50)], "level int, ix int, iy int, na long, nb long")
    hot, rows = cell_join._blocks(loads, 4_000_000)
    assert [tuple(r) for r in hot.collect()] == [(0, 1, 1, 5, 2)]
    assert [r[0] for r in loads.orderBy("ix").select(rows).collect()] == [10_000 * 2 + 4_000 * 5, 80]


def test_exact_join_travels_without_the_package():
    sent = cloudpickle.dumps(cell_join._joined(grid.Grid(0.0, 0.0, 1.0, 1.0, 4, 4), "a_id", "b_id"))
    assert b"larkfield.spatial.grid" not in sent


def _boxes(spark, n, seed, size):
    rng = np.random.default_rng(seed)
    rows = [(i, float(x), float(y), float(x + size), float(y + size)) for i, (x, y) in enumerate(rng.uniform(0, 3.7, (n, 2)))]
    return spark.createDataFrame(rows, "id long, xmin double, ymin double, xmax double, ymax double").coalesce(1), rows


def _met(a, b):
    return sorted((i, j) for i, *p in a for j, *q in b if p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1])


@pytest.mark.parametrize("limits", [{}, {"crowded_pairs": 200, "salt_rows": 40}])
def test_boxes_of_one_size_meet_by_runs_in_full_cells(spark, monkeypatch, limits):
    """From a file of one task the boxes are dealt to all cores before their cells are listed."""
    monkeypatch.setattr(grid, "RUN_BOXES", 8)
    monkeypatch.setattr(grid, "RUNS_PER_BOX", 1)
    (left, a), (right, b) = _boxes(spark, 300, 1, 0.3), _boxes(spark, 400, 2, 0.4)
    listed, runs, loads, pairs = [], [], grid._cell_loads, grid._run_pairs
    monkeypatch.setattr(grid, "_cell_loads", lambda *sides: listed.extend(s.rdd.getNumPartitions() for s in sides) or loads(*sides))
    monkeypatch.setattr(grid, "_run_pairs", lambda *args: runs.append(1) or pairs(*args))
    out = grid.box_join(left, right, grid.Grid(0.0, 0.0, 4.0, 4.0, 3, 3), "id", "id", **limits)
    assert sorted((r["a_id"], r["b_id"]) for r in out.collect()) == _met(a, b)
    assert runs and min(listed) >= spark.sparkContext.defaultParallelism


def test_runs_lie_close_together_and_know_their_box(spark):
    boxes, rows = _boxes(spark, 4000, 3, 0.1)
    at_odds = [(4000, float("nan"), 1.0, 1.0, 1.0), (4001, 1.0, 1.0, float("nan"), 1.0)]
    boxes = boxes.union(spark.createDataFrame(at_odds, boxes.schema)).select("id", *[F.col(c).alias(f"b_{c}") for c in grid.BOX]).withColumnRenamed("id", "b_id")
    for keys in (["cell_id"], ["cell_id", "sub_id"]):
        found = grid._in_runs(boxes.withColumns({k: F.lit(0) for k in keys}).coalesce(1), "b", keys).collect()
        assert sorted(i["b_id"] for r in found for i in r["items"]) == list(range(4002))
        assert max(len(r["items"]) for r in found) <= grid.RUN_BOXES and len(found) < 100
        whole = [r for r in found if r["_xmax"] == r["_xmax"]]
        for r in whole:
            low = [i for i in r["items"] if i["b_xmin"] == i["b_xmin"]]
            assert r["_xmin"] <= min(i["b_xmin"] for i in low) and r["_xmax"] >= max(i["b_xmax"] for i in low)
            assert r["_ymin"] <= min(i["b_ymin"] for i in low) and r["_ymax"] >= max(i["b_ymax"] for i in low)
        area = [(r["_xmax"] - r["_xmin"]) * (r["_ymax"] - r["_ymin"]) for r in whole]
        assert len(whole) == len(found) - 1 and np.median(area) < 0.1 * 3.8 * 3.8
        assert max(max(r["_xmax"] - r["_xmin"], r["_ymax"] - r["_ymin"]) for r in sorted(whole, key=lambda r: -len(r["items"]))[:20]) < 3.8 / 2


def test_keys_of_one_part_are_not_salted(spark):
    left = spark.range(30).selectExpr("id % 3 AS k", "id AS a")
    right = spark.range(30).selectExpr("id % 3 AS k", "id AS b")
    hot = spark.createDataFrame([(0, 10, 10), (1, 10, 10)], "k long, _left long, _right long")
    plain, salted = (joins.salted_join(left, right, ["k"], None, hot, n) for n in (10, 4))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "_ls" not in plan(plain) and "_ls" in plan(salted)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect())) and plain.count() == 300
