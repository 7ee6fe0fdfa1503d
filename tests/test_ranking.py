import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkfield.operators import ranking


def skewed_rows(n=6000, seed=3):
    """A third of the rows in one group with one score, some NULL scores."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.34
        score = 5.0 if hot else rng.choice([None, round(rng.random() * 10, 1)])
        rows.append((i, "hot" if hot else f"g{rng.randrange(50)}", score, rng.randrange(10)))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(skewed_rows(), "id long, grp string, score double, v int").repartition(7).cache()


ORDER = [("score", "desc"), ("id", "asc")]


@pytest.mark.parametrize("n_ranges", [1, 2, 7, 40])
def test_global_rank_and_sum(frame, n_ranges):
    window = Window.orderBy(F.desc_nulls_last("score"), "id")
    wanted = frame.select("id", F.row_number().over(window).alias("r"), F.sum("v").over(
        window.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = ranking.running(frame, ORDER, rank="r", sums={"s": "v"}, n_ranges=n_ranges).select("id", "r", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("n_ranges", [2, 16])
def test_rank_per_group_with_hot_group(frame, n_ranges):
    window = Window.partitionBy("grp").orderBy(F.desc_nulls_last("score"), "id")
    wanted = frame.select("id", F.row_number().over(window).alias("r"))
    got = ranking.row_numbers(frame, ORDER, "r", ["grp"], n_ranges).select("id", "r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_only_hot_groups_are_cut(frame):
    window = Window.partitionBy("grp").orderBy(F.desc_nulls_last("score"), "id")
    wanted = frame.select("id", F.row_number().over(window).alias("r"), F.lead("id").over(window).alias("n"))
    got = ranking.running(frame, ORDER, ["grp"], rank="r", hot_rows=300).select("id", "r")
    nxt = ranking.next_values(frame, ORDER, ["grp"], {"n": "id"}, hot_rows=300).select("id", "n")
    assert sorted(map(str, got.join(nxt, "id").collect())) == sorted(map(str, wanted.collect()))


def test_hot_score_is_spread_over_ranges(frame):
    ranged = ranking.range_split(frame, ORDER, n_ranges=12)
    assert ranged.n_ranges == 12 and ranged.n_rows == 6000 and max(ranged.counts.values()) < 6000 / 12 * 2.5


def test_small_frames_take_several_ranges(spark):
    """The plan of large data runs at any size."""
    df = spark.range(500).selectExpr("id", "id % 7 AS p")
    assert ranking.range_split(df, [("p", "desc"), ("id", "asc")]).n_ranges >= 4


@pytest.mark.parametrize("group", [[], ["grp"]])
@pytest.mark.parametrize("n_ranges", [1, 8])
def test_running_sums_over_nulls(frame, group, n_ranges):
    rows = frame.withColumn("w", F.when(F.col("id") % 3 == 0, F.col("v")))
    window = Window.partitionBy(*group).orderBy(F.desc_nulls_last("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    wanted = rows.select("id", F.sum("w").over(window).alias("s"))
    got = ranking.running(rows, ORDER, group, rank=None, sums={"s": "w"}, n_ranges=n_ranges).select("id", "s")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_sums_of_nulls_alone_stay_null(spark):
    df = spark.createDataFrame([(i, None) for i in range(50)] + [(50, 7)], "id long, v int")
    got = ranking.running(df, [("id", "asc")], rank=None, sums={"s": "v"}, n_ranges=5).collect()
    assert {r["id"]: r["s"] for r in got} == {**{i: None for i in range(50)}, 50: 7}


@pytest.mark.parametrize("n_ranges", [1, 9])
def test_next_values(frame, n_ranges):
    window = Window.partitionBy("grp").orderBy(F.desc_nulls_last("score"), "id")
    wanted = frame.select("id", F.lead("id").over(window).alias("n"), F.lead("v").over(window).alias("m"))
    got = ranking.next_values(frame, ORDER, ["grp"], {"n": "id", "m": "v"}, n_ranges).select("id", "n", "m")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


@pytest.mark.parametrize("rows", [20, 99, 250])
def test_quantile_buckets(spark, rows):
    df = spark.range(rows).select("id", (F.lit(0.0) + F.col("id")).alias("p"))
    got = ranking.quantile_buckets(df, [("p", "desc"), ("id", "asc")], n_ranges=4)
    wanted = {rows - 1 - k: k * 99 // rows + 1 for k in range(rows)}
    assert {r["id"]: r["bucket_value"] for r in got.collect()} == wanted


@pytest.mark.parametrize("k", [0, 1, 777, 5999, 6000, 9000])
def test_first_rows_come_in_order(frame, k):
    wanted = [r["id"] for r in frame.orderBy(F.desc_nulls_last("score"), "id").limit(k).collect()]
    for n_ranges in (1, 9):
        assert [r["id"] for r in ranking.first_rows(frame, ORDER, k, n_ranges=n_ranges).collect()] == wanted


def test_ordered_chunks_lose_nothing(frame):
    out = ranking.ordered_chunks(frame, ["grp"], [("id", "asc")], "id", "ids", chunk=300, n_ranges=6).collect()
    assert max(len(r["ids"]) for r in out) == 300
    lists = {}
    for r in sorted(out, key=lambda r: (r["grp"], r["chunk_no"])):
        lists.setdefault(r["grp"], []).extend(r["ids"])
    wanted = {}
    for r in frame.orderBy("id").collect():
        wanted.setdefault(r["grp"], []).append(r["id"])
    assert lists == wanted


def test_values_at_ranks(spark):
    df = spark.createDataFrame([(float(v),) for v in [5] * 400 + list(range(600))], "x double").repartition(5)
    wanted = sorted([5.0] * 400 + [float(v) for v in range(600)])
    got = ranking.values_at_ranks(df, "x", [1, 2, 6, 300, 406, 1000], n_ranges=7)
    assert got == {r: wanted[r - 1] for r in (1, 2, 6, 300, 406, 1000)}


def test_empty_frame(spark):
    df = spark.createDataFrame([], "id long, p double")
    assert ranking.quantile_buckets(df, [("p", "desc"), ("id", "asc")]).collect() == []
