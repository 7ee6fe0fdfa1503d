import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkfield.operators import aggregates, joins, matching, reshape, sampling
from larkfield.plans import extracts


def test_salted_join_hot_on_both_sides(spark):
    rng = random.Random(1)
    left = [(i, 0 if i % 3 == 0 else rng.randrange(1, 30)) for i in range(900)]
    right = [(i, 0 if i % 3 == 0 else rng.randrange(1, 30)) for i in range(300)]
    a = spark.createDataFrame(left, "a long, k int").repartition(5)
    b = spark.createDataFrame(right, "b long, k int").repartition(3)
    wanted = sorted((x, y) for x, k in left for y, m in right if k == m)
    got = joins.salted_join(a, b, ["k"], min_rows=40).select("a", "b")
    assert sorted(map(tuple, got.collect())) == wanted
    assert [tuple(r) for r in joins.hot_keys(a, ["k"], 40).collect()] == [(0, 300)]


def test_every_hot_key_is_split(spark):
    """Three thousand hot keys, none left whole for being too many."""
    a = spark.range(30_000).selectExpr("id % 3000 AS k", "id AS a")
    b = spark.range(3000).selectExpr("id AS k", "id * 2 AS b")
    assert joins.hot_keys(a, ["k"], 5).count() == 3000
    joined = joins.salted_join(a, b, ["k"], min_rows=5)
    assert joined.selectExpr("count(*)", "count_if(b = k * 2)", "count(DISTINCT a)").first()[:] == (30_000, 30_000, 30_000)


def test_bound_columns_need_every_key_once(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    ok = joins.bind_columns(a, spark.createDataFrame([(2, 0.2), (1, 0.1)], "id long, p double"), "id")
    assert sorted(map(tuple, ok.collect())) == [(1, "x", 0.1), (2, "y", 0.2)]
    for rows in ([(1, 0.1)], [(1, 0.1), (2, 0.2), (2, 0.3)], [(1, 0.1), (2, 0.2), (3, 0.3)], [(1, 0.1), (None, 0.2)]):
        with pytest.raises(ValueError):
            joins.bind_columns(a, spark.createDataFrame(rows, "id long, p double"), "id")


def test_range_join_shared_bound(spark):
    zones = spark.createDataFrame([(1, 0.0, 6.0), (2, 6.0, 12.0), (3, 20.0, 40.0)], "z int, lo double, hi double")
    points = spark.createDataFrame([(1, 6.0), (2, 3.0), (3, 15.0), (4, 40.0)], "id int, x double")
    got = joins.range_join(points, "x", zones, "lo", "hi", 6.0)
    assert sorted((r["id"], r["z"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (4, 3)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + row[1:], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed, letters, longest, limit", [(1, "abcdef", 12, 8), (2, "ab", 9, 4), (3, "абвгдежзиклмнопрст", 16, 8)])
def test_nearest_text_equals_brute_force(spark, seed, letters, longest, limit):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(0, longest)))
    left, right = [word() for _ in range(60)] + ["", "zz", "yyyyyyy"], [word() for _ in range(25)] + ["q" * 9, ""]
    got = matching.nearest_texts(spark.createDataFrame([(w,) for w in left], "a string"), "a",
                                 spark.createDataFrame([(w,) for w in right], "b string"), "b", limit)
    wanted = {}
    for a in set(left):
        d, b = min((distance(a, b), b) for b in right if b)
        wanted[a] = (b, d) if a and d < limit else ("", None)
    rows = got.collect()
    assert len(rows) == len(wanted)
    assert {r["a"]: (r["match"], r["d"]) for r in rows} == wanted


def test_overrides_come_first(spark):
    df = spark.createDataFrame([(" ТПК",), ("Кольцевая лини",), ("",)], "c string")
    names = spark.createDataFrame([("Кольцевая линия",), ("Большая кольцевая линия",)], "n string")
    got = {r["c"]: r["o"] for r in matching.fuzzy_replace(df, "c", names, "n", "o").collect()}
    assert got == {" ТПК": "Большая кольцевая линия", "Кольцевая лини": "Кольцевая линия", "": ""}


def test_impute_by_difference(spark):
    rows = spark.createDataFrame([("A", "red"), ("A", ""), ("B", ""), ("C", ""), ("D", "red"), ("D", "")], "st string, line string")
    known = spark.createDataFrame([("A", "red"), ("A", "blue"), ("B", "green"), ("D", "red")], "s string, l string")
    got = sorted((r["st"], r["line"] or "none") for r in matching.impute_by_difference(rows, "st", "line", known, "s", "l").collect())
    assert got == [("A", "blue"), ("A", "red"), ("B", "green"), ("C", "none"), ("D", "none"), ("D", "red")]


def test_edges(spark):
    stations = spark.createDataFrame([(1, "A_x", 1), (2, "B", 1), (3, "B", 2)], "id int, name string, line int")
    got = matching.build_edges(spark.createDataFrame([(1, 2), (2, 3)], "station1 int, station2 int"), stations)
    assert sorted((r["name1"], r["name2"], r["kind"]) for r in got.collect()) == [("A_x", "B", "1"), ("B", "B", "transfer")]


def test_route_totals(spark):
    legs = spark.createDataFrame([(1, 0, 600, 10.0, 5), (1, 1, 1200, 20.0, 2), (1, 2, 1800, 5.0, 1), (2, 0, 3600, 7.0, 9)],
                                 "route int, pt int, dur int, dist double, cond int")
    got = {r["route"]: r for r in aggregates.route_totals(legs, "route", "pt", "dur", "dist", "cond").collect()}
    # The first stop does not wait; the last leg is the way back.
    assert got[1]["duration"] == pytest.approx((3600 + 3 * 1800) / 3600)
    assert (got[1]["distance"], got[1]["proper_distance"]) == (35.0, 30.0)
    assert (got[2]["duration"], got[2]["proper_distance"]) == (1.0, 0.0)


def test_skew_report_guards_empty_tables(spark):
    gb = 1024 ** 3
    df = spark.createDataFrame([("t", 0, gb), ("t", 1, 3 * gb), ("u", 0, 0), ("u", 1, 0)], "tab string, unit int, size long")
    got = {r["tab"]: r for r in aggregates.skew_report(df, ["tab"], "unit", "size", 2).collect()}
    assert [float(got["t"][c]) for c in ("current", "skewed", "wasted", "skew_factor", "skew_percent")] == [4, 6, 2, 1.5, 33]
    assert got["t"]["skew_unit"] == 1 and got["u"]["skew_factor"] is None


def test_group_mean_null_policy(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in aggregates.group_mean(df, ["g"], "v", "m", "all").collect()}
    assert got == {"a": None, "b": 3.0}


def test_wide_to_long_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 5, None)], "id int, age int, lifetime double")
    got = sorted((r["var_name"], r["var_value"] or "-") for r in reshape.wide_to_long(df, ["id"], ["age", "lifetime"]).collect())
    assert got == [("age", "5"), ("lifetime", "-")]


def usage(spark, rows):
    return spark.createDataFrame(rows, "subs_id long, usage_type_id int, a_number string, b_number string, traffic_type_id int, start_date date")


def test_contact_list_windows_and_directions(spark):
    day = dt.date
    cdr = usage(spark, [(1, 2, "89161234567", "x", 1, day(2018, 9, 10)),  # first day of the window
                        (1, 1, "x", "89161234567", 2, day(2018, 9, 12)),  # last day
                        (1, 1, "x", "89161234567", 1, day(2018, 9, 13)),  # after it
                        (1, 1, "x", "89161234567", 4, day(2018, 9, 11)),  # other traffic
                        (2, 1, "x", "89161234567", 1, day(2018, 9, 11))])  # not in the batch
    billing = usage(spark, [(1, 1, "x", "12345", 3, day(2018, 9, 11)), (3, 1, "x", "777", 3, day(2018, 9, 11))])
    batches = spark.createDataFrame([(1, day(2018, 9, 13)), (1, day(2018, 9, 14)), (3, day(2017, 1, 1))], "subs_id long, report_date date")
    numbers = spark.createDataFrame([("89161234567",), ("12345",)], "msisdn string")
    out = extracts.contact_list([cdr, billing], batches, numbers, batch_name="b", offset=1, depth=2)
    got = sorted((r["subs_id"], r["report_date"].day, r["contact"]) for r in out.collect())
    assert got == [(1, 13, "12345"), (1, 13, "79161234567"), (1, 14, "12345"), (1, 14, "79161234567")]
    again = extracts.contact_list([cdr, billing], batches, numbers, batch_name="b", offset=1, depth=2, with_report_date=False)
    assert again.count() == 4 and again.columns == ["subs_id", "contact", "batchname"]


def test_hide_positives(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    for replacement in (False, True):
        out = sampling.hide_positives(df, "y", "id", 40, "s", with_replacement=replacement)
        hidden = out.where("y = 0 AND orig_target = 1").count()
        assert hidden == 40 if not replacement else 30 <= hidden <= 40
        assert out.where("y = 1 AND orig_target = 0").count() == 0 and out.count() == 1000


def test_sample_negatives_three_classes(spark):
    df = spark.createDataFrame([(i, [-1, 0, 1][i % 3]) for i in range(30)], "id long, y int")
    out = sampling.sample_negatives(df, "y", "id", 4, negative=-1, others=[0])
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {-1: 4, 0: 10, 1: 10}


def test_poisson_weights_have_the_right_mean(spark):
    df = spark.range(20000).select(sampling.poisson_weight("s", "id", F.lit(0.7)).alias("w"))
    row = df.agg(F.avg("w").alias("m"), F.variance("w").alias("v"), F.count_if(F.col("w") == 0).alias("z")).first()
    assert abs(row["m"] - 0.7) < 0.03 and abs(row["v"] - 0.7) < 0.05 and abs(row["z"] / 20000 - 0.4966) < 0.02


def test_poisson_weights_agree_for_a_fixed_and_a_column_rate(spark):
    both = spark.range(3000).select(sampling.poisson_weight("s", "id", 0.7).alias("a"),
                                    sampling.poisson_weight("s", "id", F.lit(0.7)).alias("b"))
    assert both.where("a <> b").count() == 0


def test_poisson_weights_of_large_rates_per_row(spark):
    df = spark.range(2000).select("id", (F.col("id") % 4).alias("k")).withColumn("rate", F.expr("array(0D, 3D, 60D, 900D)[k]"))
    drawn = df.select("k", sampling.poisson_weight("s", "id", F.col("rate")).alias("w"), sampling.poisson_weight("s", "id", F.col("rate") - 10).alias("none"))
    got = {r["k"]: (r["m"], r["v"]) for r in drawn.groupBy("k").agg(F.avg("w").alias("m"), F.variance("w").alias("v")).collect()}
    for k, rate in enumerate((0, 3, 60, 900)):
        assert abs(got[k][0] - rate) <= 4 * (rate / 500) ** 0.5 and abs(got[k][1] - rate) <= 0.3 * rate
    assert drawn.where("k < 2 AND none IS NOT NULL").count() == 0


def test_splits_are_stable(spark):
    df = spark.range(5000)
    sizes = [p.count() for p in sampling.split_frame(df, "id", [0.8, 0.1])]
    assert sum(sizes) == 5000 and abs(sizes[0] - 4000) < 150
    other = [p.count() for p in sampling.split_frame(df.repartition(13), "id", [0.8, 0.1])]
    assert other == sizes
