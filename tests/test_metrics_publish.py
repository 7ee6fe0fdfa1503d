import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkfield.operators import metrics
from larkfield.plans import publish


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), rng.choice([0.3, 0.3, 0.5, round(rng.random(), 3)])) for i in range(600)]
    return rows, spark.createDataFrame(rows, "id long, y int, p double").cache()


def test_confusion_has_false_positives(scored):
    rows, df = scored
    got = metrics.confusion_counts(df, "p", "y", 0.5).first()
    assert got["fp"] == sum(p > 0.5 and y == 0 for _, y, p in rows) != got["tp"]
    assert sum(got) == sum(p != 0.5 for _, _, p in rows)


def test_roc_and_steps(scored):
    rows, df = scored
    roc = metrics.roc_curve(df, "p", "y").orderBy("step").collect()
    assert len(roc) == 1000 and roc[0]["threshold"] == 1.0 and roc[-1]["threshold"] == 0.001
    for r in random.Random(1).sample(roc, 60) + [roc[500], roc[700]]:
        t = r["threshold"]
        assert r["tp"] == sum(p > t and y == 1 for _, y, p in rows)
        assert r["fp"] == sum(p > t and y == 0 for _, y, p in rows)
        assert r["tn"] == sum(p < t and y == 0 for _, y, p in rows)
        assert r["fn"] == sum(p < t and y == 1 for _, y, p in rows)
    points, seen = [], set()
    for r in roc:
        if r["fpr"] not in seen:
            seen.add(r["fpr"])
            points.append((r["fpr"], r["tpr"]))
    wanted = sum((b[0] - a[0]) * a[1] for a, b in zip(points, points[1:]))
    assert metrics.auc_steps(metrics.roc_curve(df, "p", "y")).first()["auc"] == pytest.approx(wanted)


@pytest.mark.parametrize("n_ranges", [1, 6])
def test_auc_rank_equals_all_pairs(scored, n_ranges):
    rows, df = scored
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    won = sum(a > b for a in pos for b in neg)
    tied = sum(a == b for a in pos for b in neg)
    got = metrics.auc_rank(df, "p", "y", n_ranges).first()
    assert got["auc_strict"] == pytest.approx(won / len(pos) / len(neg))
    assert got["auc_half"] == pytest.approx((won + tied / 2) / len(pos) / len(neg))


def test_auc_grows_with_the_blend(scored):
    _, df = scored
    aucs = [metrics.auc_rank(df.withColumn("b", (F.col("p") + w * F.col("y")) / (1 + w)), "b", "y").first()["auc_half"]
            for w in (0.0, 0.3, 0.9)]
    assert aucs[0] < aucs[1] < aucs[2]


def test_gain_starts_at_zero_and_checks_labels(spark, scored):
    _, df = scored
    curve = metrics.cumulative_gain(df, "p", "y", "id").orderBy("rn").collect()
    assert tuple(curve[0]) == (0, 0, 0.0, 0.0) and curve[-1]["gain"] == 1.0 and len(curve) == 601
    for classes in ([0, 1], [-1, 1], [0], [-1], [1]):
        metrics.cumulative_gain(spark.createDataFrame([(i, c, 0.1) for i, c in enumerate(classes)], "id int, y int, p double"), "p", "y", "id")
    three = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2), (3, 2, 0.3)], "id int, y int, p double")
    with pytest.raises(ValueError):
        metrics.cumulative_gain(three, "p", "y", "id")
    assert metrics.cumulative_gain(three, "p", "y", "id", pos_label=2).count() == 4


def test_hit_rate_is_empty_for_a_single_step(spark, scored):
    _, df = scored
    assert metrics.hit_rate_at(df, "p", "y", "id", 100, 100).count() == 0
    assert metrics.hit_rate_at(df, "p", "y", "id", 100, 301).count() == 3


def test_best_f1_and_pr(scored):
    rows, df = scored
    def f1(t):
        tp, fp = sum(p >= t and y for _, y, p in rows), sum(p >= t and not y for _, y, p in rows)
        return 2 * tp / (tp + fp + sum(y for _, y, _ in rows))
    best = max((f1(t), t) for t in {p for _, _, p in rows})
    got = metrics.best_f1_threshold(df, "p", "y", n_ranges=5).first()
    assert (got["f1"], got["threshold"]) == pytest.approx(best)
    assert 0 < metrics.precision_recall_auc(df, "p", "y").first()["pr_auc"] < 1


def test_psi(spark, scored):
    _, df = scored
    assert metrics.psi(df, df, "p").first()["psi"] == pytest.approx(0)
    moved = df.withColumn("p", F.lit(2.0))
    assert metrics.psi(df, moved, "p").first()["psi"] > 1


def test_training_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in (1, 2):
        metrics.log_training(metrics.training_log_row(spark, f"m{i}", {"depth": i}, ["a", "b"], "logloss", 0.1, 0.2), path)
    rows = spark.read.option("sep", "\t").option("header", True).csv(path).collect()
    assert sorted(r["model_id"] for r in rows) == ["m1", "m2"] and rows[0]["features"] == "a, b"


def test_next_model_id_of_empty_registry(spark):
    empty = spark.createDataFrame([], "model_id int, model_name string")
    assert publish.next_model_id(empty).first()[0] == 1


def test_bucket_table_defaults_to_today(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.0)], "subs_id long, p double")
    rows = publish.bucket_table(df, "p", condition="p > 0").collect()
    today = spark.sql("SELECT date_sub(current_date(), 3)").first()[0]
    assert {r["subs_id"]: r["bucket_value"] for r in rows} == {2: 1, 1: 50} and rows[0]["report_date"] == today


def test_partitions_and_rejects(spark, tmp_path):
    day = dt.date(2018, 9, 10)
    rows = [(1, day, 1), (2, day, 9), (3, day, None), (4, dt.date(2018, 9, 21), 1), (5, None, 2)]
    df = spark.createDataFrame(rows, "subs_id long, report_date date, segment_id int")
    good, bad = publish.score_partitions(df, day, dt.date(2018, 9, 20))
    assert {r["subs_id"]: r["segment_part"] for r in good.collect()} == {1: "1", 2: "unknown", 3: "unknown"}
    assert sorted(r["subs_id"] for r in bad.collect()) == [4, 5]
