import random
import warnings

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from larkfield.lookalike import models, prepare, pu
from larkfield.lookalike.bagging import BaggingPU, BaggingPUModel


@pytest.fixture(scope="module")
def table(spark):
    """Positives sit at large x; a third of them is not marked."""
    rng = random.Random(11)
    rows = []
    for i in range(1200):
        truth = int(rng.random() < 0.3)
        x = rng.gauss(3.0 if truth else 0.0, 1.0)
        marked = truth and rng.random() < 0.67
        rows.append((i, float(x), rng.random(), rng.choice(["a", "b"]), truth, "h" if marked else "\\N"))
    return spark.createDataFrame(rows, "id long, x double, noise double, cat string, truth int, hashed string").cache()


FEATURES = ["x", "noise", "cat"]


def test_build_target(spark):
    df = spark.createDataFrame([("\\N",), (None,), ("h",)], "hashed string")
    assert [r["target"] for r in prepare.build_target(df, to_target="hashed").collect()] == [0, 0, 1]
    assert [r["target"] for r in prepare.build_target(df, to_target="hashed", negative=-1).collect()] == [-1, -1, 1]
    with pytest.raises(ValueError, match="not found"):
        prepare.build_target(df, target="missing")
    with pytest.raises(ValueError, match="not defined"):
        prepare.build_target(df)


def test_prepare_keeps_the_true_label(table):
    p = prepare.prepare(table, "id", FEATURES, to_target="hashed", n_sample=300, hidden_size=40)
    counts = {(r["target"], r["orig_target"]): r["count"] for r in p.df.groupBy("target", "orig_target").count().collect()}
    assert counts[(0, 1)] == 40 and counts[(0, 0)] == 300 and (1, 0) not in counts
    three = prepare.prepare(table.withColumn("t", F.when(F.col("hashed") == "h", 1).when(F.col("x") < -1, 0).otherwise(-1)),
                            "id", FEATURES, target="t", n_sample=100, hidden_size=10, three_class=True)
    got = {(r["target"], r["orig_target"]): r["count"] for r in three.df.groupBy("target", "orig_target").count().collect()}
    assert got[(-1, -1)] == 100 and got[(-1, 1)] == 10 and (0, 0) in got


def test_relabel_rule(spark):
    df = spark.createDataFrame([(1, 1, 0.4), (2, 1, 0.8), (3, -1, 0.9), (4, -1, 0.3), (5, -1, 0.5), (6, -1, 0.8), (7, 0, 0.95)], "id int, ys int, p1 double")
    got = {r["id"]: r["ys"] for r in pu.relabel(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: -1, 6: -1, 7: 0}


def small_forest():
    return models.random_forest(trees=10, depth=4)


def test_rounds_recover_hidden_positives(table):
    p = prepare.prepare(table, "id", FEATURES, to_target="hashed", hidden_size=60, process=False)
    done = pu.run_rounds(p.df, "id", p.features, small_forest, max_rounds=3)
    assert done.where("ys = -1").count() == 0
    model = pu.train_full_model(done, p.features, trees=10, depth=4)
    scored = pu.score_all(model, table, "id")
    assert scored.count() == 1200
    hidden = p.df.where("target = 0").select("id", "orig_target").join(scored, "id")
    top = hidden.orderBy(F.desc("p1"), "id").limit(100).agg(F.avg("orig_target")).first()[0]
    base = hidden.agg(F.avg("orig_target")).first()[0]
    assert top > 2 * base


def test_rounds_need_a_positive(table):
    with pytest.raises(ValueError, match="no positive"):
        pu.run_rounds(table.withColumn("target", F.lit(0)), "id", FEATURES, small_forest)


def test_gbm_importance_and_storage(table, tmp_path):
    rows = table.withColumn("label", F.col("truth").cast("double"))
    model = models.gbm_train(rows, FEATURES, "label", {"maxIter": 3, "maxDepth": 3})
    table_of = models.feature_importance(model, FEATURES).orderBy(F.desc("importance")).collect()
    assert table_of[0]["variable"] == "x" and table_of[0]["scaled_importance"] == 1.0
    assert models.select_by_importance(model, FEATURES, 0.5) == ["x"]
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    pair = [sorted(map(tuple, models.score(m, rows, FEATURES, ["id"]).collect())) for m in (model, again)]
    assert pair[0] == pair[1]
    name = models.model_name("gbm", FEATURES, {"a": 1, "b": 2})
    assert name.startswith("gbm-") and name == models.model_name("gbm", FEATURES[::-1], {"b": 2, "a": 1})
    assert name != models.model_name("gbm", FEATURES, {"a": 1, "b": 3})


def test_missing_values_are_scored(table):
    rows = table.withColumn("label", F.col("truth").cast("double"))
    model = models.train(rows, FEATURES, small_forest())
    holes = table.select("id", F.lit(None).cast("double").alias("x"), F.lit(float("nan")).alias("noise"), F.lit("new").alias("cat"))
    assert models.score(model, holes, FEATURES, ["id"]).where("p1 IS NULL").count() == 0


def test_calibration_is_monotone(table):
    scored = table.select("id", F.least(F.greatest(F.col("x") / 6 + 0.3, F.lit(0.0)), F.lit(1.0)).alias("p1"), "truth")
    curve = models.calibrate(scored, "p1", "truth")
    rows = models.apply_calibration(curve, scored, "p1").orderBy("p1").collect()
    assert all(a["cal_p1"] <= b["cal_p1"] + 1e-12 for a, b in zip(rows, rows[1:]))


@pytest.fixture(scope="module")
def labelled(table):
    return table.select("id", "x", "noise", "truth", (F.col("hashed") == "h").cast("int").alias("label")).cache()


def tree():
    return DecisionTreeClassifier(maxDepth=3, seed=1)


def test_bagging(labelled):
    bag = BaggingPU(tree(), n_estimators=4, max_samples=0.8, seed=5)
    model = bag.fit(labelled, "id", ["x", "noise"])
    proba = model.predict_proba(labelled, ["id", "label", "truth"])
    means = {(r["label"], r["truth"]): r["avg(p1)"] for r in proba.groupBy("label", "truth").avg("p1").collect()}
    assert means[(0, 1)] > 2 * means[(0, 0)]
    row = proba.first()
    assert row["p0"] + row["p1"] == pytest.approx(1.0)
    logs = model.predict_log_proba(labelled, ["id"])
    assert logs.where("log_p1 > 0").count() == 0
    assert model.decision(labelled, ["id"]).count() == 1200
    share = model.vote_share(labelled, ["id"]).select("p1").distinct().collect()
    assert {r[0] for r in share} <= {0.0, 0.25, 0.5, 0.75, 1.0}


def test_oob_is_null_for_positives(labelled):
    model = BaggingPU(tree(), n_estimators=4, seed=5).fit(labelled, "id", ["x", "noise"])
    oob = model.oob_scores(labelled, ["id", "label"])
    assert oob.where("label = 1 AND oob_p1 IS NOT NULL").count() == 0
    # A row escapes one Poisson(1) draw with chance exp(-1).
    seen = oob.where("label = 0").agg(F.avg("oob_estimators")).first()[0]
    assert abs(seen - 4 * 0.368) < 0.15
    accuracy = model.oob_accuracy(labelled).first()
    positives = labelled.where("label = 1").count()
    unlabelled = 1200 - positives
    assert accuracy["accuracy_all"] == pytest.approx(accuracy["accuracy_unlabelled"] * unlabelled / 1200)


def test_sample_without_replacement_and_feature_subsets(labelled):
    model = BaggingPU(tree(), n_estimators=3, max_samples=200, max_features=1, bootstrap=False, oob_score=False).fit(
        labelled, "id", ["x", "noise"])
    assert all(len(names) == 1 for _, names in model.members)
    weights = labelled.select("label", model.draw.weight(0).alias("w"))
    assert weights.where("label = 1 AND w <> 1").count() == 0
    drawn = weights.where("label = 0").agg(F.sum("w"), F.max("w")).first()
    assert abs(drawn[0] - 200) < 45 and drawn[1] == 1


def test_bagging_checks_and_warm_start(labelled):
    names = ["x", "noise"]
    for bad in ({"max_samples": 0}, {"max_samples": 1.5}, {"max_samples": 10 ** 6}, {"max_features": 3}, {"max_features": 0},
                {"bootstrap": False}, {"warm_start": True}):
        with pytest.raises(ValueError):
            BaggingPU(tree(), n_estimators=1, **bad).fit(labelled, "id", names)
    bag = BaggingPU(tree(), n_estimators=2, warm_start=True, oob_score=False)
    first = bag.fit(labelled, "id", names)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert bag.fit(labelled, "id", names) is first and len(caught) == 1
    bag.n_estimators = 3
    more = bag.fit(labelled, "id", names)
    assert len(more.members) == 3 and more.members[:2] == first.members
    bag.n_estimators = 1
    with pytest.raises(ValueError):
        bag.fit(labelled, "id", names)


def test_votes_of_models_without_probabilities(spark):
    from pyspark.ml.classification import LinearSVC
    df = spark.range(200).selectExpr("id", "id / 200.0 AS x", "CAST(id >= 150 AS INT) AS label")
    model = BaggingPU(estimator=LinearSVC(maxIter=5), n_estimators=3, oob_score=False).fit(df, "id", ["x"])
    votes = model.vote_share(df, ["id"]).collect()
    assert len(votes) == 200 and all(0 <= r["p1"] <= 1 for r in votes)


@pytest.mark.parametrize("levels", [60, 1500])
def test_text_with_many_values_trains(spark, levels):
    from larkfield.lookalike import models
    df = spark.range(3000).selectExpr("id", f"concat('v', id % {levels}) AS t", "rand(1) AS x", "CAST(id % 2 AS DOUBLE) AS label")
    for estimator in (models.random_forest(trees=2, depth=3), models.logistic(iterations=2)):
        model = models.train(df, ["t", "x"], estimator)
        assert models.score(model, df, ["t", "x"], ["id"]).count() == 3000
    assert models.random_forest(columns=0.9).getFeatureSubsetStrategy() == "0.9"


def test_flat_trees_score_like_the_models(spark, labelled):
    """Probabilities, raw scores and votes of trees and small forests, from arrays and from the models themselves."""
    from pyspark.ml.classification import RandomForestClassifier

    for base in (tree(), RandomForestClassifier(numTrees=3, maxDepth=3, seed=2)):
        model = BaggingPU(base, n_estimators=3, max_features=1, seed=5).fit(labelled, "id", ["x", "noise"])
        flat = {r["id"]: r for r in model._outputs(labelled, ["id"], ["p0", "p1", "raw", "each"]).collect()}
        assert model._flat is not None
        each = model._each(labelled)
        names = [f"_{kind}{i}" for kind in "prc" for i in range(3)]
        for r in each.select("id", *names).collect():
            own = flat[r["id"]]
            assert own["each"] == pytest.approx([float(r[f"_p{i}"][1]) for i in range(3)])
            assert own["raw"] == pytest.approx(sum(float(r[f"_r{i}"][1]) for i in range(3)) / 3)
            assert own["p0"] + own["p1"] == pytest.approx(1)


def test_five_hundred_members_are_one_small_plan(labelled):
    model = BaggingPU(tree(), n_estimators=5, seed=5).fit(labelled, "id", ["x", "noise"])
    few = model.predict_proba(labelled, ["id"])
    many = BaggingPUModel(model.members * 100, model.features, model.draw)
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (few, many.predict_proba(labelled, ["id"]))]
    assert len(plans[1]) < 1.1 * len(plans[0])
    pair = [sorted((r["id"], round(r["p1"], 9)) for r in f.collect()) for f in (few, many.predict_proba(labelled, ["id"]))]
    assert pair[0] == pair[1]
    assert len(many.oob_scores(labelled, ["id"])._jdf.queryExecution().executedPlan().toString()) < 20_000


def test_models_without_probabilities_vote_by_themselves(spark):
    from pyspark.ml.classification import LinearSVC
    df = spark.range(200).selectExpr("id", "id / 200.0 AS x", "CAST(id >= 150 AS INT) AS label")
    model = BaggingPU(estimator=LinearSVC(maxIter=5), n_estimators=3, oob_score=False).fit(df, "id", ["x"])
    share = {r["id"]: r["p1"] for r in model.vote_share(df, ["id"]).collect()}
    assert {r["id"]: r["p1"] for r in model.predict_proba(df, ["id"]).collect()} == pytest.approx(share)
    mixed = BaggingPUModel([*model.members, *BaggingPU(tree(), n_estimators=4, seed=1).fit(df, "id", ["x"]).members[3:]], ["x"], model.draw)
    assert all(0 <= r["p1"] <= 1 and r["p0"] + r["p1"] == pytest.approx(1) for r in mixed.predict_proba(df, ["id"]).collect())


def test_every_tree_has_its_own_columns_and_rows(spark):
    from larkfield.lookalike.forest import train_forest

    names = [f"f{i}" for i in range(10)]
    df = spark.range(1500).select("id", *[F.rand(i).alias(n) for i, n in enumerate(names[:-1])], F.concat(F.lit("c"), F.col("id") % 4).alias("f9"))
    df = df.withColumn("label", ((F.col("f0") + F.col("f1") > 1) | (F.col("f9") == "c2")).cast("double")).cache()
    model = train_forest(df, names, trees=6, depth=5, column_rate=0.9)
    assert all(len(m) == 9 for m in model.masks) and len({tuple(m) for m in model.masks}) > 1
    for tree_, mask in enumerate(model.masks):  # no tree splits on a column that it was not given
        nodes = range(model.trees.roots[tree_], model.trees.roots[tree_ + 1] if tree_ < 5 else len(model.trees.left))
        used = {model.inputs[model.trees.feature[n]] for n in nodes if model.trees.left[n] >= 0}
        assert used and used <= set(mask)
    drawn = model.trees.counts[model.trees.roots].sum(1)
    assert all(abs(n - 0.632 * 1500) < 120 for n in drawn) and len(set(drawn.tolist())) > 1
    scored = model.score(df, ["id", "label"])
    means = {r["label"]: r["m"] for r in scored.groupBy("label").agg(F.avg("p1").alias("m")).collect()}
    assert means[1.0] > means[0.0] + 0.3
    narrow = train_forest(df, names, trees=3, depth=3, column_rate=0.2)
    assert all(len(m) == 2 for m in narrow.masks)
    with pytest.raises(ValueError):
        train_forest(df, names, trees=1, column_rate=0.0)


def test_many_valued_text_is_ordered_by_the_label(spark, tmp_path):
    """3,000 values with rates of their own: held-out AUC beside that of values hashed into 1,024 numbers."""
    from larkfield.operators.metrics import auc_rank

    rows = spark.range(45_000).select("id", F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(3000))).alias("t"), F.rand(3).alias("x"))
    rate = F.when(F.pmod(F.xxhash64("t", F.lit("rate")), F.lit(10)) < 3, 0.8).otherwise(0.1)
    df = rows.withColumn("label", (F.rand(5) < rate).cast("double")).withColumn("h", F.pmod(F.xxhash64("t"), F.lit(1024)).cast("double")).cache()
    train_df, held = df.where("id % 4 <> 0"), df.where("id % 4 = 0")

    def auc(features):
        model = models.gbm_train(train_df, features, "label", {"maxIter": 5, "maxDepth": 4})
        return auc_rank(models.score(model, held, features, ["label"]), "p1", "label").first()["auc_half"], model

    ordered, model = auc(["t", "x"])
    hashed, _ = auc(["h", "x"])
    assert ordered > 0.78 and ordered > hashed + 0.1
    models.save_model(model, str(tmp_path / "coded"))
    again = models.load_model(str(tmp_path / "coded"))
    assert again.stages[0].getOrDefault("folder").startswith(str(tmp_path))
    pair = [sorted(map(tuple, models.score(m, held, ["t", "x"], ["id"]).collect())) for m in (model, again)]
    assert pair[0] == pair[1]


def test_codes_leave_out_the_rows_own_fold(spark):
    from larkfield.lookalike.target_codes import SMOOTHING, ordered_by_target

    # every row has a value of its own: without the own fold nothing is known of it
    df = spark.range(500).select("id", F.concat(F.lit("only"), F.col("id")).alias("t"), (F.col("id") % 2).cast("double").alias("label"))
    coded, (stage,), names = ordered_by_target(df, ["t"], "label")
    assert names == ["t_code"] and {r["t_code"] for r in coded.collect()} == {0.5}
    scored = {r["label"]: r["t_code"] for r in stage.transform(df).select("label", "t_code").distinct().collect()}
    assert scored == pytest.approx({0.0: 0.5 * SMOOTHING / (SMOOTHING + 1), 1.0: (0.5 * SMOOTHING + 1) / (SMOOTHING + 1)})
    assert stage.transform(df.withColumn("t", F.lit("new"))).select("t_code").distinct().collect()[0][0] == 0.5
