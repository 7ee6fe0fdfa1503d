"""Model quality measures as aggregations over a scored, labelled frame.

Labels are 1 for positive and 0 (or -1) for negative rows.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkfield.functions.features import break_bin, exact_quantiles
from larkfield.operators.ranking import range_split, running
from larkfield.session import checkpointed

BINARY_CLASSES = [{0, 1}, {-1, 1}, {0}, {-1}, {1}]


def confusion_counts(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row ``tp, tn, fp, fn``; a score equal to the threshold counts nowhere."""
    above, below = F.col(score) > threshold, F.col(score) < threshold
    yes, no = F.col(label) == 1, F.col(label) != 1
    return df.agg(F.count_if(above & yes).alias("tp"), F.count_if(below & no).alias("tn"),
                  F.count_if(above & no).alias("fp"), F.count_if(below & yes).alias("fn"))


def roc_curve(df: DataFrame, score: str, label: str, steps: int = 1000) -> DataFrame:
    """Rates at thresholds 1, 1 - 1/steps, ..., 1/steps.

    Every row is counted once, at the grid points around its score; the counts per
    threshold are running sums over at most ``steps`` rows.
    """
    s = F.col(score)
    guess = F.least(F.greatest(F.ceil(s * steps) - 1, F.lit(0)), F.lit(steps))
    point = lambda c: c.cast("double") / float(steps)
    # The product can be off by one unit in the last place, so compare with the grid itself.
    passed = F.when(point(guess + 1) < s, guess + 1).when((guess > 0) & (point(guess) >= s), guess - 1)
    passed = F.least(F.coalesce(passed, guess), F.lit(steps))
    missed = F.when(point(passed + 1) == s, passed + 2).otherwise(passed + 1)
    rows = df.where(s.isNotNull()).select(
        (F.col(label) == 1).alias("_yes"),
        F.explode(F.array(F.struct(F.lit("passed").alias("kind"), passed.alias("at")),
                          F.struct(F.lit("missed").alias("kind"), missed.alias("at")))).alias("e"))
    counts = rows.groupBy("e.at").agg(
        *[F.count_if((F.col("e.kind") == k) & (F.col("_yes") == F.lit(y))).alias(n)
          for n, k, y in (("tp", "passed", True), ("fp", "passed", False),
                          ("fn", "missed", True), ("tn", "missed", False))])
    grid = df.sparkSession.range(0, steps + 3).select(F.col("id").alias("at"))
    dense = grid.join(counts, "at", "left").fillna(0)
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("at").desc())
    up = Window.partitionBy(F.lit(0)).orderBy("at")
    summed = dense.select("at", *[F.sum(c).over(down).alias(c) for c in ("tp", "fp")],
                          *[F.sum(c).over(up).alias(c) for c in ("fn", "tn")])
    return summed.where(F.col("at").between(1, steps)).select(
        (F.lit(steps) - F.col("at")).alias("step"), point(F.col("at")).alias("threshold"),
        "tp", "fp", "fn", "tn",
        (F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("tpr"))


def auc_steps(roc: DataFrame) -> DataFrame:
    """One row ``auc``: the first point of each false-positive rate, left rectangles."""
    points = roc.where("fpr IS NOT NULL").groupBy("fpr").agg(
        F.min("step").alias("step"), F.min_by("tpr", "step").alias("tpr"))
    following = F.lead("fpr").over(Window.partitionBy(F.lit(0)).orderBy("step"))
    widths = points.select(((following - F.col("fpr")) * F.col("tpr")).alias("area"))
    return widths.agg(F.sum("area").alias("auc"))


def _per_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score, stored; ties shrink to one row."""
    y = F.col(label) == 1
    return checkpointed(df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score"))
                        .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))


def auc_rank(df: DataFrame, score: str, label: str, n_ranges: int | None = None) -> DataFrame:
    """One row: chance that a positive outscores a negative.

    ``auc_strict`` counts ties as lost, ``auc_half`` as half won. Exact, in whole numbers
    up to the final division.
    """
    wide = "decimal(19,0)"
    groups = running(_per_score(df, score, label), [("score", "asc")], rank=None,
                     sums={"_cum": "neg"}, n_ranges=n_ranges)
    below = (F.col("_cum") - F.col("neg")).cast(wide)
    pos, neg = F.col("pos").cast(wide), F.col("neg").cast(wide)
    sums = groups.agg(F.sum(pos * below).alias("won"), F.sum(pos * neg).alias("tied"),
                      F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    pairs = F.nullif(F.col("p").cast("double") * F.col("n").cast("double"), F.lit(0.0))
    won, tied = F.col("won").cast("double"), F.col("tied").cast("double")
    return sums.select((won / pairs).alias("auc_strict"), ((won + tied * 0.5) / pairs).alias("auc_half"))


def threshold_table(df: DataFrame, score: str, label: str, n_ranges: int | None = None) -> DataFrame:
    """Counts when all scores at or above each distinct score are called positive."""
    scores = _per_score(df, score, label)
    cumulative = running(scores, [("score", "desc")], rank=None, sums={"tp": "pos", "fp": "neg"}, n_ranges=n_ranges)
    total = scores.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return cumulative.select("score", "pos", "neg", "tp", "fp", (total["p"] - F.col("tp")).alias("fn"),
                             (total["n"] - F.col("fp")).alias("tn"))


def _f1() -> Column:
    return 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))


def best_f1_threshold(df: DataFrame, score: str, label: str, n_ranges: int | None = None) -> DataFrame:
    """One row ``threshold, f1``: the cut with the largest F1, the highest such cut."""
    table = threshold_table(df, score, label, n_ranges).select(_f1().alias("f1"), "score")
    best = table.agg(F.max(F.struct("f1", "score")).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def metrics_at_best_f1(valid: DataFrame, test: DataFrame, score: str, label: str) -> DataFrame:
    """Measures on ``test`` at the threshold that is best on ``valid``."""
    threshold = best_f1_threshold(valid, score, label).select("threshold").scalar()
    called, y = F.col(score) >= threshold, F.col(label) == 1
    counts = test.agg(F.count_if(called & y).alias("tp"), F.count_if(called & ~y).alias("fp"),
                      F.count_if(~called & y).alias("fn"), F.count_if(~called & ~y).alias("tn"))
    auc = auc_rank(test, score, label).select("auc_half").scalar()
    return counts.select(
        threshold.alias("threshold"), _f1().alias("f1"), auc.alias("roc_auc"),
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"),
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"),
        ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
        .alias("accuracy"))


def precision_recall_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``pr_auc``: precision at each distinct score weighted by its gain in recall."""
    table = threshold_table(df, score, label)
    gain = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return table.agg((F.sum(gain) / F.nullif(F.sum("pos"), F.lit(0))).alias("pr_auc"))


def psi(base: DataFrame, other: DataFrame, column: str, parts: int = 10,
        floor: float = 1e-4) -> DataFrame:
    """One row ``psi``: population shift over quantile bins of ``base``.

    The outer bins are open-ended; a share of 0 is counted as ``floor``.
    """
    breaks = exact_quantiles(base, column, [i / parts for i in range(1, parts)])
    breaks = [float("-inf"), *dict.fromkeys(breaks), float("inf")]
    n_bins = len(breaks) - 1

    def shares(df: DataFrame, name: str) -> DataFrame:
        counted = df.where(F.col(column).isNotNull()).groupBy(
            break_bin(F.col(column), breaks).alias("bin")).agg(F.count("*").alias("_n"))
        total = F.sum("_n").over(Window.partitionBy(F.lit(0)))  # at most ``parts`` rows
        return counted.select("bin", (F.col("_n") / total).alias(name))

    bins = base.sparkSession.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    joined = bins.join(shares(base, "e"), "bin", "left").join(shares(other, "a"), "bin", "left")
    e = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(floor))
    a = F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(floor))
    return joined.agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))


def _checked_counts(df: DataFrame, label: str, pos_label) -> tuple[Column, int, int]:
    """(positive flag, rows, positives); labels that are not binary are an error."""
    flag = F.coalesce(F.col(label) == F.lit(1 if pos_label is None else pos_label), F.lit(False)).cast("int")
    value = F.col(label).try_cast("double")
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("hits"), *[
        F.count_if(value == v).alias(f"c{i}") for i, v in enumerate((-1, 0, 1))]).first()
    if pos_label is None:
        found = {v for i, v in enumerate((-1, 0, 1)) if counts[f"c{i}"]}
        strange = counts["n"] != sum(counts[f"c{i}"] for i in range(3))
        if strange or (found and found not in BINARY_CLASSES):
            raise ValueError("labels are not binary and no positive label is given")
    return flag, counts["n"], counts["hits"] or 0


def cumulative_gain(df: DataFrame, score: str, label: str, tie: str, pos_label=None,
                    n_ranges: int | None = None) -> DataFrame:
    """Rows ``rn, hits, percentage, gain``: best scores first, equal scores by ``tie``.

    ``gain`` is the share of all positives among the first ``rn`` rows. The curve starts
    with (0, 0).
    """
    return _gains(df, score, label, tie, pos_label, n_ranges)[0]


def _gains(df: DataFrame, score: str, label: str, tie: str, pos_label, n_ranges: int | None) -> tuple[DataFrame, int]:
    """The gain curve and the number of rows behind it."""
    df = checkpointed(df.select(score, label, tie))  # scores of a model are computed once
    flag, n, total = _checked_counts(df, label, pos_label)
    rows = df.select(score, tie, flag.alias("_y"))
    ranged = range_split(rows, [(score, "desc"), (tie, "asc")], n_ranges=n_ranges)
    curve = running(rows, [], rank="rn", sums={"hits": "_y"}, ranged=ranged)
    curve = curve.select("rn", "hits", (F.col("rn") / float(n or 1)).alias("percentage"),
                         (F.col("hits") / F.nullif(F.lit(float(total)), F.lit(0.0))).alias("gain"))
    start = df.sparkSession.range(1).select(*[F.lit(0).cast(f.dataType).alias(f.name) for f in curve.schema])
    return start.unionByName(curve), n


def lift_table(df: DataFrame, score: str, label: str, tie: str, fractions: Sequence[float],
               pos_label=None, n_ranges: int | None = None) -> DataFrame:
    """At each data fraction: share of positives captured, precision and cumulative lift."""
    gains, n = _gains(df, score, label, tie, pos_label, n_ranges)
    wanted = {f: int(round(f * n)) for f in fractions}
    cuts = df.sparkSession.createDataFrame(list(wanted.items()), "fraction double, rn long")
    rows = gains.where(F.col("rn").isin(*set(wanted.values())) & (F.col("rn") > 0))
    rows = rows.join(F.broadcast(cuts), "rn")
    return rows.select("fraction", "rn", F.col("gain").alias("captured"),
                       (F.col("hits") / F.nullif("rn", F.lit(0))).alias("precision"),
                       (F.col("gain") / F.nullif("percentage", F.lit(0.0))).alias("lift"))


def hit_rate_at(df: DataFrame, score: str, truth: str, tie: str, step: int, stop: int,
                n_ranges: int | None = None) -> DataFrame:
    """Hidden positives among the best ``t`` scores, t = step, 2*step, ... below ``stop``.

    ``df`` holds the rows that were trained as unlabelled; ``truth`` is 1 for hidden
    positives. Gives no rows when ``stop`` is not above ``step``.
    """
    gains = cumulative_gain(df, score, truth, tie, 1, n_ranges)
    rows = gains.where((F.col("rn") > 0) & (F.col("rn") < stop) & (F.col("rn") % step == 0))
    return rows.select(F.col("rn").alias("t"), (F.col("hits") / F.nullif("rn", F.lit(0))).alias("precision_at_t"),
                       F.col("gain").alias("recall_at_t"))


RUN_SCHEMA = ("model_id string, parameters string, features string, metric string, "
              "train_metric double, valid_metric double, logged_at timestamp")


def training_log_row(spark: SparkSession, model_id: str, parameters: Mapping, features: Sequence[str],
                     metric: str, train_metric: float, valid_metric: float,
                     logged_at: dt.datetime | None = None) -> DataFrame:
    """One row for the table of training runs."""
    row = (model_id, json.dumps(dict(parameters), sort_keys=True, default=str), ", ".join(features),
           metric, float(train_metric), float(valid_metric), logged_at or dt.datetime.now())
    return spark.createDataFrame([row], RUN_SCHEMA)


def log_training(row: DataFrame, path: str) -> None:
    """Append to the runs table, kept as tab-separated text with a header."""
    row.coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)
