"""Model quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkfield.operators import metrics, sampling
from larkfield.plans.registry import query

SCORED_SQL = """SELECT o_orderkey AS id, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y,
 round((o_totalprice / 500000.0 + 0.1 * CAST(o_orderpriority = '1-URGENT' AS INTEGER)) / 1.1, 3) AS p FROM orders"""


def scored(t, condition: str = "true"):
    y = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return t.orders.where(condition).select(F.col("o_orderkey").alias("id"), y.alias("y"),
                           F.round((F.col("o_totalprice") / 500000.0 + 0.1 * y) / 1.1, 3).alias("p"))


@query("confusion_counts", f"""
WITH s AS ({SCORED_SQL}) SELECT count(*) FILTER (p > 0.6 AND y = 1) AS tp, count(*) FILTER (p < 0.6 AND y = 0) AS tn,
 count(*) FILTER (p > 0.6 AND y = 0) AS fp, count(*) FILTER (p < 0.6 AND y = 1) AS fn FROM s
""")
def confusion_counts(t):
    return metrics.confusion_counts(scored(t), "p", "y", 0.6)


ROC_SQL = f"""s AS ({SCORED_SQL}), th AS (SELECT range AS step, (1000 - range) / 1000.0::DOUBLE AS threshold FROM range(0, 1000)),
 c AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY p),
 r AS (SELECT step, threshold, CAST(coalesce(sum(pos) FILTER (p > threshold), 0) AS BIGINT) AS tp, CAST(coalesce(sum(neg) FILTER (p > threshold), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(pos) FILTER (p < threshold), 0) AS BIGINT) AS fn, CAST(coalesce(sum(neg) FILTER (p < threshold), 0) AS BIGINT) AS tn FROM th, c GROUP BY step, threshold)"""


@query("roc_curve", f"""
WITH {ROC_SQL} SELECT step, threshold, tp, fp, fn, tn, round(fp / (fp + tn), 10) AS fpr, round(tp / (tp + fn), 10) AS tpr FROM r
""")
def roc_curve(t):
    out = metrics.roc_curve(scored(t), "p", "y")
    return out.withColumn("fpr", F.round("fpr", 10)).withColumn("tpr", F.round("tpr", 10))


@query("auc_steps", f"""
WITH {ROC_SQL}, q AS (SELECT fp / (fp + tn) AS fpr, min(step) AS step, arg_min(tp / (tp + fn), step) AS tpr FROM r GROUP BY 1),
 z AS (SELECT (lead(fpr) OVER (ORDER BY step) - fpr) * tpr AS area FROM q) SELECT round(sum(area), 10) AS auc FROM z
""")
def auc_steps(t):
    return metrics.auc_steps(metrics.roc_curve(scored(t), "p", "y")).select(F.round("auc", 10).alias("auc"))


@query("auc_rank", f"""
WITH s AS ({SCORED_SQL}), g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p),
 w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos * below) / (sum(pos) * sum(neg)), 10) AS auc_strict, round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 10) AS auc_half FROM w
""")
def auc_rank(t):
    out = metrics.auc_rank(scored(t), "p", "y")
    return out.select(F.round("auc_strict", 10).alias("auc_strict"), F.round("auc_half", 10).alias("auc_half"))


TABLE_SQL = """g AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY p),
 c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np FROM g),
 f AS (SELECT *, 2 * tp / (2 * tp + fp + np - tp) AS f1 FROM c)"""


@query("best_f1_threshold", f"""
WITH s AS ({SCORED_SQL}), {TABLE_SQL} SELECT p AS threshold, round(f1, 10) AS f1 FROM f ORDER BY f.f1 DESC, p DESC LIMIT 1
""")
def best_f1_threshold(t):
    out = metrics.best_f1_threshold(scored(t), "p", "y")
    return out.select("threshold", F.round("f1", 10).alias("f1"))


@query("metrics_at_best_f1", f"""
WITH a AS ({SCORED_SQL.replace('SELECT', 'SELECT o_orderdate AS day,', 1)}), s AS (SELECT * FROM a WHERE day < TIMESTAMP '1998-01-01'), {TABLE_SQL}, b AS (SELECT p AS threshold FROM f ORDER BY f1 DESC, p DESC LIMIT 1),
 t AS (SELECT * FROM a WHERE day >= TIMESTAMP '1998-01-01'),
 m AS (SELECT count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn, count(*) FILTER (p < threshold AND y = 0) AS tn, any_value(threshold) AS threshold FROM t, b),
 tg AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY p),
 w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM tg),
 u AS (SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc FROM w)
SELECT threshold, round(2 * tp / (2 * tp + fp + fn), 10) AS f1, round(roc_auc, 10) AS roc_auc, round(tp / (tp + fp), 10) AS "precision", round(tp / (tp + fn), 10) AS recall, round((tp + tn) / (tp + tn + fp + fn), 10) AS accuracy FROM m, u
""")
def metrics_at_best_f1(t):
    """Threshold from the earlier orders (validation), measures on the later ones (test)."""
    valid, test = [scored(t, part) for part in ("o_orderdate < timestamp_ntz '1998-01-01'",
                                                "o_orderdate >= timestamp_ntz '1998-01-01'")]
    out = metrics.metrics_at_best_f1(valid, test, "p", "y")
    names = ["f1", "roc_auc", "precision", "recall", "accuracy"]
    return out.select("threshold", *[F.round(c, 10).alias(c) for c in names])


@query("precision_recall_auc", f"""
WITH s AS ({SCORED_SQL}), {TABLE_SQL} SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 8) AS pr_auc FROM f
""")
def precision_recall_auc(t):
    return metrics.precision_recall_auc(scored(t), "p", "y").select(F.round("pr_auc", 8).alias("pr_auc"))


@query("psi", """
WITH b AS (SELECT o_totalprice AS x FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), o AS (SELECT o_totalprice AS x FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
 q AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM b),
 e AS (SELECT len(list_filter(c, lambda v: v < x)) AS bin, count(*) AS n FROM b, q GROUP BY 1), a AS (SELECT len(list_filter(c, lambda v: v < x)) AS bin, count(*) AS n FROM o, q GROUP BY 1),
 j AS (SELECT e.n / (SELECT count(*) FROM b) AS es, a.n / (SELECT count(*) FROM o) AS sh FROM e JOIN a ON e.bin = a.bin)
SELECT round(sum((sh - es) * ln(sh / es)), 8) AS psi FROM j
""")
def psi(t):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    o = t.orders
    out = metrics.psi(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_totalprice")
    return out.select(F.round("psi", 8).alias("psi"))


GAIN_SQL = f"""s AS ({SCORED_SQL}), r AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS rn FROM s),
 g AS (SELECT rn, CAST(sum(y) OVER (ORDER BY rn) AS BIGINT) AS hits, count(*) OVER () AS n, sum(y) OVER () AS np FROM r)"""


@query("cumulative_gain", f"""
WITH {GAIN_SQL} SELECT rn, hits, round(rn / n, 10) AS percentage, round(hits / np, 10) AS gain FROM g UNION ALL SELECT 0, 0, 0, 0
""")
def cumulative_gain(t):
    out = metrics.cumulative_gain(scored(t), "p", "y", "id")
    return out.select("rn", "hits", F.round("percentage", 10).alias("percentage"), F.round("gain", 10).alias("gain"))


FRACTIONS = [0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


@query("lift_table", f"""
WITH {GAIN_SQL}, f AS (SELECT unnest({FRACTIONS}::DOUBLE[]) AS fraction), x AS (SELECT fraction, CAST(round_even(fraction * (SELECT count(*) FROM s), 0) AS BIGINT) AS rn FROM f)
SELECT fraction, rn, round(hits / np, 10) AS captured, round(hits / rn, 10) AS "precision", round((hits / np) / (rn / n), 8) AS lift FROM g JOIN x USING (rn)
""")
def lift_table(t):
    out = metrics.lift_table(scored(t), "p", "y", "id", FRACTIONS)
    return out.select("fraction", "rn", F.round("captured", 10).alias("captured"),
                      F.round("precision", 10).alias("precision"), F.round("lift", 8).alias("lift"))


@query("hit_rate_at_t", f"""
WITH s AS ({SCORED_SQL}), h AS (SELECT id FROM s WHERE y = 1 ORDER BY md5('s1|' || CAST(id AS VARCHAR)), id LIMIT 1000),
 u AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS t FROM s WHERE y = 0 OR id IN (SELECT id FROM h)),
 z AS (SELECT t, sum(y) OVER (ORDER BY t) AS hits, sum(y) OVER () AS goods FROM u)
SELECT t, round(hits / t, 10) AS precision_at_t, round(hits / goods, 10) AS recall_at_t FROM z WHERE t % 100 = 0 AND t < 1000
""")
def hit_rate_at_t(t):
    hidden = sampling.hide_positives(scored(t), "y", "id", 1000, "s1")
    out = metrics.hit_rate_at(hidden.where("y = 0"), "p", "orig_target", "id", 100, 1000)
    return out.select("t", F.round("precision_at_t", 10).alias("precision_at_t"),
                      F.round("recall_at_t", 10).alias("recall_at_t"))
