"""Numeric and categorical feature columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.operators.joins import with_group_values
from larkfield.operators.ranking import row_numbers, values_at_ranks
from larkfield.session import small_side

# Limits and columns of the subscriber feature clean-up.
CLIP_MIN = {"cl_avg_lifetime": 0, "rc_avg_day": 0, "rc": 0}
CLIP_MAX = {
    "cl_avg_lifetime": 9000, "rc": 5000, "rc_avg_day": 100, "sms_tot_cnt": 3000,
    "sum_ses_mou": 200000, "mou": 10000, "avg_day_voice_cnt": 1000, "avg_day_mou": 10000,
    "avg_day_mbou": 5000, "sum_ses_mbou": 50000, "avg_ses_mbou": 100, "cl_onnet_cnt": 100,
    "cl_size": 300,
}
LOG_COLUMNS = ["avg_day_data_cnt", "rc"]
ROOT_COLUMNS = ["io_voice_traf_ratio"]
CATEGORY_CAPS = {"add_sim_cnt": 5}


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to ``low..high``; unlike ``greatest`` and ``least`` a NULL stays NULL."""
    out = column
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def clean_features(df: DataFrame, columns: Sequence[str] | None = None, *,
                   floors: Mapping[str, float] = CLIP_MIN, caps: Mapping[str, float] = CLIP_MAX,
                   logs: Sequence[str] = LOG_COLUMNS, roots: Sequence[str] = ROOT_COLUMNS,
                   category_caps: Mapping[str, int] = CATEGORY_CAPS) -> DataFrame:
    """Floor, cap, ``log1p``, square root and capped categories, in that order.

    Only listed columns that exist are touched; the rest pass through.
    """
    selected = []
    for name in columns or df.columns:
        c = clip(F.col(name), floors.get(name), caps.get(name))
        if name in logs:
            c = F.log1p(c)
        if name in roots:
            c = F.sqrt(c)
        if name in category_caps:
            c = clip(c, high=category_caps[name]).cast("string")
        selected.append(c.alias(name))
    return df.select(*selected)


def interaction_features(df: DataFrame, columns: Sequence[str], feature: str) -> DataFrame:
    """``<c>_mult_<f>`` and ``<c>_div_<f>`` for every other column; division by 0 gives 0."""
    f = F.col(feature)
    added = []
    for c in columns:
        if c != feature:
            added.append((F.col(c) * f).alias(f"{c}_mult_{feature}"))
            added.append(F.when(f == 0, F.lit(0.0)).otherwise(F.col(c) / f)
                         .alias(f"{c}_div_{feature}"))
    return df.select("*", *added)


def _level_part(column: str) -> Column:
    return F.coalesce(F.regexp_replace(F.col(column).cast("string"), r"([\\_])", r"\\$1"), F.lit(r"\N"))


def categorical_interaction(df: DataFrame, factors: Sequence[str], max_factors: int = 1_000_000,
                            min_occurrence: int = 10, other: str = "other") -> DataFrame:
    """Add ``a_b`` for every pair of factors; rare levels become ``other``.

    Levels are told apart by the pair of values. In a level's name a backslash and an underscore
    within a value are written behind a backslash, and a NULL is written ``\\N``, so two pairs never
    share a name.

    A level stays when it occurs ``min_occurrence`` times and is among the
    ``max_factors`` most frequent (equal counts by name).
    """
    out = df
    for i, a in enumerate(factors):
        for b in factors[i + 1:]:
            name = f"{a}_{b}"
            pair = F.concat(_level_part(a), F.lit("_"), _level_part(b))
            out = out.withColumn(name, pair)
            levels = (out.groupBy(F.col(name).alias("_level")).agg(F.count("*").alias("_n"))
                      .where(F.col("_n") >= min_occurrence))
            if levels.limit(max_factors + 1).count() > max_factors:
                ranked = row_numbers(levels, [("_n", "desc"), ("_level", "asc")], "_r")
                levels = ranked.where(F.col("_r") <= max_factors)
            side = small_side(levels.select("_level"))
            out = (out.join(side, out[name] == side["_level"], "left")
                   .withColumn(name, F.when(F.col("_level").isNotNull(), F.col(name))
                               .otherwise(F.lit(other))).drop("_level"))
    return out


def min_max_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """``(x - min) / (max - min)``; a constant column gives NULL."""
    bounds = df.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                               for c in columns]).alias("b")).scalar()
    out = [((F.col(c) - bounds[c]["lo"]) / F.nullif(bounds[c]["hi"] - bounds[c]["lo"], F.lit(0)))
           .alias(c + suffix) for c in columns]
    return df.select("*", *out)


def max_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """``x / max`` with NULL counted as 0."""
    tops = df.agg(F.struct(*[F.max(c).alias(c) for c in columns]).alias("b")).scalar()
    out = [F.coalesce(F.col(c) / F.nullif(tops[c], F.lit(0)), F.lit(0.0)).alias(c + suffix)
           for c in columns]
    return df.select("*", *out)


def pseudocolour(value: Column) -> Column:
    """0..1 to ``#RRGGBB`` from green over yellow to red, halves rounded to even."""
    red = F.bround(F.least(F.lit(1.0), value * 2) * 255, 0).cast("int")
    green = F.bround(F.least(F.lit(1.0), (1 - value) * 2) * 255, 0).cast("int")
    return F.when(value.isNotNull(), F.concat(
        F.lit("#"), F.lpad(F.hex(red), 2, "0"), F.lpad(F.hex(green), 2, "0"), F.lit("00")))


def equal_width_bin(df: DataFrame, column: str, bins: int | Column, output: str,
                    group: Sequence[str] = ()) -> DataFrame:
    """Right-closed bins 1..n of equal width between minimum and maximum, per group if given.

    ``bins`` may be a column expression over the group aggregates ``_rows``, ``_lo``
    and ``_hi``. The minimum falls into bin 1; a constant column gives bin 1.
    """
    group = list(group)
    limits = [F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count(column).alias("_rows")]
    if group:
        joined = with_group_values(df, df.groupBy(*group).agg(*limits), group)
    else:
        one = df.agg(F.struct(*limits)).scalar()
        joined = df.select("*", one["_lo"].alias("_lo"), one["_hi"].alias("_hi"),
                           one["_rows"].alias("_rows"))
    n = F.lit(bins) if isinstance(bins, int) else bins
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    number = F.ceil((F.col(column) - F.col("_lo")) / width * n)
    number = F.when(F.col(column).isNotNull(),
                    F.least(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)), n))
    return joined.withColumn(output, number.cast("long")).drop("_lo", "_hi", "_rows")


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Quantiles with linear interpolation between order statistics."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias(column))
    n = values.count()
    if n == 0:
        return [float("nan")] * len(shares)
    places = [(n - 1) * s for s in shares]
    ranks = sorted({int(p) + 1 for p in places} | {min(int(p) + 2, n) for p in places})
    found = values_at_ranks(values, column, ranks)
    out = []
    for p in places:
        low, high = found[int(p) + 1], found[min(int(p) + 2, n)]
        out.append(low + (high - low) * (p - int(p)))
    return out


def break_bin(column: Column, breaks: Sequence[float], include_lowest: bool = False) -> Column:
    """Number of the right-closed interval ``(b[i-1], b[i]]``; outside gives NULL."""
    out = F.lit(None).cast("int")
    for i in range(len(breaks) - 1, 0, -1):
        out = F.when((column > breaks[i - 1]) & (column <= breaks[i]), F.lit(i)).otherwise(out)
    if include_lowest:
        out = F.when(column == breaks[0], F.lit(1)).otherwise(out)
    return out


def quantile_bin(df: DataFrame, column: str, output: str, parts: int = 10,
                 include_lowest: bool = False) -> DataFrame:
    """Bin by exact quantile breaks; the minimum lies in no interval unless asked for."""
    breaks = exact_quantiles(df, column, [i / parts for i in range(parts + 1)])
    return df.withColumn(output, break_bin(F.col(column), breaks, include_lowest))


def scaled_height(df: DataFrame, rate: str, output: str, base: float = 50.0) -> DataFrame:
    """Drawing height: ``rate * (base / smallest positive rate) / largest rate``, at least ``base``."""
    r = F.col(rate)
    one = df.agg(F.struct(F.min(F.when(r > 0, r)).alias("low"), F.max(r).alias("top"))).scalar()
    height = r * (F.lit(base) / one["low"]) / F.nullif(one["top"], F.lit(0.0))
    return df.withColumn(output, clip(height, low=base))


def factor_levels(df: DataFrame, column: str) -> DataFrame:
    """Rows ``(position, level)``: distinct values in sorted order, from 0."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    ranked = row_numbers(levels, [("level", "asc")], "_r")
    return ranked.select((F.col("_r") - 1).alias("position"), "level")


def relabel_levels(df: DataFrame, column: str, labels: Sequence[str], output: str) -> DataFrame:
    """Rename level i (in sorted order) to ``labels[i]``."""
    names = df.sparkSession.createDataFrame(list(enumerate(labels)), "_p long, _label string")
    levels = factor_levels(df, column)
    table = levels.join(F.broadcast(names), levels["position"] == names["_p"], "left")
    side = small_side(table.select(F.col("level").alias("_level"), "_label"))
    return (df.join(side, df[column] == side["_level"], "left")
            .withColumn(output, F.col("_label")).drop("_level", "_label"))


def dense_ids(df: DataFrame, column: str, output: str) -> DataFrame:
    """Table ``(column, output)`` numbering the distinct values 0..n-1 in sorted order."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    ranked = row_numbers(values, [(column, "asc")], "_r")
    return ranked.select(column, (F.col("_r") - 1).alias(output))


def sparse_triplets(df: DataFrame, row: str, col: str) -> DataFrame:
    """Coordinate triplets ``(row_id, col_id, v)`` with ``v`` = 1 for every input row."""
    clean = df.select(row, col).dropna()
    rows, cols = dense_ids(clean, row, "row_id"), dense_ids(clean, col, "col_id")
    out = clean.join(small_side(rows), row).join(small_side(cols), col)
    return out.select("row_id", "col_id", F.lit(1).alias("v"))
