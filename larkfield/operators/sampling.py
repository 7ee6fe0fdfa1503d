"""Samples and splits keyed by a hash of the row id, so they repeat exactly."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.operators.ranking import first_rows, row_numbers
from larkfield.session import small_side


def hash_text(salt: str | Column, key: str) -> Column:
    """Hex digest of salt and key: a random order that any engine can repeat."""
    return F.md5(F.concat_ws("|", salt if isinstance(salt, Column) else F.lit(salt), F.col(key).cast("string")))


def hash_share(salt: str | Column, key: str) -> Column:
    """A number in [0, 1) from salt and key."""
    return F.conv(F.substring(hash_text(salt, key), 1, 8), 16, 10).cast("double") / float(2 ** 32)


def random_sample(df: DataFrame, key: str, share: float, n: int, salt: str = "s") -> DataFrame:
    """At most ``n`` rows in random order out of a random ``share`` of all rows."""
    picked = df.where(hash_share(salt + "/share", key) <= share).withColumn("_h", hash_text(salt, key))
    return first_rows(picked, [("_h", "asc"), (key, "asc")], n).drop("_h")


def top_k_by_score(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` best scores, equal scores by key."""
    return first_rows(df, [(score, "desc"), (key, "asc")], k)


def sample_negatives(df: DataFrame, label: str, key: str, n: int, positive=1, negative=0,
                     others: Sequence = (), salt: str | None = None) -> DataFrame:
    """The first ``n`` negatives (by key, or in random order with a salt) and all positives.

    ``others`` are further label values kept whole, for three-class tables.
    """
    unlabelled = df.where(F.col(label) == F.lit(negative))
    if salt is None:
        picked = first_rows(unlabelled, [(key, "asc")], n)
    else:
        ordered = unlabelled.withColumn("_h", hash_text(salt, key))
        picked = first_rows(ordered, [("_h", "asc"), (key, "asc")], n).drop("_h")
    return picked.unionByName(df.where(F.col(label).isin(positive, *others)))


def hide_positives(df: DataFrame, label: str, key: str, k: int, salt: str, positive=1, negative=0,
                   original: str = "orig_target", with_replacement: bool = False) -> DataFrame:
    """Relabel ``k`` random positives as unlabelled; the true label stays in ``original``.

    With replacement, ``k`` draws are made over the positives and a row drawn twice is
    hidden once, so fewer than ``k`` rows may change.
    """
    keyed = df.where(F.col(label) == F.lit(positive)).select(F.col(key).alias("_key"))
    if with_replacement:
        total = keyed.count()
        draws = df.sparkSession.range(k).select(
            (F.floor(hash_share(salt, "id") * total) + 1).alias("_r")).distinct()
        numbered = row_numbers(keyed, [("_key", "asc")], "_r")
        chosen = numbered.join(small_side(draws), "_r", "left_semi").select("_key")
    else:
        ordered = keyed.withColumn("_h", hash_text(salt, "_key"))
        chosen = first_rows(ordered, [("_h", "asc"), ("_key", "asc")], k).select("_key")
    hit = df.join(small_side(chosen), F.col(key) == F.col("_key"), "left")
    return hit.select(
        *[F.when(F.col("_key").isNotNull(), F.lit(negative)).otherwise(F.col(c))
          .cast(df.schema[c].dataType).alias(c) if c == label else F.col(c) for c in df.columns],
        F.col(label).alias(original))


def split_part(key: str, shares: Sequence[float], salt: str = "split") -> Column:
    """Part number of each row for shares such as 0.8, 0.1; the rest is the last part."""
    u, out = hash_share(salt, key), F.lit(len(shares))
    bounds = []
    total = 0.0
    for s in shares:
        total += s
        bounds.append(total)
    for i in reversed(range(len(shares))):
        out = F.when(u < bounds[i], F.lit(i)).otherwise(out)
    return out


def split_frame(df: DataFrame, key: str, shares: Sequence[float], salt: str = "split") -> list[DataFrame]:
    """Random parts of about the given shares, and the rest."""
    part = split_part(key, shares, salt)
    return [df.where(part == i) for i in range(len(shares) + 1)]


def kfold_column(df: DataFrame, key: str, folds: int, output: str = "fold", salt: str = "fold") -> DataFrame:
    """Fold number 0..folds-1 per row."""
    number = F.conv(F.substring(hash_text(salt, key), 1, 8), 16, 10).cast("long") % folds
    return df.withColumn(output, number.cast("int"))


def time_split(df: DataFrame, day: str, valid_share: float | None = None,
               output: str = "is_valid") -> DataFrame:
    """Mark validation rows: the last calendar month, or about the last share by day.

    The cut falls between days: a day lies wholly on one side.
    """
    if valid_share is None:
        last = df.agg(F.trunc(F.max(F.to_date(day)), "month")).scalar()
        return df.withColumn(output, F.to_date(day) >= last)
    per_day = df.groupBy(F.to_date(day).alias("d")).agg(F.count("*").alias("n"))
    rows = sorted((r["d"], r["n"]) for r in per_day.where("d IS NOT NULL").collect())  # one row per day
    wanted, seen = sum(n for _, n in rows) * valid_share, 0
    cut = dt.date.max
    for d, n in reversed(rows):
        if seen >= wanted:
            break
        cut, seen = d, seen + n
    return df.withColumn(output, F.to_date(day) >= F.lit(cut))


def redistribute(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Hash rows to ``parts`` tasks by key, or evenly without a key."""
    return df.repartition(parts, *keys)


def poisson_weight(salt: str | Column, key: str, rate: float | Column) -> Column:
    """A Poisson draw per row from its hash: how often a bootstrap takes the row.

    Inverts the distribution function. The search goes on until more draws have a chance below
    1e-18, for a rate per row as far as that row's rate asks for. A rate below 0 or NULL gives NULL.
    """
    u = hash_share(salt, key)
    if not isinstance(rate, Column):
        largest = max(20, math.ceil(rate + 10 * math.sqrt(rate) + 20))
        term, bounds = math.exp(-rate), []
        for n in range(largest):
            bounds.append((bounds[-1] if bounds else 0.0) + term)
            term *= rate / (n + 1)
        draw = F.lit(largest)
        for n in reversed(range(largest)):
            draw = F.when(u < bounds[n], n).otherwise(draw)
        return draw
    # chances as logarithms, so that those of large rates do not vanish
    begin = F.struct(F.lit(0).alias("n"), (-rate).alias("log"), F.exp(-rate).alias("sum"), F.lit(False).alias("done"))

    def step(acc: Column, i: Column) -> Column:
        done = acc["done"] | (u < acc["sum"])
        log = acc["log"] + F.ln(rate) - F.ln(i.cast("double"))
        return F.struct(F.when(done, acc["n"]).otherwise(acc["n"] + 1).alias("n"), log.alias("log"),
                        (acc["sum"] + F.exp(log)).alias("sum"), done.alias("done"))

    largest = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    drawn = F.aggregate(F.sequence(F.lit(1), largest), begin, step, lambda acc: acc["n"])
    return F.when(rate == 0, F.lit(0)).when(rate > 0, drawn)
