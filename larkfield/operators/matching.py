"""Entity matching: nearest spelling, filling gaps by set difference, edges with names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.functions.text import LINE_OVERRIDES
from larkfield.session import checkpointed, small_side

FEW_PAIRS = 5_000_000


def _segments(text: Column, pieces: Column) -> Column:
    """Cut into ``pieces`` parts whose lengths differ by at most one: (start, part)."""
    n = F.length(text)
    base, longer = F.floor(n / pieces).cast("int"), (n % pieces).cast("int")
    shorter = pieces - longer

    def part(i: Column) -> Column:
        # The shorter parts come first.
        start = i * base + F.greatest(i - shorter, F.lit(0))
        size = base + F.when(i >= shorter, 1).otherwise(0)
        return F.struct(start.alias("at"), F.substr(text, start + 1, size).alias("part"))

    return F.transform(F.sequence(F.lit(0), pieces - 1), part)


def _substrings(text: Column, low: Column, high: Column) -> Column:
    """All substrings whose length is between ``low`` and ``high``: (start, part)."""
    n = F.length(text)
    sizes = F.sequence(low, high)
    return F.flatten(F.transform(sizes, lambda s: F.when(
        s <= n, F.transform(F.sequence(F.lit(0), n - s), lambda i: F.struct(
            i.alias("at"), F.substr(text, i + 1, s).alias("part")))).otherwise(F.array())))


def pairs_within(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Pairs ``(a, b, d)`` of distinct texts with edit distance ``d <= k``, without a cross join.

    If ``a`` is cut into ``k + 1`` parts, ``k`` edits leave one part untouched, and it lies
    in ``b`` at most ``k`` places away. So pairs meet by an equi-join on that part. Texts of
    at most ``k`` letters are cut into single letters; pairs of them without a common letter
    are not found here: their distance is the longer length, see ``nearest_texts``.
    """
    a = left.select("a", F.length("a").alias("_la"))
    pieces = F.least(F.lit(k + 1), F.col("_la"))
    parts = a.where("_la > 0").select("a", "_la", F.explode(_segments(F.col("a"), pieces)).alias("_s"))
    b = right.select("b", F.length("b").alias("_lb")).where("_lb > 0")
    # Lengths a part can have for any partner length _lb - k .. _lb + k.
    low = F.greatest(F.floor((F.col("_lb") - k) / (k + 1)).cast("int"), F.lit(1))
    high = F.floor((F.col("_lb") + k + k) / (k + 1)).cast("int")
    pieces_of_b = b.select("b", "_lb", F.explode(
        _substrings(F.col("b"), low, F.greatest(high, low))).alias("_t"))
    met = parts.select("a", "_la", F.col("_s.at").alias("_pa"), F.col("_s.part").alias("_part")).join(
        pieces_of_b.select("b", "_lb", F.col("_t.at").alias("_pb"), F.col("_t.part").alias("_part")),
        "_part")
    near = (F.abs(F.col("_pa") - F.col("_pb")) <= k) & (F.abs(F.col("_la") - F.col("_lb")) <= k)
    candidates = met.where(near).select("a", "b").distinct()
    scored = candidates.select("a", "b", F.levenshtein("a", "b", k).alias("d"))
    return scored.where("d >= 0")


def nearest_texts(left: DataFrame, left_column: str, right: DataFrame, right_column: str,
                  limit: int = 8) -> DataFrame:
    """For each distinct left text its nearest right text: ``(a, match, d)``.

    The smallest edit distance wins, then the first in sorted order. Texts without a right
    text closer than ``limit`` get ``match = ''`` and no distance; an empty left text is
    never matched, and empty right texts are no candidates.

    The search widens step by step: exact matches first, then distance 1, 2, ...; texts
    already matched leave the search, so the loose and costly steps see only what is left.
    """
    # Stored once: the distinct texts are read in every step, the full tables only here.
    texts = checkpointed(left.select(F.col(left_column).alias("a")).where("a IS NOT NULL").distinct())
    names = checkpointed(right.select(F.col(right_column).alias("b")).where("b <> ''").distinct())
    exact = texts.where("a <> ''").join(names, F.col("a") == F.col("b"))
    found = exact.select("a", F.col("b").alias("match"), F.lit(0).alias("d"))
    open_texts = checkpointed(texts.where("a <> ''").join(names, F.col("a") == F.col("b"), "left_anti"))
    # First name in sorted order of each length below the limit: at most limit - 1 rows.
    short = names.groupBy(F.length("b").alias("n")).agg(F.min("b").alias("b"))
    short_names = [r["b"] for r in short.where(F.col("n") < limit).collect()]
    results = [found]
    for k in _widening(limit - 1, open_texts.count() * names.count()):
        if open_texts.isEmpty():
            break
        close = pairs_within(open_texts, names, k)
        # Any two texts are at most the longer length apart; this also covers short texts
        # that share no letter with a name.
        if short_names:
            tried = open_texts.where(F.length("a") <= k).select(
                "a", F.explode(F.array(*[F.lit(b) for b in short_names])).alias("b"))
            replaced = tried.select("a", "b", F.levenshtein("a", "b", k).alias("d")).where("d >= 0")
            close = close.unionByName(replaced)
        best = close.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m"))
        step = checkpointed(best.select("a", F.col("m.b").alias("match"), F.col("m.d").alias("d")))
        results.append(step)
        open_texts = checkpointed(open_texts.join(small_side(step.select("a")), "a", "left_anti"))
    rest = open_texts.unionByName(texts.where("a = ''"))
    out = rest.select("a", F.lit("").alias("match"), F.lit(None).cast("int").alias("d"))
    for r in results:
        out = out.unionByName(r)
    return out


def _widening(last: int, pairs: int) -> list[int]:
    """Distances tried: 1, 3, then the last; with few possible pairs the last at once."""
    if last <= 0:
        return []
    return [last] if pairs <= FEW_PAIRS else sorted({min(1, last), min(3, last), last})


def fuzzy_replace(df: DataFrame, column: str, names: DataFrame, name_column: str, output: str,
                  limit: int = 8, overrides: Mapping[str, str] = LINE_OVERRIDES) -> DataFrame:
    """Add the matched name of every row; ``overrides`` come before the search.

    A text that equals a name keeps it; no match gives an empty text.
    """
    known = F.create_map(*[F.lit(v) for kv in overrides.items() for v in kv]) if overrides else None
    todo = df if not overrides else df.where(~F.col(column).isin(*overrides))
    matches = nearest_texts(todo, column, names, name_column, limit)
    side = small_side(matches.select(F.col("a").alias("_a"), "match"))
    joined = df.join(side, F.col(column) == F.col("_a"), "left")
    value = F.col("match") if known is None else F.coalesce(
        F.try_element_at(known, F.col(column)), F.col("match"))
    return joined.select(*df.columns, value.alias(output))


def impute_by_difference(rows: DataFrame, station: str, line: str, known: DataFrame,
                         known_station: str, known_line: str) -> DataFrame:
    """Fill blank lines: the line known for the station that no other of its rows uses.

    With several lines left the first in sorted order is taken, with none NULL. A station
    with a single row takes its first known line. Anti-joins and a grouped minimum do the
    work, so no station's lines are gathered in one place.
    """
    known = known.select(F.col(known_station).alias("_st"), F.col(known_line).alias("_ln")).distinct()
    used = (rows.where((F.col(line) != "") & F.col(line).isNotNull())
            .select(F.col(station).alias("_st"), F.col(line).alias("_ln")).distinct())
    free = known.join(used, ["_st", "_ln"], "left_anti").groupBy("_st").agg(F.min("_ln").alias("_free"))
    joined = rows.join(small_side(free), F.col(station) == F.col("_st"), "left")
    filled = F.when((F.col(line) == "") | F.col(line).isNull(), F.col("_free")).otherwise(F.col(line))
    return joined.select(*[filled.alias(c) if c == line else F.col(c) for c in rows.columns])


def build_edges(connections: DataFrame, stations: DataFrame) -> DataFrame:
    """Edges with both station names; a change of line is a transfer."""
    def end(n: int) -> DataFrame:
        return small_side(stations.select(F.col("id").alias(f"station{n}"), F.col("name").alias(f"name{n}"),
                                          F.col("line").alias(f"line{n}")))

    joined = connections.join(end(1), "station1").join(end(2), "station2")
    kind = F.when(F.col("line1") != F.col("line2"), "transfer").otherwise(F.col("line1").cast("string"))
    return joined.select("station1", "station2", "name1", "name2", kind.alias("kind"))
