"""Shards of equal row counts that keep linked documents together, by balanced label propagation.

Documents with the same ``group`` are linked. Linked documents start spread evenly. In every round
each of them counts the labels of its neighbours (a join with the counts of its group) and wants to
move to the commonest label, in every other round to the commonest among the shards that have room;
equal counts go by a hash of the group, so that all neighbours agree and never swap for ever. Between
two shards as many move one way as the other, and more while there is room. Moves are admitted in the
order of a hash of the group, so a quota splits as few groups as it can. After the last round documents without links fill the room that is left. Shard ``k`` of ``n`` holds
``rows // n`` documents and one more if ``k < rows % n``.

Everything is DataFrame functions. Counts of a group are summed over salted parts first and sent
back to the salted parts, so a group with a third of all rows is never in one task. A rank is the
count of all buckets before plus the row number within a bucket; a bucket is a hash of the id.

Defined cases: a null text has size 1, crc 0 and no links; empty texts are linked with each other;
rows that repeat are ranked one by one; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.session import checkpointed

#: Parts that a large group is cut into, and hash buckets that ranks are counted in.
SALTS, BUCKETS, MOVE_BUCKETS = 64, 4096, 1024


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size in bytes plus one, crc of the text, and a group of equal texts."""
    text = docs[text_col]
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("group"))


def _ranked(rows: DataFrame, within: list[str]) -> DataFrame:
    """Add ``rank`` from 0 among rows with equal ``within``, ordered by a hash of the id."""
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = bucketed.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.select(*within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*within, "_bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = bucketed.withColumn("_number", F.row_number().over(inside) - 1)
    joined = numbered.join(F.broadcast(offsets), [*within, "_bucket"])  # at most BUCKETS rows a shard
    return joined.withColumn("rank", (F.col("_before") + F.col("_number")).cast("long")).drop("_bucket", "_before", "_number")


def _linked(base: DataFrame) -> DataFrame:
    """Rows whose group has other members, with the salt that their group is cut by."""
    salted = base.filter(F.col("group").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("group", "salt").agg(F.count("*").alias("n"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1")
    return salted.join(groups.select("group", F.explode("salts").alias("salt")), ["group", "salt"])


def _per_label(shards: int, value: Column) -> list[Column]:
    return [F.sum(F.when(F.col("label") == k, value).otherwise(0)).alias(f"n{k}") for k in range(shards)]


def _commonest(shards: int, among: list[int]) -> Column:
    """The shard of ``among`` with the most neighbours; equal counts are told apart by the group's hash."""
    turned = [F.col(f"n{k}") * shards + F.pmod(F.lit(k) + F.xxhash64("group"), F.lit(shards)) for k in among]
    best = F.greatest(*turned) if len(turned) > 1 else turned[0]
    return F.coalesce(*[F.when(t == best, F.lit(k)) for k, t in zip(among, turned)])


def _admitted(demand: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may move from shard to shard: exchanges first, then into the room that is left."""
    quota = {(s, t): min(n, demand.get((t, s), 0)) for (s, t), n in demand.items()}
    for (s, t), n in sorted(demand.items()):
        more = max(0, min(n - quota[s, t], room[t]))
        quota[s, t] += more
        room[t] -= more
    return quota


def _round(members: DataFrame, shards: int, quota: list[int], only_open: bool) -> tuple[DataFrame, int]:
    """One round of moves; the members with new labels and how many moved."""
    loads = {r.label: r.n for r in members.groupBy("label").agg(F.count("*").alias("n")).collect()}
    room = [quota[k] - loads.get(k, 0) for k in range(shards)]
    among = [k for k in range(shards) if room[k] > 0] if only_open else list(range(shards))
    if not among or not loads:
        return members, 0
    parts = members.groupBy("group", "salt").agg(*_per_label(shards, F.lit(1)))
    counts = [F.sum(f"n{k}").alias(f"n{k}") for k in range(shards)]
    groups = parts.groupBy("group").agg(*counts, F.collect_list("salt").alias("salts"))
    each = F.array(*[F.col(f"n{k}") for k in range(shards)])
    wanted = groups.select("group", F.explode("salts").alias("salt"), _commonest(shards, among).alias("wanted"), each.alias("_n"))
    gains = F.element_at("_n", F.col("wanted") + 1) >= F.element_at("_n", F.col("label") + 1)
    turn = F.pmod(F.xxhash64("group", F.lit("turn")), F.lit(MOVE_BUCKETS)) * SALTS + F.col("salt")
    tried = checkpointed(members.join(wanted, ["group", "salt"]).select(
        *members.columns, F.when(gains & (F.col("wanted") != F.col("label")), F.col("wanted")).alias("wanted"), turn.alias("turn")))
    queue = checkpointed(tried.filter("wanted IS NOT NULL").groupBy("label", "wanted", "turn").agg(F.count("*").alias("n")))
    demand = {(r.label, r.wanted): r.n for r in queue.groupBy("label", "wanted").agg(F.sum("n").alias("n")).collect()}
    allowed = _admitted(demand, room)
    so_far = F.sum("n").over(Window.partitionBy("label", "wanted").orderBy("turn"))
    most = reduce(lambda c, x: F.when((F.col("label") == x[0][0]) & (F.col("wanted") == x[0][1]), x[1]).otherwise(c), allowed.items(), F.lit(0))
    fits = queue.withColumn("end", so_far).filter(F.col("end") <= most)
    last = {(r.label, r.wanted): (r.last, r.n) for r in fits.groupBy("label", "wanted").agg(F.max("turn").alias("last"), F.sum("n").alias("n")).collect()}
    # whole turns may fit one way and not the other: never fill a shard beyond its quota
    _even_out(last, queue, loads, quota)
    goes = reduce(lambda a, b: a | b, [(F.col("label") == s) & (F.col("wanted") == t) & (F.col("turn") <= x) for (s, t), (x, _) in last.items()], F.lit(False))
    moved = tried.withColumn("label", F.when(goes, F.col("wanted")).otherwise(F.col("label"))).drop("wanted", "turn")
    return moved, sum(n for _, n in last.values())


def _even_out(last: dict[tuple[int, int], tuple[int, int]], queue: DataFrame, loads: dict[int, int], quota: list[int]) -> None:
    """Drop flows into shards that would hold more than their quota, since a flow out of them was cut short."""
    while True:
        after = dict(loads)
        for (s, t), (_, n) in last.items():
            after[s] -= n
            after[t] = after.get(t, 0) + n
        over = [k for k, n in after.items() if n > quota[k]]
        if not over:
            return
        into = sorted((flow for flow in last if flow[1] == over[0]), key=lambda f: last[f][1])
        need = after[over[0]] - quota[over[0]]
        flow = next((f for f in into if last[f][1] >= need), into[-1])
        limit = last[flow][1] - need
        so_far = F.sum("n").over(Window.partitionBy("label", "wanted").orderBy("turn"))
        kept = queue.filter((F.col("label") == flow[0]) & (F.col("wanted") == flow[1])).withColumn("end", so_far).filter(
            F.col("end") <= limit).agg(F.max("turn").alias("last"), F.sum("n").alias("n")).first()
        if kept.n:
            last[flow] = (kept.last, kept.n)
        else:
            del last[flow]


def balanced_shards(base: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for rows of ``text_groups`` (or any such groups).

    Row counts of shards differ by one at most. Rounds end early once nothing moves.
    """
    base = checkpointed(base.select("doc_id", "size", "text_crc32", "group"))
    total = base.count()
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    linked = checkpointed(_linked(base))
    members = checkpointed(_ranked(linked, []).withColumn("label", (F.col("rank") % shards).cast("int")).drop("rank"))
    still = 0
    for k in range(rounds):
        members, moved = _round(members, shards, quota, only_open=k % 2 == 0)
        still = 0 if moved else still + 1
        if still == 2:
            break
    members = checkpointed(members)
    loads = {r.label: r.n for r in members.groupBy("label").agg(F.count("*").alias("n")).collect()}
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    placed = _ranked(members, ["label"]).select("doc_id", "size", "text_crc32", F.col("label").alias("shard"), F.col("rank").alias("slot"))
    alone = base.join(linked.select("group", "salt").distinct(), (base["group"] == linked["group"]) & (
        F.pmod(F.xxhash64(base["doc_id"]), F.lit(SALTS)) == linked["salt"]), "left_anti")
    ranked = _ranked(alone, [])
    shard, slot, end = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for k in range(shards):
        load = loads.get(k, 0)
        fits = F.col("rank").between(end, end + quota[k] - load - 1)
        shard, slot = F.when(fits, F.lit(k)).otherwise(shard), F.when(fits, F.col("rank") - end + load).otherwise(slot)
        end += quota[k] - load
    filled = ranked.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    return placed.select(*columns).unionByName(filled)
