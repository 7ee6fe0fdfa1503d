"""Prefix trie of conversations by hashing fixed-length blocks of turns first.

A node is a distinct sequence of first turns. Its digest is the XOR of the hashes of its turns, each
hashed together with its position, so digests of all prefixes of a conversation are a running XOR and
no task needs a conversation whole. Turns are cut into blocks of ``BLOCK`` positions. Conversations
are grouped by the digests at block ends first; a block that no sibling block shares its start with has the
same members at each of its turns, so its nodes come straight from the group. Only where sibling blocks
diverge are the turn boundaries inside them grouped again.

Sums over subtrees need no walk. Each node is owned by its smallest member; what a conversation owns
is the rest of its path from some depth on. Everything before that depth is a shared turn, so the
saved tokens below a node are the shared turns of its members from its depth on, and its leaves
are its members that end in an own childless node. Both are sums over members, taken by block.

Defined cases: rows without conv_id belong to no conversation; a null turn comes first; turns of equal
number follow by role, then by a hash of the text; null role or text is empty. Rows that repeat are turns
of their own. An empty table gives no rows, not even a root. Texts are only hashed and measured, so very long
ones never leave the scan. Hashes have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.operators.ranking import running
from larkfield.session import checkpointed

#: Turns of a block, blocks of a chunk that a running sum takes in one piece.
BLOCK, CHUNK = 4, 256
#: Conversation ids in one piece of a list that is hashed in order.
_PIECE_IDS = 50_000


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), two hashes and the code points of every turn; texts stay behind."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    slim = turns.filter(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].isNotNull().alias("numbered"), turns["turn"].alias("turn"),
        role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("ha"), F.xxhash64(F.lit(2), role, text).alias("hb"),
        F.length(text).cast("long").alias("points"))
    order = [(c, "asc") for c in ("numbered", "turn", "role", "ha", "hb")]
    return checkpointed(running(checkpointed(slim), order, ["conv_id"], rank="place").select("conv_id", "place", "ha", "hb", "points"))


def conversations_of(numbered: DataFrame) -> DataFrame:
    """conv_id and n_turns."""
    return numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


def with_shared_heads(numbered: DataFrame, family: int = 100, modulus: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from the first conversation of their family.

    Conversation c starts with the first h turns of c - c % ``family``, h being crc32(c as text) % ``modulus``,
    and goes on with its own turns after its first h. Returns (turns, conversations); a turnless
    conversation is in the second only.
    """
    own = conversations_of(numbered).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus)
    own = checkpointed(own.withColumn("base", F.expr(f"conv_id - conv_id % {int(family)}")))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    heads = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = own.join(bases, "base", "left").select("conv_id", "base", "h", heads.alias("head"),
                                                  (heads + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"))
    plan = checkpointed(plan)
    tail = numbered.join(plan.select("conv_id", "h", "head"), "conv_id").filter("place > h").withColumn("place", F.expr("head + place - h"))
    first = numbered.filter(F.col("place") < modulus).withColumnRenamed("conv_id", "base")
    head = first.join(plan.select("conv_id", "base", "head"), "base").filter("place <= head")
    columns = ["conv_id", "place", "ha", "hb", "points"]
    return tail.select(columns).unionByName(head.select(columns)), plan.select("conv_id", "n_turns")


def _blocks(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation and block: digests and code points before it and at each of its turns."""
    rows = turns.join(conversations, "conv_id").select(
        "conv_id", "place", "n_turns", "points", F.xxhash64("ha", "hb", "place").alias("a"), F.xxhash64("hb", "ha", "place").alias("b"),
        F.expr(f"(place - 1) div {BLOCK}").alias("block"), F.expr(f"(place - 1) div {BLOCK * CHUNK}").alias("chunk"))
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.select("conv_id", "chunk", "block", "n_turns", "points", ((F.col("place") - 1) % BLOCK + 1).alias("slot"),
                         F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"),
                         F.sum("points").over(so_far).alias("points_to"), F.col("a").alias("own_a"), F.col("b").alias("own_b"))
    at = lambda c, slot: F.max(F.when(F.col("slot") == slot, F.col(c)))
    before = [at("a", 1).bitwiseXOR(at("own_a", 1)).alias("a0"), at("b", 1).bitwiseXOR(at("own_b", 1)).alias("b0"),
              (at("points_to", 1) - at("points", 1)).alias("before")]
    slots = [at(c, j).alias(f"{n}{j}") for j in range(1, BLOCK + 1) for c, n in (("a", "a"), ("b", "b"), ("points", "p"))]
    blocks = inside.groupBy("conv_id", "chunk", "block").agg(F.max("n_turns").alias("n_turns"), F.max("slot").alias("size"), *before, *slots)
    # Only conversations of more than one chunk carry something over.
    totals = (rows.filter(f"n_turns > {BLOCK * CHUNK}").groupBy("conv_id", "chunk")
              .agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"), F.sum("points").alias("tp")))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "chunk", F.bit_xor("ta").over(earlier).alias("ta"), F.bit_xor("tb").over(earlier).alias("tb"),
                            F.sum("tp").over(earlier).alias("tp")).filter("chunk > 0")
    out = blocks.join(carried, ["conv_id", "chunk"], "left")
    moved = {f"{n}{j}": F.col(f"{n}{j}").bitwiseXOR(F.coalesce(F.col(f"t{n}"), F.lit(0).cast("long"))) for j in range(BLOCK + 1) for n in "ab"}
    return out.withColumns({**moved, "before": F.col("before") + F.coalesce("tp", F.lit(0))}).drop("chunk", "ta", "tb", "tp")


#: What tells one block from another, and what follows from that.
_KEY = ["block", "size", "a0", "b0", "end_a", "end_b"]
_SLOTS = [f"{n}{j}" for j in range(1, BLOCK + 1) for n in "abp"]
_NODE = ["depth", "a", "b"]


def _keyed(blocks: DataFrame) -> DataFrame:
    end = lambda n: F.coalesce(*[F.col(f"{n}{j}") for j in range(BLOCK, 0, -1)])
    return blocks.withColumns({"end_a": end("a"), "end_b": end("b")})


def _block_groups(blocks: DataFrame) -> DataFrame:
    """Distinct blocks with their members; ``alone`` if no other block starts at the same node."""
    groups = checkpointed(blocks.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
                                                    *[F.first(c).alias(c) for c in _SLOTS]))
    siblings = groups.groupBy("block", "a0", "b0").agg((F.count(F.lit(1)) == 1).alias("alone"))
    return groups.join(siblings, ["block", "a0", "b0"])


def _nodes(groups: DataFrame, sums: dict[str, list[str]]) -> DataFrame:
    """Nodes at every turn of the blocks; blocks that stand alone need no grouping.

    ``sums`` maps an output column to the input column of each slot.
    """
    def slot(j: int) -> Column:
        fields = [(F.col("block") * BLOCK + j).alias("depth"), F.col(f"a{j}").alias("a"), F.col(f"b{j}").alias("b"),
                  F.col(f"a{j - 1}").alias("parent_a"), F.col(f"b{j - 1}").alias("parent_b"), "n_convs", "conv_id"]
        return F.struct(*fields, *[F.col(c[j - 1]).alias(n) for n, c in sums.items()])

    turns = F.slice(F.array(*[slot(j) for j in range(1, BLOCK + 1)]), F.lit(1), F.col("size"))
    straight = groups.filter("alone").select(F.inline(turns))
    apart = groups.filter("not alone").select(F.inline(turns)).groupBy(*_NODE).agg(
        F.first("parent_a").alias("parent_a"), F.first("parent_b").alias("parent_b"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), *[F.sum(n).alias(n) for n in sums])
    return straight.unionByName(apart)


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids of the conversations that end at each node, in numeric order.

    Ids are spread by ranges of (node, id) and joined to texts there, so a node where a third of all
    conversations end is a few long texts by the time one task streams them through the hash.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece() -> pa.RecordBatch:
            columns = [[node[0]], [node[1]], [node[2]], [ids[0]], [",".join(map(str, ids))]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["depth", "a", "b", "first", "text"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("depth", "a", "b", "conv_id")]
            for depth, a, b, conv in zip(*columns):
                if node != (depth, a, b) or len(ids) >= _PIECE_IDS:
                    if ids:
                        yield piece()
                    node, ids = (depth, a, b), []
                ids.append(conv)
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, {"depth": [], "a": [], "b": [], "ends_sha256": []}

        def finish() -> None:
            for name, value in zip(done, (*node, state.hexdigest())):
                done[name].append(value)

        for batch in batches:
            for depth, a, b, text in zip(*[batch.column(c).to_pylist() for c in ("depth", "a", "b", "text")]):
                if node == (depth, a, b):
                    state.update(b"," + text.encode())
                    continue
                if node is not None:
                    finish()
                node, state = (depth, a, b), hashlib.sha256(text.encode())
            if done["a"]:
                yield pa.RecordBatch.from_pydict(done)
                done = {name: [] for name in done}
        if node is not None:
            finish()
            yield pa.RecordBatch.from_pydict(done)

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ends.repartitionByRange(n, *_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    pieces = spread.mapInArrow(joined, "depth long, a long, b long, first long, text string")
    return pieces.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie.

    ``turns``: conv_id, place (gapless from 1), ha, hb, points, as ``numbered_turns`` gives them;
    ``conversations``: conv_id, n_turns, those without turns included. Columns: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and
    the node's digest (digest_a, digest_b).
    """
    blocks = checkpointed(_keyed(_blocks(turns, conversations)))
    groups = checkpointed(_block_groups(blocks))
    shape = checkpointed(_nodes(groups, {}))
    parent = [F.expr("depth - 1").alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")]
    children = checkpointed(shape.select(*parent).groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_children")))
    top = conversations.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).first()

    # Per conversation: the depth from which it owns its path, and whether it owns a leaf.
    owned = shape.groupBy("conv_id").agg(F.min("depth").alias("own_from"))
    leaf = shape.join(children, _NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    marked = blocks.join(owned, "conv_id", "left").join(leaf, "conv_id", "left")
    marked = marked.withColumn("own_from", F.coalesce("own_from", F.col("n_turns") + 1))
    turning = F.expr(f"block = least(own_from - 1, n_turns - 1) div {BLOCK}")
    shared = F.col("before")
    for j in range(1, BLOCK + 1):
        here = F.col("block") * BLOCK + j
        shared = shared + F.when((here < F.col("own_from")) & (F.col("size") >= j), F.col(f"p{j}")).otherwise(0)
    marked = checkpointed(marked)
    shared_points = marked.filter(turning).select("conv_id", shared.alias("shared"))
    spent, saved = F.col("before"), []
    for j in range(1, BLOCK + 1):
        depth = F.col("block") * BLOCK + j
        saved.append(F.sum(F.when(F.col("own_from") > depth, F.col("shared") - spent).otherwise(0)).alias(f"s{j}"))
        spent = spent + F.coalesce(F.col(f"p{j}"), F.lit(0))
    sums = marked.join(shared_points, "conv_id").groupBy(*_KEY).agg(*saved, F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"))
    same = F.lit(True)
    for c in _KEY:
        same = same & (groups[c] == sums[c])
    both = groups.join(sums, same).select(groups["*"], *[f"s{j}" for j in range(1, BLOCK + 1)], "leaves")
    nodes = checkpointed(_nodes(both, {"saved_tokens": [f"s{j}" for j in range(1, BLOCK + 1)], "n_leaves": ["leaves"] * BLOCK}))

    zero = F.lit(0).cast("long")
    last = blocks.filter(f"block = (n_turns - 1) div {BLOCK}").select("conv_id", F.col("n_turns").alias("depth"), F.col("end_a").alias("a"), F.col("end_b").alias("b"))
    turnless = conversations.filter("n_turns = 0").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    digests = _end_digests(last.unionByName(turnless))

    total = nodes.filter("depth = 1").agg(F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"))
    root = total.filter(F.lit(top["n_convs"] > 0)).select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("parent_a"), zero.alias("parent_b"),
        F.lit(top["n_convs"]).alias("n_convs"), F.lit(top["conv_id"]).cast("long").alias("conv_id"), "saved_tokens", "n_leaves")
    every = nodes.unionByName(root)
    upper = shape.join(children, _NODE).select(*_NODE, F.col("conv_id").alias("upper"))  # nodes that have children
    found = (every.join(children, _NODE, "left").join(digests, _NODE, "left")
             .withColumn("up", F.when(F.col("depth") > 1, F.col("depth") - 1))
             .join(upper.select(F.col("depth").alias("up"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), "upper"),
                   ["up", "parent_a", "parent_b"], "left"))
    above = F.when(F.col("depth") == 1, F.lit(top["conv_id"]).cast("long")).when(F.col("depth") > 1, F.col("upper"))
    return found.select("conv_id", "depth", above.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
                        F.col("a").alias("digest_a"), F.col("b").alias("digest_b"))
