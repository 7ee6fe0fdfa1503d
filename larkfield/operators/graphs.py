"""Components and totals of a network given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.session import checkpointed


def connected_components(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest node that can be reached; direction does not count.

    Each round ties a node to the smallest label among its own and its neighbours', then follows the labels
    once, so the reach doubles and a long line takes few rounds. Ends that are no nodes become nodes; NULL ends and
    loops tie nothing. A node with very many neighbours is an ordinary partial aggregation.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = checkpointed(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    ids = nodes.select(F.col(node).alias("x")).where("x IS NOT NULL").unionByName(both.select("x")).distinct()
    state = checkpointed(ids.withColumn("label", F.col("x")))
    for _ in range(most_rounds):
        of = state.select(F.col("x").alias("y"), F.col("label").alias("near"))
        # a neighbour's label goes to the node and to the node's own label, so whole trees are tied at once
        told = both.join(of, "y").select("x", "near").join(state, "x")
        hooks = told.where("near < label").select(F.col("label").alias("x"), "near").unionByName(told.where("near < label").select("x", "near"))
        best = hooks.groupBy("x").agg(F.min("near").alias("near"))
        tied = checkpointed(state.join(best, "x", "left").select("x", F.least("label", F.coalesce("near", "label")).alias("label")))
        up = tied.select(F.col("x").alias("label"), F.col("label").alias("up"))
        jumped = tied.join(up, "label").select("x", F.col("up").alias("label"))
        before = state.select("x", F.col("label").alias("old"))
        state = checkpointed(jumped.join(before, "x").select("x", "label", (F.col("label") != F.col("old")).alias("moved")))
        if not state.agg(F.count_if("moved")).first()[0]:
            break
        state = state.select("x", "label")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return state.select(F.col("x").alias(node), F.col("label").alias("component"))


def network_totals(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per component of the station graph, and one for the whole network (``component`` NULL).

    ``stations`` is the result of ``node_stats`` (id, line, total_traffic, user_count); ``edges(station1, station2)``.
    Columns: component (smallest station id), stations, lines, connections (distinct pairs, loops aside),
    total_traffic, user_count, ends (stations with one connection), most_connected (the most connections of a station).
    """
    pair = edges.where("station1 <> station2").select(F.least("station1", "station2").alias("station1"), F.greatest("station1", "station2").alias("station2")).distinct()
    pair = checkpointed(pair.join(stations.select(F.col("id").alias("station1")), "station1", "left_semi")
                        .join(stations.select(F.col("id").alias("station2")), "station2", "left_semi"))
    comps = connected_components(stations, pair, "id", "station1", "station2")
    degree = pair.select(F.explode(F.array("station1", "station2")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    known = stations.select("id", "line", "total_traffic", "user_count").join(comps, "id").join(degree, "id", "left")
    links = F.coalesce("links", F.lit(0))
    # every connection is counted at both its ends
    totals = known.groupingSets([["component"], []], "component").agg(
        F.count("*").alias("stations"), F.count_distinct("line").alias("lines"), (F.sum(links) / 2).cast("long").alias("connections"),
        F.sum("total_traffic").alias("total_traffic"), F.sum("user_count").alias("user_count"),
        F.count_if(links == 1).alias("ends"), F.max(links).alias("most_connected"))
    return totals.where("stations > 0")
