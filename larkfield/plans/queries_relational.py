"""Joins, aggregations, sets, reshaping, sampling and matching."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from larkfield.operators import aggregates as agg
from larkfield.operators import graphs
from larkfield.operators import joins, matching, reshape, sampling
from larkfield.lookalike.bagging import Draw
from larkfield.operators.ranking import first_rows
from larkfield.functions.text import lookup_or_keep
from larkfield.plans import extracts
from larkfield.plans.registry import query
from larkfield.session import small_side

# --- joins --------------------------------------------------------------------------------


@query("inner_equi_join", """
SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def inner_equi_join(t):
    n, r, s = t.nation, t.region, t.supplier
    return (s.join(n, s["s_nationkey"] == n["n_nationkey"])
            .join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "n_name", "r_name"))


@query("left_join_multi_key", """
SELECT c.c_custkey, c.c_nationkey AS line, s.s_suppkey, c.c_name AS name_x, s.s_name AS name_y
FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey
""")
def left_join_multi_key(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("line"), F.col("c_name").alias("name_x"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("s_line"), F.col("s_name").alias("name_y"))
    return c.join(s, (c["c_custkey"] == s["s_suppkey"]) & (c["line"] == s["s_line"]), "left").drop("s_line")


@query("semi_join", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def semi_join(t):
    c = t.customer.where("c_mktsegment = 'BUILDING'")
    o = t.orders.select("o_orderkey", "o_custkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi")


@query("scalar_subquery", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = (SELECT max(c_custkey) FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)))
""")
def scalar_subquery(t):
    c = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    richest = t.customer.where(F.col("c_acctbal") == c.agg(F.max("c_acctbal")).scalar())
    key = richest.agg(F.max("c_custkey")).scalar()
    return t.orders.where(F.col("o_custkey") == key).select("o_orderkey", "o_totalprice")


@query("range_join", """
WITH z AS (SELECT range AS zone, range * 10000.0 AS lo, (range + 1) * 10000.0 AS hi FROM range(0, 60)),
 p AS (SELECT o_orderkey, round(o_totalprice, -3) AS x FROM orders)
SELECT o_orderkey, zone FROM p JOIN z ON x BETWEEN lo AND hi
""")
def range_join(t):
    zones = t.spark.range(0, 60).select(F.col("id").alias("zone"), (F.col("id") * 10000.0).alias("lo"),
                                        ((F.col("id") + 1) * 10000.0).alias("hi"))
    points = t.orders.select("o_orderkey", F.round("o_totalprice", -3).alias("x"))
    return joins.range_join(points, "x", zones, "lo", "hi", 10000.0).select("o_orderkey", "zone")


@query("one_row_reference", """
SELECT c_custkey, c_acctbal - (SELECT avg_bal FROM (SELECT round(avg(s_acctbal), 4) AS avg_bal, count(*) AS n FROM supplier)) AS above,
 (SELECT count(*) FROM supplier) AS n FROM customer
""")
def one_row_reference(t):
    ref = t.supplier.agg(F.struct(F.round(F.avg("s_acctbal"), 4).alias("avg_bal"),
                                  F.count("*").alias("n"))).scalar()
    return t.customer.select("c_custkey", (F.col("c_acctbal") - ref["avg_bal"]).alias("above"),
                             ref["n"].alias("n"))


@query("lateral_table_function", """
SELECT p_partkey, unnest(range(p_size // 10, p_size // 10 + 3)) AS cell FROM part
""")
def lateral_table_function(t):
    first = F.floor(F.col("p_size") / 10)
    return t.part.select("p_partkey", F.explode(F.sequence(first, first + 2)).alias("cell"))


@query("skewed_join", """
SELECT l_orderkey, l_suppkey, s_name, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey FROM lineitem)
JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
""")
def skewed_join(t):
    """A third of the rows share one supplier; they are spread over several tasks."""
    supp = F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(F.col("l_suppkey"))
    items = t.lineitem.select("l_orderkey", "l_linenumber", supp.cast("long").alias("l_suppkey"))
    right = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    joined = joins.salted_join(items, right, ["l_suppkey"], min_rows=5000)
    return joined.groupBy("l_orderkey", "l_suppkey", "s_name").agg(F.count("*").alias("n"))


@query("lookup_or_keep", """
SELECT p_partkey, coalesce(CAST(n_nationkey AS VARCHAR), p_brand) AS line, n_nationkey IS NOT NULL AS line_found
FROM part LEFT JOIN nation ON p_brand = replace(n_name, 'NATION_', 'Brand#')
""")
def lookup_or_keep_query(t):
    lookup = t.nation.select(F.regexp_replace("n_name", "NATION_", "Brand#").alias("k"), "n_nationkey")
    return lookup_or_keep(t.part.select("p_partkey", "p_brand"), "p_brand", lookup, "k", "n_nationkey",
                          "line").select("p_partkey", "line", "line_found")


@query("column_bind", """
SELECT o_orderkey, o_totalprice, round(o_totalprice / 500000.0, 8) AS p1, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS orig_target FROM orders
""")
def column_bind(t):
    """Prediction and label beside the frame: bound by id, never by position."""
    predicted = t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 500000.0, 8).alias("p1"),
                                (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("orig_target")).orderBy("p1")
    return joins.bind_columns(t.orders.select("o_orderkey", "o_totalprice"), predicted, "o_orderkey")


CONTACT_SQL = "'8' || lpad(CAST(o_orderkey % 500 AS STRING), 10, '0')"


def _usage(t, billing: bool):
    rows = t.orders.where("o_orderstatus = 'F'" if billing else "o_orderstatus <> 'F'")
    return rows.select(
        F.col("o_custkey").alias("subs_id"), (F.col("o_orderkey") % 3).cast("int").alias("usage_type_id"),
        F.expr(CONTACT_SQL).alias("a_number"), F.concat(F.lit("x"), F.col("o_orderkey")).alias("b_number"),
        (F.col("o_orderkey") % 7).cast("int").alias("traffic_type_id"),
        F.col("o_orderdate").cast("date").alias("start_date"))


@query("multi_batch_window_join", f"""
WITH months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders),
 batches AS (SELECT DISTINCT c_custkey AS subs_id, d AS report_date FROM customer JOIN months ON c_nationkey % 12 + 1 = month(d)),
 usage AS (SELECT o_custkey AS subs_id, CAST(o_orderdate AS DATE) AS start_date, o_orderkey % 7 AS traffic_type,
  CASE WHEN o_orderkey % 3 = 2 THEN {CONTACT_SQL} ELSE 'x' || o_orderkey END AS contact FROM orders),
 nums AS (SELECT '8' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS msisdn FROM part WHERE p_size < 25)
SELECT DISTINCT u.subs_id, b.report_date, CASE WHEN regexp_matches(u.contact, '^([0-9]{{11}}|[0-9]{{14}})$') THEN '7' || right(u.contact, 10) ELSE u.contact END AS contact, 'b1' AS batchname
FROM usage u JOIN batches b ON u.subs_id = b.subs_id AND u.start_date <= b.report_date - 1 AND u.start_date >= b.report_date - 181
WHERE u.traffic_type IN (1, 2, 3) AND u.contact IN (SELECT msisdn FROM nums)
""")
def multi_batch_window_join(t):
    months = t.orders.select(F.trunc("o_orderdate", "month").alias("report_date")).distinct()
    months = months.withColumn("m", F.month("report_date"))
    batches = t.customer.select(F.col("c_custkey").alias("subs_id"), (F.col("c_nationkey") % 12 + 1).alias("m"))
    batches = batches.join(small_side(months), "m").select("subs_id", "report_date")
    numbers = t.part.where("p_size < 25").select(
        F.concat(F.lit("8"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("msisdn"))
    return extracts.contact_list([_usage(t, False), _usage(t, True)], batches, numbers, batch_name="b1",
                                 offset=1, depth=180)


# --- matching -----------------------------------------------------------------------------


@query("fuzzy_nearest_join", """
WITH l AS (SELECT DISTINCT replace(p_name, 'i', 'e') AS a FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT ''),
 r AS (SELECT DISTINCT p_type AS b FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT p_brand FROM part),
 d AS (SELECT a, b, levenshtein(a, b) AS d, row_number() OVER (PARTITION BY a ORDER BY levenshtein(a, b), b) AS k FROM l, r)
SELECT a, CASE WHEN d < 8 AND a <> '' THEN b ELSE '' END AS match, CAST(CASE WHEN d < 8 AND a <> '' THEN d END AS INTEGER) AS d FROM d WHERE k = 1
""")
def fuzzy_nearest_join(t):
    p = t.part
    left = p.select(F.regexp_replace("p_name", "i", "e").alias("a")).union(p.select(F.lower("p_type")))
    left = left.union(p.select(F.lit("")))
    right = p.select(F.col("p_type").alias("b")).union(p.select("p_name")).union(p.select("p_brand"))
    return matching.nearest_texts(left, "a", right, "b")


@query("fuzzy_replace", """
WITH l AS (SELECT DISTINCT lower(n_name) AS a FROM nation), r AS (SELECT DISTINCT p_brand AS b FROM part UNION SELECT DISTINCT n_name FROM nation),
 d AS (SELECT a, b, levenshtein(a, b) AS d, row_number() OVER (PARTITION BY a ORDER BY levenshtein(a, b), b) AS k FROM l, r)
SELECT c_custkey, CASE WHEN a = 'nation_3' THEN 'THIRD' WHEN d < 8 THEN b ELSE '' END AS line
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN d ON a = lower(n_name) AND k = 1
""")
def fuzzy_replace(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.lower("n_name").alias("raw"))
    names = t.part.select(F.col("p_brand").alias("b")).union(t.nation.select("n_name"))
    return matching.fuzzy_replace(rows, "raw", names, "b", "line", overrides={"nation_3": "THIRD"}).select(
        "c_custkey", "line")


@query("impute_by_difference", """
WITH rows AS (SELECT s_suppkey, s_nationkey AS station, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'line' || (s_suppkey % 5) END AS line FROM supplier),
 known AS (SELECT DISTINCT c_nationkey AS station, 'line' || (c_custkey % 7) AS line FROM customer),
 free AS (SELECT station, min(line) AS line FROM (SELECT * FROM known EXCEPT SELECT DISTINCT station, line FROM rows WHERE line <> '') GROUP BY station)
SELECT s_suppkey, r.station, CASE WHEN r.line = '' THEN f.line ELSE r.line END AS line FROM rows r LEFT JOIN free f ON r.station = f.station
""")
def impute_by_difference(t):
    key = F.col("s_suppkey")
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("station"), F.when(
        key % 2 == 0, "").otherwise(F.concat(F.lit("line"), key % 5)).alias("line"))
    known = t.customer.select(F.col("c_nationkey").alias("ks"),
                              F.concat(F.lit("line"), F.col("c_custkey") % 7).alias("kl"))
    return matching.impute_by_difference(rows, "station", "line", known, "ks", "kl")


@query("edge_build", """
WITH e AS (SELECT DISTINCT s_nationkey AS station1, c_nationkey AS station2 FROM supplier JOIN customer ON s_suppkey = c_custkey)
SELECT station1, station2, a.n_name AS name1, b.n_name AS name2,
 CASE WHEN a.n_regionkey <> b.n_regionkey THEN 'transfer' ELSE CAST(a.n_regionkey AS VARCHAR) END AS kind
FROM e JOIN nation a ON station1 = a.n_nationkey JOIN nation b ON station2 = b.n_nationkey
""")
def edge_build(t):
    edges = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey")).select(
        F.col("s_nationkey").alias("station1"), F.col("c_nationkey").alias("station2")).distinct()
    nodes = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                            F.col("n_regionkey").alias("line"))
    return matching.build_edges(edges, nodes)


# --- aggregations -------------------------------------------------------------------------


@query("group_max_ordered", """
SELECT l_suppkey, max(l_extendedprice) AS most FROM lineitem GROUP BY 1 ORDER BY 2 DESC
""")
def group_max_ordered(t):
    return agg.group_max_ordered(t.lineitem, ["l_suppkey"], "l_extendedprice", "most")


@query("skew_report", """
WITH u AS (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) * 1048576 AS bytes FROM lineitem GROUP BY ALL),
 s AS (SELECT l_returnflag, l_linestatus, sum(bytes) AS total, max(bytes) AS top, avg(bytes) AS mean, max((bytes, l_suppkey)) AS best FROM u GROUP BY ALL)
SELECT l_returnflag, l_linestatus, CAST(round(total / 1073741824.0, 2) AS DOUBLE) AS "current", CAST(round(top / 1073741824.0 * 100, 2) AS DOUBLE) AS skewed,
 CAST(round(round(top / 1073741824.0 * 100, 2) - round(total / 1073741824.0, 2), 2) AS DOUBLE) AS wasted, best[2] AS skew_unit,
 CAST(round(top / mean, 2) AS DOUBLE) AS skew_factor, CAST(round(100 - mean / top * 100, 0) AS DOUBLE) AS skew_percent FROM s
""")
def skew_report(t):
    units = t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(
        (F.count("*") * 1048576).alias("bytes"))
    out = agg.skew_report(units, ["l_returnflag", "l_linestatus"], "l_suppkey", "bytes", 100)
    numbers = ["current", "skewed", "wasted", "skew_factor", "skew_percent"]
    return out.select("l_returnflag", "l_linestatus", "skew_unit",
                      *[F.col(c).cast("double").alias(c) for c in numbers])


@query("partition_max", """
SELECT o_orderkey, o_totalprice = max(o_totalprice) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS is_top FROM orders
""")
def partition_max(t):
    return agg.mark_group_maximum(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"),
                                  ["o_orderstatus", "o_orderpriority"], "o_totalprice", "is_top").select(
        "o_orderkey", "is_top")


@query("group_dedupe", """
SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem
""")
def group_dedupe(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("value_counts", """
SELECT event_type, count(*) AS n FROM events GROUP BY 1
""")
def value_counts(t):
    return agg.value_counts(t.events, ["event_type"])


@query("group_mean_null_policy", """
WITH d AS (SELECT d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, source, CASE WHEN count(*) = count(quality) THEN round(avg(quality), 8) END AS mean_all, round(avg(quality), 8) AS mean_ignore FROM d GROUP BY ALL
""")
def group_mean_null_policy(t):
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    strict = agg.group_mean(joined, ["lang", "source"], "quality", "mean_all", "all")
    loose = agg.group_mean(joined, ["lang", "source"], "quality", "mean_ignore")
    return strict.join(loose, ["lang", "source"]).select(
        "lang", "source", F.round("mean_all", 8).alias("mean_all"), F.round("mean_ignore", 8).alias("mean_ignore"))


@query("describe", """
SELECT 'l_quantity' AS column_name, count(*) AS n_rows, count(*) - count(l_quantity) AS nulls, min(l_quantity) AS smallest, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS largest FROM lineitem
UNION ALL SELECT 'l_discount', count(*), count(*) - count(l_discount), min(l_discount), round(avg(l_discount), 6), max(l_discount) FROM lineitem
""")
def describe(t):
    return agg.describe(t.lineitem, ["l_quantity", "l_discount"]).withColumn("mean", F.round("mean", 6))


@query("conditional_min_max", """
SELECT min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS low, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS high FROM orders
""")
def conditional_min_max(t):
    return agg.conditional_min_max(t.orders, F.col("o_orderpriority") == "1-URGENT", "o_totalprice")


@query("class_balance", """
SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality <> 1) AS negatives,
 count(*) FILTER (quality <> 1) / count(*) FILTER (quality = 1) AS pos_weight FROM labels
""")
def class_balance(t):
    return agg.class_balance(t.labels, "quality")


@query("first_of_each", """
SELECT l_quantity, min(l_orderkey) AS l_orderkey, min(l_partkey) AS first_part FROM
 (SELECT l_quantity, l_orderkey, l_partkey, rank() OVER (PARTITION BY l_quantity ORDER BY l_orderkey, l_partkey) AS k FROM lineitem) WHERE k = 1 GROUP BY 1
""")
def first_of_each(t):
    rows = t.lineitem.withColumn("at", F.struct("l_orderkey", "l_partkey"))
    out = agg.first_of_each(rows, "l_quantity", "at", {"first_part": "l_partkey"})
    return out.select("l_quantity", F.col("at.l_orderkey").alias("l_orderkey"), "first_part")


STOPS_SQL = """SELECT l_suppkey AS route, CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS pt, l_partkey, l_quantity,
 l_extendedprice FROM lineitem"""
STOP_TIE = ["l_partkey", "l_quantity", "l_extendedprice"]


def _stops(t):
    return t.lineitem.select(F.col("l_suppkey").alias("route"),
                             (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pt"),
                             "l_partkey", "l_quantity", "l_extendedprice")


@query("lead_pairs", f"""
WITH s AS ({STOPS_SQL})
SELECT route, pt, l_partkey, lead(pt) OVER w AS next_pt, lead(l_partkey) OVER w AS next_l_partkey FROM s
WINDOW w AS (PARTITION BY route ORDER BY pt, l_partkey, l_quantity, l_extendedprice)
""")
def lead_pairs(t):
    out = agg.stop_pairs(_stops(t), "route", "pt", ["pt", "l_partkey"], STOP_TIE)
    return out.select("route", "pt", "l_partkey", "next_pt", "next_l_partkey")


@query("route_totals", f"""
WITH s AS ({STOPS_SQL}),
 k AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY pt, l_partkey, l_quantity, l_extendedprice) AS a,
  row_number() OVER (PARTITION BY route ORDER BY pt DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS z FROM s)
SELECT route, round(sum(l_extendedprice), 2) AS distance, round(sum(CASE WHEN z > 1 THEN l_extendedprice ELSE 0 END), 2) AS proper_distance,
 round((sum(l_quantity) + sum(CASE WHEN a > 1 THEN l_partkey % 4 * 1800 ELSE 0 END)) / 3600.0, 6) AS duration, count(*) AS legs FROM k GROUP BY route
""")
def route_totals(t):
    legs = _stops(t).withColumn("wait", F.col("l_partkey") % 4)
    out = agg.route_totals(legs, "route", "pt", "l_quantity", "l_extendedprice", "wait", STOP_TIE)
    return out.select("route", F.round("distance", 2).alias("distance"),
                      F.round("proper_distance", 2).alias("proper_distance"),
                      F.round("duration", 6).alias("duration"), "legs")


@query("collect_ordered", f"""
WITH s AS ({STOPS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY pt, l_partkey, l_quantity, l_extendedprice) - 1 AS p FROM s)
SELECT route, p // 100 AS chunk_no, list(l_partkey ORDER BY p) AS parts FROM r GROUP BY ALL
""")
def collect_ordered(t):
    order = [("pt", "asc"), *[(c, "asc") for c in STOP_TIE]]
    return reshape.collect_ordered(_stops(t), ["route"], order, "l_partkey", "parts", chunk=100)


@query("node_stats", """
WITH st AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS line FROM nation),
 tr AS (SELECT n_name AS name, n_regionkey AS line, sum(c_custkey) AS total_traffic, count(*) AS user_count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
 e AS (SELECT s_nationkey AS a, CAST(s_suppkey % 25 AS INTEGER) AS b FROM supplier), dg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
SELECT st.id, st.name, st.line, coalesce(CAST(total_traffic AS BIGINT), 0) AS total_traffic, coalesce(CAST(user_count AS BIGINT), 0) AS user_count, coalesce(degree, 0) AS degree
FROM st LEFT JOIN tr ON st.name = tr.name AND st.line = tr.line LEFT JOIN dg ON dg.id = st.id
""")
def node_stats(t):
    return agg.node_stats(*_station_network(t))


def _station_network(t):
    """Nations as stations, customers as their traffic, suppliers as connections."""
    stations = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                               F.col("n_regionkey").alias("line"))
    traffic = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("name"), F.col("n_regionkey").alias("line"),
        F.col("c_custkey").alias("total_traffic"), F.lit(1).alias("user_count"))
    edges = t.supplier.select(F.col("s_nationkey").alias("station1"),
                              (F.col("s_suppkey") % 25).cast("int").alias("station2"))
    return stations, traffic, edges


@query("network_totals", """
WITH RECURSIVE st AS (SELECT c_custkey AS id, c_nationkey AS line FROM customer),
 e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT o_custkey AS a, ((o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer)) + 1 AS b FROM orders WHERE o_orderkey % 12 = 0) x
  WHERE a <> b AND a IN (SELECT id FROM st) AND b IN (SELECT id FROM st)),
 ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 reach AS (SELECT id AS x, id AS y FROM st UNION SELECT reach.x, ways.b FROM reach JOIN ways ON ways.a = reach.y),
 comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY 1),
 dg AS (SELECT a AS id, count(*) AS links FROM ways GROUP BY 1),
 tr AS (SELECT o_custkey AS id, count(*) AS n, sum(o_orderkey) AS k FROM orders GROUP BY 1),
 k AS (SELECT st.id, line, component, coalesce(links, 0) AS links, coalesce(n, 0) AS users, coalesce(k, 0) AS traffic FROM st JOIN comp USING (id) LEFT JOIN dg ON dg.id = st.id LEFT JOIN tr ON tr.id = st.id)
SELECT component, count(*) AS stations, count(DISTINCT line) AS lines, CAST(sum(links) // 2 AS BIGINT) AS connections, CAST(sum(traffic) AS BIGINT) AS total_traffic,
 CAST(sum(users) AS BIGINT) AS user_count, count(*) FILTER (links = 1) AS ends, max(links) AS most_connected FROM k GROUP BY GROUPING SETS ((component), ())
""")
def network_totals(t):
    """Customers as stations in a sparse network of their orders: totals of every part and of the whole."""
    stations = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("line"))
    traffic = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("name"), F.col("c_nationkey").alias("line"), F.col("o_orderkey").alias("total_traffic"), F.lit(1).alias("user_count"))
    n = t.customer.count()
    edges = t.orders.where("o_orderkey % 12 = 0").select(F.col("o_custkey").alias("station1"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % n + 1).alias("station2"))
    return graphs.network_totals(agg.node_stats(stations, traffic, edges), edges)


# --- sets, reshaping, order ---------------------------------------------------------------


@query("union_all", """
SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier
""")
def union_all(t):
    return reshape.union_all(t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")),
                             t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation")))


@query("intersect_distinct", """
SELECT o_custkey AS id FROM orders INTERSECT SELECT l_partkey FROM lineitem
""")
def intersect_distinct(t):
    return reshape.intersect_distinct(t.orders.select(F.col("o_custkey").alias("id")),
                                      t.lineitem.select(F.col("l_partkey").alias("id")))


@query("except_distinct", """
SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders
""")
def except_distinct(t):
    return reshape.except_distinct(t.customer.select(F.col("c_custkey").alias("id")),
                                   t.orders.select(F.col("o_custkey").alias("id")))


LONG_SQL = """WITH d AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, 'lang' AS var_name, lang AS var_value FROM d UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR) FROM d
UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM d"""


def _labelled(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


@query("wide_to_long", LONG_SQL)
def wide_to_long(t):
    return reshape.wide_to_long(_labelled(t), ["doc_id"], ["lang", "quality", "toxic"])


@query("explode_map", LONG_SQL)
def explode_map(t):
    wide = reshape.wide_to_map(_labelled(t), ["doc_id"], ["lang", "quality", "toxic"])
    return reshape.explode_map(wide, ["doc_id"], "var_map")


@query("explode_array", """
SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations
""")
def explode_array(t):
    return t.conversations.select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))


@query("order_by", """
SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey
""")
def order_by(t):
    return t.part.select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey")


@query("limit_top_n", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50
""")
def limit_top_n(t):
    return first_rows(t.orders.select("o_orderkey", "o_totalprice"),
                      [("o_totalprice", "desc"), ("o_orderkey", "asc")], 50)


@query("top_k_by_score", """
SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 20000
""")
def top_k_by_score(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice")
    return first_rows(rows, [("l_extendedprice", "desc"), ("l_orderkey", "asc"), ("l_partkey", "asc")], 20000)


# --- sampling -----------------------------------------------------------------------------

HASH_SQL = "(('0x' || substr(md5('{salt}|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT)"


@query("random_sample_n", f"""
SELECT o_orderkey FROM orders WHERE {HASH_SQL.format(salt='s/share', key='o_orderkey')} / 4294967296.0 <= 0.5
ORDER BY md5('s|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 2000
""")
def random_sample_n(t):
    return sampling.random_sample(t.orders.select("o_orderkey"), "o_orderkey", 0.5, 2000)


LABELLED_SQL = "SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS target FROM orders"


def labelled_orders(t):
    return t.orders.select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("target"))


@query("sample_negatives_plus_positives", f"""
WITH l AS ({LABELLED_SQL}) (SELECT * FROM l WHERE target = 0 ORDER BY o_orderkey LIMIT 3000) UNION ALL SELECT * FROM l WHERE target = 1
""")
def sample_negatives_plus_positives(t):
    return sampling.sample_negatives(labelled_orders(t), "target", "o_orderkey", 3000)


@query("hide_positives", f"""
WITH l AS ({LABELLED_SQL}), h AS (SELECT o_orderkey FROM l WHERE target = 1 ORDER BY md5('s1|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100)
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM h) THEN 0 ELSE target END AS target, target AS orig_target FROM l
""")
def hide_positives(t):
    return sampling.hide_positives(labelled_orders(t), "target", "o_orderkey", 100, "s1")


@query("split_frame", f"""
SELECT o_orderkey, CASE WHEN {HASH_SQL.format(salt='split', key='o_orderkey')} / 4294967296.0 < 0.8 THEN 0
 WHEN {HASH_SQL.format(salt='split', key='o_orderkey')} / 4294967296.0 < 0.9 THEN 1 ELSE 2 END AS part FROM orders
""")
def split_frame(t):
    parts = sampling.split_frame(t.orders.select("o_orderkey"), "o_orderkey", [0.8, 0.1])
    return reshape.union_all(*[p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


@query("kfold_column", f"""
SELECT c_custkey, CAST({HASH_SQL.format(salt='fold', key='c_custkey')} % 5 AS INTEGER) AS fold FROM customer
""")
def kfold_column(t):
    return sampling.kfold_column(t.customer.select("c_custkey"), "c_custkey", 5)


@query("time_split_month", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) >= (SELECT date_trunc('month', max(o_orderdate)) FROM orders) AS is_valid FROM orders
""")
def time_split_month(t):
    return sampling.time_split(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate").select(
        "o_orderkey", "is_valid")


@query("time_split_share", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1),
 c AS (SELECT d, sum(n) OVER (ORDER BY d DESC) - n AS later, sum(n) OVER () AS total FROM d)
SELECT o_orderkey, CAST(o_orderdate AS DATE) >= (SELECT min(d) FROM c WHERE later < total * 0.2) AS is_valid FROM orders
""")
def time_split_share(t):
    return sampling.time_split(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 0.2).select(
        "o_orderkey", "is_valid")


# Distribution function of the Poisson law with mean 1/2 at 0, 1, ... 19.
POISSON_HALF = [math.exp(-0.5) * math.fsum(0.5 ** i / math.factorial(i) for i in range(n + 1)) for n in range(20)]


@query("bootstrap_unlabelled", f"""
WITH l AS ({LABELLED_SQL}), r AS (SELECT target, unnest(range(0, 5))::INTEGER AS estimator, o_orderkey FROM l),
 h AS (SELECT target, estimator, ('0x' || substr(md5('1/' || estimator || '|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM r)
SELECT estimator, target, CAST(CASE WHEN target = 1 THEN 1 ELSE len(list_filter({POISSON_HALF}::DOUBLE[], lambda c: c <= u)) END AS INTEGER) AS draws, count(*) AS n FROM h GROUP BY ALL
""")
def bootstrap_unlabelled(t):
    """Draws per order and estimator: Poisson for unlabelled rows, one for each positive."""
    draw = Draw("o_orderkey", "target", share=0.5, bootstrap=True, seed=1)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("estimator"), draw.weight(i).alias("draws")) for i in range(5)]))
    return labelled_orders(t).select("target", each.alias("d")).groupBy("d.estimator", "target", "d.draws").agg(F.count("*").alias("n"))


@query("salted_many_hot_keys", """
SELECT l_suppkey, count(*) AS n, sum(o_orderkey) AS s FROM lineitem JOIN orders ON l_suppkey = o_custkey GROUP BY 1
""")
def salted_many_hot_keys(t):
    """Every supplier counts as hot, on both sides."""
    left = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber")
    right = t.orders.select(F.col("o_custkey").alias("l_suppkey"), "o_orderkey")
    joined = joins.salted_join(left, right, ["l_suppkey"], min_rows=2)
    return joined.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("redistribute", """
SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1
""")
def redistribute(t):
    spread = sampling.redistribute(t.lineitem.select("l_suppkey"), 16, "l_suppkey")
    return spread.groupBy("l_suppkey").agg(F.count("*").alias("n"))
