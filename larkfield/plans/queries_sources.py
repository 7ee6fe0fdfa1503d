"""Sources and sinks: every sink query writes the whole table and reads it back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from larkfield.functions import columns
from larkfield.functions.columns import ColumnGroups
from larkfield.operators.ranking import ordered_chunks
from larkfield.operators.reshape import union_all
from larkfield.plans import publish
from larkfield.plans.queries_ranking import AS_OF
from larkfield.plans.registry import query
from larkfield.session import fresh_path
from larkfield.sinks import files as sink_files
from larkfield.sinks import tables as sink_tables
from larkfield.sources import files, nested, sql



@query("scan_table", """
SELECT n_nationkey, n_name, n_regionkey FROM nation
""")
def scan_table(t):
    t.nation.createOrReplaceTempView("scanned_nation")
    return files.scan_table(t.spark, "scanned_nation")


@query("scan_partitioned", """
SELECT event_id, user_id, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-09'
""")
def scan_partitioned(t):
    """Write a year/month/day tree once, then read one day of it."""
    root = fresh_path(t.spark, "events_by_day")
    names = ["report_date_year", "report_date_month", "report_date_day"]
    parts = t.events.select("event_id", "user_id", "value", *[
        f("ts").alias(n) for f, n in zip((F.year, F.month, F.dayofmonth), names)])
    parts.repartition(*names, F.col("event_id") % 4).write.partitionBy(*names).parquet(root)
    one = files.scan_partitioned(t.spark, root,
                                 "report_date_year = 2024 AND report_date_month = 1 AND report_date_day = 9")
    return one.select("event_id", "user_id", "value")


@query("read_positional_text", """
SELECT CAST(o_orderkey AS VARCHAR) AS subs_id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS cust_type,
 CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gender, o_totalprice AS mou FROM orders
""")
def read_positional_text(t):
    """Ctrl-A text without header: key, category, flag, number, dropped column."""
    path = fresh_path(t.spark, "positional")
    flag = F.when(F.col("o_orderstatus") == "F", "Y").when(F.col("o_orderstatus") == "O", "S-").otherwise("\\N")
    line = F.concat_ws("\x01", F.col("o_orderkey").cast("string"), F.when(
        F.col("o_orderstatus") == "F", "\\N").otherwise(F.col("o_orderpriority")), flag,
        F.col("o_totalprice").cast("string"), F.lit("gone"))
    t.orders.select(line.alias("value")).write.text(path)
    columns = ["subs_id", "cust_type", "gender", "mou", "tp_id"]
    groups = ColumnGroups(["subs_id"], ["gender"], ["cust_type"], ["mou"], ["tp_id"])
    good, _ = files.set_aside(files.read_positional_text(t.spark, path, columns, groups))
    return good


@query("read_delimited", """
SELECT c_custkey, c_name, c_acctbal FROM customer
""")
def read_delimited(t):
    path = fresh_path(t.spark, "delimited")
    t.customer.select("c_custkey", "c_name", "c_acctbal").write.option("sep", "\t").option("header", True).csv(path)
    return files.read_delimited(t.spark, path, "c_custkey long, c_name string, c_acctbal double", sep="\t")


@query("import_with_names", """
SELECT CAST(s_suppkey AS VARCHAR) AS msisdn, s_acctbal AS score FROM supplier
""")
def import_with_names(t):
    path, names = fresh_path(t.spark, "headerless"), fresh_path(t.spark, "names")
    t.supplier.select("s_suppkey", "s_acctbal").write.csv(path)
    t.spark.createDataFrame([("msisdn",), ("score",)], "col_name string").coalesce(1).write.option("header", True).csv(names)
    return files.import_with_names(t.spark, path, names_file=names, types={"score": "double"})


@query("sql_select", """
SELECT CAST(l_orderkey AS VARCHAR) AS L_ORDERKEY, CAST(l_linenumber AS VARCHAR) AS L_LINENUMBER FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30
""")
def sql_select(t):
    t.lineitem.createOrReplaceTempView("selected_lineitem")
    return sql.sql_select(t.spark, "SELECT l_orderkey, l_linenumber FROM selected_lineitem WHERE l_returnflag = ? AND l_quantity >= ?",
                          ["R", 30], infer_types=False)


@query("parse_nested_json", """
SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, event_type FROM events
""")
def parse_nested_json(t):
    """``props`` wrapped as JSON text inside a JSON document, then decoded twice."""
    outer = F.to_json(F.struct(F.col("props").alias("data"), F.col("event_type").alias("kind")))
    docs = t.events.select("event_id", outer.alias("doc"))
    return docs.select("event_id", nested.inner_json(F.col("doc"), "data", "k long")["k"].alias("k"),
                       F.get_json_object("doc", "$.kind").alias("event_type"))


def _map_documents(t):
    """Map documents of at most 500 entries: nations as lines, suppliers as stations and links."""
    def text_key(c):
        return F.col(c).cast("string").alias("key")

    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("int")
    entries = {
        "lines": (t.nation, "n_nationkey", F.struct(text_key("n_nationkey"), F.struct(
            F.col("n_name").alias("name"), F.concat(F.lit("#"), F.hex("n_nationkey")).alias("color")).alias("value"))),
        "stations": (suppliers, "s_suppkey", F.struct(text_key("s_suppkey"), F.struct(
            F.col("s_name").alias("name"), F.col("s_nationkey").alias("lineId")).alias("value"))),
        "links": (suppliers, "s_suppkey", F.struct(text_key("s_suppkey"), F.struct(
            key.alias("fromStationId"), (key + 1).alias("toStationId")).alias("value"))),
    }
    documents = []
    for name, (df, order, entry) in entries.items():
        chunks = ordered_chunks(df.withColumn("e", entry), ["n_regionkey"], [(order, "asc")], "e", "es", chunk=500)
        data = F.to_json(F.struct(F.map_from_entries("es").alias(name)))
        documents.append(chunks.select(F.to_json(F.struct(data.alias("data"))).alias("value")))
    return union_all(*documents)


@query("transpose_dict", """
SELECT n_nationkey AS line, n_name AS name, '#' || hex(n_nationkey) AS colour FROM nation
""")
def transpose_dict(t):
    return nested.map_tables(_map_documents(t))["lines"]


@query("map_stations", """
SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS name, s_nationkey AS line FROM supplier
""")
def map_stations(t):
    return nested.map_tables(_map_documents(t))["stations"]


@query("map_connections", """
SELECT CAST(s_suppkey AS INTEGER) AS station1, CAST(s_suppkey + 1 AS INTEGER) AS station2, s_nationkey AS line FROM supplier
""")
def map_connections(t):
    return nested.map_tables(_map_documents(t))["connections"]


@query("flatten_nested", """
WITH p AS (SELECT s_suppkey, lower(s_name) AS name, CASE s_nationkey WHEN 3 THEN 14 ELSE s_nationkey END AS line FROM supplier)
SELECT CAST(c_custkey AS INTEGER) AS id, max(CAST(s_suppkey / 4.0 AS DOUBLE)) AS latitude, max(CAST(s_suppkey / 2.0 AS DOUBLE)) AS longitude, replace(c_name, 'Customer', 'SUPPLIER') AS name, c_nationkey AS line
FROM customer LEFT JOIN p ON c_nationkey = line AND lower(replace(c_name, 'Customer', 'SUPPLIER')) = p.name GROUP BY ALL
""")
def flatten_nested(t):
    """Lines holding arrays of stops, one document per nation, matched to stations."""
    stop = F.struct(F.concat(F.lit(" "), "s_name").alias("name"), (F.col("s_suppkey") / 4.0).alias("lat"),
                    (F.col("s_suppkey") / 2.0).alias("lng"))
    per_line = ordered_chunks(t.supplier.withColumn("stop", stop), ["s_nationkey"], [("s_suppkey", "asc")], "stop", "stations")
    doc = F.to_json(F.struct(F.array(F.struct(F.col("s_nationkey").cast("string").alias("id"), "stations")).alias("lines")))
    places = nested.place_rows(per_line.select(doc.alias("value")), line_numbers={"3": 14}, renames={"no such": "name"})
    stations = t.customer.select(F.col("c_custkey").cast("int").alias("id"), F.regexp_replace(
        "c_name", "Customer", "SUPPLIER").alias("name"), F.col("c_nationkey").alias("line"))
    return nested.locate_stations(stations, places)


# --- sinks --------------------------------------------------------------------------------


@query("write_delimited_dir", """
SELECT p_partkey, p_name, p_retailprice FROM part
""")
def write_delimited_dir(t):
    path = fresh_path(t.spark, "csv_dir")
    sink_files.write_delimited_dir(t.part.select("p_partkey", "p_name", "p_retailprice"), path)
    return files.read_delimited(t.spark, path, "p_partkey long, p_name string, p_retailprice double", header=False)


@query("prepare_load", """
SELECT o_orderkey AS O_ORDERKEY, o_orderstatus AS O_ORDERSTATUS, year(o_orderdate)::INTEGER AS "O_ORDERDATE_year", month(o_orderdate)::INTEGER AS "O_ORDERDATE_month", day(o_orderdate)::INTEGER AS "O_ORDERDATE_day" FROM orders
""")
def prepare_load(t):
    return sink_tables.prepare_load(t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus"))


@query("split_dates", """
SELECT event_id, event_type, year(ts)::INTEGER AS ts_year, month(ts)::INTEGER AS ts_month, day(ts)::INTEGER AS ts_day FROM events
""")
def split_dates(t):
    return sink_tables.split_dates(t.events.select("event_id", "ts", "event_type"))


@query("type_map", """
WITH m AS (SELECT greatest(max(length(p_name)), max(length(p_brand)), max(length(p_type))) AS n FROM part)
SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS column_name,
 unnest(['BIGINT', 'VARCHAR(' || n || ')', 'VARCHAR(' || n || ')', 'VARCHAR(' || n || ')', 'INTEGER', 'FLOAT']) AS sql_type FROM m
""")
def type_map(t):
    return sink_tables.type_table(t.part)


@query("append_columns", """
SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier
""")
def append_columns(t):
    """The chosen columns of a wider frame, appended to a catalog table of another column order."""
    table = f"appended_{uuid.uuid4().hex}"
    t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.saveAsTable(table)
    wider = t.supplier.select("s_acctbal", F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    sink_tables.append_columns(wider, table, ["id", "name"])
    return t.spark.table(table)


@query("replace_table", """
SELECT o_orderkey AS O_ORDERKEY, o_orderstatus AS O_ORDERSTATUS, year(o_orderdate)::INTEGER AS "O_ORDERDATE_year", month(o_orderdate)::INTEGER AS "O_ORDERDATE_month", day(o_orderdate)::INTEGER AS "O_ORDERDATE_day" FROM orders
""")
def replace_table(t):
    """Written twice through the catalog, bucketed by its key; the second write replaces the first."""
    table, rows = f"replaced_{uuid.uuid4().hex}", t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    sink_tables.replace_table(rows.where("o_orderstatus = 'F'"), table, "O_ORDERKEY", 4)
    return sink_tables.replace_table(rows, table, "O_ORDERKEY", 4)


@query("guess_key", """
SELECT 'customer' AS frame, 'SUBS_ID' AS key_column, count(DISTINCT c_custkey) AS n_keys FROM customer UNION ALL
SELECT 'orders', 'MSISDN', count(DISTINCT o_custkey) FROM orders UNION ALL
SELECT 'part', 'p_name', count(DISTINCT p_name) FROM part UNION ALL SELECT 'supplier', 's_name', count(DISTINCT s_name) FROM supplier
""")
def guess_key(t):
    """The key that a load would be spread by, and how many values it has."""
    frames = {
        "customer": (t.customer.select("c_name", F.col("c_custkey").alias("MSISDN"), F.col("c_custkey").alias("SUBS_ID")), None),
        "orders": (t.orders.select("o_orderstatus", F.col("o_custkey").alias("MSISDN")), None),
        "part": (t.part.select("p_name", "p_brand"), "missing"), "supplier": (t.supplier.select("s_suppkey", "s_name"), "s_name"),
    }
    rows = []
    for name, (frame, wanted) in frames.items():
        key = columns.guess_key(frame.columns, wanted)
        rows.append(frame.agg(F.lit(name).alias("frame"), F.lit(key).alias("key_column"), F.count_distinct(key).alias("n_keys")))
    return union_all(*rows)


def _staged(t):
    """Lines of orders: some with a field too many, some keys twice."""
    path = fresh_path(t.spark, "staged")
    line = F.concat_ws("\t", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), "o_orderpriority")
    broken = F.when(F.col("o_orderstatus") == "P", F.concat(line, F.lit("\textra"))).otherwise(line)
    t.orders.select(broken.alias("value")).write.text(path)
    return sink_tables.staged_bulk_load(t.spark, path, ["cust", "order_no", "priority"], key=["cust"])


STAGED_SQL = """WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS cust, CAST(o_orderkey AS VARCHAR) AS order_no, o_orderpriority AS priority, o_orderstatus,
 o_custkey || chr(9) || o_orderkey || chr(9) || o_orderpriority AS line FROM orders)"""


@query("staged_bulk_load", f"""
{STAGED_SQL} SELECT cust, arg_min(order_no, line) AS order_no, arg_min(priority, line) AS priority FROM l WHERE o_orderstatus <> 'P' GROUP BY cust
""")
def staged_bulk_load(t):
    return _staged(t).loaded


@query("staged_bulk_load_errors", f"""
{STAGED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY line) AS k FROM l WHERE o_orderstatus <> 'P')
SELECT 'e1' AS kind, line || chr(9) || 'extra' AS line FROM l WHERE o_orderstatus = 'P' UNION ALL SELECT 'e2', line FROM k WHERE k > 1
""")
def staged_bulk_load_errors(t):
    load = _staged(t)
    second = load.errors_2.select(F.lit("e2").alias("kind"), F.concat_ws("\t", "cust", "order_no", "priority").alias("line"))
    return load.errors_1.select(F.lit("e1").alias("kind"), "line").unionByName(second)


@query("write_partitioned_scores", """
SELECT o_orderkey AS subs_id, CAST(o_orderdate AS DATE) AS report_date, CASE WHEN o_orderkey % 7 BETWEEN 1 AND 5 THEN CAST(o_orderkey % 7 AS VARCHAR) ELSE 'unknown' END AS segment_part,
 o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01' AS accepted FROM orders
""")
def write_partitioned_scores(t):
    path, refused = fresh_path(t.spark, "scores"), fresh_path(t.spark, "scores_refused")
    rows = t.orders.select(F.col("o_orderkey").alias("subs_id"), F.to_date("o_orderdate").alias("report_date"),
                           (F.col("o_orderkey") % 7).cast("int").alias("segment_id"))
    publish.write_partitioned_scores(rows, path, dt.date(1997, 1, 1), dt.date(1997, 3, 31), refused)
    kept = t.spark.read.option("recursiveFileLookup", False).parquet(path)
    kept = kept.select("subs_id", "report_date", F.col("segment_part").cast("string"), F.lit(True).alias("accepted"))
    part = F.when(F.col("segment_id").between(1, 5), F.col("segment_id").cast("string")).otherwise("unknown")
    out = t.spark.read.parquet(refused).select("subs_id", "report_date", part.alias("segment_part"), F.lit(False).alias("accepted"))
    return kept.unionByName(out)


@query("export_topk", """
SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000
""")
def export_topk(t):
    path = fresh_path(t.spark, "topk")
    sink_files.export_topk(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"],
                           [("o_totalprice", "desc"), ("o_orderkey", "asc")], 1000, path)
    return files.read_delimited(t.spark, path, "o_orderkey long", header=False)


@query("write_lines", """
SELECT CAST(o_custkey AS VARCHAR) AS value FROM orders INTERSECT SELECT CAST(l_partkey AS VARCHAR) FROM lineitem
""")
def write_lines(t):
    """Ids found in both lists, one per line."""
    path = fresh_path(t.spark, "lines")
    both = t.orders.select(F.col("o_custkey").alias("id")).intersect(t.lineitem.select(F.col("l_partkey").alias("id")))
    sink_files.write_lines(both, "id", path)
    return t.spark.read.text(path)


@query("write_csv_frame", """
SELECT s_suppkey, s_name, s_acctbal FROM supplier
""")
def write_csv_frame(t):
    path = fresh_path(t.spark, "frame")
    sink_files.write_csv_frame(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return files.read_delimited(t.spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("publish_registries", """
SELECT 'model_desc' AS registry, 194 AS model_id, 'vendor' AS detail UNION ALL SELECT 'segment_desc', 194, '1 best' UNION ALL SELECT 'scoring_to_load', 194, '2018-09-12 1'
UNION ALL SELECT 'scoring', 194, CAST(count(*) AS VARCHAR) FROM orders
""")
def publish_registries(t):
    scores = publish.bucket_table(t.orders, "o_totalprice", "o_orderkey", as_of=AS_OF, model_id=194)
    names = ("scoring", "model_desc", "segment_desc", "scoring_to_load")
    paths = {n: fresh_path(t.spark, n) for n in names}
    publish.publish(scores, paths, "vendor", "best")
    read = {n: t.spark.read.parquet(p) for n, p in paths.items()}
    detail = {"model_desc": F.col("model_name"), "segment_desc": F.concat_ws(" ", F.col("segment_id").cast("string"), "segment_name"),
              "scoring_to_load": F.concat_ws(" ", F.col("report_date").cast("string"), F.col("model_version").cast("string"))}
    out = read["scoring"].groupBy("model_id").agg(F.count("*").cast("string").alias("detail")).select(
        F.lit("scoring").alias("registry"), "model_id", "detail")
    for n, d in detail.items():
        out = out.unionByName(read[n].select(F.lit(n).alias("registry"), "model_id", d.alias("detail")))
    return out
