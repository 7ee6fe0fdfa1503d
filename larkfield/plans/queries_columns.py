"""Projections, predicates, text functions and feature columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larkfield.functions import columns as cols
from larkfield.functions import features as feat
from larkfield.functions import text
from larkfield.plans.registry import query

AS_OF = dt.date(2000, 1, 10)


@query("project_rename", """
SELECT n_regionkey AS region, n_nationkey AS id, n_name AS name FROM nation
""")
def project_rename(t):
    return t.nation.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("id"),
                           F.col("n_name").alias("name"))


@query("filter_compound", """
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
WHERE l_returnflag IN ('A','R') AND (l_quantity >= 40 OR l_discount < 0.02) AND l_shipdate IS NOT NULL AND l_linestatus LIKE 'F%'
""")
def filter_compound(t):
    c = F.col
    return (t.lineitem.where(c("l_returnflag").isin("A", "R")
                             & ((c("l_quantity") >= 40) | (c("l_discount") < 0.02))
                             & c("l_shipdate").isNotNull() & c("l_linestatus").like("F%"))
            .select("l_orderkey", "l_partkey", "l_quantity"))


@query("ilike", """
SELECT p_partkey, p_name ILIKE '%RING' AS any_case, p_name LIKE '%RING' AS exact_case FROM part
""")
def ilike(t):
    return t.part.select("p_partkey", F.col("p_name").ilike("%RING").alias("any_case"),
                         F.col("p_name").like("%RING").alias("exact_case"))


@query("case_when", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN l_partkey ELSE l_suppkey END AS contact,
 count(*) AS n FROM lineitem GROUP BY ALL
""")
def case_when(t):
    pick = F.when(F.col("l_linenumber") == 2, F.col("l_partkey")).otherwise(F.col("l_suppkey"))
    return (t.lineitem.select("l_orderkey", "l_linenumber", pick.alias("contact"))
            .groupBy("l_orderkey", "l_linenumber", "contact").agg(F.count("*").alias("n")))


@query("conditional_update", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer
""")
def conditional_update(t):
    return cols.update_where(t.customer, "c_acctbal", F.col("c_acctbal") < 0, F.lit(0.0)).select(
        "c_custkey", "c_acctbal")


@query("lateral_alias", """
SELECT o_orderkey, contact, kind FROM (
 SELECT o_orderkey, o_custkey * 2 AS contact, CASE WHEN o_custkey * 2 > 1000 THEN 'far' ELSE 'near' END AS kind FROM orders)
WHERE contact IN (SELECT p_partkey FROM part)
""")
def lateral_alias(t):
    t.orders.createOrReplaceTempView("lateral_orders")
    t.part.createOrReplaceTempView("lateral_part")
    return t.spark.sql("""
        SELECT * FROM (SELECT o_orderkey, o_custkey * 2 AS contact,
                              CASE WHEN contact > 1000 THEN 'far' ELSE 'near' END AS kind
                       FROM lateral_orders)
        WHERE contact IN (SELECT p_partkey FROM lateral_part)""")


@query("const_and_date_cols", """
SELECT c_custkey, DATE '2000-01-10' - 3 AS report_date, 194 AS model_id, 'first' AS tag FROM customer
""")
def const_and_date_cols(t):
    return t.customer.select("c_custkey", F.date_sub(F.lit(AS_OF), 3).alias("report_date"),
                             F.lit(194).alias("model_id"), F.lit("first").alias("tag"))


@query("cast_types", """
SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS price_whole, CAST(p_size AS VARCHAR) AS size_text,
 TRY_CAST(regexp_replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_no, TRY_CAST(p_brand AS INTEGER) AS not_a_number,
 CAST(p_size AS DOUBLE) AS size_double
FROM (SELECT *  REPLACE (floor(p_retailprice) AS p_retailprice) FROM part)
""")
def cast_types(t):
    return t.part.select(
        "p_partkey", F.floor("p_retailprice").cast("long").alias("price_whole"),
        F.col("p_size").cast("string").alias("size_text"),
        F.regexp_replace("p_brand", "Brand#", "").try_cast("int").alias("brand_no"),
        F.col("p_brand").try_cast("int").alias("not_a_number"),
        F.col("p_size").cast("double").alias("size_double"))


@query("normalize_names", """
SELECT s_suppkey AS S_SUPPKEY, s_name AS S_NAME, s_nationkey AS S_NATIONKEY, s_acctbal AS S_ACCTBAL FROM supplier
""")
def normalize_names(t):
    return cols.normalize_names(t.supplier, "upper")


@query("column_groups", """
SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part
""")
def column_groups(t):
    """Keep key, flags, categories and numbers of the wide part table, by name."""
    frame = t.part.select("*", F.lit(0.0).alias("price_sk_amt"))
    groups = cols.column_groups(frame.columns, index=["p_partkey"], categorical=["p_brand", "p_type"],
                                bad=["p_name"])
    return frame.select(*groups.kept)


@query("list_columns", """
SELECT * FROM (SELECT 1::INTEGER AS "position", 'o_orderkey' AS column_name, 'bigint' AS type_name, count(*) FILTER (o_orderkey IS NULL) AS nulls FROM orders
UNION ALL SELECT 2, 'o_custkey', 'bigint', count(*) FILTER (o_custkey IS NULL) FROM orders
UNION ALL SELECT 3, 'o_orderstatus', 'string', count(*) FILTER (o_orderstatus IS NULL) FROM orders
UNION ALL SELECT 4, 'o_totalprice', 'double', count(*) FILTER (o_totalprice IS NULL) FROM orders
UNION ALL SELECT 5, 'o_orderdate', 'timestamp_ntz', count(*) FILTER (o_orderdate IS NULL) FROM orders
UNION ALL SELECT 6, 'o_orderpriority', 'string', count(*) FILTER (o_orderpriority IS NULL) FROM orders)
""")
def list_columns(t):
    """The columns of a table with the NULLs counted in each."""
    t.orders.createOrReplaceTempView("columns_of_orders")
    return cols.list_columns(t.spark, "columns_of_orders").join(cols.null_report(t.orders), "column_name")


@query("any_null", """
SELECT lang, bool_or(quality IS NULL) AS quality_missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang
""")
def any_null(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return cols.any_null_by(joined, ["lang"], ["quality"])


@query("null_report", """
WITH d AS (SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'doc_id' AS column_name, count(*) - count(doc_id) AS nulls FROM d UNION ALL
SELECT 'n_chars', count(*) - count(n_chars) FROM d UNION ALL
SELECT 'quality', count(*) - count(quality) FROM d UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM d
""")
def null_report(t):
    joined = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    return cols.null_report(joined)


@query("drop_and_fill_na", """
WITH d AS (SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'dropped' AS kind, doc_id, quality FROM d WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
UNION ALL SELECT 'filled', doc_id, coalesce(quality, -1) FROM d
""")
def drop_and_fill_na(t):
    joined = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    dropped = joined.dropna().select(F.lit("dropped").alias("kind"), "doc_id", "quality")
    filled = joined.fillna({"quality": -1}).select(F.lit("filled").alias("kind"), "doc_id", "quality")
    return dropped.unionByName(filled)


@query("composite_key", """
SELECT n_name || '_' || CAST(n_regionkey AS VARCHAR) AS node_name, n_name AS name, n_regionkey AS line FROM nation
""")
def composite_key(t):
    return t.nation.select(F.concat_ws("_", "n_name", F.col("n_regionkey").cast("string"))
                           .alias("node_name"), F.col("n_name").alias("name"),
                           F.col("n_regionkey").alias("line"))


@query("multi_column_apply", """
SELECT doc_id, replace(lang || ',' || source, ',', '!') AS a, replace(text, ',', '!') AS b FROM documents
""")
def multi_column_apply(t):
    rows = t.documents.select("doc_id", F.concat_ws(",", "lang", "source").alias("y"),
                              F.col("text").alias("z"))
    return cols.apply_to_columns(rows, {"a": "y", "b": "z"},
                                 lambda c: F.regexp_replace(c, ",", "!")).select("doc_id", "a", "b")


# --- text ---------------------------------------------------------------------------------

PHONE_SQL = """CASE c_custkey % 4 WHEN 0 THEN '89' || lpad(CAST(c_custkey AS STRING), 9, '0')
 WHEN 1 THEN '00089' || lpad(CAST(c_custkey AS STRING), 9, '0')
 WHEN 2 THEN CAST(c_custkey AS STRING) ELSE '+7' || lpad(CAST(c_custkey AS STRING), 9, '0') END"""


@query("normalize_phone", f"""
WITH p AS (SELECT c_custkey, {PHONE_SQL} AS phone FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(phone, '^([0-9]{{11}}|[0-9]{{14}})$') THEN '7' || right(phone, 10) ELSE phone END AS phone FROM p
""")
def normalize_phone(t):
    return t.customer.select("c_custkey", F.expr(PHONE_SQL).alias("phone")).select(
        "c_custkey", text.normalize_phone(F.col("phone")).alias("phone"))


ADDRESS_SQL = """'City' || chr(92) || CASE p_size % 5
 WHEN 0 THEN 'Metro station ' || p_name || ' (' || p_type || ' line)'
 WHEN 1 THEN 'Station ' || p_name || ', ' || p_type
 WHEN 2 THEN 'metro "' || p_name || '" ' || p_type
 WHEN 3 THEN '  ' || p_name || ' ' ELSE p_name || ' (' || p_brand || ') (' || p_type || ')' END"""
NOISE = [r"\(.*\)", "Metro station", "Station", "metro", '"']


@query("clean_station", f"""
WITH a AS (SELECT p_partkey, split_part({ADDRESS_SQL}, chr(92), 2) AS part FROM part),
 n AS (SELECT p_partkey, split_part(part, ',', 1) AS name FROM a)
SELECT p_partkey, trim(replace(replace(replace(replace(regexp_replace(name, '\\(.*\\)', '', 'g'), 'Metro station', ''), 'Station', ''), 'metro', ''), '"', '')) AS station FROM n
""")
def clean_station(t):
    address = t.part.select("p_partkey", F.expr(ADDRESS_SQL).alias("address"))
    return address.select("p_partkey", text.clean_station(text.station_part(F.col("address")), NOISE)
                          .alias("station"))


@query("extract_qualifier", f"""
WITH a AS (SELECT p_partkey, split_part({ADDRESS_SQL}, chr(92), 2) AS part FROM part)
SELECT p_partkey, CASE WHEN contains(part, '(') THEN trim(split_part(part, '(', 2), ')')
 WHEN contains(part, ',') THEN trim(split_part(part, ',', 2), ')')
 WHEN contains(part, '"') THEN trim(split_part(part, '"', -1), ')') ELSE '' END AS line_name FROM a
""")
def extract_qualifier(t):
    address = t.part.select("p_partkey", F.expr(ADDRESS_SQL).alias("address"))
    return address.select("p_partkey", text.extract_qualifier(text.station_part(F.col("address")))
                          .alias("line_name"))


@query("dict_replace", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN 'later' ELSE o_orderpriority END AS priority FROM orders
""")
def dict_replace(t):
    return t.orders.select("o_orderkey", text.dict_replace(
        F.col("o_orderpriority"), {"1-URGENT": "now", "5-LOW": "later"}).alias("priority"))


@query("lower_strip_contains", """
SELECT page_id, lower(trim(url)) AS url, contains(lower(html), 'lang="en"') AS is_en FROM pages
""")
def lower_strip_contains(t):
    return t.pages.select("page_id", F.lower(F.trim("url")).alias("url"),
                          F.lower("html").contains('lang="en"').alias("is_en"))


FLAG_SQL = """CASE l_linenumber WHEN 1 THEN 'Y' WHEN 2 THEN 'N' WHEN 3 THEN 'S-' WHEN 4 THEN chr(92) || 'N'
 WHEN 5 THEN 'flag_1' WHEN 6 THEN 'x0' ELSE l_returnflag END"""


@query("decode_flag", f"""
WITH f AS (SELECT {FLAG_SQL} AS flag FROM lineitem)
SELECT flag, CASE WHEN right(flag, 1) IN ('0', '1') THEN CAST(right(flag, 1) AS DOUBLE)
 WHEN flag = 'Y' THEN 1.0 WHEN flag IN ('N', 'S-', chr(92) || 'N') THEN 0.0 END AS value, count(*) AS n FROM f GROUP BY ALL
""")
def decode_flag(t):
    flags = t.lineitem.select(F.expr(FLAG_SQL).alias("flag"))
    return (flags.select("flag", text.decode_flag(F.col("flag")).alias("value"))
            .groupBy("flag", "value").agg(F.count("*").alias("n")))


@query("bounded_text", """
SELECT doc_id, CASE WHEN length(text) >= 2000 THEN source || ':' || CAST(n_chars AS VARCHAR) ELSE text END AS bounded FROM documents
""")
def bounded_text(t):
    short = F.concat_ws(":", "source", F.col("n_chars").cast("string"))
    return t.documents.select("doc_id", text.bounded_text(F.col("text"), 2000, short).alias("bounded"))


@query("describe_row", """
SELECT s_suppkey, 's_name: ' || s_name || chr(10) || 's_nationkey: ' || CAST(s_nationkey AS VARCHAR) AS description,
 '<table><tr><td>Name</td><td>Share</td></tr><tr><td>' || s_name || '</td><td>' || printf('%.2f', s_nationkey / 32.0 * 100) || '%</td></tr></table>' AS html
FROM supplier
""")
def describe_row(t):
    share = text.percent_text(F.col("s_nationkey") / 32.0)
    return t.supplier.select(
        "s_suppkey", text.describe_row(["s_name", "s_nationkey"]).alias("description"),
        text.describe_html(["Name", "Share"], [F.col("s_name"), share]).alias("html"))


@query("edit_distance", """
SELECT p_name, p_type, levenshtein(lower(p_type), p_name) AS d, count(*) AS n FROM part GROUP BY ALL
""")
def edit_distance(t):
    pairs = t.part.groupBy("p_name", "p_type").agg(F.count("*").alias("n"))
    return pairs.select("p_name", "p_type", F.levenshtein(F.lower("p_type"), "p_name").alias("d"), "n")


@query("kml_colour", """
SELECT p_partkey, '#a0' || substr(rgb, 6, 2) || substr(rgb, 4, 2) || substr(rgb, 2, 2) AS colour
FROM (SELECT p_partkey, '#' || lpad(hex(p_size), 2, '0') || lpad(hex(p_partkey % 256), 2, '0') || 'FF' AS rgb FROM part)
""")
def kml_colour(t):
    rgb = F.concat(F.lit("#"), F.lpad(F.hex("p_size"), 2, "0"),
                   F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), F.lit("FF"))
    return t.part.select("p_partkey", text.kml_colour(rgb).alias("colour"))


# --- features -----------------------------------------------------------------------------

FEATURES_SQL = """SELECT o_custkey AS subs_id, CAST(count(*) AS DOUBLE) - 12 AS rc, count(*) AS add_sim_cnt,
 round(sum(o_totalprice), 2) AS sum_ses_mou, CAST(count(*) AS DOUBLE) / 64 AS io_voice_traf_ratio,
 min(o_totalprice) AS mou FROM orders GROUP BY o_custkey"""


def customer_features(t):
    return t.orders.groupBy(F.col("o_custkey").alias("subs_id")).agg(
        (F.count("*").cast("double") - 12).alias("rc"), F.count("*").alias("add_sim_cnt"),
        F.round(F.sum("o_totalprice"), 2).alias("sum_ses_mou"),
        (F.count("*").cast("double") / 64).alias("io_voice_traf_ratio"),
        F.min("o_totalprice").alias("mou"))


@query("clean_features", f"""
WITH f AS ({FEATURES_SQL})
SELECT subs_id, round(ln(1 + least(greatest(rc, 0), 5000)), 8) AS rc, CAST(least(add_sim_cnt, 5) AS VARCHAR) AS add_sim_cnt,
 least(sum_ses_mou, 200000) AS sum_ses_mou, round(sqrt(io_voice_traf_ratio), 8) AS io_voice_traf_ratio, least(mou, 10000) AS mou FROM f
""")
def clean_features(t):
    out = feat.clean_features(customer_features(t))
    return out.select("subs_id", F.round("rc", 8).alias("rc"), "add_sim_cnt", "sum_ses_mou",
                      F.round("io_voice_traf_ratio", 8).alias("io_voice_traf_ratio"), "mou")


@query("interaction_features", """
SELECT l_orderkey, l_partkey, l_quantity * l_discount AS l_quantity_mult_l_discount,
 CASE WHEN l_discount = 0 THEN 0 ELSE round(l_quantity / l_discount, 6) END AS l_quantity_div_l_discount,
 l_tax * l_discount AS l_tax_mult_l_discount,
 CASE WHEN l_discount = 0 THEN 0 ELSE round(l_tax / l_discount, 6) END AS l_tax_div_l_discount FROM lineitem
""")
def interaction_features(t):
    base = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_tax", "l_discount")
    out = feat.interaction_features(base, ["l_quantity", "l_tax", "l_discount"], "l_discount")
    return out.select("l_orderkey", "l_partkey", "l_quantity_mult_l_discount",
                      F.round("l_quantity_div_l_discount", 6).alias("l_quantity_div_l_discount"),
                      "l_tax_mult_l_discount",
                      F.round("l_tax_div_l_discount", 6).alias("l_tax_div_l_discount"))


@query("categorical_interaction", """
WITH p AS (SELECT p_partkey, p_brand || '_' || p_type AS v FROM part),
 k AS (SELECT v FROM p GROUP BY v HAVING count(*) >= 15)
SELECT p_partkey, CASE WHEN k.v IS NULL THEN 'other' ELSE p.v END AS p_brand_p_type FROM p LEFT JOIN k ON p.v = k.v
""")
def categorical_interaction(t):
    return feat.categorical_interaction(t.part.select("p_partkey", "p_brand", "p_type"),
                                        ["p_brand", "p_type"], min_occurrence=15).select(
        "p_partkey", "p_brand_p_type")


@query("min_max_scale", """
SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 8) AS scaled FROM orders
""")
def min_max_scale(t):
    out = feat.min_max_scale(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return out.select("o_orderkey", F.round("o_totalprice_scaled", 8).alias("scaled"))


@query("max_scale", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value / (1024.0 ** 3) END AS gb FROM events)
SELECT event_id, round(coalesce(gb / max(gb) OVER (), 0), 8) AS scaled FROM e
""")
def max_scale(t):
    gb = F.when(F.col("event_type") != "error", F.col("value") / float(1024 ** 3))
    return feat.max_scale(t.events.select("event_id", gb.alias("gb")), ["gb"]).select(
        "event_id", F.round("gb_scaled", 8).alias("scaled"))


@query("clip_value", """
SELECT event_id, least(greatest(0.01 * value, 0.003), 1) AS radius, greatest(value, 8) AS size FROM events
""")
def clip_value(t):
    return t.events.select("event_id", feat.clip(F.lit(0.01) * F.col("value"), 0.003, 1.0).alias("radius"),
                           feat.clip(F.col("value"), low=8.0).alias("size"))


@query("pseudocolour", """
WITH p AS (SELECT p_partkey, (p_size - 1) / 64.0 AS v FROM part)
SELECT p_partkey, '#' || lpad(hex(CAST(round_even(least(1, v * 2) * 255, 0) AS BIGINT)), 2, '0')
 || lpad(hex(CAST(round_even(least(1, (1 - v) * 2) * 255, 0) AS BIGINT)), 2, '0') || '00' AS colour FROM p
""")
def pseudocolour(t):
    return t.part.select("p_partkey", feat.pseudocolour((F.col("p_size") - 1) / 64.0).alias("colour"))


@query("equal_width_bin", """
WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT p_partkey, CAST(least(greatest(ceil((p_retailprice - lo) / (hi - lo) * 10), 1), 10) AS BIGINT) AS bin FROM part, m
""")
def equal_width_bin(t):
    return feat.equal_width_bin(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", 10,
                                "bin").select("p_partkey", "bin")


@query("rank_colour_per_group", """
WITH e AS (SELECT event_id, event_type, value FROM events),
 m AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n FROM e GROUP BY 1)
SELECT event_id, e.event_type, CAST(least(greatest(ceil((value - lo) / (hi - lo) * n), 1), n) AS BIGINT) AS colour_index
FROM e JOIN m ON e.event_type = m.event_type
""")
def rank_colour_per_group(t):
    rows = t.events.select("event_id", "event_type", "value")
    return feat.equal_width_bin(rows, "value", F.col("_rows"), "colour_index",
                                ["event_type"]).select("event_id", "event_type", "colour_index")


@query("quantile_bin", """
WITH q AS (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS b FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice <= b[1] THEN NULL
 ELSE CAST(len(list_filter(b[1:10], lambda x: x < o_totalprice)) AS INTEGER) END AS decile FROM orders, q
""")
def quantile_bin(t):
    return feat.quantile_bin(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice",
                             "decile").select("o_orderkey", "decile")


@query("scaled_height", """
WITH m AS (SELECT min(CASE WHEN l_discount > 0 THEN l_discount END) AS low, max(l_discount) AS top FROM lineitem)
SELECT l_discount, round(greatest(l_discount * (50.0 / low) / top, 50), 6) AS height, count(*) AS n FROM lineitem, m GROUP BY ALL
""")
def scaled_height(t):
    out = feat.scaled_height(t.lineitem.select("l_discount"), "l_discount", "height")
    return (out.select("l_discount", F.round("height", 6).alias("height"))
            .groupBy("l_discount", "height").agg(F.count("*").alias("n")))


@query("factor_levels", """
SELECT row_number() OVER (ORDER BY p_name) - 1 AS position, p_name AS level FROM (SELECT DISTINCT p_name FROM part)
""")
def factor_levels(t):
    return feat.factor_levels(t.part, "p_name")


@query("relabel_levels", """
WITH f AS (SELECT l_linenumber, CASE WHEN l_returnflag = 'N' THEN '0' ELSE '1' END AS target FROM lineitem)
SELECT target, CASE target WHEN '0' THEN '1' ELSE '0' END AS relabelled, count(*) AS n FROM f GROUP BY ALL
""")
def relabel_levels(t):
    flags = t.lineitem.select(F.when(F.col("l_returnflag") == "N", "0").otherwise("1").alias("target"))
    return (feat.relabel_levels(flags, "target", ["1", "0"], "relabelled")
            .groupBy("target", "relabelled").agg(F.count("*").alias("n")))


@query("sparse_triplets", """
WITH e AS (SELECT user_id, event_type FROM events),
 r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS row_id FROM (SELECT DISTINCT user_id FROM e)),
 c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS col_id FROM (SELECT DISTINCT event_type FROM e))
SELECT row_id, col_id, 1 AS v FROM e JOIN r USING (user_id) JOIN c USING (event_type)
""")
def sparse_triplets(t):
    return feat.sparse_triplets(t.events, "user_id", "event_type")
