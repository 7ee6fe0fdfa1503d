"""Ranking, buckets, publishing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larkfield.operators import ranking
from larkfield.plans import publish
from larkfield.plans.registry import query

AS_OF = dt.date(2018, 9, 15)
PRICE_ORDER = [("o_totalprice", "desc"), ("o_orderkey", "asc")]


@query("global_row_number", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rnk FROM orders
""")
def global_row_number(t):
    return ranking.row_numbers(t.orders.select("o_orderkey", "o_totalprice"), PRICE_ORDER,
                               "rnk").select("o_orderkey", "rnk")


@query("bucket_99", """
SELECT o_orderkey, CAST(((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)-1)*99)//count(*) OVER ()+1 AS BIGINT) AS bucket_value
FROM orders WHERE o_totalprice > 0
""")
def bucket_99(t):
    rows = t.orders.where("o_totalprice > 0").select("o_orderkey", "o_totalprice")
    return ranking.quantile_buckets(rows, PRICE_ORDER).select("o_orderkey", "bucket_value")


@query("bucket_table", """
SELECT DATE '2018-09-12' AS report_date, o_orderkey AS subs_id, 194 AS model_id, 1 AS model_version, o_totalprice AS probability,
 CAST(((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)-1)*99)//count(*) OVER ()+1 AS BIGINT) AS bucket_value, 1 AS segment_id, 0 AS load_id
FROM orders WHERE o_totalprice > 1000
""")
def bucket_table(t):
    return publish.bucket_table(t.orders, "o_totalprice", "o_orderkey", as_of=AS_OF, model_id=194,
                                condition="o_totalprice > 1000")


@query("bucket_table_ones", """
SELECT DATE '2018-09-12' AS report_date, c_custkey AS subs_id, 7 AS model_id, 2 AS model_version, 1.0::DOUBLE AS probability,
 1::BIGINT AS bucket_value, 3 AS segment_id, 0 AS load_id FROM customer
""")
def bucket_table_ones(t):
    return publish.bucket_table(t.customer, None, "c_custkey", as_of=AS_OF, model_id=7,
                                model_version=2, segment_id=3)


@query("row_number_per_group", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS pos FROM events
""")
def row_number_per_group(t):
    rows = t.events.select("event_id", "event_type", "value")
    return ranking.row_numbers(rows, [("value", "desc"), ("event_id", "asc")], "pos",
                               ["event_type"]).select("event_id", "event_type", "pos")


@query("next_model_id", """
SELECT coalesce(max(l_suppkey), 0) + 1 AS next_model_id FROM lineitem
""")
def next_model_id(t):
    return publish.next_model_id(t.lineitem, "l_suppkey")


@query("row_number_hot_groups", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS pos,
 sum(CASE WHEN event_id % 3 > 0 THEN event_id END) OVER (PARTITION BY event_type ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total,
 lead(event_id) OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS following FROM events
""")
def row_number_hot_groups(t):
    """Every group counts as hot: ranks, running sums over NULLs and next values across ranges."""
    order = [("value", "desc"), ("event_id", "asc")]
    rows = t.events.select("event_id", "event_type", "value", F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("v"))
    out = ranking.running(rows, order, ["event_type"], "pos", {"total": "v"}, hot_rows=100)
    out = ranking.next_values(out, order, ["event_type"], {"following": "event_id"}, hot_rows=100)
    return out.select("event_id", "event_type", "pos", "total", "following")
