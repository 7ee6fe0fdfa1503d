"""Contact lists over date windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.functions.text import normalize_phone
from larkfield.operators.joins import salted_join
from larkfield.session import small_side

USAGE = ["subs_id", "usage_type_id", "a_number", "b_number", "traffic_type_id", "start_date"]


def usage_contacts(usage: DataFrame, incoming_type: int = 2) -> DataFrame:
    """Usage rows with the other party's number: A for incoming, B for outgoing."""
    contact: Column = F.when(F.col("usage_type_id") == incoming_type, F.col("a_number")).otherwise(
        F.col("b_number"))
    return usage.select("subs_id", "traffic_type_id", "start_date", contact.alias("contact"))


def contact_list(usages: Sequence[DataFrame], batches: DataFrame, numbers: DataFrame, *, batch_name: str,
                 offset: int, depth: int, traffic_types: Sequence[int] = (1, 2, 3),
                 with_report_date: bool = True) -> DataFrame:
    """Contacts of each batch's subscribers, ``offset + depth`` to ``offset`` days before its date.

    One plan serves all batch dates: usage is cut to the wanted traffic, numbers and dates
    before any shuffle, then joined to the batches by subscriber with the window as a
    condition. Both window ends count. A contact seen for several batch dates appears once
    per date, with or without the date column.
    """
    # The widest window of all batches bounds the usage dates, so old files are not read.
    bounds = batches.agg(F.struct(F.min("report_date").alias("lo"), F.max("report_date").alias("hi"))).scalar()
    listed = small_side(numbers.select(F.col("msisdn").alias("contact")).distinct())
    parts = []
    for usage in usages:
        rows = usage_contacts(usage).where(F.col("traffic_type_id").isin(*traffic_types))
        rows = rows.where((F.col("start_date") <= F.date_sub(bounds["hi"], offset))
                          & (F.col("start_date") >= F.date_sub(bounds["lo"], offset + depth)))
        parts.append(rows.join(listed, "contact", "left_semi").select("subs_id", "start_date", "contact"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # The same contact on the same day counts once anyway: shrink hot subscribers early.
    rows = rows.distinct()
    inside = ((F.col("start_date") <= F.date_sub("report_date", offset))
              & (F.col("start_date") >= F.date_sub("report_date", offset + depth)))
    wanted = batches.select("subs_id", "report_date").distinct()
    joined = salted_join(rows, wanted, ["subs_id"], inside, check_right=False)
    out = joined.select("subs_id", "report_date", normalize_phone(F.col("contact")).alias("contact")).distinct()
    out = out.withColumn("batchname", F.lit(batch_name))
    return out if with_report_date else out.select("subs_id", "contact", "batchname")
