"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_local_folders: dict[str, str] = {}


def local_session(cores: str = "8", name: str = "larkfield", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster other
    executors could not see it, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _local_folders:
            _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="larkfield-")
        folder = _local_folders[context.applicationId]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path for one write, below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


#: Bytes that a table marked for broadcast may have.
BROADCAST_BYTES = 32 << 20


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: the length of text and of nested values written out, 8 for other columns."""
    sizes = [F.lit(8)]
    for field in df.schema:
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(F.col(f"`{field.name}`")))
        elif kind.startswith(("array", "struct", "map")):
            sizes.append(F.octet_length(F.col(f"`{field.name}`").cast("string")))
        else:
            sizes.append(F.lit(8))
    total = F.lit(0)
    for size in sizes:
        total = total + F.coalesce(size, F.lit(0))
    return total


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` stored once, and marked for broadcast only if it holds at most ``max_bytes``.

    Beyond the bound the frame is returned unmarked, so Spark shuffles the join and AQE splits
    skewed partitions. The input runs once: the size is taken from the stored rows.
    """
    return within_bytes(checkpointed(df), max_bytes)


def within_bytes(stored: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``small_side`` of a frame that is stored already."""
    size = stored.agg(F.sum(_row_bytes(stored)).alias("n")).first()["n"] or 0
    return F.broadcast(stored) if size <= max_bytes else stored


def dealt(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt evenly to as many tasks as a shuffle has, at least one per core.

    A small file is read by one or two tasks; costly work on each row would then leave the other cores idle. The number is
    given, so that AQE does not join the small partitions again; rows go in turn, so that equal rows spread.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that later filters do not compute them again.

    Spark pushes a filter on a computed column below the projection by repeating the
    expression, and join keys bring such filters along. The columns therefore come out of
    a generator over a one-element array, which filters do not pass.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))
