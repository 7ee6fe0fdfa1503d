"""A map that opens: documents of bounded size by quadtree tile, linked by region.

``index.kml`` links to the quarters of the map, each of those to its own quarters, down to tiles with a
bounded number of placemarks. A link holds the box of what lies below it, so a viewer loads a tile only where
it is looked at. Every document is written whole by one task under a name of its own and then given its
final name, so a task that runs twice leaves one right file.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.operators.ranking import row_numbers
from larkfield.session import checkpointed
from larkfield.sinks.features import placemarks
from larkfield.spatial.wkt import _number

# The writer travels inside the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEEPEST = 18
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>'
_TAIL = "</Document></kml>\n"
_BOX = ["xmin", "ymin", "xmax", "ymax"]


def quadtree_key(x: Column, y: Column, levels: int = DEEPEST) -> Column:
    """One digit a level: 0 and 1 are the southern quarters, 2 and 3 the northern, odd ones lie east."""
    n = 1 << levels
    ix = F.least(F.greatest(F.floor((x + 180) / 360 * n), F.lit(0)), F.lit(n - 1)).cast("int")
    iy = F.least(F.greatest(F.floor((y + 90) / 180 * n), F.lit(0)), F.lit(n - 1)).cast("int")
    bit = lambda v, level: F.shiftright(v, levels - 1 - level).bitwiseAND(F.lit(1))
    return F.concat(*[(bit(iy, k) * 2 + bit(ix, k)).cast("string") for k in range(levels)])


def _tiled(rows: DataFrame, most: int) -> DataFrame:
    """Rows with their tile: the shortest prefix of the key that at most ``most`` rows share, in numbered parts if none is."""
    keys = rows.groupBy("key").agg(F.count("*").alias("n"))
    prefixes = keys.select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("len")).withColumn("prefix", F.expr("substr(key, 1, len)"))
    counts = prefixes.groupBy("prefix").agg(F.sum("n").alias("total"))
    fits = prefixes.join(counts, "prefix").where((F.col("total") <= most) | (F.col("len") == DEEPEST))
    chosen = fits.groupBy("key").agg(F.min(F.struct("len", "total")).alias("m"))
    placed = rows.join(chosen, "key").withColumns({"prefix": F.expr("substr(key, 1, m.len)"), "crowded": F.col("m.total") > most}).drop("m", "key")
    numbered = row_numbers(checkpointed(placed), [("name", "asc"), ("value", "asc")], "nth", ["prefix"])
    part = F.expr(f"(nth - 1) div {int(most)}").cast("string")
    return numbered.withColumn("tile", F.when(F.col("crowded"), F.concat("prefix", F.lit("-"), part)).otherwise(F.col("prefix")))


def _document(title: Column, body: Column) -> Column:
    # characters that XML does not allow would make the whole document unreadable
    clean = F.regexp_replace(body, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return F.concat(F.lit(_HEAD), title, F.lit("</name>\n"), clean, F.lit(_TAIL))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it for."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _stored(documents: DataFrame, folder: str) -> int:
    """Write a file per row (file, text); returns how many."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                target = f"{base}/{file}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(text.encode())
                store.move(draft, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return documents.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_map_document(df: DataFrame, layer: str, geometry: str, path: str, bad_path: str, most: int = 2000, **options) -> dict[str, int]:
    """Write ``index.kml`` and what it links to below ``path``; rows with a bad geometry go to ``bad_path``.

    A placemark lies in the tile that holds the middle of its box, whole and once. Tiles have at most ``most``
    placemarks; places with more at one spot get numbered parts. ``options`` are those of ``placemarks``.
    Returns the numbers of tiles and index documents. No row gives an index without links.
    """
    spark = df.sparkSession
    good, bad = placemarks(df, layer, geometry, keep_box=True, **options)
    bad.write.mode("overwrite").parquet(bad_path)
    key = quadtree_key((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)
    rows = checkpointed(good.select(F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), "value", *_BOX, key.alias("key")))
    tiled = checkpointed(_tiled(rows, most))
    extent = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")]
    # at most ``most`` placemarks come together in a row
    tiles = tiled.groupBy("tile", "crowded").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda v: v["value"]), "\n").alias("body"), *extent)
    tiles = checkpointed(tiles)
    folder = _qualified(spark, path)
    files = tiles.select(F.concat(F.lit("tiles/t"), "tile", F.lit(".kml")).alias("file"), _document(F.concat(F.lit("t"), "tile"), F.col("body")).alias("text"))
    written = _stored(files, folder)

    # nodes above the tiles: every shorter prefix of a tile's key
    own = F.regexp_extract("tile", "^[0-3]*", 0)
    depth = F.length(own) + F.when(F.col("crowded"), 1).otherwise(0)
    above = tiles.select("tile", own.alias("key"), depth.alias("depth"), *_BOX)
    inner = above.where("depth > 0").select(F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("len"), "key", *_BOX).select(
        F.expr("substr(key, 1, len)").alias("node"), *_BOX).groupBy("node").agg(*extent)
    leaf = above.select(F.concat(F.lit("tiles/t"), "tile", F.lit(".kml")).alias("href"), F.expr("substr(key, 1, greatest(depth - 1, 0))").alias("parent"), *_BOX)
    branch = inner.where("node <> ''").select(F.concat(F.lit("index/n"), "node", F.lit(".kml")).alias("href"), F.expr("substr(node, 1, length(node) - 1)").alias("parent"), *_BOX)
    sides = [F.concat(F.lit(f"<{n}>"), _number(F.col(c)), F.lit(f"</{n}>")) for n, c in (("north", "ymax"), ("south", "ymin"), ("east", "xmax"), ("west", "xmin"))]
    up = F.when(F.col("parent") == "", F.lit("")).otherwise(F.lit("../"))
    link = F.concat(F.lit("<NetworkLink><Region><LatLonAltBox>"), *sides, F.lit("</LatLonAltBox><Lod><minLodPixels>64</minLodPixels></Lod></Region><Link><href>"),
                    up, F.col("href"), F.lit("</href><viewRefreshMode>onRegion</viewRefreshMode></Link></NetworkLink>"))
    links = leaf.unionByName(branch).select("parent", "href", link.alias("link"))
    # a node has four quarters at most; a crowded place has one link for each of its parts
    pages = links.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("href", "link"))), lambda v: v["link"]), "\n").alias("body"))
    if not written:
        pages = spark.createDataFrame([("", "")], "parent string, body string")
    file = F.when(F.col("parent") == "", F.lit("index.kml")).otherwise(F.concat(F.lit("index/n"), "parent", F.lit(".kml")))
    indexes = _stored(pages.select(file.alias("file"), _document(F.concat(F.lit("n"), "parent"), F.col("body")).alias("text")), folder)
    return {"tiles": written, "indexes": indexes}
