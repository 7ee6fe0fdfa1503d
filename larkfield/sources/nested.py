"""Nested JSON: documents inside documents, maps and arrays to rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shape of the two map documents, line numbers that differ between
# them, spellings that differ, and one stop that only the second document lists.
MAP_SCHEMA = T.StructType([
    T.StructField("lines", T.MapType(T.StringType(), T.StructType([
        T.StructField("name", T.StringType()), T.StructField("color", T.StringType())]))),
    T.StructField("stations", T.MapType(T.StringType(), T.StructType([
        T.StructField("name", T.StringType()), T.StructField("lineId", T.IntegerType())]))),
    T.StructField("links", T.MapType(T.StringType(), T.StructType([
        T.StructField("fromStationId", T.IntegerType()),
        T.StructField("toStationId", T.IntegerType())]))),
])
PLACE_SCHEMA = T.StructType([T.StructField("lines", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("stations", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType())])))])))])
LINE_NUMBERS = {"95": 14, "96": 13, "97": 15}
PLACE_RENAMES = {
    "библиотека им.ленина": "библиотека имени ленина",
    "воробьевы горы": "воробьёвы горы",
    "щелковская": "щёлковская",
    "семеновская": "семёновская",
    "молодежная": "молодёжная",
    "филевский парк": "филёвский парк",
    "новые черемушки": "новые черёмушки",
    "теплый стан": "тёплый стан",
    "савеловская": "савёловская",
    "тропарево": "тропарёво",
    "хорошево": "хорошёво",
    "хорошевская": "хорошёвская",
}
SKIPPED_PLACE = "улица сергея эйзенштейна"


def inner_json(text: Column, field: str, schema: T.DataType | str) -> Column:
    """Decode the JSON text held in a string field of an outer JSON document."""
    return F.from_json(F.get_json_object(text, f"$.{field}"), schema)


def map_rows(df: DataFrame, column: str, key: str, fields: Mapping[str, str],
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of an id -> object map: the id as ``key`` and the wanted fields, renamed."""
    rows = df.select(*keep, F.explode(F.col(column)).alias("_id", "_object"))
    return rows.select(*keep, F.col("_id").alias(key),
                       *[F.col("_object")[source].alias(out) for out, source in fields.items()])


def map_tables(documents: DataFrame, text: str = "value") -> dict[str, DataFrame]:
    """Lines, stations and connections of a network map document."""
    parsed = documents.select(inner_json(F.col(text), "data", MAP_SCHEMA).alias("m")).select("m.*")
    lines = map_rows(parsed, "lines", "line", {"name": "name", "colour": "color"})
    stations = map_rows(parsed, "stations", "id", {"name": "name", "line": "lineId"})
    links = map_rows(parsed, "links", "link", {"station1": "fromStationId", "station2": "toStationId"})
    stations = stations.withColumn("id", F.col("id").cast("int"))
    origin = stations.select(F.col("id").alias("station1"), "line")
    return {"lines": lines.withColumn("line", F.col("line").cast("int")), "stations": stations,
            "connections": links.join(origin, "station1").select("station1", "station2", "line")}


def place_rows(documents: DataFrame, text: str = "value",
               line_numbers: Mapping[str, int] = LINE_NUMBERS,
               renames: Mapping[str, str] = PLACE_RENAMES,
               skipped: str = SKIPPED_PLACE) -> DataFrame:
    """Rows ``(line, name, longitude, latitude)`` from lines that hold arrays of stops.

    Names are lower-cased, trimmed and respelt; line numbers are mapped to the map's own.
    """
    parsed = documents.select(F.from_json(F.col(text), PLACE_SCHEMA).alias("p"))
    lines = parsed.select(F.explode("p.lines").alias("l"))
    stops = lines.select(F.col("l.id").alias("_line"), F.explode("l.stations").alias("s"))
    numbers = F.create_map(*[F.lit(v) for kv in line_numbers.items() for v in kv])
    spellings = F.create_map(*[F.lit(v) for kv in renames.items() for v in kv])
    name = F.trim(F.lower(F.col("s.name")))
    return stops.select(
        F.coalesce(F.try_element_at(numbers, F.col("_line")), F.col("_line").cast("int")).alias("line"),
        F.coalesce(F.try_element_at(spellings, name), name).alias("name"),
        F.col("s.lng").alias("longitude"), F.col("s.lat").alias("latitude"),
    ).where(F.col("name") != skipped)


def locate_stations(stations: DataFrame, places: DataFrame) -> DataFrame:
    """Stations with coordinates of the stop of the same line and lower-cased name.

    Stations without a stop keep NULL coordinates. If a stop is listed twice, one of its
    positions is taken whole, the largest, so the result does not depend on row order.
    """
    one = (places.groupBy("line", "name")
           .agg(F.max(F.struct("longitude", "latitude")).alias("at"))
           .select(F.col("line").alias("_line"), F.col("name").alias("_name"), "at"))
    match = (stations["line"] == one["_line"]) & (F.lower(stations["name"]) == one["_name"])
    return stations.join(one, match, "left").select(
        "id", F.col("at.latitude").alias("latitude"), F.col("at.longitude").alias("longitude"),
        "name", "line")
