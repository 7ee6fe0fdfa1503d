import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from larkfield import session
from larkfield.functions.columns import ColumnGroups
from larkfield.sinks import files as sink_files
from larkfield.sinks import tables
from larkfield.sources import files, jdbc, nested, sql


def write(tmp_path, name, *lines):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "part-0").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)


def test_positional_text_sets_bad_rows_aside(spark, tmp_path):
    path = write(tmp_path, "p", "1\x01Y\x01a\"b\x012.5\x01z", "2\x01\\N\x01\\N\x01\\N\x01z", "3\x01flag_1\x01c\x01oops\x01z",
                 "4\x01Q\x01c\x011\x01z", "5\x01Y")
    groups = ColumnGroups(["id"], ["flg"], ["cat"], ["num"], ["gone"])
    df = files.read_positional_text(spark, path, ["id", "flg", "cat", "num", "gone"], groups)
    good, bad = files.set_aside(df)
    assert good.columns == ["id", "flg", "cat", "num"]
    assert sorted(map(tuple, good.collect())) == [("1", 1.0, 'a"b', 2.5), ("2", 0.0, None, None), ("4", None, "c", 1.0)]
    assert sorted(r["id"] for r in bad.collect()) == ["3", "5"]


def test_import_needs_names(spark, tmp_path):
    path = write(tmp_path, "n", "1,2", "\\N,4")
    with pytest.raises(ValueError):
        files.import_with_names(spark, path)
    rows = files.import_with_names(spark, path, ["a", "b"], types={"b": "int"}).collect()
    assert sorted(map(str, rows)) == ["Row(a='1', b=2)", "Row(a=None, b=4)"]


def test_sql_select(spark):
    df = sql.sql_select(spark, "SELECT 1 AS a, 'x' AS b WHERE 1 = ?", [1], case="upper")
    assert df.columns == ["A", "B"] and sql.shape(df) == (1, 2)
    texts = sql.sql_select(spark, "SELECT 1 AS a WHERE :v = 0", {"v": 1}, infer_types=False, case=None)
    assert texts.dtypes == [("a", "string")] and texts.count() == 0
    with pytest.raises(ValueError):
        sql.sql_select(spark, " ")


def test_jdbc_options_without_a_database():
    assert jdbc.jdbc_options("u", query="q")["query"] == "q"
    assert jdbc.jdbc_options("u", table="t", properties={"user": "x"})["dbtable"] == "t"
    for both in ({}, {"query": "q", "table": "t"}):
        with pytest.raises(ValueError):
            jdbc.jdbc_options("u", **both)
    with pytest.raises(ValueError):
        jdbc.jdbc_read_partitioned(None, "u", "t", "id", 5, 5, 4)


def test_from_columns(spark):
    assert files.from_columns(spark, {"a": [1, 2], "b": ["x", "y"]}).count() == 2


def test_nested_documents(spark):
    inner = {"lines": {"1": {"name": "Red", "color": "#f00"}}, "stations": {"7": {"name": "Парк", "lineId": 1}, "8": {"name": "Савёловская", "lineId": 14}},
             "links": {"0": {"fromStationId": 7, "toStationId": 8}}}
    docs = spark.createDataFrame([(json.dumps({"data": json.dumps(inner)}),)], "value string")
    tables_ = nested.map_tables(docs)
    assert tuple(tables_["lines"].first()) == (1, "Red", "#f00")
    assert tuple(tables_["connections"].first()) == (7, 8, 1)
    places = spark.createDataFrame([(json.dumps({"lines": [
        {"id": "1", "stations": [{"name": " ПАРК ", "lat": 1.0, "lng": 2.0}, {"name": "Улица Сергея Эйзенштейна", "lat": 0, "lng": 0}]},
        {"id": "95", "stations": [{"name": "Савеловская", "lat": 3.0, "lng": 4.0}]}]}),)], "value string")
    rows = nested.place_rows(places)
    assert rows.count() == 2
    got = {r["id"]: (r["longitude"], r["latitude"]) for r in nested.locate_stations(tables_["stations"], rows).collect()}
    assert got == {7: (2.0, 1.0), 8: (4.0, 3.0)}


def test_load_fixtures(spark):
    ints = spark.createDataFrame([(0, 0, -1), (1, 3, -2)], "ints_1 long, ints_2 long, ints_3 long")
    assert tables.type_map(tables.prepare_load(ints)) == {"INTS_1": "BIGINT", "INTS_2": "BIGINT", "INTS_3": "BIGINT"}
    dates = spark.createDataFrame([(i, dt.datetime(2013, 1, i + 1)) for i in range(4)], "ints_1 long, dt_1 timestamp")
    ready = tables.prepare_load(dates)
    assert ready.columns == ["INTS_1", "DT_1_year", "DT_1_month", "DT_1_day"] and ready.count() == 4
    mixed = spark.createDataFrame([("aa", 0.1, "bcd")], "s string, f double, t string")
    assert tables.type_map(mixed) == {"s": "VARCHAR(3)", "f": "FLOAT", "t": "VARCHAR(3)"}
    with pytest.raises(ValueError):
        tables.prepare_load(spark.createDataFrame([(1, None)], "a int, b string"))
    with pytest.raises(ValueError):
        tables.type_map(spark.createDataFrame([("x" * 3001,)], "a string"))
    with pytest.raises(TypeError):
        tables.type_map(spark.sql("SELECT array(1) AS a"))


def test_replace_and_append_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "subs_id long, name string")
    table = tables.replace_table(df, "loaded_names", buckets=2)
    assert table.columns == ["SUBS_ID", "NAME"] and table.count() == 2
    assert tables.replace_table(df.limit(1), "loaded_names").count() == 1
    tables.append_columns(df, "loaded_names", ["subs_id", "name"])
    assert spark.table("loaded_names").count() == 3
    spark.sql("DROP TABLE loaded_names")


def test_staged_load(spark, tmp_path):
    long = "y" * 256
    path = write(tmp_path, "s", "a|b", "1|x", "1|w", "2|z", "2|z", "3", "4|x|y", f"5|{long}", '6|"q|r"')
    load = tables.staged_bulk_load(spark, path, ["a", "b"], key=["a"], sep="|", skip_header=True)
    assert sorted(map(tuple, load.loaded.collect())) == [("1", "w"), ("2", "z")]
    assert sorted(r["line"][:3] for r in load.errors_1.collect()) == ["3", "4|x", "5|y", '6|"']
    assert sorted(map(tuple, load.errors_2.collect())) == [("1", "x", 1), ("2", "z", 1)]
    quoted = tables.staged_bulk_load(spark, path, ["a", "b"], sep="|", quotes=True, skip_header=True)
    assert ("6", "q|r") in set(map(tuple, quoted.loaded.collect())) and quoted.errors_2.count() == 0


def test_write_lines_and_topk(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.9)], "id long, p double")
    sink_files.write_lines(df, "id", str(tmp_path / "l"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["1", "2", "3"]
    sink_files.export_topk(df, ["id"], [("p", "desc"), ("id", "asc")], 2, str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.csv(str(tmp_path / "t")).collect()) == ["2", "3"]


def test_partitioned_scan_prunes(spark, tmp_path):
    path = str(tmp_path / "tree")
    spark.range(10).selectExpr("id", "id % 2 AS report_date_day").write.partitionBy("report_date_day").parquet(path)
    df = files.scan_partitioned(spark, path, "report_date_day = 1")
    assert df.count() == 5
    assert "PartitionFilters: [isnotnull(report_date_day" in df._jdf.queryExecution().toString()


def test_broadcast_only_below_the_bound(spark):
    plan = lambda d: spark.range(10).join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(session.small_side(spark.range(50), 50 * 16))
    assert "strategy=broadcast" not in plan(session.small_side(spark.range(51), 50 * 16))
    wide = spark.range(3).selectExpr("id", "repeat('x', 5000) AS t")
    assert "strategy=broadcast" not in plan(session.small_side(wide, 10_000))


def test_header_goes_by_position(spark, tmp_path):
    path = write(tmp_path, "h", "SUBS,NAME", "1,a", "2,b", "id,name")
    load = tables.staged_bulk_load(spark, path, ["id", "name"], sep=",", skip_header=True)
    assert sorted(map(tuple, load.loaded.collect())) == [("1", "a"), ("2", "b"), ("id", "name")]
    whole = tables.staged_bulk_load(spark, path, ["id", "name"], sep=",")
    assert whole.loaded.count() == 4


def test_header_of_every_file_goes(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("id,name\n" + "".join(f"{k}{i},n\n" for i in range(4)))
    load = tables.staged_bulk_load(spark, str(tmp_path / "*.txt"), ["id", "name"], sep=",", skip_header=True)
    assert sorted(r["id"] for r in load.loaded.collect()) == sorted(f"{k}{i}" for k in range(3) for i in range(4))


def test_map_documents_open_and_hold_every_placemark_once(spark, tmp_path):
    import random
    import xml.etree.ElementTree as ET

    from larkfield.sinks.map_document import write_map_document

    rnd = random.Random(4)
    rows = [(f"p{i} <&> \x01", f"POINT ({rnd.uniform(30, 40)} {rnd.uniform(50, 60)})") for i in range(300)]
    rows += [(f"same{i}", "POINT (37.5 55.5)") for i in range(45)] + [("edge", "POINT (180 90)"), ("bad", "oops"), (None, "POINT (-180 -90)")]
    df = spark.createDataFrame(rows, "name string, wkt string")
    made = write_map_document(df, "points", "wkt", str(tmp_path / "map"), str(tmp_path / "bad"), most=20, name="name", description=None)
    space = "{http://www.opengis.net/kml/2.2}"
    names, seen, todo = [], set(), ["index.kml"]
    while todo:
        file = todo.pop()
        assert file not in seen
        seen.add(file)
        root = ET.parse(tmp_path / "map" / file).getroot()
        found = root.findall(f".//{space}Placemark")
        assert len(found) <= 20
        names += [p.find(f"{space}name").text or "" for p in found]
        for href in root.iter(f"{space}href"):
            todo.append(href.text.removeprefix("../") if "/" in file else href.text)
    assert sorted(names) == sorted((n or "").replace("\x01", "") for n, w in rows if w != "oops")
    files = {str(f.relative_to(tmp_path / "map")) for f in (tmp_path / "map").rglob("*.kml")}
    assert seen == files and made == {"tiles": sum(f.startswith("tiles") for f in files), "indexes": sum(not f.startswith("tiles") for f in files)}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    assert write_map_document(df.limit(0), "points", "wkt", str(tmp_path / "none"), str(tmp_path / "bad2"), name="name") == {"tiles": 0, "indexes": 1}
    ET.parse(tmp_path / "none" / "index.kml")
