import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from larkfield.functions import columns, features, text


def values(spark, rows, expression, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expression).collect()]


def test_phone(spark):
    got = values(spark, ["89161234567", "00089161234567", "9161234567", "8916123456x", None],
                 text.normalize_phone(F.col("c")))
    assert got == ["79161234567", "79161234567", "9161234567", "8916123456x", None]


ADDRESSES = [
    ("Москва Город\\Станция метро Сокол (Замоскворецкая линия)", "Сокол", "Замоскворецкая линия"),
    ("Москва Город\\Станция метро Тропарево, Сокольническая линия", "Тропарево", " Сокольническая линия"),
    ('Москва Город\\Ст. метро "Динамо" Замоскворецкая', "Динамо Замоскворецкая", " Замоскворецкая"),
    ("Москва Город\\Станция Аэропорт", "Аэропорт", ""),
    ("Москва Город\\Москва Город\\Станция метро Фрунзенская", "Фрунзенская", ""),
    ("Москва Город\\станция метро Деловой Центр, ТПК", "Деловой Центр", " ТПК"),
]


def test_addresses(spark):
    part = text.station_part(text.repair_address(F.col("c")))
    rows = [a for a, _, _ in ADDRESSES]
    assert values(spark, rows, text.clean_station(part)) == [s for _, s, _ in ADDRESSES]
    assert values(spark, rows, text.extract_qualifier(part)) == [q for _, _, q in ADDRESSES]


def test_second_bracket_and_rename(spark):
    assert values(spark, ["A (x) (y)"], text.extract_qualifier(F.col("c"))) == ["x) "]
    assert values(spark, ["Тропарево", "Иное", None], text.dict_replace(F.col("c"), text.STATION_RENAMES)) == [
        "Тропарёво", "Иное", None]


def test_flags(spark):
    got = values(spark, ["Y", "N", "S-", "\\N", "x1", "0", "Q", None], text.decode_flag(F.col("c")))
    assert got == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, None, None]
    with pytest.raises(Exception, match="unknown flag"):
        values(spark, ["Q"], text.decode_flag(F.col("c"), strict=True))


def test_like_and_levenshtein_on_letters(spark):
    row = spark.sql("SELECT 'hello' LIKE 'HELLO' a, 'hello' ILIKE 'HELLO' b, levenshtein('мама', 'папа') c").first()
    assert tuple(row) == (False, True, 2)


def test_lookup_or_keep(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    look = spark.createDataFrame([("a", 7)], "k string, v int")
    got = {r["c"]: (r["o"], r["o_found"]) for r in text.lookup_or_keep(df, "c", look, "k", "v", "o").collect()}
    assert got == {"a": ("7", True), "b": ("b", False), None: (None, False)}


@pytest.mark.parametrize("names, wanted, key", [
    (["ints_1", "ints_2", "ints_3"], "ints_2", "ints_2"),
    (["str_1", "float_1", "int_1"], None, "str_1"),
    (["str_1", "float_1", "int_1"], "missing", "str_1"),
    (["ints_1", "MSISDN"], None, "MSISDN"),
    (["ints_1", "SUBS_ID"], None, "SUBS_ID"),
    (["ints_1", "MSISDN", "SUBS_ID"], None, "SUBS_ID"),
    (["ints_1", "MSISDN", "SUBS_ID"], "MSISDN", "MSISDN"),
])
def test_guess_key(names, wanted, key):
    assert columns.guess_key(names, wanted) == key


def test_column_groups():
    names = ["msisdn", "bal_sk_amt", "kurt_day_mou", "gender", "branch", "mou", "task_cnt", "tp_id"]
    g = columns.column_groups(names, ["msisdn"], ["gender"], ["branch"], ["tp_id"])
    assert g.kept == ["msisdn", "gender", "branch", "mou", "task_cnt"]
    assert g.dropped == ["bal_sk_amt", "kurt_day_mou", "tp_id"]


def test_update_keeps_value_on_null_condition(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "x int, m boolean")
    assert [r["x"] for r in columns.update_where(df, "x", F.col("m"), F.lit(0)).collect()] == [1, 0, 3]


def test_names_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert columns.normalize_names(df).columns == ["A", "B"]
    assert columns.any_null(df) and not columns.any_null(df.select("a"))
    assert {r["column_name"]: r["nulls"] for r in columns.null_report(df).collect()} == {"a": 0, "b": 1}
    df.createOrReplaceTempView("two_columns")
    assert [tuple(r) for r in columns.list_columns(spark, "two_columns").collect()] == [(1, "a", "int"), (2, "b", "string")]


def test_multi_column_apply(spark):
    df = spark.createDataFrame([(1, "yes,asd", "a,s,s")], "x int, y string, z string")
    out = columns.apply_to_columns(df, {"a": "y", "b": "z"}, lambda c: F.regexp_replace(c, ",", "!")).first()
    assert (out["a"], out["b"], out["y"]) == ("yes!asd", "a!s!s", "yes,asd")


def test_clean_features_keeps_null(spark):
    df = spark.createDataFrame([(-5.0, 7, 0.25, 20000.0), (None, None, None, None), (9999.0, 2, 1.0, 5.0)],
                               "rc double, add_sim_cnt int, io_voice_traf_ratio double, mou double")
    rows = [tuple(r) for r in features.clean_features(df).collect()]
    assert rows[0] == (0.0, "5", 0.5, 10000.0)
    assert rows[1] == (None, None, None, None)
    assert rows[2][0] == pytest.approx(math.log1p(5000)) and rows[2][1:] == ("2", 1.0, 5.0)


def test_interactions_guard_zero(spark):
    df = spark.createDataFrame([(6.0, 2.0), (6.0, 0.0), (None, 3.0)], "a double, f double")
    out = features.interaction_features(df, ["a", "f"], "f")
    assert [(r["a_mult_f"], r["a_div_f"]) for r in out.collect()] == [(12.0, 3.0), (0.0, 0.0), (None, None)]


def test_scaling_of_constant_and_null(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, None)], "a double, b double")
    assert [r["a_scaled"] for r in features.min_max_scale(df, ["a"]).collect()] == [None, None]
    assert [r["b_scaled"] for r in features.max_scale(df, ["b"]).collect()] == [1.0, 0.0]


def test_pseudocolour(spark):
    got = values(spark, [0.0, 0.25, 0.5, 1.0, None], features.pseudocolour(F.col("c")), "c double")
    assert got == ["#00FF00", "#80FF00", "#FFFF00", "#FF0000", None]


def test_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    got = {r["x"]: r["b"] for r in features.equal_width_bin(df, "x", 5, "b").collect()}
    assert [got[float(v)] for v in range(11)] == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    dec = {r["x"]: r["d"] for r in features.quantile_bin(df, "x", "d").collect()}
    assert dec[0.0] is None and dec[1.0] == 1 and dec[10.0] == 10
    low = {r["x"]: r["d"] for r in features.quantile_bin(df, "x", "d", include_lowest=True).collect()}
    assert low[0.0] == 1


def test_levels_and_ids(spark):
    df = spark.createDataFrame([("0",), ("1",), ("-1",), ("1",)], "t string")
    assert [tuple(r) for r in features.factor_levels(df, "t").orderBy("position").collect()] == [(0, "-1"), (1, "0"), (2, "1")]
    got = {(r["t"], r["o"]) for r in features.relabel_levels(df, "t", ["0", "1", "-1"], "o").collect()}
    assert got == {("-1", "0"), ("0", "1"), ("1", "-1")}


def test_rare_and_excess_levels(spark):
    df = spark.createDataFrame([("a", "x")] * 12 + [("b", "y")] * 11 + [("c", "z")] * 3, "p string, q string")
    count = lambda d: {r[0]: r[1] for r in d.groupBy("p_q").count().collect()}
    assert count(features.categorical_interaction(df, ["p", "q"])) == {"a_x": 12, "b_y": 11, "other": 3}
    assert count(features.categorical_interaction(df, ["p", "q"], max_factors=1)) == {"a_x": 12, "other": 14}


def test_interaction_levels_are_pairs(spark):
    rows = [("a_b", "c")] * 6 + [("a", "b_c")] * 6 + [("x", None)] * 12 + [(None, "x")] * 12
    df = spark.createDataFrame(rows, "f string, g string")
    got = features.categorical_interaction(df, ["f", "g"]).groupBy("f", "g", "f_g").count().collect()
    levels = {(r["f"], r["g"]): r["f_g"] for r in got}
    assert levels[("a_b", "c")] == levels[("a", "b_c")] == "other"
    assert levels[("x", None)] == r"x_\N" and levels[(None, "x")] == r"\N_x"
    kept = features.categorical_interaction(df, ["f", "g"], min_occurrence=6)
    assert {(r["f"], r["g"]): r["f_g"] for r in kept.collect()}[("a_b", "c")] == r"a\_b_c"


def test_poisson_draws_of_large_rates(spark):
    from larkfield.operators.sampling import poisson_weight
    df = spark.range(4000).select(poisson_weight("s", "id", 50.0).alias("n"))
    low, mean, high = df.selectExpr("min(n)", "avg(n)", "max(n)").first()
    assert 49 < mean < 51 and low < 35 and high > 65
