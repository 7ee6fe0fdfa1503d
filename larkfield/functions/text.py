"""Text clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.session import small_side

# Patterns, word lists and renames that decide the cleaned text.
PHONE_PATTERN = r"^(\d{11}|\d{14})$"
STATION_NOISE = [
    r"\(.*\)", "Станция метро", "станция метро", "Станция", "Ст. метро", "метро", '"',
    "Люблинско-Дмитровской линии", "Таганско-Краснопресненской линии",
    "Сокольнической линии", "Кольцевой линии", "МЦК",
]
STATION_RENAMES = {
    "Кузнецкий мост": "Кузнецкий Мост",
    "Охотный ряд": "Охотный Ряд",
    "Лермонтовский Проспект": "Лермонтовский проспект",
    "улица Старокачаловская": "Улица Старокачаловская",
    "улица академика Янгеля": "Улица Академика Янгеля",
    "Новые Черемушки": "Новые Черёмушки",
    "Хорошевская": "Хорошёвская",
    "Тропарево": "Тропарёво",
    "Тёплый стан": "Тёплый Стан",
    "Октябрьское поле": "Октябрьское Поле",
    "Речной Вокзал": "Речной вокзал",
    "Проспект мира": "Проспект Мира",
    "Деловой Центр": "Деловой центр",
}
LINE_OVERRIDES = {
    " ТПК": "Большая кольцевая линия",
    "Третий пересадочный контур": "Большая кольцевая линия",
}
MISPLACED_ADDRESS = ("нзенская", "Москва Город\\Станция метро Фрунзенская")
FLAG_VALUES = {"\\N": 0.0, "Y": 1.0, "N": 0.0, "S-": 0.0}


def normalize_phone(number: Column) -> Column:
    """Numbers of 11 or 14 digits become ``7`` and their last ten digits; others stay."""
    return F.when(number.rlike(PHONE_PATTERN), F.concat(F.lit("7"), F.right(number, F.lit(10)))
                  ).otherwise(number)


def repair_address(address: Column, fix: tuple[str, str] = MISPLACED_ADDRESS) -> Column:
    """Replace the whole address when it holds the marker of a known bad row."""
    marker, whole = fix
    return F.when(address.contains(marker), F.lit(whole)).otherwise(address)


def station_part(address: Column) -> Column:
    """Text after the first backslash; NULL when there is none."""
    return F.get(F.split(address, r"\\"), F.lit(1))


def clean_station(part: Column, noise: Sequence[str] = STATION_NOISE) -> Column:
    """Station name: text before a comma, without the noise patterns, trimmed.

    The patterns are removed in the given order, longer phrases first.
    """
    name = F.substring_index(part, ",", 1)
    for pattern in noise:
        name = F.regexp_replace(name, pattern, "")
    return F.trim(name)


def extract_qualifier(part: Column) -> Column:
    """Line name beside a station name; empty when there is none.

    In brackets, else after a comma, else after the last double quote. Blanks are kept.
    """
    bracket = F.get(F.split(part, r"\("), F.lit(1))
    comma = F.get(F.split(part, ","), F.lit(1))
    quote = F.substring_index(part, '"', -1)
    found = (F.when(part.contains("("), bracket).when(part.contains(","), comma)
             .when(part.contains('"'), quote))
    stripped = F.btrim(found, F.lit(")"))
    return F.when(part.isNull(), F.lit(None)).otherwise(F.coalesce(stripped, F.lit("")))


def dict_replace(column: Column, mapping: Mapping[str, str]) -> Column:
    """Exact-match rename by a short fixed mapping; other values stay."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    if not pairs:
        return column
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)


def lookup_or_keep(df: DataFrame, column: str, lookup: DataFrame, key: str, value: str,
                   output: str) -> DataFrame:
    """Rename by a lookup table: its ``value`` where ``key`` matches, else the old text.

    ``lookup`` must hold each key once. ``<output>_found`` tells whether a key matched.
    """
    side = small_side(lookup.select(F.col(key).alias("_key"), F.col(value).alias("_value")))
    joined = df.join(side, df[column] == F.col("_key"), "left")
    return joined.select(
        *[df[c] for c in df.columns],
        F.coalesce(F.col("_value").cast("string"), df[column].cast("string")).alias(output),
        F.col("_key").isNotNull().alias(f"{output}_found"))


def decode_flag(column: Column, values: Mapping[str, float] = FLAG_VALUES,
                strict: bool = False) -> Column:
    """``..1``/``..0`` give their last digit, listed codes their number.

    Other text gives NULL, or fails the query when ``strict``. NULL stays NULL.
    """
    last = F.right(column, F.lit(1))
    pairs = [F.lit(v) for kv in values.items() for v in kv]
    mapped = F.try_element_at(F.create_map(*pairs), column)
    decoded = F.when(last.isin("0", "1"), last.cast("double")).otherwise(mapped)
    if strict:
        bad = column.isNotNull() & decoded.isNull()
        error = F.raise_error(F.concat(F.lit("unknown flag "), column)).cast("double")
        decoded = F.when(bad, error).otherwise(decoded)
    return decoded


def bounded_text(text: Column, limit: int, alternative: Column) -> Column:
    """``alternative`` once the text reaches ``limit`` characters."""
    return F.when(F.length(text) >= limit, alternative).otherwise(text)


def describe_row(names: Sequence[str], columns: Mapping[str, Column] | None = None) -> Column:
    """One ``name: value`` line per column; NULL is written as ``None``."""
    columns = columns or {}
    lines = []
    for name in names:
        value = F.coalesce(columns.get(name, F.col(name)).cast("string"), F.lit("None"))
        lines.append(F.concat(F.lit(f"{name}: "), value))
    return F.concat_ws("\n", *lines)


def describe_html(titles: Sequence[str], cells: Sequence[Column]) -> Column:
    """A two-row HTML table: the titles, then the values of the row."""
    head = "".join(f"<td>{t}</td>" for t in titles)
    body = [F.concat(F.lit("<td>"), F.coalesce(c.cast("string"), F.lit("NA")), F.lit("</td>"))
            for c in cells]
    return F.concat(F.lit(f"<table><tr>{head}</tr><tr>"), *body, F.lit("</tr></table>"))


def percent_text(share: Column) -> Column:
    """A share as ``12.34%``, halves rounded to even."""
    return F.concat(F.format_string("%.2f", F.bround(share * 100, 2)), F.lit("%"))


def kml_colour(rgb: Column, prefix: str = "#a0") -> Column:
    """``#RRGGBB`` to opacity, blue, green, red."""
    return F.concat(F.lit(prefix), F.substring(rgb, 6, 2), F.substring(rgb, 4, 2),
                    F.substring(rgb, 2, 2))
