"""Text, date, price and JSON column functions of the catalogue."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tag spellings that mean another tag, after normalisation.
TAG_ALIASES = {
    "rogue like": "roguelike",
    "rogue-like": "roguelike",
    "single player": "single-player",
    "multi player": "multiplayer",
}
#: How a title's series name ends.
SERIES_END = r"\s+(?:[ivx]+|\d+)(?:\s|:|$)|\s*:\s*"
#: Words that mean yes, and the formats of dates in the order in which they are tried.
TRUE_WORDS = ["1", "true", "t", "y", "yes"]
DATE_FORMATS = ["MMM d, yyyy", "d MMM, yyyy", "MMM yyyy", "yyyy"]


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_tag(tag: Column, ascii_only: bool = False) -> Column:
    """Lower case, compatibility form, white space and slashes as single hyphens, none at the ends.

    Only texts with other than ASCII characters pay for Unicode normalisation;
    ascii_only leaves it out of the plan altogether.
    """
    t = F.lower(tag)
    if not ascii_only:
        t = F.when(F.length(t) == F.octet_length(t), t).otherwise(_nfkc(t))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = F.regexp_replace(F.translate(t, "/ ", "--"), "-+", "-")
    return F.regexp_replace(t, "^-+|-+$", "")


def apply_alias(tag: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in TAG_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, tag), tag)


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones; none for null."""
    return F.coalesce(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def owners_midpoint(text: Column) -> Column:
    """'1,000,000 .. 2,000,000' is 1500000; null where two numbers aren't found."""
    low, high = (F.replace(F.regexp_extract(text, r"([\d,]+)\s*\.\.\s*([\d,]+)", i), F.lit(","), F.lit("")).try_cast("double") for i in (1, 2))
    return (low + high) / 2


def series_prefix(title: Column) -> Column:
    """The title up to a roman or arabic number or a colon, lower case and trimmed."""
    return F.trim(F.element_at(F.split(F.lower(F.trim(title)), SERIES_END, 2), 1))


def titles_match(wanted: Column, title: Column) -> Column:
    """Whether a wanted title means this one.

    It does if it is part of the title, or the title (of 4 characters or more) part
    of it; or if its series name (4 or more) is the title or begins it as whole words.
    """
    w, t = F.lower(F.trim(wanted)), F.lower(F.trim(title))
    prefix = series_prefix(w)
    within = F.contains(t, w) | (F.length(t) >= 4) & F.contains(w, t)
    series = (F.length(prefix) >= 4) & ((t == prefix) | F.startswith(t, F.concat(prefix, F.lit(" "))) | F.startswith(t, F.concat(prefix, F.lit(":"))))
    return (F.length(w) >= 2) & (within | series)


def same_series(seed_title: Column, title: Column) -> Column:
    """Whether a title holds the seed's series name, if that has 4 characters or more."""
    prefix = series_prefix(seed_title)
    return (F.length(prefix) >= 4) & F.contains(F.lower(title), prefix)


def parsed_date(text: Column) -> Column:
    """The first of the accepted formats that fits; null for others."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def vote(text: Column) -> Column:
    """1 for the words that mean yes, else 0."""
    return F.lower(F.trim(text)).isin(TRUE_WORDS).cast("int")


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def whole_or_null(text: Column) -> Column:
    return text.try_cast("bigint")


def joined(values: Column) -> Column:
    return F.array_join(values, ", ")


def price_of(is_free: Column, hundredths: Column) -> Column:
    """0 for free items, else hundredths / 100; null where unknown."""
    return F.when(F.coalesce(is_free, F.lit(False)), 0.0).otherwise(hundredths / 100.0)


def user_key(text: Column) -> Column:
    """A 17-digit account number anywhere in the text, else the name after /id/; null for neither."""
    number = F.regexp_extract(text, r"(7656119\d{10})", 1)
    name = F.regexp_extract(text, r"/id/([^/?#]+)", 1)
    return F.coalesce(F.nullif(number, F.lit("")), F.nullif(name, F.lit("")))


def json_slice(text: Column) -> Column:
    """From the first { to the last }, as a variant; null where that doesn't parse."""
    begin, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((begin > 0) & (end >= begin), F.try_parse_json(F.substring(text, begin, end - begin + 1)))


def list_line(text: Column) -> Column:
    """A line of an answer without its bullet or number."""
    return F.trim(F.regexp_replace(text, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))


def json_weights(df: DataFrame, json: str, keys: list[str], least: float = 5) -> DataFrame:
    """(keys, tag, weight): numeric members of JSON objects with at least that value.

    Other members, and texts that aren't objects or don't parse, are skipped one by one.
    """
    parsed = df.select(*keys, F.try_parse_json(F.when(F.length(json) >= 3, F.col(json))).alias("_v")).where("schema_of_variant(_v) like 'OBJECT%'")
    each = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(*keys, F.col("key").alias("tag"), F.col("value"))
    number = F.when(F.schema_of_variant("value").rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get("value", "$", "double"))
    return each.select(*keys, "tag", number.alias("weight")).where(F.col("weight") >= least)
