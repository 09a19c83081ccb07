"""Registered queries and the DuckDB statement that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.functions.vocab import JUNK_TOKENS, STOPWORDS
from attesta.session import shared_folder  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its statement if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def normal_sql(x: str) -> str:
    """SQL of functions.text.normalize, with DuckDB's own folding of accents."""
    out = f"strip_accents(coalesce({x}, ''))"
    for letter, plain in (("ł", "l"), ("Ł", "L"), ("ø", "o"), ("Ø", "O"), ("æ", "ae"), ("Æ", "AE"), ("đ", "d"), ("Đ", "D"), ("ß", "ss"), ("ẞ", "SS"), ("&", " and ")):
        out = f"replace({out}, '{letter}', '{plain}')"
    return rf"trim(lower(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"


def key_sql(x: str) -> str:
    return f"replace({normal_sql(x)}, ' ', '')"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({normal_sql(x)}, ' '), lambda t: t <> '' AND t NOT IN ({quoted(JUNK_TOKENS + STOPWORDS)}))"
