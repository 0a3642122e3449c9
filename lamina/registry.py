"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
#: SQL for T.content_words and T.tokens.
SQL_CONTENT = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains([" + STOPS + "], w)))"
SQL_TOKENS = "list_filter(string_split_regex(coalesce({0}, ''), '\\s+'), lambda w: w <> '')"


def query(sql: str | None = None):
    """Registers a query under its name, with SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
