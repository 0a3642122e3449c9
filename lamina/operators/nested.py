"""Nested values: every string in them with its path, and searches over all of them; a largest budget by halving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that no text should hold.
CONTROLS, BAD_QUOTES = r"[\x00-\x08\x0b-\x1f]", "[―‖]"
_FOUND = "array<struct<path: string, value: string>>"


def strings(value: Column, kind: T.DataType, path: Column) -> Column:
    """path and value of every string in a value, as an array: a.b for fields, a[0] for items, a[key] for values of a map.

    The expression follows the type when the plan is made, so that whatever is nested stays one projection without shuffle.
    Keys of maps aren't values; types without strings cost nothing; null values have no strings.
    """
    none = F.array().cast(_FOUND)
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), value.alias("value")))).otherwise(none)
    if not _has_strings(kind):
        return none
    if isinstance(kind, T.StructType):
        parts = [strings(value.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields if _has_strings(f.dataType)]
        return F.concat(*parts)
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x, i: strings(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
    else:
        each = F.transform(F.map_entries(value), lambda e: strings(e["value"], kind.valueType, F.concat(path, F.lit("["), e["key"].cast("string"), F.lit("]"))))
    return F.coalesce(F.flatten(each), none)


def _has_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_strings(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_strings(kind.elementType)
    return isinstance(kind, T.StringType) or (isinstance(kind, T.MapType) and _has_strings(kind.valueType))


def all_strings(rows: DataFrame, key: str) -> DataFrame:
    """key, path and value of every string in every column of rows, the key's own left out."""
    found = F.concat(F.array().cast(_FOUND), *[strings(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in rows.schema if f.name != key and _has_strings(f.dataType)])
    return rows.select(F.col(key), F.explode(found).alias("x")).select(key, "x.path", "x.value")


def code_points(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    """key, path and codes (U+..., distinct and sorted) of the strings in rows with characters of the pattern.

    Defined cases: no columns with strings or no such characters: no rows; a repeated key: rows of each; strings of any length are read as a whole.
    """
    found = all_strings(rows, key).where(F.col("value").rlike(pattern))
    codes = F.transform(F.array_distinct(F.regexp_extract_all("value", F.lit(f"({pattern})"), F.lit(1))), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")))
    return found.select(key, "path", F.array_join(F.array_sort(codes), " ").alias("codes"))


def largest(fits: Callable[[Column], Column], most: Column, halvings: int = 40) -> Column:
    """The largest whole number from 0 to most that fits, -1 if none does; what fits must fit for all smaller numbers too.

    The search halves inside one expression, a fixed number of times: enough for ranges up to 2^halvings, with no loop outside.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("low"), most.cast("bigint").alias("high"), F.lit(-1).cast("bigint").alias("best"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2)
        open_, good = acc["low"] <= acc["high"], fits(middle)
        return F.struct(
            F.when(open_ & good, middle + 1).otherwise(acc["low"]).cast("bigint").alias("low"), F.when(open_ & ~good, middle - 1).otherwise(acc["high"]).cast("bigint").alias("high"),
            F.when(open_ & good, middle).otherwise(acc["best"]).cast("bigint").alias("best"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, step, lambda acc: acc["best"])
