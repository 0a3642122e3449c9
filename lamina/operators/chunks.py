"""Chunks of records: typed texts of each record, long ones in windows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import text as T


class Emitter(NamedTuple):
    """A kind of chunk: the last part of its identifiers, its type, its text, and the width and overlap of windows (None: never cut)."""

    suffix: str
    kind: str
    text: Column
    windows: tuple[int, int] | None = (200, 40)


def emit(rows: DataFrame, prefix: Column, emitters: list[Emitter], keep: list[str]) -> DataFrame:
    """The columns to keep, chunk_id, chunk_type, text, window_index, n_windows, prev_chunk_id and next_chunk_id.

    One pass over rows, however many emitters: a record's chunks are an array that is taken apart. Null and empty texts
    emit nothing. A text of one window keeps a bare identifier and has no window columns; others get :w0, :w1 and so on.
    """
    made = []
    for e in emitters:
        parts = T.windows(e.text, *e.windows) if e.windows else F.array(e.text)
        made.append(F.struct(F.lit(e.suffix).alias("suffix"), F.lit(e.kind).alias("kind"), F.when(e.text != "", parts).alias("parts")))
    held = F.filter(F.array(*made), lambda c: c["parts"].isNotNull())
    fields = rows.select(*keep, prefix.alias("_prefix"), F.explode(held).alias("_c"))
    parts = fields.select(*keep, F.concat_ws(":", "_prefix", "_c.suffix").alias("_base"), F.col("_c.kind").alias("chunk_type"), F.size("_c.parts").alias("_n"), F.posexplode("_c.parts").alias("_i", "text"))
    many = F.col("_n") > 1
    name = lambda i: F.concat("_base", F.lit(":w"), i.cast("string"))
    return parts.select(
        *keep,
        F.when(many, name(F.col("_i"))).otherwise(F.col("_base")).alias("chunk_id"),
        "chunk_type",
        "text",
        F.when(many, F.col("_i")).alias("window_index"),
        F.when(many, F.col("_n")).alias("n_windows"),
        F.when(many & (F.col("_i") > 0), name(F.col("_i") - 1)).alias("prev_chunk_id"),
        F.when(many & (F.col("_i") < F.col("_n") - 1), name(F.col("_i") + 1)).alias("next_chunk_id"),
    )
