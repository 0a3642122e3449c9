"""The joins of corpus building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def must_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails when a left row has no partner."""
    joined = left.join(right.withColumn("_matched", F.lit(True)), keys, "left")
    checked = F.when(F.col("_matched").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no partner for"), *[F.col(k).cast("string") for k in keys]))).otherwise(F.lit(True))
    return joined.withColumn("_matched", checked).where("_matched").drop("_matched")


def prefer(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def compare_and_set(rows: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """column replaced by corrections.after where it equals corrections.expected; applied tells where. corrections: key, expected, after."""
    joined = rows.join(corrections, key, "left")
    hit = F.coalesce(F.col(column).eqNullSafe(F.col("expected")) & F.col("after").isNotNull(), F.lit(False))
    return joined.withColumn("applied", hit).withColumn(column, F.when(hit, F.col("after")).otherwise(F.col(column))).drop("expected", "after")


def assembled(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Each hit's groups, its own first (place 0), then the others that explain its key, by name: the hit's columns, place, group.

    hits: q, id, key, own (null: a hit that stands for its key alone, whose groups are just those of the key); members: key,
    group, in any number of copies. A hit without any group fails, as nothing could be returned for it. Groups stay rows, so
    that a key with many of them is no long array.
    """
    others = members.select("key", "group").distinct().where("group is not null")
    own = hits.where("own is not null").withColumn("group", F.col("own"))
    siblings = hits.join(others, "key", "left").where("own is null or group <> own")
    empty = F.raise_error(F.concat(F.lit("no group for "), F.col("key").cast("string"))).cast("int")
    order = Window.partitionBy("q", "id").orderBy(~F.col("own").eqNullSafe(F.col("group")), "group")
    place = F.when(F.col("group").isNull(), empty).otherwise(F.row_number().over(order) - 1)
    return own.unionByName(siblings.select(own.columns)).withColumn("place", place)


def range_band(rows: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """Each row's band by low <= value <= high. bands: a dimension of a few dozen rows."""
    return rows.join(F.broadcast(bands), F.col(value).between(F.col("low"), F.col("high")))


def bundles(chunks: DataFrame, explains: DataFrame) -> DataFrame:
    """What each chunk stands for: id, verses (ascending), stories (its own first, then by name). chunks: id, verse, own; explains: story, verse, distinct.

    A chunk with a story of its own stands for it and for every other story that explains one of its verses; one without
    (own null) for all stories of its verse. The verses are those of all these stories. A chunk without any story fails.
    """
    chunks = chunks.select("id", "verse", "own")
    spoken = chunks.where("own is not null").join(explains.select(F.col("story").alias("own"), F.col("verse").alias("v")), "own", "left")
    verses = spoken.select("id", "own", F.coalesce("v", "verse").alias("verse")).unionByName(chunks.where("own is null").select("id", "own", "verse"))
    stories = verses.join(explains, "verse", "left").select("id", "own", "story").distinct()
    missing = F.raise_error(F.concat(F.lit("no story for chunk "), F.col("id").cast("string"))).cast("string")
    stories = stories.withColumn("story", F.coalesce("story", "own", missing))
    names = stories.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((~F.col("story").eqNullSafe(F.col("own"))).alias("other"), "story"))).alias("s"))
    held = stories.join(explains, "story").groupBy("id").agg(F.array_sort(F.collect_set("verse")).alias("verses"))
    return names.join(held, "id").select("id", "verses", F.transform("s", lambda x: x["story"]).alias("stories"))
