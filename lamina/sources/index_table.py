"""An index as a table: rows by key in hashed, sorted folders, lookups that read one file for a key, and what must hold before it is built."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: The most keys that a lookup takes as literals; more come as a table.
MOST_LITERALS = 1_000


class IndexRefused(ValueError):
    """The rows can't become an index. total: how many are at fault; worst: the first of them."""

    def __init__(self, why: str, total: int, worst: list[tuple]):
        super().__init__(f"{total} {why}; first: {worst}")
        self.total, self.worst = total, worst


def too_long(rows: DataFrame, key: str, length: Column, most: int) -> DataFrame:
    """key and length of rows that an encoder of at most so many units would cut."""
    return rows.select(F.col(key).alias("key"), length.cast("long").alias("length")).where(F.col("length") > most)


def mismatches(artifacts: dict[str, DataFrame], key: str) -> DataFrame:
    """key and, for each artifact, how often it has the key, of keys that aren't exactly once in all of them.

    All artifacts are counted together: one shuffle of partial counts, no join, and no order or position is compared. A null key is a key like others.
    """
    names = list(artifacts)
    of = lambda name: artifacts[name].select(F.col(key).alias("key"), *[F.lit(int(n == name)).alias(n) for n in names])
    rows = of(names[0])
    for name in names[1:]:
        rows = rows.unionByName(of(name))
    counts = rows.groupBy("key").agg(*[F.sum(n).alias(n) for n in names])
    return counts.where(F.array_contains(F.array(*[F.col(n) != 1 for n in names]), True))


def _refuse(faults: DataFrame, why: str, order: list[Column], worst: int) -> None:
    """One pass: the number of faults is observed below a bounded top-k."""
    seen = Observation()
    rows = faults.observe(seen, F.count("*").alias("n")).orderBy(*order).limit(worst).collect()
    if rows:
        raise IndexRefused(why, seen.get["n"], [tuple(r) for r in rows])


def require_lengths(rows: DataFrame, key: str, length: Column, most: int = 512, worst: int = 10) -> None:
    """Fails with the longest rows if any is longer than most, so that no index silently loses the end of a text."""
    _refuse(too_long(rows, key, length, most), f"rows are longer than {most}", [F.desc("length"), F.asc_nulls_first("key")], worst)


def require_same_keys(artifacts: dict[str, DataFrame], key: str, worst: int = 10) -> None:
    """Fails with the smallest keys that aren't exactly once in every artifact."""
    _refuse(mismatches(artifacts, key), f"keys aren't exactly once in each of {', '.join(artifacts)}", [F.asc_nulls_first("key")], worst)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, key: str, path: str, buckets: int = 64, page_rows: int = 20_000) -> None:
    """Rows as Parquet in a folder for each bucket (a hash of the key), sorted by key, with a Bloom filter on it and small row groups.

    A key must be there once and not be null: otherwise IndexRefused names the first. Buckets should grow with the table (some hundred MB each).
    The folder appears by one renaming, when all is written; path must not be there yet.
    """
    if "_bucket" in rows.columns:
        raise ValueError("_bucket is a column of the index's own")
    spark = rows.sparkSession
    require_same_keys({"index": rows.select(key)}, key)
    _refuse(rows.where(F.col(key).isNull()).select(F.col(key)), "keys are null", [F.col(key)], 10)
    jpath, staged = spark._jvm.org.apache.hadoop.fs.Path, f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    files = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(jpath(path)):
        raise FileExistsError(path)
    try:
        dealt = rows.withColumn("_bucket", _bucket(F.col(key), buckets)).repartitionById(buckets, "_bucket").sortWithinPartitions("_bucket", key)
        writer = dealt.write.partitionBy("_bucket").option(f"parquet.bloom.filter.enabled#{key}", True).option("parquet.block.row.count.limit", page_rows)
        writer.parquet(f"{staged}/rows")
        about = {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue()}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{staged}/about")
        if not files.rename(jpath(staged), jpath(path)):
            raise OSError(f"could not rename {staged}")
    finally:
        files.delete(jpath(staged), True)


class Index:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str):
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.spark, self.path, self.key, self.buckets = spark, path, about["key"], about["buckets"]
        self.schema = StructType.fromJson(about["schema"])

    def rows(self) -> DataFrame:
        """All rows, with _bucket."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{self.path}/rows")

    def get(self, keys: Iterable) -> DataFrame:
        """key, state (found, missing) and the row's columns of a few keys, given as values.

        Buckets are literals of the plan, so that the scan lists and opens their folders only, and skips row groups by the key's
        range and Bloom filter. Repeated keys count once; null is missing; no keys: no rows.
        """
        wanted = list(dict.fromkeys(keys))
        if len(wanted) > MOST_LITERALS:
            raise ValueError(f"more than {MOST_LITERALS} keys: use join")
        kind = self.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in wanted], StructType([StructField(self.key, kind)]))
        placed = {r[0] for r in asked.select(_bucket(F.col(self.key), self.buckets)).collect()}
        scan = self.rows().where(F.col("_bucket").isin(sorted(placed)) & F.col(self.key).isin([k for k in wanted if k is not None]))
        return self._answer(asked, scan)

    def join(self, keys: DataFrame) -> DataFrame:
        """As get, for a table of keys of any size: its first column; both sides meet by bucket and key."""
        return self._answer(keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias(self.key)).distinct(), self.rows())

    def _answer(self, asked: DataFrame, scan: DataFrame) -> DataFrame:
        there = scan.drop("_bucket").withColumn("_there", F.lit(True))
        state = F.when(F.col("_there"), "found").otherwise("missing").alias("state")
        return asked.join(there, self.key, "left").select(self.key, state, *[n for n in self.schema.names if n != self.key])
