"""What the training-data operators share: tables in the shared folder, row keys, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}

#: A key counts as hot from 1/HOT_SHARE of all rows on, so at most HOT_SHARE keys are ever broadcast.
HOT_SHARE = 1024


def scratch_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode without one, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL_ROOTS.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lamina-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/lamina-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and no executor's loss undoes it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, path: str) -> None:
    """Add the rows of df to the Parquet table at path, which scratch_path named."""
    df.write.mode("append").parquet(path)


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a row by its doc_id and text, never null. Rows that repeat both share a key."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit("second"), text, doc_id)


def attach(rows: DataFrame, summary: DataFrame, keys: list[str], weight: str, values: list[str], spread: list[str], merge: bool = False) -> DataFrame:
    """Left join of rows with summary (one row a key, keys not null), safe against hot keys.

    weight is the number of rows of the key. Keys that hold 1/HOT_SHARE of all counted rows or more are
    broadcast: by their definition there are at most HOT_SHARE of them. Their rows get a salt from the
    spread columns, so that the shuffle for the other keys deals them out evenly. merge: those are joined by sorting
    both sides, however small the summary is, so that the plan is the same at every size.
    """
    total = summary.agg(F.sum(weight).alias("_total"))
    hot = summary.crossJoin(F.broadcast(total)).where(F.col(weight) * HOT_SHARE >= F.col("_total"))
    hot = hot.select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_is_hot"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_is_hot"), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long"))
    )
    rest = summary.select(*keys, *[F.col(v).alias(f"_rest_{v}") for v in values], F.lit(0).cast("long").alias("_salt"))
    joined = salted.join(rest.hint("merge") if merge else rest, [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_hot_{v}", f"_rest_{v}").alias(v) for v in values])


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs as a struct, whatever their names), doc_id, text, k1, k2, and at (the row's place, to deal out rows that repeat)."""
    doc_id = F.col("doc_id").cast("long")
    k1, k2 = row_key(doc_id, F.col("text"))
    return docs.select(F.struct("*").alias("row"), doc_id.alias("doc_id"), "text", k1.alias("k1"), k2.alias("k2"), F.monotonically_increasing_id().alias("at"))


def rows_with(df: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of row with another text; n_chars, if there is one, follows a text that changed."""
    new = {"text": text}
    if "n_chars" in columns:
        same = text.eqNullSafe(F.col("row.text"))
        new["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length(text).cast("long"))
    return df.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])
