"""Readers of JSON lines, JSON documents, texts, pages and annotation sheets. Schemas are given, never inferred, so that nothing is read twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One record a line. Tolerant: a missing path gives no rows, and lines that aren't records are left out; otherwise both fail."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    try:
        return reader.json(path)
    except AnalysisException as error:
        if tolerant and _missing(error):
            return spark.createDataFrame([], schema)
        raise


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The records of one JSON document; None if it is missing or isn't JSON."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        df.limit(1).collect()
    except AnalysisException as error:
        if _missing(error):
            return None
        raise
    except Exception as error:  # the reader's own errors differ by release; only malformed records are meant
        if "MALFORMED_RECORD" in str(error):
            return None
        raise
    return df


def whole_texts(spark: SparkSession, path: str, glyphs: dict[str, str] | None = None) -> DataFrame:
    """path, modified and text of each file, with single characters replaced as they are read."""
    text = F.col("value")
    if glyphs:
        text = F.translate(text, "".join(glyphs), "".join(glyphs.values()))
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), text.alias("text"))


def verified(spark: SparkSession, folder: str, pins: DataFrame) -> DataFrame:
    """Each pinned file's state in folder: ok, changed or missing. pins: path (below folder), sha256 (lowercase hex). A pin counts once; files without one don't.

    Files are read whole, one a row, by Spark's reader of binary files (2 GB each at most); a folder that isn't there has none.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        files = reader.load(folder)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return pins.select("path", "sha256").distinct().withColumn("state", F.lit("missing"))
    # the reader gives qualified paths: what comes after the folder's own is compared
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/") + "/"
    below = F.substring_index(F.col("path"), root, -1)
    found = files.select(below.alias("path"), F.sha2("content", 256).alias("actual"))
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.lower("sha256"), "ok").otherwise("changed")
    return pins.select("path", "sha256").distinct().join(found, "path", "left").select("path", "sha256", state.alias("state"))


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, that of the smallest order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def annotation_sheet(spark: SparkSession, path: str, columns: list[str], cell: str) -> DataFrame:
    """A filled-in sheet, all columns as texts, and label: null for a blank cell, 0 or 1. Any other cell fails."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    value = F.trim(F.coalesce(F.col(cell), F.lit("")))
    wrong = F.raise_error(F.concat(F.lit("not a label: "), value)).cast("int")
    return rows.withColumn("label", F.when(value.isin("0", "1"), value.cast("int")).when(value != "", wrong))


def stale(metrics: DataFrame, index: DataFrame) -> DataFrame:
    """Whether the newest metrics file is older than the newest file of the index. Both: modified."""
    one = metrics.agg(F.max("modified").alias("m")).crossJoin(index.agg(F.max("modified").alias("i")))
    return one.select((F.col("m") < F.col("i")).alias("stale"))
