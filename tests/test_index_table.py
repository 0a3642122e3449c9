"""The index table: what it refuses, what lookups return and how much they read."""

import os

import pytest
from pyspark.sql import functions as F

from lamina.sources import index_table as I


@pytest.fixture
def index(spark, tmp_path):
    path = str(tmp_path / "index")
    I.write_index(spark.range(5_000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), (F.col("id") * 2).alias("n")), "chunk_id", path, buckets=8, page_rows=100)
    return I.Index(spark, path)


def test_lookups(index, spark):
    got = {tuple(r) for r in index.get(["c7", "c4999", "nope", "c7", None]).collect()}
    assert got == {("c7", "found", 14), ("c4999", "found", 9998), ("nope", "missing", None), (None, "missing", None)}
    assert index.get([]).collect() == []
    asked = spark.createDataFrame([("c7",), ("c7",), ("nope",), (None,)], "k string")
    assert {tuple(r) for r in index.join(asked).collect()} == {("c7", "found", 14), ("nope", "missing", None), (None, "missing", None)}
    with pytest.raises(ValueError, match="use join"):
        index.get(f"c{i}" for i in range(2_000))


def test_every_row_is_there_once(index):
    assert index.rows().count() == 5_000 and index.rows().select("chunk_id").distinct().count() == 5_000
    assert index.rows().where(F.col("_bucket") != I._bucket(F.col("chunk_id"), 8)).count() == 0


def _scan_metrics(df):
    """Metrics of the file scans of a plan that has run."""
    found, open_ = {}, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            open_.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            open_.append(node.plan())
        children = node.children()
        open_ += [children.apply(i) for i in range(children.length())]
        if node.nodeName().startswith("Scan parquet"):
            for name in ("numFiles", "numOutputRows"):
                found[name] = found.get(name, 0) + node.metrics().apply(name).value()
    return found


def test_a_lookup_opens_one_file(index):
    one = index.get(["c1234"])
    assert [r.n for r in one.collect()] == [2468]
    metrics = _scan_metrics(one)
    assert metrics["numFiles"] == 1 and metrics["numOutputRows"] <= 5_000 // 8 * 2
    assert len([n for _, _, names in os.walk(f"{index.path}/rows") for n in names if n.endswith(".parquet")]) == 8


def test_what_is_no_index(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(I.IndexRefused) as e:
        I.write_index(spark.createDataFrame([("a",), ("b",), ("a",), ("a",)], "k string"), "k", path)
    assert (e.value.total, e.value.worst) == (1, [("a", 3)])
    with pytest.raises(I.IndexRefused):
        I.write_index(spark.createDataFrame([("a",), (None,)], "k string"), "k", path)
    with pytest.raises(ValueError):
        I.write_index(spark.createDataFrame([("a", 1)], "k string, _bucket int"), "k", path)
    assert os.listdir(tmp_path) == []
    I.write_index(spark.createDataFrame([("a",)], "k string").where("false"), "k", path)
    assert [tuple(r) for r in I.Index(spark, path).get(["a"]).collect()] == [("a", "missing")]
    with pytest.raises(FileExistsError):
        I.write_index(spark.createDataFrame([("a",)], "k string"), "k", path)


def test_long_rows_are_refused(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("w "), F.col("id").cast("int")).alias("text"))
    size = F.size(F.split(F.trim("text"), " "))
    I.require_lengths(rows, "id", size, most=99)
    with pytest.raises(I.IndexRefused) as e:
        I.require_lengths(rows, "id", size, most=50)
    assert e.value.total == 49 and e.value.worst == [(i, i) for i in range(99, 89, -1)]


def test_artifacts_must_have_the_same_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k long"), spark.createDataFrame([(1,), (3,), (2,)], "k long")
    assert {tuple(r) for r in I.mismatches({"a": a, "b": b}, "k").collect()} == {(2, 2, 1), (3, 0, 1)}
    with pytest.raises(I.IndexRefused) as e:
        I.require_same_keys({"a": a, "b": b}, "k")
    assert (e.value.total, e.value.worst) == (2, [(2, 2, 1), (3, 0, 1)])
    I.require_same_keys({"a": a.where("k = 1"), "b": b.where("k = 1")}, "k")
    I.require_same_keys({"a": a.where("false"), "b": b.where("false")}, "k")
