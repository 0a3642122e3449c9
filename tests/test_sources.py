"""Readers and writers: round trips and broken files."""

import csv
import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lamina.sources import readers, writers


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "s": ["x"]}\n\nnot json\n{"k": 2}\n')
    got = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "k int, s array<string>", tolerant=True)
    assert [(r.k, r.s) for r in got.orderBy("k").collect()] == [(1, ["x"]), (2, None)]
    assert readers.json_lines(spark, str(tmp_path / "none"), "k int", tolerant=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.json_lines(spark, str(tmp_path / "none"), "k int")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), "k int").collect()


def test_json_document(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"k": 1}, indent=2))
    (tmp_path / "b.json").write_text("{")
    assert readers.json_document(spark, str(tmp_path / "a.json"), "k int").first().k == 1
    assert readers.json_document(spark, str(tmp_path / "b.json"), "k int") is None
    assert readers.json_document(spark, str(tmp_path / "c.json"), "k int") is None


def test_whole_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo ―")
    rows = readers.whole_texts(spark, str(tmp_path / "a.txt"), {"―": "-"})
    assert [r.text for r in rows.collect()] == ["one\ntwo -"]
    assert readers.stale(rows, rows).first().stale is False


def test_annotation_sheet(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,label_a\n1,0\n2,\n3, 1\n')
    rows = readers.annotation_sheet(spark, str(tmp_path / "a.csv"), ["id", "label_a"], "label_a")
    assert [(r.id, r.label) for r in rows.orderBy("id").collect()] == [("1", 0), ("2", None), ("3", 1)]
    (tmp_path / "b.csv").write_text("id,label_a\n1,yes\n")
    with pytest.raises(Exception, match="not a label: yes"):
        readers.annotation_sheet(spark, str(tmp_path / "b.csv"), ["id", "label_a"], "label_a").collect()


def test_keep_first(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, o int, v string")
    assert sorted(r.v for r in readers.keep_first(df, "k", "o").collect()) == ["a", "c"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x", "y"], None, 0.5), (2, None, 'q"uote', float("nan"))], "k int, a array<string>, t string, v double")
    writers.flat_csv(df.coalesce(1), str(tmp_path / "csv"))
    rows = list(csv.reader(open(glob.glob(f"{tmp_path}/csv/part*")[0])))
    assert rows == [["k", "a", "t", "v"], ["1", "x;y", "", "0.5"], ["2", "", 'q"uote', "NaN"]]
    writers.json_lines(df, str(tmp_path / "j"), by="k")
    writers.json_lines(df.where("k = 2").withColumn("t", F.lit("new")), str(tmp_path / "j"), by="k")
    back = readers.json_lines(spark, str(tmp_path / "j"), "k int, a array<string>, t string, v double")
    assert sorted((r.k, r.t) for r in back.collect()) == [(1, None), (2, "new")]
    assert writers.report_markdown(df.select("k", "t", "v"), "R").splitlines() == ["## R", "", "| k | t | v |", "|-|-|-|", "| 1 | n/a | 0.5000 |", '| 2 | q"uote | n/a |']


def test_files_against_their_sums(spark, tmp_path):
    (tmp_path / "in" / "deep er").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"alpha")
    (tmp_path / "in" / "deep er" / "b.bin").write_bytes(b"beta")
    sums = {p: hashlib.sha256(b).hexdigest() for p, b in [("a.txt", b"alpha"), ("deep er/b.bin", b"other"), ("c.txt", b"")]}
    pins = spark.createDataFrame([*sums.items(), ("a.txt", sums["a.txt"])], "path string, sha256 string")
    got = {r.path: r.state for r in readers.verified(spark, str(tmp_path / "in"), pins).collect()}
    assert got == {"a.txt": "ok", "deep er/b.bin": "changed", "c.txt": "missing"}
    assert {r.state for r in readers.verified(spark, str(tmp_path / "none"), pins).collect()} == {"missing"}
