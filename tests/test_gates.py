"""Gates on small records with known faults, and writes that hard gates stop."""

import os

import pytest
from pyspark.sql import functions as F

from lamina.operators import gates as G
from lamina.plans import gates as plans

SCHEMA = "id long, part int, fields map<string, struct<value: string, source: string>>, title string, body string"


def rows(spark, *records):
    return spark.createDataFrame([(i, part, None if fields is None else {k: tuple(v) for k, v in fields.items()}, title, body) for i, part, fields, title, body in records], SCHEMA)


def gates():
    fields = F.col("fields")
    return [
        G.Gate("structure", True, G.differs("part", F.col("part"), F.lit(1))),
        G.Gate("ownership", True, G.not_owned(fields, plans.OWNERS)),
        G.Gate("encoding", True, G.badly_encoded(fields, {"note": plans.CHARSET})),
        G.Gate("meter", False, G.odd_segments("text", fields["text"]["value"], plans.SEGMENT_END, plans.VOWELS, 4, 18)),
        G.Gate("title", False, G.title_absent("title", F.col("title"), F.col("body"))),
    ]


GOOD = {"text": ("manopubbangama dhamma, manosettha manomaya", "main"), "note": ("“papam me katan”ti tasma—dukkham – kĕna? ŏ: (x)!", "side")}


def found(spark, *records):
    return {(r.id, r.gate, r.path, r.problem) for r in G.violations(rows(spark, *records), "id", gates()).collect()}


def test_a_good_record_has_no_findings(spark):
    assert found(spark, (1, 1, GOOD, "The Weaver", "a weaver came")) == set()


@pytest.mark.parametrize(
    ("part", "fields", "expected"),
    [
        (2, GOOD, ("structure", "part", "part=2, expected 1")),
        (None, GOOD, ("structure", "part", "part=null, expected 1")),
        (1, GOOD | {"note": ("x", "main")}, ("ownership", "note", "source=main, expected side")),
        (1, GOOD | {"note": ("x", None)}, ("ownership", "note", "source=null, expected side")),
        (1, GOOD | {"old": ("x", "gone")}, ("ownership", "old", "not in the ownership table")),
        (1, GOOD | {"note": ("a\x01b\x1fc\x01", "side")}, ("encoding", "note", "control U+0001 U+001F")),
        (1, GOOD | {"text": ("cäsa, manosettha manomaya", "main")}, ("encoding", "text", "not composed")),
        (1, GOOD | {"note": ("dhamma 12\U0001f600", "side")}, ("encoding", "note", "charset U+0031 U+0032 U+1F600")),
        (1, GOOD | {"text": (" , ab; manopubbangama dhamma!", "main")}, ("meter", "text[0]", "1 vowels")),
    ],
)
def test_each_gate_names_what_it_finds(spark, part, fields, expected):
    got = {x[1:] for x in found(spark, (1, part, fields, None, None))}
    assert expected in got
    # a control character is outside of the note's set too, and a short segment may be a consequence
    assert {g for g, *_ in got} <= {expected[0], "encoding" if expected[0] == "encoding" else expected[0], "meter"}


def test_titles_of_which_the_body_has_nothing(spark):
    assert (1, "title", "title", "weaver daughter") in found(spark, (1, 1, GOOD, "The Weaver's Daughter", "a monk came"))
    assert not found(spark, (1, 1, GOOD, "The Old Man", "nothing"), (2, 1, GOOD, None, "x"), (3, 1, GOOD, "Weaver", "WEAVERS"))


def test_nulls_and_repeats(spark):
    got = G.violations(rows(spark, (1, 1, None, None, None), (1, 1, None, None, None), (None, 2, {"text": (None, "main")}, "", "")), "id", gates()).collect()
    assert [(r.id, r.gate) for r in got] == [(None, "structure")]


def test_report_counts_rows_and_findings(spark):
    many = rows(spark, *[(i, 1 + (i % 5 == 0), GOOD, None, None) for i in range(20)])
    got = {r.gate: r for r in G.report(many, "id", gates()).collect()}
    assert (got["structure"].violations, got["structure"].first, got["structure"].passed, got["structure"].n_rows) == (4, 0, False, 20)
    assert got["ownership"].passed and not any(r.build_ok for r in got.values())
    empty = G.report(many.where("false"), "id", gates()).collect()
    assert len(empty) == 5 and all(r.passed and r.build_ok and r.violations == 0 and r.first is None for r in empty)


def test_gates_take_one_scan_and_no_shuffle_of_rows(spark):
    plan = G.violations(plans.records(spark, "/root/testdata/sf0.001"), "doc_id", plans.gates())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_closure(spark):
    covered, expected = spark.createDataFrame([(k,) for k in (1, 1, 2, 9, None)], "k long"), spark.createDataFrame([(k,) for k in (1, 2, 3, 3, None)], "k long")
    assert {tuple(r) for r in G.closure(covered, expected, "k").collect()} == {(1, "repeated", 2), (3, "missing", 0), (9, "unknown", 1)}
    assert G.closure(covered.where("false"), expected.where("false"), "k").collect() == []


def test_a_hard_gate_stops_the_write(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = rows(spark, *[(i, 1 + (i % 2), GOOD, None, None) for i in range(30)])
    with pytest.raises(G.GateFailure) as e:
        G.publish(bad, "id", gates(), path, sample=3)
    assert e.value.broken == ["structure"] and e.value.counts["structure"] == 15
    assert [x[0] for x in e.value.sample] == [1, 3, 5]
    assert os.listdir(tmp_path) == []


def test_warnings_are_recorded_with_the_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    data = rows(spark, (1, 1, GOOD, "The Weaver", "a monk"), (2, 1, GOOD, None, None))
    assert G.publish(data, "id", gates(), path) == {"structure": 0, "ownership": 0, "encoding": 0, "meter": 0, "title": 1}
    back = {r.id: [x.gate for x in r.findings] for r in spark.read.parquet(path).collect()}
    assert back == {1: ["title"], 2: []} and os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        G.publish(data, "id", gates(), path)


def test_an_empty_table_is_published(spark, tmp_path):
    assert set(G.publish(rows(spark, (1, 1, GOOD, "", "")).where("id > 1"), "id", gates(), str(tmp_path / "out")).values()) == {0}
