"""Lines in pieces: a row of a scan is some thousand lines, and what is found of them is what rows one by one give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import books as B
from lamina.operators import evaluation as E
from lamina.operators import scan
from lamina.plans import books as P

SCHEMA = "book string, n long, line string"
ODD = [
    "plain words here", "  two  spaces   within ", "\f  7 after a feed", "a crumb {1.2} and [345.6] more", " [12]", "ends.  ", "ends. ", "tail \t\r", "\x0b", "   ", "", " ", "half-", "\tedge\t", "x.\r\n", "quote”",
    "      5. Manopubbaṅgamā dhammā manoseṭṭhā manomayā ca paduṭṭhena bhāsatī vā karoti vā tato naṁ", "      The mind goes before all states and those who speak with it in mind.", "   short verse", "      12 34", "1.2 A title",
    "Dhp 5", "***", "Keywords: a", "  12", "   BG: a note", "     3. The Chapter about X", "  Yvagga  ", "Conclusion, Nigamanakathā", "a line of prose that is as wide as the page is, and so runs on",
]


def book(rng, n):
    """Lines of a book, with a story every now and then."""
    lines = []
    while len(lines) < n:
        lines += ["1.2 A title", "", "Dhp 5", "Keywords: x", "***"] + rng.choices(ODD, k=rng.randrange(5, 60))
    return lines[:n]


def test_states_of_pieces_equal_a_loop(spark):
    rng = random.Random(3)
    table = [[rng.randrange(4) for _ in range(4)] for _ in range(5)]
    rows = [(g, n, rng.choice([*range(5), None]), n * 3 if rng.random() < 0.1 else None, f"é{n}" * (n % 3)) for g in ("a", None) for n in rng.sample(range(700), 400)]
    df = spark.createDataFrame(rows, "g string, n long, s int, c long, x string").repartition(3)
    packed = scan.packed(df, ["g"], "n", ["s", "c", "x"], 8)
    texts = {r for batch in packed.select("g", "n", "at", "x").toArrow().to_batches() for i in range(batch.num_rows) for r in _texts(batch.slice(i, 1))}
    assert texts == {(r[0], r[1], r[4]) for r in rows}
    for backward in (False, True):
        want = {}
        for g in ("a", None):
            state, last = 0, None
            for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=backward):
                before, prior = state, last
                state = state if r[2] is None else table[r[2]][state]
                last = last if r[3] is None else r[3]
                want[g, r[1]] = (before, state, last, prior)
        found = scan.states(packed.drop("x"), ["g"], "n", "s", table, ["c"], backward=backward, block=8, fan=3).toArrow()
        got = {}
        for i in range(found.num_rows):
            pieces = scan.Pieces(found.slice(i, 1))
            columns = [pieces.values(c).tolist() for c in ("before", "after", "last_c", "prior_c")]
            got |= {(found["g"][i].as_py(), n): x for n, *x in zip(pieces.places.tolist(), *columns)}
        assert {k: tuple(v) for k, v in got.items()} == want
    assert scan.states(packed.drop("x").where("n < 0"), ["g"], "n", "s", table, block=8).count() == 0


def _texts(batch):
    import pyarrow as pa

    part = pa.Table.from_batches([batch])
    pieces = scan.Pieces(part)
    return list(zip(part["g"].to_pylist() * len(pieces.places), pieces.places.tolist(), pieces.texts("x").to_pylist()))


def test_scans_read_pieces_not_lines(spark, monkeypatch):
    """str_reflow at 6 GB: each scan shuffled a row for each line, twice."""
    read, states, around = [], scan.states, B._looked_around
    monkeypatch.setattr(scan, "states", lambda rows, *a, **k: read.append(rows.count()) or states(rows, *a, **k))
    monkeypatch.setattr(B, "_looked_around", lambda rows, block: read.append(rows.count()) or around(rows, block))
    lines = spark.createDataFrame([("x", n, line) for n, line in enumerate(book(random.Random(5), 1000))], SCHEMA).coalesce(1)
    assert B.reflow(B.segmented(lines, 256).cache(), 256).count() > 50
    assert len(read) == 6 and max(read) <= 16


@pytest.mark.parametrize("block", [32, 4096])
def test_order_and_size_of_pieces_change_nothing(spark, block):
    rng = random.Random(block)
    rows = [(b, n, line) for b, size in (("a", 500), (None, 333), ("c", 1)) for n, line in enumerate(book(rng, size))]
    lines = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: sorted(map(str, df.collect()))
    one, mixed = B.segmented(lines.coalesce(1)).cache(), B.segmented(lines.repartition(5, F.rand(1)), block).cache()
    assert key(one) == key(mixed) and one.count() == len(rows)
    assert key(B.reflow(one)) == key(B.reflow(mixed.repartition(5, F.rand(2)), block))


def test_patterns_that_are_tried_on_signs_only(spark):
    """What a cheap sign rules out is what the pattern doesn't find."""
    df = spark.createDataFrame([(a + b,) for a in ODD for b in ["", " ", " ", "\r\n", ODD[3]]], "line string")
    line = F.col("line")
    bare = F.regexp_replace(F.regexp_replace(F.replace(line, F.lit("\f"), F.lit("")), B.L.PAGE_CRUMB, ""), r"\s+$", "")
    whole = F.concat(F.regexp_extract(bare, "^( *)", 1), F.regexp_replace(F.regexp_replace(bare, "^ +", ""), " {2,}", " "))
    assert df.where(B.tidy(line) != whole).count() == 0
    assert df.where(B._ends_in(line, B.SENTENCE_END, ".!?:;”’)–") != line.rlike(B.SENTENCE_END)).count() == 0
    assert df.where(B._ends_in(line, B.RUNS_ON, ".,;:!?–—’”") != line.rlike(B.RUNS_ON)).count() == 0
    assert df.where(B.is_noise(line) != (line.rlike(B.FOOTER) | line.rlike(B.PAGE_NUMBER))).count() == 0
    assert df.where(B._flags(line, line.rlike(B.MARKED)) != B._flags(line, F.lit(True))).count() == 0
    stripped = F.regexp_replace(line, rf"^{B.WHITE}+|{B.WHITE}+$", "")
    joined = F.replace(F.regexp_replace(F.array_join(F.filter(F.array(stripped, F.lit("x")), lambda x: x != ""), "\n"), "(\\p{L})-\n", "$1-"), F.lit("\n"), F.lit(" "))
    assert df.where(B.wrapped(F.array(line, F.lit("x"))) != joined).count() == 0


def test_documents_are_laid_out_once(spark, tmp_path, monkeypatch):
    """Dealt by ranges as documents, not as lines, for whose ranges all of them were laid out once more; a doc_id that comes twice gets its lines side by side, as before."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["one", "two.", "three-", "  four"], 200)), f"l{i % 2}") for i in [*range(30), 4, 4, 7]] + [(None, "x", "l0"), (50, None, "l1"), (51, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    asked, numbered = [], E.numbered
    monkeypatch.setattr(E, "numbered", lambda rows, by, order, **k: asked.append((rows, k)) or numbered(rows, by, order, **k))
    got = P._lines(spark, str(tmp_path))
    laid, how = asked[0]
    assert how["dealt"]
    want = numbered(laid.select("*"), ["book"], ["d", "k"]).select("book", F.col("i").alias("n"), "line")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
