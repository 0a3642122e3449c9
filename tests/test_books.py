"""The scan of state machines, and books: against loops, in blocks small enough that everything crosses them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lamina.operators import books as B
from lamina.operators import scan

SCHEMA = "book string, n long, line string"


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("block, fan", [(4096, 1024), (16, 1024), (4, 3)])
def test_states_equal_a_loop(spark, backward, block, fan):
    rng = random.Random(1)
    table = [[rng.randrange(5) for _ in range(5)] for _ in range(7)]
    rows = []
    for g in ("a", "b", None):
        numbers = [3] if g == "b" else sorted(rng.sample(range(900), 300))
        rows += [(g, n, rng.choice([*range(7), None]), n if rng.random() < 0.1 else None, f"t{n}") for n in numbers]
    want = {}
    for g in ("a", "b", None):
        state, last = 0, None
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=backward):
            before, prior = state, last
            state = state if r[2] is None else table[r[2]][state]
            last = last if r[3] is None else r[3]
            want[g, r[1]] = (before, state, last, prior, r[4])
    df = spark.createDataFrame(rows, "g string, n long, s int, c long, x string").repartition(3)
    got = scan.states(df, ["g"], "n", "s", table, ["c"], backward=backward, block=block, fan=fan)
    assert {(r.g, r.n): (r.before, r.after, r.last_c, r.prior_c, r.x) for r in got.collect()} == want
    assert scan.states(df.where("n < 0"), ["g"], "n", "s", table, block=block).count() == 0


def plain_parts(lines):
    """One line after another, with look-ahead over the whole book."""
    def is_(pattern, i):
        return 0 <= i < len(lines) and re.search(pattern.replace(r"\p{L}", r"[^\W\d_]"), lines[i]) is not None

    heads = {}
    for i in range(len(lines)):
        if is_(B.VERSES, i):
            j = i - 1
            while j >= max(0, i - 8) and is_(B.BLANK, j):
                j -= 1
            while j >= max(0, i - 8) and not is_(B.BLANK, j) and not is_(B.HEADER, j):
                j -= 1
            if j >= max(0, i - 8) and is_(B.HEADER, j):
                heads[j] = i
    out = [(None, None, "none")] * len(lines)
    starts = sorted(heads)
    for at, story in enumerate(starts):
        end, verse = (starts + [len(lines)])[at + 1], heads[story]
        for i in range(story, end):
            out[i] = (story, None, "title" if i < verse else "meta")
        rating = next((i for i in range(verse + 1, end) if is_(B.RATING, i)), None)
        keys = next((i for i in range(verse + 1, end) if is_(B.KEYWORDS, i)), end)
        body = rating + 1 if rating is not None else next((i for i in range(keys + 1, end) if is_(B.BLANK, i)), end)
        if rating is not None:
            out[rating] = (story, None, "rating")
        i, kept = body, []
        while i < end:
            if is_(B.NOTE_NUMBER, i) and not lines[i].startswith("\f") and is_(B.NOTE_BODY, i + 1):
                note, i = i, i + 1
                out[note] = (story, note, "footnote")
                while i < end and not is_(B.BLANK, i) and not is_(B.HEADER, i) and not (is_(B.NOTE_NUMBER, i) and not lines[i].startswith("\f") and is_(B.NOTE_BODY, i + 1)):
                    out[i] = (story, note, "footnote")
                    i += 1
                continue
            kept.append(i)
            i += 1
        cut = next((i for i in kept if is_(B.CHAPTER, i) or is_(B.COLOPHON, i)), None)
        ends = [i for i in kept if cut is not None and i > cut and is_(B.CHAPTER_END, i)]
        # where only a footnote's line looks like the end, all that follows counts as heading: segmented says so
        ends = ends or [end for i in range((cut or 0) + 1, end) if cut is not None and is_(B.CHAPTER_END, i)][:1]
        for i in kept:
            if cut is None or i < cut:
                part = "body"
            elif is_(B.COLOPHON, cut):
                part = "colophon"
            else:
                part = "heading" if i == cut or (ends and i <= ends[0]) else "preface"
            out[i] = (story, None, part)
    return out


def some_book(rng, n):
    choices = [
        "1.2 A title", "  3.4 Another", "      A second title", "", "Dhp 5", "Dhp 7-9.", "CST4: x", "Keywords: a,", "***", "text line one", "text 2.", "  12", "   BG: a note", "   going on", "    3. The Chapter about X,",
        "   Yvagga", "  Conclusion, Nigamanakathā", "\f  7", "more",
    ]
    weights = [4, 2, 2, 6, 4, 2, 1, 2, 3, 6, 4, 3, 3, 2, 1, 1, 1, 1, 3]
    return rng.choices(choices, weights, k=n)


@pytest.mark.parametrize("block", [32, 4096])
def test_parts_equal_a_plain_parser(spark, block):
    rng = random.Random(block)
    found = {name: some_book(rng, size) for name, size in (("a", 700), ("b", 1), ("c", 150), ("d", 33))}
    rows = [(b, n, line) for b, lines in found.items() for n, line in enumerate(lines)]
    got = {(r.book, r.n): (r.story, r.note, r.part) for r in B.segmented(spark.createDataFrame(rows, SCHEMA).repartition(4), block).collect()}
    want = {(b, n): x for b, lines in found.items() for n, x in enumerate(plain_parts(lines))}
    assert got == want
    assert {x[2] for x in want.values()} == {"none", "title", "meta", "rating", "body", "heading", "preface", "colophon", "footnote"}
    assert B.segmented(spark.createDataFrame([], SCHEMA)).count() == 0


BOOK = """1.1 The Story of a Wheel
  that turned
        Cakka-vatthu

Dhp 1-2
CST4: Another name
Compare: one,
 two and half-
the third
A summary that
wraps
Cast: A, B,
C
Keywords: x, y
****
First words with a mark.12 And grouped 80,12 stays
so it ends.
      5. Manopubbaṅgamā dhammā manoseṭṭhā
      1. Manopubbaṅgamā dhammā, manoseṭṭhā manomayā,
      manasā ce paduṭṭhena,
      The mind goes before all states,
      and is their chief.
Short end.
A longer line of prose that runs on and on until it is as wide as
the page, then stops.
1.2 Second
        Dutiya-vatthu
Dhp 3
Keywords: z

This body has no rating line.13
   12
     BG: the note of the story before
   goes on
   13
     An unnamed note

    2. The Chapter about More,
   Dutiyavagga
A preface.""".split("\n")


@pytest.fixture(scope="module")
def parts(spark):
    return B.segmented(spark.createDataFrame([(None, n, line) for n, line in enumerate(BOOK)], SCHEMA), 32).cache()


def test_titles_and_metadata(parts):
    titles = {r.group_id: r for r in B.titles(parts).collect()}
    assert titles["1.1"].title == "The Story of a Wheel that turned" and titles["1.1"].second_title == "Cakka-vatthu"
    assert (titles["1.1"].first_verse, titles["1.1"].last_verse, titles["1.2"].first_verse, titles["1.2"].last_verse) == (1, 2, 3, 3)
    fields = {r.story: r for r in B.metadata(parts).collect()}
    one, two = fields[0], fields[BOOK.index("1.2 Second")]
    assert (one.cst4, one.compare, one["cast"], one.keywords, one.rating) == ("Another name", "one, two and half-", "A, B, C", "x, y", 4)
    assert one.synopsis == "the third A summary that wraps" and one.burlingame is None
    assert (two.keywords, two.synopsis, two.rating) == ("z", None, None)


def test_footnotes_go_home(parts):
    notes = B.footnotes(parts)
    got = {r.marker: (r.author, r.text) for r in notes.collect()}
    assert got == {"12": ("BG", "the note of the story before goes on"), "13": ("unlabeled", "An unnamed note")}
    homes = {r.marker: r.home for r in B.returned(parts, notes).collect()}
    assert homes == {"12": 0, "13": BOOK.index("1.2 Second")}
    assert B.returned(parts, notes.where("marker = '99'")).count() == 0


def plain_homes(has, found):
    """has, found: for each story the numbers of its footnotes and those in its text."""
    held = [{(m, k) for m in x} for k, x in enumerate(has)]
    for k in range(len(held)):
        for m in sorted(found[k] - {m for m, _ in held[k]}):
            for j in (k - 1, k + 1):
                if not 0 <= j < len(held) or m in found[j]:
                    continue
                moving = {x for x in held[j] if x[0] == m}
                if moving:
                    held[j] -= moving
                    held[k] |= moving
                    break
    return {(m, origin): k for k, x in enumerate(held) for m, origin in x}


def test_footnotes_move_as_in_a_loop(spark):
    rng = random.Random(4)
    has, found = ([{str(rng.randrange(1, 4)) for _ in range(rng.randrange(3))} for _ in range(60)] for _ in range(2))
    rows, story_of = [], []
    for k in range(60):
        story_of.append(len(rows))
        lines = [f"1.{k + 1} Title", "Dhp 1", "***", " ".join(f"word{m}" for m in sorted(found[k]))]
        for m in sorted(has[k]):
            lines += [f"  {m}", "    BG: note"]
        rows += [*lines, ""]
    parts = B.segmented(spark.createDataFrame([("x", n, line) for n, line in enumerate(rows)], SCHEMA), 64).cache()
    number = {n: k for k, n in enumerate(story_of)}
    got = {(r.marker, number[r.story]): number[r.home] for r in B.returned(parts, B.footnotes(parts), block=16).collect()}
    assert got == plain_homes(has, found)


def test_reflow_and_verses(parts):
    got = [(r.kind, r.text) for r in B.reflow(parts).where("story = 0").orderBy("first_line").collect()]
    assert got == [
        ("paragraph", "First words with a mark.12 And grouped 80,12 stays so it ends."),
        ("verse", "5. Manopubbaṅgamā dhammā manoseṭṭhā\n1. Manopubbaṅgamā dhammā, manoseṭṭhā manomayā,\nmanasā ce paduṭṭhena,\nThe mind goes before all states,\nand is their chief."),
        ("paragraph", "Short end."),
        ("paragraph", "A longer line of prose that runs on and on until it is as wide as the page, then stops."),
    ]
    verses = B.verses(parts).collect()
    assert [(r.number, r.original, r.translation) for r in verses] == [(1, "Manopubbaṅgamā dhammā, manoseṭṭhā manomayā, manasā ce paduṭṭhena,", "The mind goes before all states, and is their chief.")]


def test_language_of_lines(spark):
    lines = {"karoti so tathattānaṁ yathā naṁ icchatī diso": "pali", "Those sages without violence,": "english", "Anāthapiṇḍika of Sāvatthi": "pali", "12 34": "unknown", "of Sāvatthi": "english"}
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", B.language(F.col("line")).alias("t"))
    assert {r.line: r.t for r in df.collect()} == lines


def test_scans_and_windows_see_no_text(spark, parts, monkeypatch):
    """What a line is goes through the windows and scans; its text is shuffled once, to what was found of it."""
    seen, states, around = [], scan.states, B._looked_around
    monkeypatch.setattr(scan, "states", lambda rows, *a, **k: seen.append(rows.columns) or states(rows, *a, **k))
    monkeypatch.setattr(B, "_looked_around", lambda rows, block: seen.append(rows.columns) or around(rows, block))
    B.segmented(spark.createDataFrame([("x", 0, "1.1 Title")], SCHEMA))
    B.reflow(parts), B.verses(parts)
    assert len(seen) == 7 and not {c for columns in seen for c in columns} & {"line", "bare", "head"}
