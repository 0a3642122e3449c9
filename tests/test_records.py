"""Interlinear pages against a plain parser; strings of nested values; budgets against a linear search."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lamina.operators import interlinear as I
from lamina.operators import nested as N


class Page(HTMLParser):
    """One element after another, with a stack."""

    def __init__(self):
        super().__init__()
        self.stack, self.inside, self.p, self.records, self.held = [], 0, None, [], [[], [], []]

    def handle_starttag(self, tag, attrs):
        names = (dict(attrs).get("class") or "").split()
        if tag == "div":
            self.inside += bool(names and names[0].startswith("verse"))
        elif tag == "p" and self.inside:
            self.close()
            self.p, self.stack = {"bold": None, "text": "", "number": None, "notes": []}, []
        elif self.p is not None and tag != "br":
            note = any(k == "note" for k, *_ in self.stack)
            kind = "other" if note else "note" if "TT" in names else "number" if "number" in names and self.p["number"] is None else "bold" if tag == "b" and self.p["bold"] is None else "other"
            if kind == "bold":
                self.p["bold"] = ""
            if kind == "number":
                self.p["number"] = ""
            self.stack.append([kind, tag, [], []])

    def handle_endtag(self, tag):
        if tag in ("p", "div"):
            self.close()
            self.inside -= tag == "div" and self.inside > 0
        elif self.p is not None and self.stack:
            kind, _, whole, inner = self.stack.pop()
            if kind == "note":
                text = clean("".join(inner) if inner is not None and self.first else "".join(whole))
                self.p["notes"] += [text] if text else []

    def handle_data(self, data):
        if self.p is None:
            return
        kinds = [k for k, *_ in self.stack]
        if "note" in kinds:
            at = kinds.index("note")
            note = self.stack[at]
            note[2].append(data)
            self.first = any(t == "span" for _, t, *_ in self.stack[at + 1 :]) or bool(note[3])
            if any(t == "span" for _, t, *_ in self.stack[at + 1 :]):
                note[3].append(data)
        elif "number" in kinds:
            self.p["number"] += data
        else:
            self.p["text"] += data
            if "bold" in kinds:
                self.p["bold"] += data

    def close(self):
        p, self.p = self.p, None
        if p is None or p["bold"] is None:
            return
        bold, text = clean(p["bold"]), clean(p["text"])
        plain = clean(text.replace(bold, "", 1))
        self.held[0].append(bold)
        self.held[1] += [plain] if plain else []
        self.held[2] += p["notes"]
        m = re.search(r"\[(\d+)\]", p["number"] or "")
        if m:
            self.records.append((int(m[1]), " ".join(self.held[0]), " ".join(self.held[1]), self.held[2]))
            self.held = [[], [], []]


def clean(text):
    return re.sub(r"\s+", " ", text).strip()


PAGES = [
    '<div class="verse1"><p><b>Mano <i>pubba</i></b><br>\n mind comes <span class="TT">*<span>a <i>note</i></span> x</span> first</p><p><b>second line</b> its words <span class="number">[1]</span></p></div>'
    '<div class="verse2"><p>no bold <span class="TT">lost</span></p><p><b>third</b><span class="a TT">whole note</span><span class="number">no. [2]</span> behind &amp; &lt;it&gt;</p></div>',
    '<div class="other"><p><b>x</b> y <span class="number">[9]</span></p></div><div id="a" class="verse x"><p><b>open <p><b>next</b> one <b>more bold</b> <span class="number">[7]</span><span class="number">[8]</span></div>',
    '<div class="verse3"><p><b>never closed</b> by a number</p></div>',
    "",
]


def test_interlinear_pages_equal_a_plain_parser(spark):
    df = spark.createDataFrame(list(enumerate([*PAGES, None])), "i int, html string").select("i", I.records(F.col("html")).alias("r"))
    got = {r.i: r.r for r in df.collect()}
    for i, html in enumerate(PAGES):
        page = Page()
        page.feed(html)
        assert [(x.number, x.bold, x.plain, x.notes) for x in got[i]] == page.records
    assert got[len(PAGES)] is None and [x.number for x in got[0]] == [1, 2] and got[0][0].notes == ["a note"] and got[0][1].plain == "behind & <it>"


def test_strings_of_nested_values(spark):
    kind = "id int, a string, b struct<c: string, d: array<struct<e: string, f: int>>>, g map<string, array<string>>, h int"
    rows = [(1, "x\x01", ("y", [("z\x02\x01\x02", 1), (None, 2)]), {"k": ["v", "―"], "n": None}, 5), (2, None, None, None, None), (2, None, (None, []), {}, 1)]
    df = spark.createDataFrame(rows, kind)
    assert sorted((r.id, r.path, r.value) for r in N.all_strings(df, "id").collect()) == [(1, "a", "x\x01"), (1, "b.c", "y"), (1, "b.d[0].e", "z\x02\x01\x02"), (1, "g[k][0]", "v"), (1, "g[k][1]", "―")]
    assert sorted((r.path, r.codes) for r in N.code_points(df, "id", N.CONTROLS).collect()) == [("a", "U+0001"), ("b.d[0].e", "U+0001 U+0002")]
    assert [(r.path, r.codes) for r in N.code_points(df, "id", N.BAD_QUOTES).collect()] == [("g[k][1]", "U+2015")]
    assert N.all_strings(df.select("id", "h"), "id").count() == 0


@pytest.mark.parametrize("most, limit", [(0, 5), (10, 100), (10, 30), (10, -1), (1000, 7 * 311)])
def test_largest_equals_a_linear_search(spark, most, limit):
    got = spark.range(1).select(N.largest(lambda x: x * 7 <= F.lit(limit), F.lit(most)).alias("x")).first().x
    assert got == max((x for x in range(most + 1) if x * 7 <= limit), default=-1)
