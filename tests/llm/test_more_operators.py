"""Language identification, fill-in-middle and centroid clustering against plain versions, and on odd inputs."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import centroids, fill_middle, languages, pii
from lamina.llm.queries import QUERIES
from lamina.llm.tokens import text_bytes

SF = "/root/testdata/sf0.001"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = "wörter und mehr  Wörter\n" * 20_000
ODD = [(1, None), (2, ""), (3, " \n"), (None, "no id at all"), (None, None), (4, "marks <S> stay"), (5, "é 日本 𝄞  x\x0by\n"), (5, "é 日本 𝄞  x\x0by\n"), (6, "1 2 3 ..."), (7, LONG), (8, "̀ ́"), (9, "a"), (10, " b ")]
ODD += [(i, f"some words {i} to cut,\tand\n\n{i} more < M>") for i in range(20, 60)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, long texts, and columns named as the operators' own."""
    rows = [(i, t, "en", 7, "x", 0.5, "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, form string, score double, output string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def plain_fill_middle(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_middle_equals_a_plain_version(odd, empty):
    def order(rows):
        return sorted(rows, key=repr)

    got = order((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_middle.transform(odd).collect())
    assert got == order((i, *plain_fill_middle(i, t)) for i, t in ODD)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}
    for r in fill_middle.transform(odd).collect():
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
    texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    assert sorted(r.restored_sha256 for r in fill_middle.transform(odd, with_output=False).collect()) == texts
    assert fill_middle.transform(empty).count() == 0
    assert "output" not in fill_middle.transform(odd, with_output=False).columns


@pytest.mark.parametrize("block", [4, 7, 512])
def test_trees_find_every_unit(block, monkeypatch):
    monkeypatch.setattr(fill_middle, "SLICE", 64)
    rng = random.Random(block)
    texts = ["", " ", "a", " a ", *("".join(rng.choice("ab é日\n\t\x0b𝄞 ") for _ in range(rng.randrange(60))) for _ in range(200)), ""]
    trees = fill_middle.Trees(*text_bytes(pa.array(texts)), block)
    for i, text in enumerate(texts):
        units = UNITS.findall(text)
        assert trees.units[i] == len(units)
        places, chars = trees.find(np.full(len(units) + 1, i), np.arange(len(units) + 1))
        before = ["".join(units[:k]) for k in range(len(units) + 1)]
        assert places.tolist() == [len(b.encode()) for b in before] and chars.tolist() == [len(b) for b in before]


def plain_clusters(rows, clusters=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    hashes = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    cs = [v for *_, v in hashes[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(cs)):
            own = [v for (_, v), c in zip(kept, of) if c == k]
            if own:
                cs[k] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    return sorted(((i, k, d, sum(e for _, e, c in out if c == k), total, hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for i, d, k in out), key=repr)


def test_clusters_equal_a_plain_version(spark):
    rng = np.random.RandomState(3)
    rows = [(i, rng.normal(0, 0.2, 64).astype("float32").tolist()) for i in range(90)]
    rows += [(i, rows[i][1]) for i in range(5)] + [(200 + i, rows[3][1]) for i in range(30)] + [(None, rows[7][1]), (300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65)]
    rows += [(304, [None] + [0.5] * 63), (305, [float("nan")] + [0.5] * 63), (306, [float("inf")] + [0.5] * 63), (307, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string, distance long").repartition(3)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

    def clusters(df, **how):
        return sorted((tuple(r[c] for c in columns) for r in centroids.cluster(centroids.scaled(df), **how).collect()), key=repr)

    assert clusters(df) == plain_clusters(rows)
    assert clusters(df, clusters=3, rounds=2) == plain_clusters(rows, 3, 2)
    few = [(i, v) for i, v in rows if i in (1, 2, 300)]
    assert clusters(df.where("vec_id in (1, 2, 300)")) == plain_clusters(few)
    assert centroids.cluster(centroids.scaled(df.where("vec_id < 0"))).columns == columns
    assert centroids.cluster(centroids.scaled(df.where("vec_id < 0"))).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="(?i)overflow|64 bits"):
        centroids.cluster(centroids.scaled(huge)).collect()


def test_clusters_stay_in_the_jvm(spark):
    table = centroids.scaled(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assigned = table.select("v", centroids.nearest(F.col("v"), centroids.first_centroids(table))["cluster"].alias("cluster"))
    plan = assigned._jdf.queryExecution().executedPlan().toString()
    assert "array_min(transform(" in plan and "Python" not in plan and "Arrow" not in plan


def test_languages_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    found = QUERIES["op11_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    for lang in ("en", "de", "fr", "es"):
        own = [r for r in found if r.lang == lang]
        assert len(own) >= 15 and sum(r.lang_pred == lang for r in own) >= 0.98 * len(own)
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_on_odd_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.fit(docs, per_language=60)
    by_text = {}
    for r in languages.predict(odd, model).collect():
        by_text.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert sum(map(len, by_text.values())) == len(ODD)
    assert all(x == ("und", 0.0) for i in (1, 2, 3, 6, 8) for x in by_text[i])
    assert by_text[5][0] == by_text[5][1] and by_text[5][0][0] != "und" and by_text[7][0][0] == "de"
    # what stands beside a text, and its other columns, change nothing
    alone = languages.predict(odd.where("doc_id = 9").withColumn("lang", F.lit("fr")).withColumn("doc_id", F.lit(77)), model).first()
    assert (alone.lang_pred, alone.score) == by_text[9][0]
    assert languages.predict(empty, model).count() == 0
    nothing = languages.fit(empty)
    assert {(r.lang_pred, r.score) for r in languages.predict(odd, nothing).collect()} == {("und", 0.0)}
    single = languages.fit(docs.where("lang = 'de'"), per_language=20)
    assert {r.lang_pred for r in languages.predict(docs.where("text rlike '[a-z]'"), single).collect()} == {"de"}


def test_languages_of_many_families(spark):
    """Each language repeats its own syllables; two families of two languages, two languages that are in no family."""
    syllables = {"cs": "ěko ští", "pl": "wcz ową", "tr": "ığı lar", "uz": "oʻz lik", "xx": "qqa zzo", "yy": "kku ggi", None: "abc def"}
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices(s.split(), k=2)) for _ in range(1 + i % 9)), lang) for i, (lang, s) in enumerate(list(syllables.items()) * 60)]
    model = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.families.names == ["slavic", "turkic", "xx", "yy"] and [m.names for m in model.members] == [["cs", "pl"], ["tr", "uz"], ["xx"], ["yy"]]
    asked = spark.createDataFrame([(k, s, None) for k, s in enumerate(x for x in syllables.values())], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in languages.predict(asked, model).collect()}
    assert [got[k] for k in range(6)] == ["cs", "pl", "tr", "uz", "xx", "yy"]
    assert languages.family_of("pt-BR") == "romance" and languages.family_of("") == ""


def test_mean_weights_equal_a_plain_version(monkeypatch):
    rng = random.Random(2)
    texts = ["", "a", "ab", *("".join(rng.choice("abcdé日") for _ in range(rng.randrange(1, 50))) for _ in range(60)), "", "xyz" * 30]
    codes, bounds = languages.code_points(pa.array(texts))
    table = np.random.RandomState(1).normal(size=(languages.BINS + 1, 3))
    table[-1] = 0
    want = []
    for t in texts:
        one, _ = languages.code_points(pa.array([t]))
        bins = [b for n, runs in enumerate(languages.run_bins(one, 0, len(t), np.full(len(t), len(t)))) for b in runs[: max(0, len(t) - n)].tolist()]
        assert len(bins) == sum(max(0, len(t) - n) for n in range(languages.ORDERS)) and languages.BINS not in bins
        want.append(table[bins].mean(0) if bins else np.zeros(3))
    for size in (1 << 20, 64, 5):
        monkeypatch.setattr(languages, "SLICE", size)
        assert np.allclose(languages.mean_weights(codes, bounds, table), want)


#: By hand, not from the operator's patterns: texts, what must be gone from them, and what must stay.
MENTIONS = [
    ("Mrs Anna Maria Schmidt Huber came late", "Anna Maria Schmidt Huber", "Mrs came late"),
    ("Mr O'Brien, Mr J. Smith and Mr J.R.R. Tolman spoke", "O'Brien Smith Tolman J. J.R.R.", "Mr and spoke"),
    ("wie Frau von Bergen und Herr Otto van der Meer sagten", "Bergen Otto Meer", "Frau von Herr van der und sagten"),
    ("Dr. Quigley met Prof. Ada Lowell-Byrne.", "Quigley Ada Lowell Byrne", "Dr. met Prof."),
    ("Mme d'Aubert, Monsieur L’Estrange", "Aubert Estrange", "Mme Monsieur"),
    ("Frau Иванова и г-н Петров", "Иванова Петров", "Frau г-н и"),
    ("hosts fe80::1 and ::1 and 2001:db8::8a2e:370:7334 answer", "fe80::1 ::1 8a2e", "hosts and answer"),
    ("iban de89370400440532013000 or gb29 nwbk 6016 1331 9268 19 or DE89 3704 0044 0532 0130 00.", "370400440532013000 6016 1331 3704", "iban or"),
    ("ring 07911 123456 or 030-1234-5678 or 06 12 34 56 78 now", "123456 1234-5678", "ring or now"),
    ("Plain words: at 12:30 the 3.1.4 std::vector and a::b, page 0123, Drift, Profit, Mr and Mrs.", "", "12:30 3.1.4 std::vector 0123, Drift, Profit, Mr and Mrs."),
]


def test_surrogates_leave_no_part_of_a_mention(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(MENTIONS)], "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.replace_pii(df).collect()}
    for i, (text, gone, stays) in enumerate(MENTIONS):
        assert not [w for w in gone.split() if w in new[i]], (text, new[i])
        assert all(w in new[i] for w in stays.split()), (text, new[i])
    assert "12 34 56" not in new[8]
    assert new[5].split()[1].endswith("ва") and new[1].count(".") == 4, "a woman's surname and initials keep their form"
    assert [len(w) for w in new[7].split()] == [len(w) for w in MENTIONS[7][0].split()] and new[7].split()[1].islower()
