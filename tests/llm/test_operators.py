"""The training-data operators against plain versions, and on odd inputs."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import exact_dedup, jaccard, line_dedup, packing, pieces, pii, resampling, sstable, toxicity, voronoi
from lamina.llm.graph import components
from lamina.llm.queries import ORACLES, QUERIES
from lamina.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
BASE = " ".join(f"w{i}" for i in range(60))
ODD = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nx"), (3, None), (4, ""), (5, "  \n\t "), (None, "a\nb\nc"), (7, BASE), (8, BASE + " tail"), (9, BASE), (9, BASE), (10, "é日本 𝄞 mail x.y@host.example.com or +1 (743) 555-3824"), (11, "z" * 30_000), (12, "q " * 20_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, copies, repeated rows, long texts, and columns named as the operators' own."""
    rows = [(i, t, "k", "r", 1, None) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, k1 string, row string, node int, n_chars long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect()) == sorted(tuple(map(repr, (r[want.columns.index(c)] for c in columns))) for r in want.fetchall())


@pytest.mark.parametrize("path, spaced", [(BYTES, True), (WORDS, False)])
def test_encoder_equals_the_library(path, spaced):
    one = Encoder(path, spaced)
    texts = ["", "a", " a", "a ", "a  b", "it's\n\nTHE end...", "x y  z", "don't |stop| ½ ²x é", "a\x1c b!\x1c c", "1 22  333 ΣΑΣ straße", *(t or "" for _, t in ODD)]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    ids, at = one.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_line_dedup_on_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_lines): (r.text, r.n_removed) for r in line_dedup.line_dedup(odd).collect()}
    assert got[1, 4] == ("a\nb\nc\nd", 0) and got[2, 4] == ("x", 3) and got[None, 3] == ("", 3) and got[3, 0] == (None, 0)
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.clean(odd).columns == odd.columns


def test_sstable_round_trip_and_lookup(spark, odd, empty):
    manifest = sstable.write_tables(odd, sstable.table_folder(spark), WORDS, False, 2)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens) for r in sstable.read_tables(manifest).collect())
    assert len(got) == len(ODD) and [g[0][1] for g in got[1:]] == sorted(i for i, _ in ODD if i)
    assert all(a[1] + a[2] == b[1] for a, b in zip(sorted(got, key=lambda g: g[1]), sorted(got, key=lambda g: g[1])[1:]))
    library = Tokenizer.from_file(WORDS)
    found = sorted((r.doc_id, list(r.ids)) for r in sstable.lookup(manifest, spark.createDataFrame([(7,), (9,), (99,)], "doc_id long")).collect())
    ids = library.encode(BASE, add_special_tokens=False).ids + [2]
    assert found == [(7, ids), (9, ids), (9, ids)]
    library.encode_special_tokens = True
    crcs = sorted(zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for _, t in ODD)
    assert crcs == sorted(r.ids_crc32 for r in sstable.read_tables(manifest).collect())
    with pytest.raises(ValueError, match="Arrow knows no store"):
        sstable.qualified(spark, "http://localhost/somewhere")
    assert sstable.read_tables(sstable.write_tables(empty, sstable.table_folder(spark), WORDS, False, 2)).count() == 0


def test_packing_leaves_nothing_out(odd, empty):
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    rows = packing.pack(odd, BYTES).collect()
    places = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in rows)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    whole = defaultdict(list)
    for i, t in ODD:
        whole[i].append(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    assert all(any(zlib.crc32(w[r.start : r.start + r.length]) == r.ids_crc32 and len(w) == r.doc_tokens for w in whole[r.doc_id]) for r in rows)
    assert sum(r.length for r in rows) == sum(len(w) for ws in whole.values() for w in ws)
    assert packing.pack(empty, BYTES).count() == 0


def test_exact_dedup_on_odd_rows(odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and all(r.group_size == len(g) for r in g) for g in groups.values())
    blank = groups[hashlib.sha256(b"").hexdigest()]
    assert sorted(r.doc_id for r in blank) == [3, 4] and {r.keep_id for r in blank} == {3}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_top_k_with_ties_nulls_and_few_rows(spark):
    rows = [(i, [1.0, 0.5]) for i in range(40)] + [(40, None), (41, [1.0, None]), (42, [float("nan"), 1.0]), (43, []), (44, [-1.0]), (None, [1.0, 1.0])]
    v = voronoi.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in voronoi.top_k(v, v.where("vec_id % 20 = 0"), 20).collect())
    assert [g[2] for g in got if g[0] == 0] == list(range(1, 21)) and {g[3] for g in got if g[0] == 0} == {64 * 64 + 32 * 32}
    assert voronoi.top_k(v.limit(0), v, 3).count() == 0
    assert {g.vec_id for g in voronoi.top_k(v.where("vec_id < 3"), v.where("vec_id = 0"), 20).collect()} == {1, 2}


def test_top_k_of_large_components(spark, tmp_path):
    # one component of each vector is up to 1e17, in a place where no other vector has a large one, so that scores keep within 64 bits
    rng, n, dim = np.random.RandomState(2), 60, 64
    small = rng.randint(-1, 2, (n, dim)) / 64
    for i in range(n):
        small[i, i] = rng.choice([-1, 1]) * 10.0 ** rng.randint(14, 18)
    rows = [(i, x.tolist()) for i, x in enumerate(small)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    # DuckDB can't multiply what passes 64 bits on the way to a sum of its own row; all others are within
    want = db.sql(ORACLES["op3_voronoi_knn"]).project("query_id, rank, vec_id, score").fetchall()
    got = [tuple(r) for r in QUERIES["op3_voronoi_knn"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want) and len(want) == 60 and max(abs(r[3]) for r in want) > 10**16
    v = voronoi.scaled(spark.createDataFrame([(1, [1.0]), (2, [1e15]), (3, [2.0])], "vec_id long, embedding array<double>"))
    assert [r.vec_id for r in voronoi.top_k(v, v.where("vec_id = 1"), 3).orderBy("rank").collect()] == [2, 3]
    v = voronoi.scaled(spark.createDataFrame([(1, [1e14]), (2, [1e14])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="passes 64 bits"):
        voronoi.top_k(v, v, 3).collect()
    with pytest.raises(Exception, match="passes 64 bits"):
        voronoi.scaled(spark.createDataFrame([(1, [1e18])], "vec_id long, embedding array<double>")).collect()


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "BLOCK", 64)
    rng = np.random.RandomState(4)
    m = np.concatenate([rng.randint(-50, 50, (3000, 8)), np.repeat(rng.randint(-50, 50, (1, 8)), 1500, 0)])
    ids = rng.permutation(len(m))
    v = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, m)], "vec_id long, v array<long>").repartition(3)
    got = sorted(tuple(r) for r in voronoi.top_k(v, v.where("vec_id % 50 = 0"), 5).collect())
    want = []
    for i, x in zip(ids, m):
        if i % 50 == 0:
            ranked = sorted((-int(s), int(j)) for j, s in zip(ids, m @ x) if j != i)[:5]
            want += [(int(i), r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    assert got == sorted(want)


def test_pieces_equal_plain_search_and_round_trip():
    one, library = pieces.PieceEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known = {library.id_to_piece(i): (s, i) for i, s in zip(one.ids.tolist(), one.scores.tolist())}

    def plain(word):
        word = pieces.SPACE + word.replace(" ", pieces.SPACE)
        best = [(0.0, [])] + [None] * len(word)
        for j in range(1, len(word) + 1):
            for n in range(min(one.longest, j), 0, -1):
                p = word[j - n : j]
                if p not in known and n > 1:
                    continue
                s = best[j - n][0] + (known[p][0] if p in known else one.unknown)
                if best[j] is None or s > best[j][0]:
                    best[j] = (s, best[j - n][1] + ([known[p][1]] if p in known else [one.bytes[b] for b in p.encode()]))
        return best[-1][1]

    texts = ["", "a", " ", " a  b ", "   three", "a     five   ", "x\n\ny 日本語 𝄞", "\n \n", "internationalisation of the tokenizers", *(t or "" for _, t in ODD[:11])]
    ids, at = one.encode(pa.array(texts))
    for t, a, b in zip(texts, at[:-1], at[1:]):
        assert ids[a:b].tolist() == (plain(t) if t else [])
        assert library.decode(ids[a:b].tolist()) == t
    assert one.decode(ids, at).to_pylist() == texts


def test_near_duplicates_equal_all_pairs(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text").where("doc_id is not null"))
    seqs = defaultdict(list)
    for r in docs.collect():
        seqs[tuple((r.text or "").lower().split())].append(r.doc_id)
    sets = {s: {s[i : i + 5] for i in range(len(s) - 4)} or ({s} if s else set()) for s in seqs}
    where = defaultdict(list)
    for s, grams in sets.items():
        for g in grams:
            where[g].append(s)
    links, top = defaultdict(set), {s: s for s in seqs}

    def root(s):
        while top[s] != s:
            s = top[s]
        return s

    for s, grams in sets.items():
        shared = defaultdict(int)
        for g in grams:
            for o in where[g]:
                shared[o] += 1
        for o, n in shared.items():
            if o != s and n >= 0.8 * (len(grams) + len(sets[o]) - n):
                links[s].add(o)
                top[root(s)] = root(o)
    least = {}
    for s, ids in seqs.items():
        least[root(s)] = min([*ids, least.get(root(s), ids[0])])
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {(i, least[root(s)], len(links[s])) for s, ids in seqs.items() for i in ids}
    assert jaccard.near_duplicates(empty).count() == 0
    stay = [r.doc_id for r in jaccard.one_of_each(odd).collect()]
    assert 7 in stay and 8 not in stay and 9 not in stay


def test_recall_holds_in_buckets_that_split_on(spark):
    # each value is one of four that a quarter of the sets share, so that buckets split to a depth of about 5
    rng = np.random.RandomState(3)
    n, pairs, t = 40_000, 2000, jaccard.TOKENS
    low = np.take_along_axis(rng.randint(1, 1 << 31, (4, t)), rng.randint(0, 4, (n, t)), 0)
    for i in range(pairs):
        own = rng.permutation(t)[: t - 51]  # 51 of 64 values stay shared: just below 0.8
        low[n - 1 - i] = low[i]
        low[n - 1 - i, own] = rng.randint(1, 1 << 31, len(own))
    low = low.astype("<u4")
    rows = [(i, bytearray(x.tobytes()), bytearray((x & 255).astype("u1").tobytes())) for i, x in enumerate(low)]
    reps = spark.createDataFrame(rows, "node long, sketch binary, low binary")
    root = {r.node: r.root for r in components(jaccard.candidates(reps, 0.99)).collect()}
    lost = sum(root.get(i, i) != root.get(n - 1 - i, n - 1 - i) for i in range(pairs))
    assert lost <= 0.01 * pairs


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 200), (150, 200), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 150: 100, 200: 100}


def test_toxicity_finds_held_out_insults(spark, odd, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    every = scored.join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    print({(lang, y): (int((g.score >= 0.7).sum()), len(g)) for (lang, y), g in every.groupby(["lang", "toxic"])})
    # words of English toxic documents are plain; those of the other languages overlap with clean ones, see the README
    for held, clean in ((every[every.lang == "en"], 0.02), (every, 0.06)):
        found = held.score >= 0.7
        assert ((held.toxic == 1) & found).sum() >= 0.8 * (held.toxic == 1).sum() and ((held.toxic == 0) & found).sum() <= clean * (held.toxic == 0).sum()
    best = lambda t: model.probability(np.array([max(model.values(list(toxicity.words_of(t))))]))[0]
    assert all(best(t) >= 0.7 for t in ("you i d i o t", "st*up-id", "m0ron", "idi.ot")) and best("hello world") < 0.3
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert len(got) == len({i for i, _ in ODD}) and got[3] == got[4] < 0.1 and toxicity.score(empty, model).count() == 0
    assert toxicity.filtered(odd, model, 0.7).columns == odd.columns


def test_resampling_keeps_the_best_share(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = resampling.resample(docs, labels, share=0.5).toPandas()
    assert rows.kept.sum() == 500 and sorted(rows["rank"]) == list(range(1, 1001))
    assert rows.sort_values("rank").gumbel_key.is_monotonic_decreasing
    good = rows.merge(labels.toPandas(), on="doc_id")
    assert good[good.quality == 1].log_weight.median() > good[good.quality == 0].log_weight.median()
    assert resampling.resample(odd, labels).count() == len(ODD) and resampling.resample(empty, labels).count() == 0


def test_surrogates(spark, odd, empty):
    text = "Mail a.B@Mail.example.com or A.B@MAIL.EXAMPLE.COM, call +1 (743) 555-3824 or 743-555-3824. Mrs. Anna Schmidt, Mr Schmidt, Frau Анна Иванова. IP 10.2.3.4, card 4111111111111111, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" v1.2.3 CC BY-NC 4.0."
    one = pii.replace_pii(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    new = one[0].text
    assert one[1].text == new and one[0].n_entities == 10 and new != text
    assert not any(x in new for x in ("Schmidt", "Анна", "555-3824", "10.2.3.4", "4111111111111111", "24be64439e")) and new.endswith("v1.2.3 CC BY-NC 4.0.")
    words = new.replace(",", "").split()
    assert words[1].lower() == words[3].lower() and words[1].endswith(".com")
    assert words[5] == "+1" and (words[6] + words[7]).translate({40: None, 41: None, 45: None}) == words[9].rstrip(".").replace("-", "")
    assert words[12] == words[14], "one surname, one surrogate"
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.replace_pii(odd).collect()}
    assert got[3] == (None, 0) and got[10][1] == 2 and "host" not in got[10][0] and pii.replace_pii(empty).count() == 0
    assert pii.clean(odd).columns == odd.columns


def test_surrogates_equal_a_plain_finder(spark):
    """Mentions found by another engine, outside Spark: gaps stay, and each entity is replaced one to one, in its format."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plain = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}
    every, made = regex.compile(pii.ANY), {}
    new = {r.doc_id: r.text for r in pii.replace_pii(docs).collect()}
    texts, mentions = {r.doc_id: r.text for r in docs.collect()}, 0
    for i, t in texts.items():
        found = list(every.finditer(t or ""))
        if not found:
            assert new[i] == t
            continue
        gaps, at = every.split(t), 0
        for gap, m in zip(gaps, found):
            assert new[i].startswith(gap, at)
            at += len(gap)
            kind, old = next(k for k, p in plain.items() if p.fullmatch(m[0])), m[0]
            end = at + len(old)  # all formats of these texts keep their length but addresses of the internet protocol
            if kind == "ip":
                end = at + len(regex.match(r"[0-9.]*[0-9]", new[i], pos=at)[0])
            put, at, mentions = new[i][at:end], end, mentions + 1
            shape = lambda x: regex.sub(r"\d", "0", regex.sub(r"\p{L}", "a", x))
            assert put != old and (kind == "ip" or shape(put) == shape(old))
            name = old.lower() if kind == "email" else regex.sub(r"\D", "", old) if kind in ("phone", "card") else old
            assert made.setdefault((kind, name), put) == put or kind in ("phone", "email")
            if kind == "card":
                assert put[0] == old[0]
        assert new[i][at:] == gaps[-1]
    assert mentions > 50 and len(set(made.values())) == len(made) and not set(made.values()) & {n for _, n in made}


def test_surrogates_leave_nothing_of_long_mentions(spark):
    long = "aB3" * 4000
    texts = [f"password = {long} end", f"{long}@host.example.com end", f"token: {long}.{long}.x9 end", f"Mr {'Abc' * 4000} end"]
    for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert r.text.endswith(" end") and r.n_entities == 1 and not any(x in r.text for x in (long[:30], long[-30:], "AbcAbc"))


def test_surrogates_of_more_kinds(spark):
    text = "IBAN GB82 WEST 1234 5698 7654 32, 2001:db8:0:0:0:ff00:42:8329, ssn 219-09-9999, Frau Anna-Maria SCHMIDT, John.Doe@Mail.example.com, Mr Schmidt"
    new = pii.replace_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    iban = new[5:32].replace(" ", "")
    assert iban[:2] == "GB" and new[9] == " " and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    words = new.replace(",", "").split()
    assert words[7].count(":") == 7 and words[7] != "2001:db8:0:0:0:ff00:42:8329" and [len(x) for x in words[9].split("-")] == [3, 2, 4]
    assert words[10] == "Frau" and "-" in words[11] and words[12].isupper() and words[12].title() == words[15]
    assert [c.isupper() for c in words[13]] == [c.isupper() for c in "John.Doe@Mail.example.com"] and "Doe" not in new


def test_surrogates_of_one_word_agree_after_collisions(spark):
    # 3,000 surnames among 16 ** 4 words: some collide; each is used by two persons
    rng = np.random.RandomState(1)
    names = sorted({"".join(rng.choice(list("abcdefghij"), 7)).title() for _ in range(3000)})
    docs = spark.createDataFrame([(i, f"Mr {n}; Mrs Anna {n}; x@{n.lower()}.com; y@{n.lower()}.com") for i, n in enumerate(names)], "doc_id long, text string")
    rows = [[x.split() for x in r.text.split("; ")] for r in pii.replace_pii(docs).collect()]
    assert all(m[1] == f[2] for m, f, *_ in rows) and len({m[1] for m, *_ in rows}) == len(names) == len({f[1] + f[2] for _, f, *_ in rows})
    hosts = [[x[0].split("@")[1] for x in r[2:]] for r in rows]
    assert all(a == b for a, b in hosts) and len({a for a, _ in hosts}) == len(names)
    tiny = spark.createDataFrame([(i, f"a@{c}.de") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")], "doc_id long, text string")
    assert len({r.text for r in pii.replace_pii(tiny).collect()}) == 26, "names get longer where their length has no free value"


def test_surrogates_stay_distinct(spark):
    mails = [(i, f"x{i % 10}@h{i}.example.com 10.0.{i // 250}.{i % 250}") for i in range(1000)]
    rows = pii.replace_pii(spark.createDataFrame(mails, "doc_id long, text string")).collect()
    assert len({r.text.split()[0] for r in rows}) == 1000 and len({r.text.split()[1] for r in rows}) == 1000


def test_hot_keys_join_like_others(spark):
    from lamina.llm.shared import attach

    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    summary = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    out = attach(rows, summary, ["k"], "n", ["low"], ["id"])
    assert out.count() == 20_000 and out.where("(k = 0 and low <> 0) or (k > 0 and low <> id) or low is null").count() == 0
