"""Rows that repeat are dealt to many tasks; resampling against a plain version."""

import math
from collections import Counter

import pandas as pd
import public_tokenizers
import xxhash

from lamina.llm import resampling, sstable

SF = "/root/testdata/sf0.001"


def test_one_repeated_row_fills_many_tables(spark):
    rows = spark.range(20_000, numPartitions=3).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")
    for docs, key in ((rows, None), (rows.selectExpr("7L as doc_id", "'same words' as text"), 7)):
        manifest = sstable.write_tables(docs, sstable.table_folder(spark), public_tokenizers.path("word_bpe_49k.json"), False, 2)
        shards = [r[0] for r in manifest.groupBy("shard").sum("n_docs").select("sum(n_docs)").collect()]
        assert sum(shards) == 20_000 and max(shards) < 10_000
        got = sorted((r.start, r.n_tokens) for r in sstable.read_tables(manifest).where(f"doc_id <=> {'null' if key is None else key}").collect())
        assert len(got) == 20_000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))
    assert sstable.lookup(manifest, spark.createDataFrame([(7,)], "doc_id long")).count() == 20_000


def test_one_repeated_row_is_ranked_in_many_parts(spark, monkeypatch):
    kept = {}
    stored = resampling.stored

    def watched(df, name):
        kept[name] = stored(df, name)
        return kept[name]

    monkeypatch.setattr(resampling, "stored", watched)
    docs = spark.range(20_000, numPartitions=3).selectExpr("7L as doc_id", "'same words' as text")
    ranks = resampling.resample(docs, spark.createDataFrame([(7, 1)], "doc_id long, quality int"), share=0.25)
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(1, 20_001)) and ranks.where("kept").count() == 5_000
    assert max(r["count"] for r in kept["placed"].groupBy("part").count().collect()) < 10_000


M = (1 << 64) - 1


def bucket(words):
    h = 0
    for w in words:
        h = (h * 31 + int(pd.util.hash_array(pd.Series([w], dtype=object).to_numpy(), categorize=False)[0])) & M
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
        h ^= h >> 31
    return h % resampling.BUCKETS


def grams(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + n]) for n in range(1, resampling.LONGEST + 1) for i in range(len(words) - n + 1))


def chained(*values, seed=42):
    """Hashes of values one after another, each seeded by the one before; nulls change nothing."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), seed=seed)
    return seed


def test_resampling_equals_a_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "a b"), (90_001, None), (90_002, ""), (90_003, "One one ONE")], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    quality = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality in (0, 1):
            quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
    raw, good, of, cache = Counter(), Counter(), [], {}
    for doc_id, text in rows:
        found = Counter()
        for g, n in grams(text).items():
            if g not in cache:
                cache[g] = bucket(g)
            found[cache[g]] += n
        of.append(found)
        raw.update(found)
        if quality.get(doc_id) == 1:
            good.update(found)
    everything = {b: (good[b] + resampling.SMOOTHING, raw[b] + resampling.SMOOTHING) for b in range(resampling.BUCKETS)}
    totals = [sum(x[i] for x in everything.values()) for i in (0, 1)]
    want = []
    for (doc_id, text), found in zip(rows, of):
        weight = sum(n * (math.log(everything[b][0] / totals[0]) - math.log(everything[b][1] / totals[1])) for b, n in found.items())
        u = ((chained("lamina", doc_id, text) >> 11) + 0.5) / 2**53
        want.append((doc_id, sum(found.values()), weight, weight - math.log(-math.log(u))))
    want.sort(key=lambda x: -x[3])
    k = round(len(rows) * sum(quality.values()) / len(quality))
    got = sorted(resampling.resample(docs, labels).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    assert [(r.doc_id, r.n_grams) for r in got] == [(d, n) for d, n, _, _ in want]
    assert all(math.isclose(r.log_weight, w, abs_tol=1e-6) and math.isclose(r.gumbel_key, key, abs_tol=1e-6) for r, (_, _, w, key) in zip(got, want))
    assert [r.kept for r in got] == [i < k for i in range(len(rows))]
