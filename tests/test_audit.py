"""Similar claims and clusters against brute force, and lines at their limits."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lamina.functions import lines as L
from lamina.operators import audit as A
from lamina.operators import retrieval as R
from lamina.operators.graph import components
from lamina.queries import QUERIES


def test_similar_claims_and_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(rng.randrange(3), i, sorted(rng.sample(words, rng.randrange(0, 16)))) for i in range(90)]
    rows += [(0, 90 + i, rows[0][2]) for i in range(5)] + [(1, 95, []), (1, 96, [])]
    share = 0.6

    def like(a, b):
        return max((len(set(x) & set(y)) / len(x) if len(x) >= 6 else 0) for x, y in ((a, b), (b, a)))

    want = {(k, i, j) for (k, i, a), (m, j, b) in itertools.combinations(rows, 2) if k == m and like(a, b) >= share}
    claims = spark.createDataFrame(rows, "k int, claim long, words array<string>")
    assert {(r.k, r.a, r.b) for r in A.similar_claims(claims, ["k"], share).collect()} == want and want
    # copies of too few words to be similar are still one cluster; those without words aren't
    joined = want | {(k, i, j) for (k, i, a), (m, j, b) in itertools.combinations(rows, 2) if k == m and a and a == b}
    root = {i: i for _, i, _ in rows}
    for _ in rows:
        for _, i, j in joined:
            root[i] = root[j] = min(root[i], root[j])
    assert {r.claim: r.cluster for r in A.claim_clusters(claims, ["k"], share).collect()} == root


def test_components_of_a_path(spark):
    n = 200
    edges = spark.createDataFrame([((i * 7) % n, ((i + 1) * 7) % n) for i in range(n - 1) if i != 100], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert len(roots) == n and len(set(roots.values())) == 2


def test_lines_at_their_limits(spark):
    df = spark.createDataFrame([("Dhp 5-7",), ("Dhp 5–7",), ("Dhp 5 — 7.",), ("Dhp 9",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(L.header_range(F.col("t"))).collect()] == [[5, 6, 7], [5, 6, 7], [5, 6, 7], [9], None, None]
    assert spark.range(1).select(L.joined_lines(F.lit("well-\nknown  \n\n words")).alias("x")).first().x == "well-known words"
    pairs = spark.createDataFrame([("a", "a"), ("Ab-c", "abcd"), ("abc", "xyz")], "a string, b string")
    assert [r[0] for r in pairs.select(L.pair_class(F.col("a"), F.col("b"))).collect()] == ["exact", "boundary", "distinct"]


def test_long_conversations_keep_their_turns_apart(spark, tmp_path):
    said = "alpha beta gamma delta epsilon zeta"
    rows = [(1, 100_005, "user", said), (1, 100_007, "user", said), (2, 5, "user", "one two three four five six"), (2, 7, "user", said)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in QUERIES["dom_claim_clusters"](spark, str(tmp_path)).select("conv_id", "turn", "cluster").collect())
    assert got == [(1, 100_005, 100_005), (1, 100_007, 100_005), (2, 5, 5), (2, 7, 7)]
    assert tuple(QUERIES["agg_tag_stability"](spark, str(tmp_path)).first()) == (1, 1)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_containments_equal_loops(spark, monkeypatch, keys):
    r = random.Random(3)
    some = lambda n: sorted(r.sample("abcdefghijklmnop", n))
    claims, sources = [(1, i, some(r.randint(4, 9))) for i in range(30)], [(1, i, some(r.randint(0, 16))) for i in range(60)]
    want = {(c, s, len(set(a) & set(b)) / len(a)) for _, c, a in claims for _, s, b in sources if len(a) >= 6 and len(set(a) & set(b)) / len(a) >= 0.6}
    cells = []
    monkeypatch.setattr(A, "scored", lambda *x: cells.append(x) or R.scored(*x))
    sources += sources[:7]
    frames = [spark.createDataFrame(rows, f"k int, {name} int, words array<string>") for rows, name in ((claims, "claim"), (sources, "source"))]
    found = A.containments(*[df if keys else df.drop("k") for df in frames], keys, 0.6)
    assert {(x.claim, x.source, x.contained) for x in found.collect()} == want and want
    assert found.count() == sum(1 + (s < 7) for _, s, _ in want)
    assert len(cells) == (not keys)  # without keys, no pair is a row before its words are counted
