"""The bounded sparse arm against the whole join, and bundles with known verses and stories."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.operators import joins as J
from lamina.operators import retrieval as R


@pytest.mark.parametrize("seeds, k", [(3, 2), (20, 5), (10_000, 3), (0, 4)])
def test_bounds_lose_no_row(spark, seeds, k):
    r = random.Random(seeds + k)
    # term i is in about 1 / (i + 1) of the rows, and weighs the more the rarer it is
    postings = [(i, row, r.randint(1, 3)) for row in range(400) for i in range(60) if r.random() < 1 / (i + 1)]
    asked = [(q, i, i // 4 + 1) for q in range(12) for i in r.sample(range(60), r.randint(1, 8))] + [(99, 1000, 5)]
    p = spark.createDataFrame(postings, "term int, id long, w long").repartition(5)
    q = spark.createDataFrame(asked, "q int, term int, wq long")
    got = sorted(map(tuple, R.bounded_sparse_arm(q, p, k, seeds).collect()))
    assert got == sorted(map(tuple, R.sparse_arm(q, p, k).collect()))
    assert {x[0] for x in got} == set(range(12))


def test_ties_at_the_bar_go_to_the_smaller_id(spark):
    p = spark.createDataFrame([("a", i, 1) for i in range(50)] + [("b", i, 1) for i in range(0, 50, 5)], "term string, id long, w long")
    q = spark.createDataFrame([(1, "a", 1), (1, "b", 4)], "q int, term string, wq long")
    got = [(r.id, r.score) for r in R.bounded_sparse_arm(q, p, 4, 10).orderBy("rank").collect()]
    assert got == [(0, 5), (5, 5), (10, 5), (15, 5)]


def test_no_questions_and_no_postings(spark):
    p = spark.createDataFrame([("a", 1, 1)], "term string, id long, w long")
    q = spark.createDataFrame([(1, "a", 1)], "q int, term string, wq long")
    assert R.bounded_sparse_arm(q.limit(0), p, 3).collect() == [] and R.bounded_sparse_arm(q, p.limit(0), 3).collect() == []


@pytest.fixture
def explains(spark):
    # verse 1 has two stories, of which B also explains 2 and 3; C has 9 alone
    return spark.createDataFrame([("A", 1), ("B", 1), ("B", 2), ("B", 3), ("C", 9)], "story string, verse long")


def test_bundles(spark, explains):
    chunks = spark.createDataFrame([(10, 1, "A"), (11, 2, "B"), (12, 1, None), (13, 9, "C"), (14, 3, None)], "id long, verse long, own string")
    got = {r.id: (r.verses, r.stories) for r in J.bundles(chunks, explains).collect()}
    both = [1, 2, 3]
    assert got == {10: (both, ["A", "B"]), 11: (both, ["B", "A"]), 12: (both, ["A", "B"]), 13: ([9], ["C"]), 14: (both[0:3], ["B"])}


def test_a_chunk_without_story_fails(spark, explains):
    with pytest.raises(Exception, match="no story for chunk 5"):
        J.bundles(spark.createDataFrame([(5, 77, None)], "id long, verse long, own string"), explains).collect()


def test_hot_terms_are_dealt_out(spark):
    p = spark.range(20_000).select(F.lit("the").alias("term"), "id", F.lit(1).cast("long").alias("w"))
    q = spark.createDataFrame([(1, "the", 2)], "q int, term string, wq long")
    assert [tuple(r) for r in R.bounded_sparse_arm(q, p, 2).orderBy("rank").collect()] == [(1, 0, 2, 1), (1, 1, 2, 2)]
