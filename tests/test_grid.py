"""The grid's states, its resumption by what is missing, and budgets against a plain loop."""

import random

from pyspark.sql import functions as F

from lamina.operators import grid as G
from lamina.sources.scratch import scratch_path

CONDITIONS = ["bare", "full"]


def _answers(todo):
    n = F.col("n")
    share = F.try_divide(F.lit(1.0), F.length("context"))
    return todo.select("q", "condition", share.alias("answer"), G.state(F.when(F.col("condition") != "bare", n), share).alias("state"))


def test_states(spark):
    asks = spark.createDataFrame([(1, 2, "ab"), (2, 0, "abcd"), (3, 1, "")], "q int, n int, text string")
    grid = G.cells(asks, {"bare": F.lit(None).cast("string"), "full": F.col("text")})
    got = {(r.q, r.condition): (r.answer, r.state) for r in G.resumed(grid, scratch_path(spark, "answers"), ["q", "condition"], _answers, CONDITIONS).collect()}
    assert got == {(q, "bare"): (None, "failed") for q in (1, 2, 3)} | {(1, "full"): (0.5, "ok"), (2, "full"): (0.25, "no_results"), (3, "full"): (None, "failed")}


def test_a_second_run_adds_what_is_missing(spark):
    path = scratch_path(spark, "answers")
    asks = spark.range(1, 6).selectExpr("id as q", "1 as n", "'abcd' as text")
    grid = G.cells(asks, {"bare": F.lit("x"), "full": F.col("text")})
    answered = []

    def count(todo):
        answered.append(todo.count())
        return _answers(todo)

    # a run that ends before its second condition, one that goes on with more questions, one with nothing to do
    assert G.resumed(grid.where("q < 4"), path, ["q", "condition"], count, CONDITIONS[:1]).count() == 3
    whole = sorted(map(tuple, G.resumed(grid, path, ["q", "condition"], count, CONDITIONS).collect()))
    assert answered == [3, 2, 5] and len(whole) == 10
    assert sorted(map(tuple, G.resumed(grid, path, ["q", "condition"], count, CONDITIONS).collect())) == whole
    assert answered == [3, 2, 5, 0, 0]


def test_budget_equals_a_plain_loop(spark):
    r = random.Random(3)
    rows = [(q, n, "é" * r.randint(0, 40)) for q in range(6) for n in range(8)]
    df = spark.createDataFrame(rows, "q int, n int, text string")
    got = {(x.q, x.n): x.body for x in df.withColumn("body", G.within_budget(F.col("text"), 90, "q", "n")).collect()}
    for q in range(6):
        left = 90
        for n in range(8):
            text = rows[q * 8 + n][2]
            assert got[q, n] == text[:left]
            left = max(0, left - len(text))
