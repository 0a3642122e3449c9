"""Weighted resamples against plain loops."""

import hashlib
import math

from pyspark.sql import functions as F

from lamina.operators import evaluation as E


def plain(units, n, seed):
    def weight(key, b):
        h = hashlib.md5(":".join([str(b // 4), *([] if key is None else [str(key)]), seed]).encode()).hexdigest()
        u = int(h[8 * (b % 4) : 8 * (b % 4) + 8], 16) / 2**32
        k, total = 0, math.exp(-1)
        while u >= total and k < 15:
            k += 1
            total += math.exp(-1) / math.factorial(k)
        return k

    means = []
    for b in range(n):
        num, den = (sum(weight(key, b) * x[i] for key, *x in units) for i in (0, 1))
        means.append(round(num / den, 9) if den else 0.0)
    means.sort()
    den = sum(d for _, _, d in units)
    return round(sum(x for _, x, _ in units) / den, 9) if den else 0.0, means[int(0.025 * n)], means[int(0.975 * n)]


def test_weights_equal_a_plain_loop(spark):
    for units, n in (([(i, i % 3, 1 + i % 2) for i in range(60)] + [(None, 5, 7), (3, 1, 1)], 203), ([(1, 1, 1)], 40), ([(1, 0, 0)], 8)):
        df = spark.createDataFrame(units, "k long, num long, den long").repartition(3)
        assert tuple(E.poisson_bootstrap(df, "k", n, "s").first()) == plain(units, n, "s")


def test_no_units(spark):
    assert tuple(E.poisson_bootstrap(spark.createDataFrame([], "k long, num long, den long"), "k", 8, "s").first()) == (0.0, 0.0, 0.0)


def test_the_interval_is_that_of_many_units(spark):
    units = spark.range(4_000).selectExpr("id as k", "id % 2 as num", "1L as den")
    mean, low, high = E.poisson_bootstrap(units, "k", 1_000, "s").first()
    # 1.96 standard errors of a share of one half
    assert mean == 0.5 and abs(low - (0.5 - 1.96 * 0.5 / 4_000**0.5)) < 0.002 and abs(high - (0.5 + 1.96 * 0.5 / 4_000**0.5)) < 0.002


def test_draws_are_added_up_before_the_shuffle(spark):
    units = spark.range(1_000).selectExpr("id as k", "id as num", "1L as den")
    plan = E.poisson_bootstrap(units, "k", 400, "s")._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.index("Exchange hashpartitioning(_g") :]
    assert "partial_sum" in first.split("Generate")[0] and "Join" not in first


def test_weights_need_no_number_of_a_hash(spark):
    """Eight digits are compared as they are: conv of each was most of the work."""
    units = spark.range(50).select("id", F.lit(1).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))
    plan = E.poisson_bootstrap(units, "id", 8, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and "conv(" not in plan


def test_units_of_few_bytes_are_many_tasks_work(spark):
    """Sums of a grouping are merged by their bytes, to one part here, though each is thousands of rows of work."""
    units = spark.range(400).groupBy((F.col("id") % 100).alias("id")).agg(F.count("*").alias("num"), F.count("*").alias("den"))
    plan = E.poisson_bootstrap(units, "id", 8, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, true" in plan
