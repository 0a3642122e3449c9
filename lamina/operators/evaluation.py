"""Retrieval metrics, agreement, confusion and bootstrap intervals."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.scratch import stored


def ir_metrics(first_hit: DataFrame) -> DataFrame:
    """Recall at 1, 3, 5 and 10, nDCG at 10 and the uncut reciprocal rank of each row's rank (null: no hit)."""
    r = F.col("rank")
    at = {f"recall_{k}": F.when(r <= k, 1.0).otherwise(0.0) for k in (1, 3, 5, 10)}
    at["ndcg_10"] = F.round(F.when(r <= 10, 1.0 / F.log2(r + 1.0)).otherwise(0.0), 6)
    at["mrr"] = F.round(F.coalesce(1.0 / r, F.lit(0.0)), 6)
    return first_hit.withColumns(at)


def draw(resample: Column, i: Column, n: Column, seed: str) -> Column:
    """The row that draw i of a resample picks, from 0: a hash that other engines compute alike."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", resample, i, F.lit(seed))), 1, 8), 16, 10).cast("long")
    return F.floor(h * n / F.lit(4294967296)).cast("long")


def numbered(rows: DataFrame, by: list[str], order: list[str], dealt: bool = False, compression: str | None = None) -> DataFrame:
    """rows with i, their place from 0 among rows of equal by, in this order, and n, how many those are.

    Rows are dealt by ranges of by and order; a place is that in its part, and the sizes of the parts before are added, so
    that no task has a group's rows to sort. dealt: rows come in such ranges already, from repartitionByRange by the first of these columns.
    compression: that of the stored rows.
    """
    keys = [*by, *order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    ranges = rows if dealt else rows.repartitionByRange(parts, *keys)
    dealt = ranges.sortWithinPartitions(*keys).withColumns({"_part": F.shiftright(at, 33), "_place": at.bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = stored(dealt, "numbered", compression)
    held = dealt.groupBy("_part", *by).agg(F.count("*").alias("_size"), F.min("_place").alias("_first"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = held.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_{c}") for c in by], "_first", before.alias("_before"), F.sum("_size").over(group).alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_p"))
    return dealt.join(F.broadcast(sizes), same).select(*rows.columns, (F.col("_before") + F.col("_place") - F.col("_first")).alias("i"), "n")


def bootstrap(rows: DataFrame, n_resamples: int, seed: str) -> DataFrame:
    """mean, low and high: the mean of num / den and its 95 % interval over resamples of the rows. rows: i (from 0), num, den, summed for each cluster before.

    Percentiles are the sorted values at int(0.025 n) and int(0.975 n).
    """
    n = rows.agg(F.count("*").alias("n"))
    draws = rows.select(F.col("i").alias("slot")).crossJoin(F.broadcast(n)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    picked = draws.select("b", draw(F.col("b"), F.col("slot"), F.col("n"), seed).alias("i")).join(rows, "i")
    means = picked.groupBy("b").agg(F.when(F.sum("den") == 0, 0.0).otherwise(F.sum("num") / F.sum("den")).alias("m"))
    s = means.agg(F.array_sort(F.collect_list(F.round("m", 9))).alias("s"))
    whole = rows.agg(F.when(F.sum("den") == 0, 0.0).otherwise(F.round(F.sum("num") / F.sum("den"), 9)).alias("mean"))
    return whole.crossJoin(s.select(F.col("s")[int(0.025 * n_resamples)].alias("low"), F.col("s")[int(0.975 * n_resamples)].alias("high")))


#: The smallest of 2^32 hash values that has a Poisson variate (of mean 1) above 0, above 1 and so on.
POISSON = [t for k in range(16) if (t := math.ceil(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))) < 2**32]


def poisson_bootstrap(units: DataFrame, key: str, n_resamples: int, seed: str) -> DataFrame:
    """mean, low and high as of bootstrap, but each resample takes a unit as often as a Poisson variate of mean 1 says, which is a hash of resample and key.

    No unit needs a number and no draw looks for its unit, so that nothing is numbered, sorted or joined: a task weighs its own units and adds up
    n_resamples pairs of sums, and only those are shuffled. Resamples vary in size, by which the interval is that of the ordinary bootstrap for many units.
    units: key, num, den (whole numbers). A hash serves four resamples. Defined cases: no units: 0.0 for all three; a resample without weight: 0.0; units of
    one key share their weights; null keys are one key.
    """
    groups = -(-n_resamples // 4)
    # units are few bytes but n_resamples rows of work each: a set number of parts is not merged by their bytes
    dealt = units.select("num", "den", F.col(key).cast("string").alias("_key")).repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = dealt.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    hashed = hashed.select("_g", "num", "den", F.md5(F.concat_ws(":", "_g", "_key", F.lit(seed))).alias("_h"))
    drawn = hashed.select("_g", "num", "den", *[F.substring("_h", 8 * j + 1, 8).alias(f"_v{j}") for j in range(4)])
    # eight hexadecimal digits are in the order of their values; the smallest that holds is looked for from below, where most are
    weight = [reduce(lambda c, x: c.when(F.col(f"_v{j}") < f"{x[1]:08x}", F.lit(x[0])), enumerate(POISSON), F).otherwise(len(POISSON)).cast("long") for j in range(4)]
    weighed = drawn.select("_g", "num", "den", *[w.alias(f"_w{j}") for j, w in enumerate(weight)])
    sums = weighed.groupBy("_g").agg(*[F.sum(F.col(f"_w{j}") * F.col(c)).alias(f"_{c}{j}") for j in range(4) for c in ("num", "den")])
    four = F.explode(F.array(*[F.struct((4 * F.col("_g") + j).alias("b"), F.col(f"_num{j}").alias("num"), F.col(f"_den{j}").alias("den")) for j in range(4)]))
    ratio = F.when(F.col("r.den") == 0, 0.0).otherwise(F.round(F.col("r.num") / F.col("r.den"), 9))
    means = sums.select(four.alias("r")).where(F.col("r.b") < n_resamples).select(ratio.alias("m")).agg(F.array_sort(F.collect_list("m")).alias("s"))
    whole = units.agg(F.when(F.coalesce(F.sum("den"), F.lit(0)) == 0, 0.0).otherwise(F.round(F.sum("num") / F.sum("den"), 9)).alias("mean"))
    at = lambda q: F.coalesce(F.get("s", F.lit(int(q * n_resamples))), F.lit(0.0))
    return whole.crossJoin(means.select(at(0.025).alias("low"), at(0.975).alias("high")))


def confusion(pairs: DataFrame, labels: list) -> DataFrame:
    """gold, predicted and n for every pair of labels, zeros too. pairs: gold, predicted."""
    spark = pairs.sparkSession
    domain = spark.createDataFrame([(g, p) for g in labels for p in labels], f"gold {pairs.schema['gold'].dataType.simpleString()}, predicted {pairs.schema['predicted'].dataType.simpleString()}")
    counts = pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def precision_recall(matrix: DataFrame) -> DataFrame:
    """label, support, precision, recall and f1, each 0 where undefined, from confusion."""
    hit = F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(F.col("gold").alias("label")).agg(hit.alias("hit"), F.sum("n").alias("support"))
    cols = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("found"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    out = rows.join(cols, "label").withColumns({"precision": safe(F.col("hit"), F.col("found")), "recall": safe(F.col("hit"), F.col("support"))})
    f1 = safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("label", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two 0/1 columns as an aggregate: NaN without rows, 1 without variation."""
    po, pa, pb = F.avg((a == b).cast("double")), F.avg(a.cast("double")), F.avg(b.cast("double"))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(F.count("*") == 0, F.lit(float("nan"))).when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))


def runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of consecutive equal values: by, run (from 1), value, first and last order, n."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return marked.groupBy(by, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
