"""Quality by importance resampling: hashed n-gram models of good and of raw text, and a Gumbel top-k sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.jaccard import _mix, word_lists
from lamina.llm.shared import stored
from lamina.llm.tokens import blocks

#: Buckets that word n-grams are hashed into; words of an n-gram, at most.
BUCKETS, LONGEST = 1 << 15, 2
#: Labelled good documents that the target model is counted over, at most. The raw model is counted over all documents.
SAMPLE = 50_000
#: Added to each bucket's count, so that no probability is 0.
SMOOTHING = 0.5


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of 1 to LONGEST lower-case words, n by n, and the text that each is of."""
    words = word_lists(texts)
    at = words.offsets.to_numpy().astype("int64") - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    h = (pd.util.hash_array(np.array(names, object), categorize=False) if names else np.empty(0, "uint64"))[coded.indices.to_numpy()]
    real = np.array([bool(n) for n in names], bool)[coded.indices.to_numpy()]
    of = np.repeat(np.arange(len(words)), np.diff(at))
    out, own = [], []
    gram = np.zeros(len(h), "uint64")
    for n in range(1, LONGEST + 1):
        size = max(0, len(h) - n + 1)
        gram = _mix(gram[:size] * np.uint64(31) + h[n - 1 :])
        ok = real[:size] & (of[:size] == of[n - 1 :])
        out.append((gram[ok] % np.uint64(BUCKETS)).astype("int64"))
        own.append(of[:size][ok])
    return np.concatenate(out), np.concatenate(own)


def _counted(batches):
    counts = np.zeros((2, BUCKETS), "int64")
    for batch in batches:
        for part in blocks(batch, "text"):
            bucket, of = ngrams(part["text"])
            good = pc.fill_null(part["good"], False).to_numpy(zero_copy_only=False)
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            counts[1] += np.bincount(bucket[good[of]], minlength=BUCKETS)
    held = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[0][held]), pa.array(counts[1][held])], ["bucket", "raw", "good"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The logarithm of the target's to the raw text's probability of each bucket, and the share of good rows among the labelled.

    Raw counts are over all of docs. The target is rows of docs that labels call good: at most SAMPLE of them, chosen by
    a hash of doc_id, so that they can be broadcast. Each task adds up its own counts; the model is BUCKETS numbers.
    """
    named = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    share = named.agg(F.avg("quality")).first()[0]
    good = named.where("quality = 1").select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).withColumn("good", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(stored(good, "good")), F.col("doc_id") == F.col("id"), "left").select("text", "good")
    counts = rows.mapInArrow(_counted, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    p = np.full((2, BUCKETS), SMOOTHING)
    for r in counts:
        p[:, r.bucket] += r.good, r.raw
    p /= p.sum(1, keepdims=True)
    return np.log(p[0] / p[1]), 1.0 if share is None else share


def weigh(docs: DataFrame, ratio: np.ndarray, seed: str) -> DataFrame:
    """doc_id, log_weight, n_grams, gumbel_key and by (a tie-break) of each row of docs.

    The weight of a text is the product of its n-grams' ratios. The key adds a Gumbel variate drawn from a hash of
    seed, doc_id and text, so that the k largest keys are a sample without replacement in proportion to the weights.
    """

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                bucket, of = ngrams(part["text"])
                n = np.bincount(of, minlength=part.num_rows)
                weight = np.bincount(of, ratio[bucket], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["by"], part["u"], pa.array(weight, pa.float64()), pa.array(n.astype("int64"))], ["doc_id", "by", "u", "log_weight", "n_grams"])

    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + 0.5) / float(1 << 53)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", "doc_id").alias("by"), uniform.alias("u"), "text")
    out = rows.mapInArrow(run, "doc_id long, by long, u double, log_weight double, n_grams long")
    return out.select("doc_id", "by", "log_weight", "n_grams", (F.col("log_weight") - F.log(-F.log("u"))).alias("gumbel_key"))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: str = "lamina") -> DataFrame:
    """One row per row of docs: doc_id, log_weight, n_grams, gumbel_key, rank (from 1) and kept.

    kept marks the k rows of the largest gumbel_key; k is share of all rows, by default the share of good rows among
    the labelled ones. Ranks come from a range partition of the keys and prefix sums over its parts' sizes; no task or
    driver sees all rows.

    Defined cases: a text without words has the weight 1; equal keys are ranked by doc_id and a hash of the text; null
    and repeated doc_ids are rows like others; an empty table gives an empty result; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    ratio, good = fit(docs, labels)
    weighed = stored(weigh(docs, ratio, seed), "weights")
    k = round(weighed.count() * (good if share is None else share))

    def place(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(np.arange(n + 1, n + 1 + batch.num_rows))], [*batch.schema.names, "part", "place"])
            n += batch.num_rows

    # the place comes last, so that rows that repeat doc_id and text, and with them the key, are dealt to many parts
    order = [F.desc("gumbel_key"), F.col("doc_id").asc_nulls_last(), F.col("by").asc(), F.col("at").asc()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = weighed.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = dealt.drop("at").mapInArrow(place, "doc_id long, by long, log_weight double, n_grams long, gumbel_key double, part long, place long")
    placed = stored(placed, "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + F.col("place"))
    return ranked.select("doc_id", "log_weight", "n_grams", "gumbel_key", "rank", (F.col("rank") <= k).alias("kept"))
