"""Exact deduplication by a tree merge of sorted digest runs. Built-in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import attach, stored

SPACES = "[\\x20\\x09-\\x0D]+"


def exact_dedup(docs: DataFrame, fan_in: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their whole normalised text (runs of white space become one space) has the same
    SHA-256, the same length in bytes and the same 64-bit hash of another family; records merge, at every level, only
    where all three agree.

    Every node starts with a run of its own records (digest, proofs of equality, smallest identifier, count). The rounds
    are those of a binomial tree: in round r, nodes whose number differs only in bit r exchange (digit r for another
    fan_in), a record goes to the node whose bit r is that of its digest, and each node merges the runs that it holds
    into one sorted run, in which the smallest identifier of each digest is retained. After all rounds a node holds the
    whole group of each of its digests, never more than its share of the digest space, and a hot digest is one
    record for each run from the first round on.

    Defined cases: a null text counts as empty; a text of any length is hashed as a whole; rows with equal doc_id and text are separate rows of which one
    stays; a null doc_id orders last, so that its row stays only where the whole group has none (keep_id is then
    null); an empty table gives an empty result; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while fan_in**rounds < parts:
        rounds += 1
    nodes = fan_in**rounds

    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, " ")
    rows = docs.select(F.col("doc_id"), text.alias("text")).select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("proof"), F.monotonically_increasing_id().alias("row_id")
    )
    rows = stored(rows, "digests")

    place = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % nodes
    runs = (
        rows.select("digest", "n_bytes", "proof", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id").alias("first"), (F.shiftright("row_id", 33) % nodes).alias("node"))
        .groupBy("node", "digest", "n_bytes", "proof")
        .agg(F.min("first").alias("first"), F.count("*").alias("n"))
    )
    for r in range(rounds):
        low = fan_in**r
        digit = lambda x: F.floor(x / low) % fan_in
        runs = runs.withColumn("node", (F.col("node") + (digit(place) - digit(F.col("node"))) * low).cast("long"))
        runs = runs.repartition(nodes, "node").sortWithinPartitions("node", "digest")
        runs = runs.groupBy("node", "digest", "n_bytes", "proof").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    merged = stored(runs.select("digest", "n_bytes", "proof", "first", "n"), "merged")

    out = attach(rows, merged, ["digest", "n_bytes", "proof"], "n", ["first", "n"], ["row_id"])
    return out.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("first.row_id") == F.col("row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
