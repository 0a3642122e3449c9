"""Packing of tokenised documents into sequences of one length: concatenate and cut."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.shared import stored
from lamina.llm.tokens import KEPT, encoded

SEQUENCE = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, path: str, spaced: bool, end_id: int, kept: int = KEPT) -> DataFrame:
    """First pass: part, doc_id, start (ids before it in its partition), ids (little-endian) and n_tokens, in the shared folder."""

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for rows, ids, at in encoded(batches, path, spaced, end_id, kept=kept):
            wide = ids.itemsize
            blob = pa.BinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * wide).astype("int64")), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at) - 1, part)), rows["doc_id"], pa.array(total + at[:-1]), blob.cast(pa.binary()), pa.array(np.diff(at)), pa.array(np.full(len(at) - 1, wide))],
                ["part", "doc_id", "start", "ids", "n_tokens", "wide"],
            )
            total += int(at[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "part long, doc_id long, start long, ids binary, n_tokens long, wide long"), "tokens")


def pack(docs: DataFrame, path: str, spaced: bool = True, end_id: int = 1, length: int = SEQUENCE, kept: int = KEPT) -> DataFrame:
    """One row per piece of a document in a sequence: PIECES.

    The first pass tokenises every partition once and keeps its ids with their offsets in the partition. A prefix
    sum over the partitions' totals gives each partition's first global offset; then global offset // length is
    the sequence. A document that crosses the end of a sequence has a boundary record on either side. Documents
    follow one another as they lie in the input; all sequences but the last are full, so nothing is padded but its
    end.

    Only the partitions' totals meet in one task and are broadcast: a row of 16 bytes for each task of the scan.

    kept bounds the pieces whose ids a Python worker holds: about 250 bytes each; fewer are encoded more often.

    Defined cases: a null text counts as empty, an empty one is its end id alone; the name of a special token in a text
    is plain text; a long text goes through as many sequences as it takes; null and repeated doc_ids are rows like
    others; an empty table gives an empty result; other columns of docs are ignored.
    """
    table = tokenised(docs, path, spaced, end_id, kept)
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def cut(batches):
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("ids", "wide")]
            firsts = (batch["base"].to_numpy() + batch["start"].to_numpy()).tolist()
            of, out = [], []
            for i, (raw, wide, first) in enumerate(zip(*cols, firsts)):
                ids, a = np.frombuffer(raw, f"<u{wide}").astype("<u4"), 0
                while a < len(ids):
                    offset = (first + a) % length
                    b = min(len(ids), a + length - offset)
                    of.append(i)
                    out.append((a, b - a, zlib.crc32(ids[a:b]), len(ids), (first + a) // length, offset))
                    a = b
            if out:
                columns = [pa.array(np.array(c, "int64")) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(of)), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return table.join(F.broadcast(bases), "part").select("doc_id", "start", "ids", "wide", "base").mapInArrow(cut, PIECES)
