"""Line deduplication over overlapping windows of three lines."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lamina.llm.shared import attach, keyed, rows_with, stored

WIDTH = 3
_ADDED = [StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())]
_SPACES = re.compile("[\x09-\x0d\x20]+")


def units(text: str) -> tuple[list[str], list[list[str]], list[str]]:
    """Blank lines before the first other line; for each other line, itself and the blank lines after it; its normal form."""
    lead: list[str] = []
    groups: list[list[str]] = []
    forms: list[str] = []
    for line in text.split("\n"):
        form = _SPACES.sub(" ", line).strip(" ")
        if form:
            groups.append([line])
            forms.append(form)
        elif groups:
            groups[-1].append(line)
        else:
            lead.append(line)
    return lead, groups, forms


def _windows(batches):
    for batch in batches:
        of, pos, digests = [], [], []
        for i, text in enumerate(batch["text"].to_pylist()):
            forms = units(text)[2]
            n = max(0, len(forms) - WIDTH + 1)
            digests += [hashlib.blake2b("\n".join(forms[j : j + WIDTH]).encode(), digest_size=16).digest() for j in range(n)]
            of.append(np.full(n, i))
            pos.append(np.arange(n, dtype="int32"))
        if digests:
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            own = batch.select(["doc_id", "k1", "k2"]).take(pa.array(np.concatenate(of)))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *own.columns, pa.array(np.concatenate(pos))], ["h1", "h2", "doc_id", "k1", "k2", "pos"])


def _cleaned(batches):
    for batch in batches:
        texts, n, removed = [], [], []
        for text, starts in zip(batch["text"].to_pylist(), batch["starts"].to_pylist()):
            lead, groups, _ = units(text or "")
            gone = np.zeros(len(groups), bool)
            for s in starts or ():
                gone[s : s + WIDTH] = True
            texts.append("\n".join([*lead, *(line for g, x in zip(groups, gone) if not x for line in g)]) if gone.any() else text)
            n.append(len(groups))
            removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "n_lines", "n_removed"])


def _deduplicated(docs: DataFrame) -> DataFrame:
    """row (the columns of docs), text, n_lines and n_removed."""
    rows = keyed(docs)
    found = rows.where("text is not null").select("doc_id", "text", "k1", "k2").mapInArrow(_windows, "h1 long, h2 long, doc_id long, k1 long, k2 long, pos int")
    windows = stored(found, "windows")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated, "repeated")
    later = attach(windows, repeated, ["h1", "h2"], "n", ["first"], ["k1", "k2", "pos"]).where(F.col("first").isNotNull() & (F.col("first") != at))
    starts = later.groupBy("k1", "k2").agg(F.collect_set("pos").alias("starts"), F.count("*").alias("n"))
    starts = stored(starts.select("k1", "k2", "starts", F.ceil(F.col("n") / F.size("starts")).alias("copies")), "starts")
    joined = attach(rows.select("row", "k1", "k2", "at"), starts, ["k1", "k2"], "copies", ["starts"], ["at"], merge=True).select("row", F.col("row.text").alias("text"), "starts")
    return joined.mapInArrow(_cleaned, StructType([joined.schema["row"], *_ADDED]))


def clean(docs: DataFrame) -> DataFrame:
    """The columns of docs with the texts of line_dedup, whose cases hold; n_chars follows a text that changed.

    Documents that lose their every line go; those that had none (null, empty or blank texts) stay.
    """
    left = _deduplicated(docs).where("n_removed = 0 or n_removed < n_lines")
    return rows_with(left, docs.columns, F.col("text"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text of each row without lines of repeated windows.

    A window is WIDTH consecutive lines that aren't blank, compared after runs of white space became one space
    and the ends were trimmed. Over all documents, the first occurrence of a window by (doc_id, position) stays;
    the lines of every later one, in the same document too, are covered, and covered lines go. Blank lines go
    with the line before them. n_lines counts lines that aren't blank.

    Windows are hashed to 128 bits. Their summary is combined before the shuffle, and windows that make up a
    large share of all are resolved by a broadcast of at most 1,024 rows (shared.attach).

    Defined cases: a null text stays null, a text of fewer than three lines stays as it is; a text of any length is read
    as a whole, one line of any length included; null doc_ids order last; rows that repeat both doc_id and text count as one and get the same result; an empty table gives
    an empty result; other columns of docs are ignored.
    """
    return _deduplicated(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "n_lines", "n_removed")
