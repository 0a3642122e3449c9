"""Fill-in-middle transformation: texts cut at random units, found through Fenwick trees over blocks of each text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.tokens import blocks, text_bytes

#: Bytes of a text in a block, a node of its Fenwick tree.
BLOCK = 512
#: Bytes whose masks are held at a time.
SLICE = 4 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of texts that are transformed, and per cent of these with the suffix first.
RATE, SPM_RATE = 50, 80
SEED = "42"
COLUMNS = ["doc_id long", "n long", "form string", "prefix_chars long", "middle_chars long", "output string", "output_sha256 string", "restored_sha256 string"]

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80


def _unit_ends(data: np.ndarray, bounds: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For bytes lo to hi of the texts' bytes: whether a unit ends behind the byte. bounds: where each text begins, and the end of all."""
    white = _WHITE[data[lo : hi + 1]]
    if hi == len(data):
        white = np.append(white, True)
    ends = ~white[:-1] & white[1:]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    ends[last[np.searchsorted(last, lo) : np.searchsorted(last, hi)] - lo] = True
    return ends


class Trees:
    """One Fenwick tree for each text of a batch, over its blocks of BLOCK bytes, with two counts in each node: the units
    that end in the blocks below it and the code points that begin there. All trees lie in one array, one behind another."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, block: int = BLOCK):
        self.data, self.bounds, self.block = data, bounds, block
        self.sizes = -(-np.diff(bounds) // block)
        self.base = np.append(0, np.cumsum(self.sizes))
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        number = np.arange(self.base[-1]) - self.base[of]
        starts = bounds[of] + number * block
        counts = np.zeros((len(starts) + 1, 2), "int64")
        for a in range(0, len(starts), max(1, SLICE // block)):
            some = starts[a : a + max(1, SLICE // block)]
            lo, hi = some[0], starts[a + len(some)] if a + len(some) < len(starts) else len(data)
            counts[a + 1 : a + 1 + len(some), 0] = np.add.reduceat(_unit_ends(data, bounds, lo, hi), some - lo, dtype="int64")
            counts[a + 1 : a + 1 + len(some), 1] = np.add.reduceat(_FIRST[data[lo:hi]], some - lo, dtype="int64")
        sums = np.cumsum(counts, axis=0)
        # node i of a tree (from 1) covers the i & -i blocks that end with block i
        node = number + 1
        self.tree = sums[self.base[of] + node] - sums[self.base[of] + node - (node & -node)]
        self.units = sums[self.base[1:], 0] - sums[self.base[:-1], 0]

    def find(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points before the end of each unit (numbered from 1; 0: the text's start) of the texts.

        All descents go down together, a step for each power of two: a node is passed where the units below it are
        too few. What is left is counted within one block.
        """
        size, base = self.sizes[text], self.base[text]
        at, left, chars = np.zeros(len(text), "int64"), unit.astype("int64"), np.zeros(len(text), "int64")
        step = 1 << int(size.max(initial=1)).bit_length()
        while step := step >> 1:
            to = at + step
            node = self.tree[np.where(to <= size, base + to - 1, 0)] if len(self.tree) else np.zeros((len(text), 2), "int64")
            passed = (to <= size) & (node[:, 0] < left)
            at, left, chars = at + step * passed, left - node[:, 0] * passed, chars + node[:, 1] * passed
        place = at * self.block
        for i in np.flatnonzero(left > 0).tolist():
            lo = int(self.bounds[text[i]] + place[i])
            hi = min(lo + self.block, int(self.bounds[text[i] + 1]))
            end = int(np.flatnonzero(_unit_ends(self.data, self.bounds, lo, hi))[left[i] - 1]) + 1
            place[i] += end
            chars[i] += int(_FIRST[self.data[lo : lo + end]].sum())
        return place, chars


def parts(output: bytes, form: str) -> tuple[bytes, bytes, bytes]:
    """Prefix, middle and suffix of a psm or spm output. Marks are where they first stand, as texts with marks stay plain."""
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a = output.index(second, len(first))
    b = output.index(MIDDLE, a + len(second))
    one, two, middle = output[len(first) : a], output[a + len(second) : b], output[b + len(MIDDLE) :]
    return (one, middle, two) if form == "psm" else (two, middle, one)


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made from."""
    return output if form == "plain" else b"".join(parts(output, form))


def transform(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, with_output: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n (units), form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    A unit is a run of characters other than white space with the white space before it, or white space at the text's
    end. The cuts and the form follow from the hash of seed and doc_id. with_output False leaves the output
    column out, so that no text is sent back from the workers.

    Defined cases: a null text counts as empty; an empty text is plain, with no units; so is one that contains a mark; white space alone is one unit; a text
    of any length is cut as a whole, with masks for SLICE bytes of it at a time; a null doc_id hashes as an empty number; rows that repeat a
    doc_id get the same hash, each with its own text; equal cuts make an empty middle; an empty table gives an empty result; other columns of docs are ignored.
    """
    salt = f"{seed}:".encode()

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                texts = pc.fill_null(part["text"], "")
                data, bounds = text_bytes(texts)
                trees, raw = Trees(data, bounds), memoryview(data).cast("B") if len(data) else b""
                n = trees.units
                digests = [hashlib.sha256(salt + (b"" if i is None else b"%d" % i)).digest()[:16] for i in part["doc_id"].to_pylist()]
                h = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype("int64")
                marked = pc.match_substring(texts, PREFIX.decode())
                for mark in (SUFFIX, MIDDLE):
                    marked = pc.or_(marked, pc.match_substring(texts, mark.decode()))
                plain = marked.to_numpy(zero_copy_only=False) | (np.diff(bounds) == 0) | (h[:, 2] % 100 >= rate)
                cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                cut = np.flatnonzero(~plain)
                (a, a_chars), (b, b_chars) = (trees.find(cut, cuts[cut, k]) for k in (0, 1))
                forms, outputs = ["plain"] * len(n), [None] * len(n)
                for i, x, y in zip(cut.tolist(), a.tolist(), b.tolist()):
                    lo, hi = int(bounds[i]), int(bounds[i + 1])
                    prefix, middle, suffix = raw[lo : lo + x], raw[lo + x : lo + y], raw[lo + y : hi]
                    forms[i] = "spm" if h[i, 3] % 100 < spm_rate else "psm"
                    outputs[i] = b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if forms[i] == "spm" else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
                for i in np.flatnonzero(plain).tolist():
                    outputs[i] = bytes(raw[int(bounds[i]) : int(bounds[i + 1])])
                counts = np.zeros((2, len(n)), "int64")
                counts[0, cut], counts[1, cut] = a_chars, b_chars - a_chars
                columns = [
                    part["doc_id"], pa.array(n), pa.array(forms), *[pa.array(c, mask=plain) for c in counts],
                    *([pa.array(outputs, pa.binary()).cast(pa.string())] if with_output else []),
                    pa.array([hashlib.sha256(x).hexdigest() for x in outputs]), pa.array([hashlib.sha256(restored(x, f)).hexdigest() for x, f in zip(outputs, forms)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    columns_out = [c for c in COLUMNS if with_output or c != "output string"]
    names = [c.split()[0] for c in columns_out]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(columns_out))
