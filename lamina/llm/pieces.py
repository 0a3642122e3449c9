"""SentencePiece encoding and decoding: a batched Viterbi search in numpy."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.tokens import Encoder, blocks, worker_cache

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Cells (words x positions x lengths) that are searched at once.
CELLS = 4_000_000


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype("uint64")


class PieceEncoder(Encoder):
    """The segmentation of each word into pieces of the highest total score; of equal ones, the one with the longest last piece.

    Scores are the model's. A character that is no piece costs more than any piece and becomes its UTF-8 bytes. No piece
    goes on from another character to a space, so that words, each with the spaces before it, are searched apart; so are
    characters that no longer piece holds, like line feeds. Words of one length advance together, position by position.
    """

    leading = True

    def __init__(self, path: str, most: int = 600_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.most, self.known, self.dtype = most, {}, np.dtype("<u2" if n <= 1 << 16 else "<u4")
        text = [model.id_to_piece(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        plain = [i for i in range(n) if not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes = {int(text[i][3:5], 16): i for i in range(n) if byte[i]}
        score = {text[i]: model.get_score(i) for i in plain}
        if any(p.strip(SPACE) and SPACE in p[1:] for p in score):
            raise ValueError("a piece goes on after a space: words can't be searched apart")
        joined = {c for p in score if len(p) > 1 for c in p}
        self.single = np.zeros(256, bool)  # ASCII characters that no longer piece holds
        self.single[[i for i in range(128) if chr(i) != " " and chr(i) not in joined]] = True
        self.unknown = min(score.values()) - 10.0
        self.longest = max(map(len, score))
        keys, rows = np.empty(len(plain), "uint64"), np.zeros((len(plain), self.longest), "uint64")
        for i, k in enumerate(plain):
            c = _codes([text[k]])[0]
            rows[i, : len(c)] = c
            keys[i] = self._prefix(c[None])[0, -1] ^ np.uint64(len(c))
        order = np.argsort(keys)
        self.keys, self.rows, self.ids = keys[order], rows[order], np.array(plain)[order]
        self.scores = np.array([score[text[i]] for i in plain])[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        surface = [bytes([int(t[3:5], 16)]) if b else b"" if model.is_control(i) else t.replace(SPACE, " ").encode() for i, (t, b) in enumerate(zip(text, byte))]
        self.surface = pa.array(surface, pa.binary())

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes, the empty one first."""
        out = np.zeros((len(codes), codes.shape[1] + 1), "uint64")
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + codes[:, j] + np.uint64(1)
        return out

    def _search(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length."""
        codes = _codes(words)
        n, length = codes.shape
        widest = min(self.longest, length)
        prefix, power = self._prefix(codes), np.ones(1, "uint64")
        gain = np.full((widest, n, length + 1), -np.inf)  # gain[l - 1, w, j]: score of the piece of l characters that ends at j
        piece = np.zeros((widest, n, length + 1), "int32")
        for l in range(1, widest + 1):
            power = np.multiply(power, BASE)
            key = (prefix[:, l:] - prefix[:, :-l] * power) ^ np.uint64(l)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            w, j = np.nonzero(self.keys[at] == key)
            p = at[w, j]
            same = np.ones(len(w), bool)
            for x in range(l):
                same &= self.rows[p, x] == codes[w, j + x]
            w, j, p = w[same], j[same], p[same]
            gain[l - 1, w, j + l] = self.scores[p]
            piece[l - 1, w, j + l] = p
        missing = np.isinf(gain[0])
        gain[0][missing] = self.unknown
        piece[0][missing] = -1
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), "int32")
        rows = np.arange(n)
        for j in range(1, length + 1):
            k = min(widest, j)
            reach = gain[:k, :, j][::-1] + best[:, j - k : j].T  # longest piece first
            pick = reach.argmax(0)
            best[:, j] = reach[pick, rows]
            back[:, j] = k - pick
        at = np.full(n, length)
        out = np.full((n, length), -2, "int64")
        col = length
        ends = np.zeros((n, length), "int64")
        while (at > 0).any():
            col -= 1
            live = at > 0
            l = back[rows, at]
            out[live, col] = piece[l[live] - 1, rows[live], at[live]]
            ends[live, col] = at[live]
            at = np.where(live, at - l, 0)
        held = out != -2
        counts = held.sum(1)
        flat = out[held]
        ids = self.ids[np.maximum(flat, 0)].astype(self.dtype)
        cut = np.append(0, np.cumsum(counts)).tolist()
        raw, size = ids.tobytes(), self.dtype.itemsize
        blobs = [raw[a * size : b * size] for a, b in zip(cut[:-1], cut[1:])]
        for w in np.flatnonzero((out == -1).any(1)):
            spelled: list[int] = []
            for p, e in zip(out[w][held[w]].tolist(), ends[w][held[w]].tolist()):
                spelled += [int(self.ids[p])] if p >= 0 else [self.bytes[x] for x in words[w][e - 1].encode("utf-8", "replace")]
            blobs[w] = np.array(spelled, self.dtype).tobytes()
        return blobs

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Marks a space after another character, and both ends of a character that no longer piece holds."""
        cut = self.single[data]
        cut[1:] |= cut[:-1] | (data[1:] == 32) & (data[:-1] != 32)
        return cut

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > self.most:
            self.known.clear()
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, some in by_length.items():
            step = max(1, CELLS // ((length + 1) * min(self.longest, length + 1)))
            for i in range(0, len(some), step):
                part = some[i : i + step]
                self.known.update(zip(part, self._search([w.replace(" ", SPACE) for w in part])))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """Texts of the ids, without the space before the first word."""
        parts = self.surface.take(pa.array(ids.astype("int64")))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype("int32")), parts), b"")
        raw = [x[1:] if x[:1] == b" " else x for x in joined.to_pylist()]
        return pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    """One for each Python worker."""
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, ids (little-endian bytes) and round_trip of each row of docs, whole texts.

    round_trip tells whether decoding the ids gives the text again. It does but for texts that hold U+2581, which
    stands for a space in pieces.

    Defined cases: null and empty texts have no ids; null and repeated doc_ids are rows like others; an empty table
    gives an empty result; other columns of docs are ignored.
    """

    def run(batches):
        one = piece_encoder(path)
        one.known = worker_cache(path)
        for batch in batches:
            for part in blocks(batch, "text"):
                texts = pc.fill_null(part["text"], "")
                ids, at = one.encode(texts)
                same = pc.equal(one.decode(ids, at), texts)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:])]
                raw, size = ids.tobytes(), ids.itemsize
                blobs = [raw[a * size : b * size] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(blobs, pa.binary()), same],
                    ["doc_id", "n_tokens", "ids_crc32", "ids", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, ids binary, round_trip boolean")
