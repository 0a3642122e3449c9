"""Whole texts to token ids with the tokenizers library, each distinct piece once.

A text is cut where the tokenizer's pre-tokeniser surely cuts, whatever stands on either side, so that the ids of the
text are the ids of its pieces one after another. Pieces repeat; an Encoder keeps their ids. Cuts are found for a
whole block of texts at once, as masks over its bytes.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Kinds of bytes: letters, digits and marks of ASCII, white space, and the rest. Apostrophes (contractions), control
#: characters and all of a character beyond ASCII are of the rest, next to which nothing is sure but white space.
REST, LETTER, DIGIT, MARK, WHITE = range(5)
KIND = np.zeros(256, "u1")
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = MARK
KIND[[32, *range(9, 14)]] = WHITE
#: White space beyond ASCII, by the first byte in UTF-8.
WIDE_WHITE: dict[int, list[bytes]] = {}
for _c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
    WIDE_WHITE.setdefault(chr(_c).encode()[0], []).append(chr(_c).encode())


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (none null) and where each text begins: len(texts) + 1 places."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.empty(0, "u1"), np.zeros(1, "int64")
    at = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")[at[0] : at[-1]]
    return data, at - at[0]


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; all bytes of a character of white space are WHITE."""
    kind = KIND[data]
    high = np.flatnonzero(data >= 0xC2)
    lead = data[high]
    for first, found in WIDE_WHITE.items():
        at = high[lead == first]
        if len(at):
            for c in found:
                hit = at[at + len(c) <= len(data)]
                for i in range(1, len(c)):
                    hit = hit[data[hit + i] == c[i]]
                for i in range(len(c)):
                    kind[hit + i] = WHITE
    return kind


class Encoder:
    """spaced: ids depend on the space before a word (byte-level vocabularies); else white space is dropped."""

    #: Whether a text is read with a space before it.
    leading = False

    def __init__(self, path: str, spaced: bool, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced, self.most, self.known = spaced, most, {}
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # between pieces that are learnt together: no piece's ids have the separator's, and it changes no ids beside it
        self.separator, self.sign = ("\n", "\n") if spaced else (" | ", "|")
        self.mark = self._plain(self.sign)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Marks the bytes that begin a piece.

        White space is parted from what is before it, and ASCII letters, digits and marks from one another. A space
        belongs to what follows it. Of a longer run of white space, the last character is parted from the others,
        unless the text ends with the run.
        """
        kind = kinds(data)
        white = kind == WHITE
        cut = np.zeros(len(data), bool)
        if len(data) < 2:
            return cut
        a, b = kind[:-1], kind[1:]
        cut[1:] = (a != b) & (a != REST) & (b != REST) & ~white[:-1]
        cut[1:] |= white[1:] & ~white[:-1]
        ends = np.flatnonzero(white[:-1] & ~white[1:]) + 1
        inside = np.ones(len(data) + 1, bool)
        inside[bounds] = False
        ends = ends[inside[ends]]
        last = ends - 1
        for _ in range(2):  # to the first byte of the run's last character
            last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
        cut[last] = True
        cut[ends[data[ends - 1] != 32]] = True
        if not self.spaced:
            cut[ends] = True
        return cut

    def _learn(self, pieces: list[str]) -> None:
        """Keep the ids of new pieces. Many are encoded as one text, cut again where a separator is."""
        if len(self.known) + len(pieces) > self.most:
            self.known.clear()
        known, size = self.known, self.dtype.itemsize
        apart = len(self.mark) > 1
        alone = [w for w in pieces if apart or w[-1].isspace() or self.sign in w]
        held = set(alone)
        together = [w for w in pieces if w not in held] if held else pieces
        for i in range(0, len(together), 20_000):
            some = together[i : i + 20_000]
            ids = np.array(self._plain(self.separator.join([*some, ""])), self.dtype)
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(some):
                alone += some
                continue
            starts, raw = np.append(0, ends[:-1] + 1), ids.tobytes()
            for w, a, b in zip(some, (starts * size).tolist(), (ends * size).tolist()):
                known[w] = raw[a:b]
        for w in alone:
            known[w] = np.asarray(self._plain(w), self.dtype).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (not null), and where each text's ids start: len(texts) + 1 offsets."""
        data, bounds = text_bytes(texts)
        if not len(data):
            return np.empty(0, self.dtype), np.zeros(len(bounds), "int64")
        cut = self.cuts(data, bounds)
        cut[bounds[bounds < len(data)]] = True
        first = np.flatnonzero(cut)
        at = np.searchsorted(first, bounds)
        pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype("int32")), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if self.leading:
            opening = np.unique(at[:-1][np.diff(bounds) > 0])
            codes = codes.copy()
            codes[opening] = len(words) + np.arange(len(opening))
            words += [" " + w for w in pieces.take(pa.array(opening)).to_pylist()]
        blobs = list(map(self.known.get, words))
        new = list(dict.fromkeys(w for w, x in zip(words, blobs) if x is None))
        if new:
            before = len(self.known)
            self._learn(new)
            if len(self.known) < before + len(new):  # others went to make room
                self._learn([w for w in dict.fromkeys(words) if w not in self.known])
            blobs = list(map(self.known.__getitem__, words))
        lengths = np.fromiter(map(len, blobs), "int64", len(blobs)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(blobs), self.dtype)
        starts = np.cumsum(lengths) - lengths
        counts = lengths[codes]
        ends = np.cumsum(counts)
        ids = pool[np.repeat(starts[codes] - (ends - counts), counts) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[at]


_caches: dict[object, dict] = {}


def worker_cache(name: object) -> dict:
    """What a Python worker keeps from task to task under a name. Other names' entries go: stages that share a worker don't add up."""
    for other, held in _caches.items():
        if other != name:
            held.clear()
    return _caches.setdefault(name, {})


@functools.cache
def encoder(path: str, spaced: bool) -> Encoder:
    """One Encoder for each Python worker."""
    return Encoder(path, spaced)


def blocks(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Slices of a batch with at most so many bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype("int64")
    cell = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(cell)) + 1), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


#: Pieces whose ids a Python worker keeps, at most.
KEPT = 1_000_000


def encoded(batches, path: str, spaced: bool, end_id: int, column: str = "text", kept: int = KEPT):
    """For slices of the batches: the slice, ids and offsets, with end_id after each text. A null text counts as empty."""
    one = encoder(path, spaced)
    one.most = kept
    one.known = worker_cache(path)
    for batch in batches:
        for part in blocks(batch, column):
            ids, at = one.encode(pc.fill_null(part[column], ""))
            yield part, np.insert(ids, at[1:], end_id), at + np.arange(len(at))
