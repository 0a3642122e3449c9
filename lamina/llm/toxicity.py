"""Toxicity: a support vector machine on a gapped subsequence kernel of words, with Nystrom landmarks."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import stored
from lamina.llm.tokens import blocks, worker_cache

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 20_000
#: Words that are instances of either class, and hard clean words of the second round, at most.
TOXIC_WORDS, CLEAN_WORDS, HARD_WORDS, LANDMARKS = 2000, 6000, 2000, 192
#: Rounds in which the clean words of the highest value join the instances.
ROUNDS = 2
#: The kernel: subsequences of three characters within SPAN, weighted DECAY for each character that they skip.
SPAN, DECAY = 6, 0.5
#: A longer run of letters is read in overlapping windows of this length.
LONGEST = 24
#: Words whose values a Python worker keeps, at most.
WORDS_KEPT = 600_000
#: Decision value of a text without words.
NO_WORDS = -1.5

_WORD = re.compile(r"\S+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][\W_]{1,3}){3,}[^\W\d_](?!\w)")
# Digits that stand for letters.
_DIGITS = str.maketrans("013457", "oieast")


def _forms(chunk: str) -> set[str]:
    """The forms of a lower-case chunk between white space that are scored: its letters joined, so that inserted
    characters drop out, and each run of letters in it; with digits read as letters where it has both. Long forms are
    read in overlapping windows."""
    if chunk.isalpha() and len(chunk) <= LONGEST:
        return {chunk}
    runs = _LETTERS.findall(chunk)
    out = {*runs, "".join(runs)}
    if runs and len(chunk) <= LONGEST and any(c.isdigit() for c in chunk):
        out.add("".join(_LETTERS.findall(chunk.translate(_DIGITS))))
    out.discard("")
    long = {w for w in out if len(w) > LONGEST}
    return out - long | {w[i : i + LONGEST] for w in long for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)}


def words_of(sentence: str) -> set[str]:
    """The words of a lower-case sentence in the forms that are scored; letters that stand apart count as one word."""
    chunks = set(_WORD.findall(sentence))
    plain = {c for c in chunks if c.isalpha() and len(c) <= LONGEST}
    return plain.union(*map(_forms, chunks - plain), *(_forms("".join(_LETTERS.findall(run))) for run in _SPELLED.findall(sentence)))


@functools.cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of a string of this length, and their weights."""
    found = [(i, j, k) for i in range(length) for j in range(i + 1, min(length, i + SPAN)) for k in range(j + 1, min(length, i + SPAN))]
    at = np.array(found, "int64").reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] - 2.0)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length, between marks of their ends: sorted subsequence keys, summed weights (0 but for the last of equal keys), norms."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype("int64")
    at, weight = _places(codes.shape[1])
    key = codes[:, at[:, 0]] << 42 | codes[:, at[:, 1]] << 21 | codes[:, at[:, 2]]
    order = np.argsort(key, axis=1)
    key = np.take_along_axis(key, order, 1)
    total = np.cumsum(weight[order], axis=1)
    last = np.ones(key.shape, bool)
    last[:, :-1] = key[:, 1:] != key[:, :-1]
    before = np.maximum.accumulate(np.where(last, total, 0.0), axis=1)
    before = np.concatenate([np.zeros((len(words), 1)), before[:, :-1]], axis=1)
    value = np.where(last, total - before, 0.0)
    return key, value, np.sqrt((value**2).sum(1))


def _by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for some in groups.values():
        for i in range(0, len(some), 4000):
            yield np.array(some[i : i + 4000])


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel values of all words of a (few) with all of b."""
    table: dict[int, int] = {}
    rows = []
    for i in range(len(a)):
        key, value, norm = _features([a[i]])
        rows.append([(table.setdefault(k, len(table)), v / norm[0]) for k, v in zip(key[0].tolist(), value[0].tolist()) if v])
    dense = np.zeros((len(table) + 1, len(a)))
    for j, row in enumerate(rows):
        for k, v in row:
            dense[k, j] = v
    known = np.array(sorted(table), "int64")
    dense = np.concatenate([dense[[table[k] for k in known.tolist()]], np.zeros((1, len(a)))])
    out = np.zeros((len(b), len(a)))
    for some in _by_length(b):
        for i in range(0, len(some), 256):
            part = some[i : i + 256]
            key, value, norm = _features([b[j] for j in part])
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            at = np.where(known[at] == key, at, len(known))
            out[part] = np.einsum("wf,wfm->wm", value, dense[at]) / norm[:, None]
    return out


@dataclass
class Model:
    """The machine's expansion over its landmarks, added up for each subsequence, and the calibration of its values."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def values(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for some in _by_length(words):
            key, value, norm = _features([words[j] for j in some])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == key, value * self.weights[at], 0.0).sum(1) / norm + self.bias
        return out

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -40, 40)))


def _fit_words(words: list[str], toxic: np.ndarray, weight: np.ndarray, landmarks: list[str]) -> Model:
    """Squared hinge loss in the Nystrom space of the landmarks, by Newton steps."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-6 * values.max()
    to_space = vectors[:, keep] / np.sqrt(values[keep])
    x = np.concatenate([kernel(landmarks, words) @ to_space, np.ones((len(words), 1))], axis=1)
    y = np.where(toxic, 1.0, -1.0)
    c = np.where(toxic, weight / weight[toxic].sum(), weight / weight[~toxic].sum()) * len(words)
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1]) * 2.0
    ridge[-1] = 1e-3
    for _ in range(40):
        on = y * (x @ w) < 1
        new = np.linalg.solve((x[on].T * c[on]) @ x[on] + np.diag(ridge), x[on].T @ (c[on] * y[on]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * w + 0.5 * new
    alpha = to_space @ w[:-1]
    total: dict[int, float] = {}
    for a, name in zip(alpha, landmarks):
        key, value, norm = _features([name])
        for k, v in zip(key[0].tolist(), (value[0] * a / norm[0]).tolist()):
            total[k] = total.get(k, 0.0) + v
    keys = np.array(sorted(total), "int64")
    return Model(keys, np.array([total[k] for k in keys.tolist()]), float(w[-1]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 3 == 1


def _document_words(batches):
    """Each document's words once, with the chunk before: copies of a document repeat both."""
    for batch in batches:
        for part in blocks(batch, "text"):
            words, before, toxic = [], [], []
            for text, label in zip(part["text"].to_pylist(), part["toxic"].to_pylist()):
                found: dict[str, str] = {}
                for sentence in _sentences(text):
                    last = ""
                    for chunk in _WORD.findall(sentence):
                        for w in _forms(chunk):
                            found.setdefault(w, last)
                        last = chunk
                words += found
                before += found.values()
                toxic += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.string()), pa.array(toxic, pa.int32())], ["word", "before", "toxic"])


def _sentences(text: str | None) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n", (text or "").lower()) if s]


def _scored(batches, model: Model, column: str = "text"):
    """Slices of the batches, and each text's largest value over its sentences' words."""
    known = worker_cache((model.bias, len(model.keys), float(model.weights.sum())))
    for batch in batches:
        for part in blocks(batch, column, 4 << 20):
            bags = [set().union(*map(words_of, _sentences(text))) for text in part[column].to_pylist()]
            new = list({w for bag in bags for w in bag if w not in known})
            if len(known) + len(new) > WORDS_KEPT:
                known.clear()
                new = list(set().union(*bags))
            known.update(zip(new, model.values(new).tolist()))
            yield part, np.array([max([known[w] for w in bag], default=NO_WORDS) for bag in bags])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier of labels.toxic from rows of docs that aren't held out.

    A sentence is a bag of words, and toxic if one of its words is; only documents are labelled, so that the words of
    toxic documents that labels.toxic lifts beyond chance, in the number of different places (the chunk before), stand for
    their toxic sentences, and words of clean
    documents, frequent ones, others by hash, and in a second round those of the highest value, for clean ones.

    What reaches the driver is bounded: SAMPLE labelled rows chosen by a hash of doc_id, TOXIC_WORDS, CLEAN_WORDS and
    HARD_WORDS words, and the distribution of the sampled documents' values for the calibration.
    """
    named = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    named = stored(named.orderBy(F.xxhash64("id"), "id").limit(SAMPLE), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(named), F.col("doc_id") == F.col("id")).select("text", "toxic")
    rows = stored(rows, "sentences")
    places = rows.mapInArrow(_document_words, "word string, before string, toxic int").groupBy("word", F.xxhash64("before").alias("place")).agg(F.max("toxic").alias("pos"), F.max(1 - F.col("toxic")).alias("neg"))
    table = stored(places.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "words")
    n = rows.agg(F.sum("toxic"), F.count("*")).first()
    share = min(0.9, max(0.001, (n[0] or 0) / max(1, n[1])))
    expected = (F.col("pos") + F.col("neg")) * share
    lift = (F.col("pos") - expected) / F.sqrt(expected * (1 - share))
    least = max(6, round(0.01 * (n[0] or 0)))  # a word of fewer toxic documents may be there by chance
    toxic = table.withColumn("lift", lift).where(F.col("pos") >= least).where("lift >= 6 and pos >= 9 * neg").orderBy(F.desc("lift"), "word").limit(TOXIC_WORDS).collect()
    half = CLEAN_WORDS // 2
    clean = [r.word for r in table.where("neg > 0 and pos < 9 * neg").orderBy(F.desc("neg"), "word").limit(half).collect()]
    clean += [r.word for r in table.where("neg > 0 and pos < 9 * neg").orderBy(F.xxhash64("word"), "word").limit(half).collect()]
    clean = list(dict.fromkeys(clean))
    if not toxic or not clean:
        return Model(np.array([0]), np.array([0.0]), NO_WORDS)
    names, lifts = [r.word for r in toxic], np.array([float(r.pos) for r in toxic])

    def machine(clean: list[str], hard: list[str]) -> Model:
        few = LANDMARKS // 3
        landmarks = list(dict.fromkeys([*names[: 2 * few], *hard[: few // 2], *clean[:: max(1, len(clean) // few)][:few]]))
        words = [*names, *clean, *hard]
        is_toxic = np.arange(len(words)) < len(names)
        return _fit_words(words, is_toxic, np.concatenate([np.sqrt(lifts), np.ones(len(clean) + len(hard))]), landmarks)

    model = machine(clean, [])

    def rate(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(model.values(batch["word"].to_pylist()))], ["word", "value"])

    seen = table.where("neg > 0 and pos < 9 * neg").select("word")
    hard: list[str] = []
    for _ in range(ROUNDS):
        found = seen.mapInArrow(rate, "word string, value double").orderBy(F.desc("value"), "word").limit(HARD_WORDS).collect()
        hard = list(dict.fromkeys([*hard, *(r.word for r in found if r.word not in set(clean))]))
        model = machine(clean, hard)

    def value(batches):
        for part, values in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([part["toxic"], pa.array(values)], ["toxic", "value"])

    # values to a thousandth between -10 and 10, with their numbers: however many rows share an identifier, at most 40,002 groups
    grade = F.round(F.least(F.greatest("value", F.lit(-10.0)), F.lit(10.0)), 3)
    seen = rows.mapInArrow(value, "toxic int, value double").groupBy("toxic", grade.alias("value")).agg(F.count("*").alias("n")).collect()
    model.slope, model.shift = _calibrated(*(np.array([float(r[c]) for r in seen]) for c in ("value", "toxic", "n")))
    return model


def _calibrated(value: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """A logistic curve of values that n rows have each, its parameters held near a slope of 5 through 0, both classes weighing the same."""
    w = np.where(toxic == 1, 0.5 / max(1, n[toxic == 1].sum()), 0.5 / max(1, n[toxic == 0].sum())) * 100 * n
    x = np.stack([value, np.ones(len(value))], axis=1)
    start = np.array([5.0, 0.0])
    t = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag([0.5, 0.5]), x.T @ (w * (p - toxic)) + 0.5 * (t - start))
        t = t - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(t[0], 0.1)), float(t[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and value of each row of docs, from its whole text.

    Defined cases: null and empty texts and texts without letters have the value NO_WORDS; a text of any length is read as
    a whole; null and repeated doc_ids are rows like others; an empty table gives an empty result; other columns of docs are ignored.
    """

    def run(batches):
        for part, values in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.probability(values)), pa.array(values)], ["doc_id", "score", "value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, value double")


def filtered(docs: DataFrame, model: Model, most: float) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below most. The cases of score hold: null and empty texts stay."""

    def run(batches):
        for part, values in _scored(batches, model):
            yield part.filter(pa.array(model.probability(values) < most))

    return docs.mapInArrow(run, docs.schema)
