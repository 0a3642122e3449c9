"""Language identification in two steps: the family of languages first, then its languages one against one, by linear support vector machines."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import stored
from lamina.llm.tokens import blocks, text_bytes

#: Labelled rows of a language that the machines are fitted on (on average: each row goes in by its hash), and languages, the most frequent ones.
PER_LANGUAGE, LANGUAGES = 1000, 200
#: Hashed runs of 1 to ORDERS code points, and bins that they are hashed to.
ORDERS, BINS = 4, 1 << 15
#: Code points whose runs are held at a time.
SLICE = 1 << 20
#: Regularisation, rounds of the optimiser, and the frequency under which a bin's scale no longer grows.
REGULAR, ITERATIONS, RARE = 3e-3, 12, 1e-4
#: Partitions of the instances, and machines that are fitted at a time.
PARTS, AT_A_TIME = 8, 4
#: A margin of 1 is as sure as a logistic of this.
STEEP = 3.0
#: Pieces of a labelled text (code points) that are instances too, so that short texts are learnt as well.
PIECE = 40

# Families of languages, by the first part of their codes in ISO 639. A language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "austronesian": "id jv mg mi ms sm su tl to",
    "bantu": "ln ny rn rw sn sw tn xh zu",
    "sinitic": "zh yue wuu",
}

_ODD = (np.random.RandomState(11).randint(0, 1 << 62, ORDERS + 1, dtype="int64").astype("uint64") << np.uint64(1)) | np.uint64(1)


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), lang)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 4 == 2


def letters(texts: pa.Array) -> pa.Array:
    """Lower-case words of letters with one space between them and on either side; empty for a text without letters or null."""
    texts = pc.fill_null(texts, "")
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    words = pc.utf8_trim(pc.replace_substring_regex(low, r"[^\pL\pM]+", " "), " ")
    padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), words, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    return pc.if_else(pc.match_substring_regex(texts, r"\pL"), padded, pa.scalar("", pa.large_string()))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and where each text begins: len(texts) + 1 places."""
    data, _ = text_bytes(texts)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype("int64")
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4"), np.append(0, np.cumsum(sizes))


def run_bins(codes: np.ndarray, lo: int, hi: int, ends: np.ndarray):
    """For each order the bins of the runs that begin at codes lo to hi; BINS, which weighs nothing, for those that pass
    their text's end (ends: of the text of each of these codes)."""
    wide = codes[lo : hi + ORDERS - 1].astype("uint64")
    wide = np.append(wide, np.zeros(hi - lo + ORDERS - 1 - len(wide), "uint64"))
    key = np.zeros(hi - lo, "uint64")
    at = np.arange(lo, hi)
    for n in range(ORDERS):
        key = (key + wide[n : n + hi - lo] + np.uint64(1)) * _ODD[n]
        mixed = (key ^ (key >> np.uint64(29))) * _ODD[ORDERS]
        yield np.where(at + n < ends, (mixed >> np.uint64(64 - 15)).astype("int64"), BINS)


def run_counts(sizes: np.ndarray) -> np.ndarray:
    """Numbers of runs of all orders in texts of so many code points."""
    return sum(np.maximum(sizes - n, 0) for n in range(ORDERS))


def mean_weights(codes: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each text, the mean of the table's rows over its runs: SLICE code points at a time, however long a text is."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), table.shape[1]))
    of = np.flatnonzero(sizes > 0)
    starts, stops = bounds[:-1][of], bounds[1:][of]
    for lo in range(0, int(bounds[-1]), SLICE):
        hi = min(lo + SLICE, int(bounds[-1]))
        a, b = np.searchsorted(stops, lo, "right"), np.searchsorted(starts, hi, "left")
        first = np.maximum(starts[a:b], lo) - lo
        ends = np.repeat(stops[a:b], np.diff(np.append(first, hi - lo)))
        for bins in run_bins(codes, lo, hi, ends):
            out[of[a:b]] += np.add.reduceat(table[bins], first, axis=0, dtype="float64")
    return out / np.maximum(run_counts(sizes), 1)[:, None]


@dataclass
class Machines:
    """names of classes, pairs of their numbers (or one class against all others: (i, -1)), a weight for each bin and machine, and biases."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BINS + 1, 0), "float32"))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decide(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the chosen class of each text, and how sure it is. Votes count first, then the sum of margins, then the order of names."""
        margin = mean_weights(codes, bounds, self.table) + self.bias
        votes, sums, sure = np.zeros((len(margin), len(self.names))), np.zeros((len(margin), len(self.names))), np.ones((len(margin), len(self.names)))
        for k, (i, j) in enumerate(self.pairs):
            m = np.clip(margin[:, k], -20, 20)
            for c, sign in ((i, 1.0), (j, -1.0)):
                if c >= 0:
                    votes[:, c] += j >= 0 and np.clip(sign, 0, 1) == (m >= 0)
                    sums[:, c] += sign * m
                    sure[:, c] = np.minimum(sure[:, c], 1 / (1 + np.exp(-STEEP * sign * m)))
        best = np.lexsort((np.broadcast_to(-np.arange(len(self.names)), sums.shape), sums, votes), axis=1)[:, -1]
        return best, sure[np.arange(len(best)), best]


@dataclass
class Model:
    families: Machines
    members: list[Machines]


def _instances(batches):
    """The sampled texts' bins with their shares of the runs: of the whole text, and of a short piece of it that its length picks."""
    for batch in batches:
        for part in blocks(batch, "text", 1 << 20):
            codes, bounds = code_points(letters(part["text"]))
            langs, names, places, shares = part["lang"].to_pylist(), [], [], []
            for lang, a, b in zip(langs, bounds[:-1].tolist(), bounds[1:].tolist()):
                at = a + (b - a) // 3
                for x, y in {(a, b), (at, min(at + PIECE, b))}:
                    count = np.zeros(BINS + 1)
                    for lo in range(x, y, SLICE):
                        hi = min(lo + SLICE, y)
                        for bins in run_bins(codes, lo, hi, np.full(hi - lo, y)):
                            count += np.bincount(bins, minlength=BINS + 1)
                    found = np.flatnonzero(count[:BINS])
                    if len(found):
                        names.append(lang)
                        places.append(found.astype("int32"))
                        shares.append(count[found] / count[:BINS].sum())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))], ["lang", "bins", "shares"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The machines, from text and lang of docs (every row of it may be learnt from: leave out what is held out).

    About per_language rows of each of the LANGUAGES most frequent languages are instances, picked by a hash of the row;
    equal rows are picked once. What is sampled is bounded by these parameters, whatever docs holds; the machines are Spark's own, fitted on the executors.
    Rows without lang, text or a letter aren't learnt from.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text", "lang").alias("key"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES)
    counts = [(r.lang, r.rows) for r in counts.collect()]
    if not counts:
        return Model(Machines([]), [])
    limits = docs.sparkSession.createDataFrame([(name, min(1.0, per_language / n)) for name, n in counts], "lang string, share double")
    # 2^-63 of the key's absolute value is even between 0 and 1; at most LANGUAGES short rows are broadcast
    picked = rows.join(F.broadcast(limits), "lang").where(F.abs(F.col("key").cast("double")) / F.lit(2.0**63) <= F.col("share")).dropDuplicates(["lang", "key"])
    sample = stored(picked.select("lang", "text").mapInArrow(_instances, "lang string, bins array<int>, shares array<double>").coalesce(PARTS), "languages")

    mean = np.zeros(BINS)
    total = sample.count()
    for r in sample.select(F.explode(F.arrays_zip("bins", "shares")).alias("x")).groupBy("x.bins").agg(F.sum("x.shares").alias("s")).collect():
        mean[r.bins] = r.s / max(total, 1)
    scale = 1 / np.sqrt(mean + RARE)
    vector = F.udf(lambda bins, shares: SparseVector(BINS, bins, np.array(shares) * scale[bins]), VectorUDT())
    data = sample.select("lang", vector("bins", "shares").alias("features")).persist()
    n = {r.lang: r["count"] for r in data.groupBy("lang").count().collect()}

    def machine(yes: list[str], no: list[str]) -> tuple[np.ndarray, float]:
        """Weights of the bins and the bias of one machine, both sides and the languages of a side weighing the same."""
        some = data.where(F.col("lang").isin(yes + no))
        weight = {**{c: 1 / len(yes) / n[c] for c in yes}, **{c: 1 / len(no) / n[c] for c in no}}
        most = max(weight.values())
        weights = F.element_at(F.create_map(*[F.lit(x) for c, w in weight.items() for x in (c, w / most)]), F.col("lang"))
        some = some.select("features", F.col("lang").isin(yes).cast("double").alias("label"), weights.alias("weight"))
        found = LinearSVC(maxIter=ITERATIONS, regParam=REGULAR, standardization=False, weightCol="weight").fit(some)
        return found.coefficients.toArray() * scale, float(found.intercept)

    by_family: dict[str, list[str]] = {}
    for lang in sorted(n):
        by_family.setdefault(family_of(lang), []).append(lang)
    names = sorted(by_family)
    groups = [by_family[f] for f in names]
    # two families need one machine, more need one each, against all others
    top = [(0, 1)] if len(names) == 2 else [(i, -1) for i in range(len(names))] if len(names) > 2 else []
    wanted = [(groups[i], groups[j] if j >= 0 else [c for k, g in enumerate(groups) if k != i for c in g]) for i, j in top]
    inner = [list(combinations(range(len(g)), 2)) for g in groups]
    wanted += [([g[i]], [g[j]]) for g, pairs in zip(groups, inner) for i, j in pairs]
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        fitted = iter(list(pool.map(inheritable_thread_target(docs.sparkSession)(lambda sides: machine(*sides)), wanted)))

    def machines(names: list[str], pairs: list[tuple[int, int]]) -> Machines:
        found = [next(fitted) for _ in pairs]
        table = np.zeros((BINS + 1, len(pairs)), "float32")
        for k, (w, _) in enumerate(found):
            table[:BINS, k] = w
        return Machines(names, pairs, table, np.array([b for _, b in found]))

    model = Model(machines(names, top), [machines(g, pairs) for g, pairs in zip(groups, inner)])
    data.unpersist()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (how sure the family and the language in it are, multiplied) of each row of docs, from its whole text alone.

    Defined cases: a null text and one without a letter are `und` with the score 0; so is every text if nothing was learnt; a
    language without others in its family is decided by the family; ties go to more votes, then to the larger sum of margins, then to the first name in order;
    a text of any length is read as a whole, SLICE code points at a time; null and repeated doc_ids are rows like others; an
    empty table gives an empty result; other columns of docs, lang and source too, aren't read.
    """

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text", 4 << 20):
                codes, bounds = code_points(letters(part["text"]))
                sizes = np.diff(bounds)
                lang, score = np.full(len(sizes), "und", object), np.zeros(len(sizes))
                if model.members and len(codes):
                    family, sure = model.families.decide(codes, bounds)
                    for f, members in enumerate(model.members):
                        mine = (family == f) & (sizes > 0)
                        if mine.any():
                            own = codes[np.repeat(mine, sizes)] if members.pairs else codes[:0]
                            best, inner = members.decide(own, np.append(0, np.cumsum(sizes[mine] if members.pairs else sizes[mine] * 0)))
                            lang[mine] = np.array(members.names, object)[best]
                            score[mine] = sure[mine] * inner
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
