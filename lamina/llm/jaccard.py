"""Similarity join of documents on word shingles by chosen paths, with classes and links."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.graph import components, local_roots
from lamina.llm.shared import appended, attach, keyed, scratch_path, stored
from lamina.llm.tokens import blocks

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Min-wise values of a set; sets in a bucket that is compared in full; depth at which a bucket is compared in blocks.
TOKENS, BUCKET, DEPTH = 64, 128, 12
#: Depth that the first runs suffice for. Sets whose buckets split further get more runs.
SHALLOW = 3
#: A bucket that keeps this share of the bucket it came from is one of near copies: splitting it doesn't help.
DENSE = 0.75
#: Matching values of TOKENS from which a pair is a candidate: five standard deviations below those of a similar pair.
LOOSE = math.floor(TOKENS * THRESHOLD - 5 * math.sqrt(TOKENS * THRESHOLD * (1 - THRESHOLD)))
#: Sets in a block of a larger bucket.
SKETCH_BLOCK = 1024
EDGES = "a long, b long"
#: Sets in a block whose shingles are compared in full.
EXACT_BLOCK = 256

_ODD = (np.random.RandomState(7).randint(0, 1 << 62, (2, max(TOKENS, 64)), dtype="int64").astype("uint64") << np.uint64(1)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Lower-case words between white space; none for a text of white space or null."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))


def shingles(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of WORDS words, and each list's first: len + 1 offsets. A shorter list that isn't empty has one, of all its words."""
    at = words.offsets.to_numpy().astype("int64") - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    hashes = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False) if len(coded) else np.empty(0, "uint64")
    h = np.concatenate([hashes[coded.indices.to_numpy()], np.zeros(WORDS, "uint64")])
    n = np.diff(at)
    n[(n == 1) & (h[at[:-1]] == pd.util.hash_array(np.array([""], object), categorize=False)[0])] = 0
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    out = np.append(0, np.cumsum(count))
    first = np.repeat(at[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    held = np.repeat(np.minimum(n, WORDS), count)
    s = np.zeros(out[-1], "uint64")
    for i in range(WORDS):
        s = s * _ODD[1, i] + np.where(i < held, h[first + i], np.uint64(i + 1))
    return _mix(s), out


def _sketch(batches):
    for batch in batches:
        for part in blocks(batch, "text", 4 << 20):
            words = word_lists(part["text"])
            s, at = shingles(words)
            joined = pc.binary_join(words, " ").to_pylist()
            name = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in joined), "<i8").reshape(-1, 2)
            n = np.diff(at)
            low = np.zeros((len(n), TOKENS), "uint32")
            if len(s):
                full = np.flatnonzero(n)
                for j in range(TOKENS):
                    low[full, j] = np.minimum.reduceat(((s ^ _ODD[1, j]) * _ODD[0, j]) >> np.uint64(32), at[full])
            raw = low.astype("<u4").tobytes()
            sketch = pa.array([raw[i : i + 4 * TOKENS] for i in range(0, len(raw), 4 * TOKENS)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part[c] for c in ("doc_id", "k1", "k2")), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(n), sketch], ["doc_id", "k1", "k2", "s1", "s2", "n_shingles", "sketch"])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), TOKENS)


def _picked(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens a bucket splits on: rows and tokens. One token, or two in a quarter of the buckets: 1 / THRESHOLD on average."""
    one = _mix(path) % np.uint64(TOKENS)
    two = (one + np.uint64(1) + _mix(path + np.uint64(1)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
    both = np.flatnonzero((_mix(path + np.uint64(2)) >> np.uint64(11)) / 2.0**53 < 1 / THRESHOLD - 1)
    return np.concatenate([np.arange(len(path)), both]), np.concatenate([one, two[both]]).astype("int64")


def _child(path: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _mix(_mix(path * _ODD[0, 0] + token.astype("uint64")) + value.astype("uint64"))


def runs_for(recall: float, depth: int = SHALLOW) -> int:
    """Runs after which a pair at the threshold has been together in a bucket of this depth with this probability."""
    lost = 0.0
    for _ in range(depth):
        one = 1 - THRESHOLD + THRESHOLD * lost
        two = 1 / THRESHOLD - 1
        lost = (1 - two) * one + two * one**2
    return math.ceil(math.log(1 - recall) / math.log(lost))


def _first_split(runs: range):
    roots = _mix(np.arange(runs.start, runs.stop, dtype="uint64") + np.uint64(12345))

    def run(batches):
        for batch in batches:
            low, node = _sketches(batch["sketch"]), batch["node"].to_numpy()
            paths = []
            for root in roots:
                _, tokens = _picked(np.array([root]))
                paths += [_child(np.full(len(node), root), np.full(len(node), t), low[:, t]) for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths).view("int64")), pa.array(np.tile(node, len(paths)))], ["path", "node"])

    return run


def _next_split(batches):
    for batch in batches:
        path = batch["path"].to_numpy().view("uint64")
        row, token = _picked(path)
        child = _child(path[row], token, _sketches(batch["sketch"])[row, token])
        yield pa.RecordBatch.from_arrays([pa.array(child.view("int64")), batch["node"].take(pa.array(row)), batch["n"].take(pa.array(row))], ["path", "node", "before"])


def joined_groups(batches, keys: list[str], most: int):
    """Batches cut between groups of equal keys, for rows sorted by them, with so many rows or the last whole group."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        if table.num_rows < most:
            rest = table
            continue
        k = [table[c].to_numpy() for c in keys]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0))
        if not len(new):
            rest = table
            continue
        yield table.slice(0, new[-1] + 1)
        rest = table.slice(new[-1] + 1)
    if rest is not None and rest.num_rows:
        yield rest


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    k = [table[c].to_numpy() for c in keys]
    return np.append(0, np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1)


def _compare(batches):
    """Buckets in full by their sketches: an edge from each set to the first it is connected with."""
    keys = ["path", "lo", "hi"]
    for table in joined_groups(batches, keys, 4096):
        node, block, whole = (table[c].to_numpy() for c in ("node", "block", "whole"))
        low = np.frombuffer(b"".join(table["low"].to_pylist()), "u1").reshape(-1, TOKENS)
        starts = group_starts(table, keys)
        ends = np.repeat(np.append(starts[1:], len(node)), np.diff(np.append(starts, len(node))))
        later = ends - np.arange(len(node)) - 1
        edges = np.cumsum(later)
        a = 0
        found_a, found_b = [], []
        while a < len(node):
            b = max(a + 1, int(np.searchsorted(edges, (edges[a - 1] if a else 0) + 60_000, "right")))
            i = np.repeat(np.arange(a, b), later[a:b])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[a:b]) - later[a:b], later[a:b])
            keep = whole[i] | (block[i] != block[j])
            i, j = i[keep], j[keep]
            like = (low[i] == low[j]).sum(1) >= LOOSE
            found_a.append(i[like])
            found_b.append(j[like])
            a = b
        root = local_roots(len(node), np.concatenate(found_a), np.concatenate(found_b))
        linked = np.flatnonzero(root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["a", "b"])


def _sets(batches):
    for batch in batches:
        for part in blocks(batch, "text", 4 << 20):
            s, at = shingles(word_lists(part["text"]))
            sets = [np.unique(s[a:b]).astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part["root"], part["n"], part["node"], pa.array(sets, pa.binary())], ["root", "n", "node", "shingles"])


def _verify(batches):
    """Exact similarities within and between blocks: each set's links, and the first set that it is connected with by links."""
    keys = ["root", "lo", "hi"]
    for table in joined_groups(batches, keys, 512):
        node, block, whole = (table[c].to_numpy() for c in ("node", "block", "whole"))
        raw = table["shingles"].to_pylist()
        starts = group_starts(table, keys)
        links, first = np.zeros(len(node), "int64"), node.copy()
        for a, b in zip(starts, np.append(starts[1:], len(node))):
            if b - a < 2:
                continue
            order = np.argsort(block[a:b], kind="stable") + a
            some = [np.frombuffer(raw[i], "<u8") for i in order]
            size = np.array([len(x) for x in some])
            codes = np.unique(np.concatenate(some), return_inverse=True)[1]
            at = np.append(0, np.cumsum(size))
            mark = np.zeros(codes.max() + 1, bool)
            left, right = [], []
            side = block[order]
            for i in range(b - a - 1):
                j = i + 1 if whole[a] else int(np.searchsorted(side, side[i], "right"))
                if j >= b - a:
                    break
                own = codes[at[i] : at[i + 1]]
                mark[own] = True
                shared = np.add.reduceat(mark[codes[at[j] :]], at[j:-1] - at[j], dtype="int64")
                mark[own] = False
                like = np.flatnonzero(shared >= THRESHOLD * (size[i] + size[j:] - shared) - 1e-9) + j
                left.append(np.full(len(like), i))
                right.append(like)
            x, y = np.concatenate(left or [np.empty(0, "int64")]).astype("int64"), np.concatenate(right or [np.empty(0, "int64")]).astype("int64")
            links[order] = np.bincount(np.append(x, y), minlength=b - a)
            first[order] = node[order][local_roots(b - a, x, y)]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(first)], ["node", "links", "first"])


def _in_blocks(rows: DataFrame, group: str, size: int) -> DataFrame:
    """Rows of a group (n of them) dealt into blocks, and sent to every pair of blocks that theirs is in: lo, hi, block, whole."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int")
    rows = rows.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other"), "whole": F.col("block") == F.col("other")})
    # a pair of one block is in the group (block, block); whole marks it
    keys = [group, "lo", "hi"]
    return rows.withColumn("whole", F.col("lo") == F.col("hi")).drop("blocks", "other", "n").repartition(*keys).sortWithinPartitions(*keys)


def candidates(reps: DataFrame, recall: float = RECALL) -> DataFrame:
    """Edges a, b between sets that a bucket held together and whose sketches agree, some more than once. reps: node, sketch, low.

    A pair can only be lost below the planned depth if both of its sets have been in a bucket that was split there. So
    the sets that were get the runs that the depth reached takes, until no bucket goes deeper than was planned for.
    The edges of all runs and depths are parts of one table, so that they are read in few tasks, however many parts there are.
    """
    path = scratch_path(reps.sparkSession, "candidates")
    depth, done, sets, total = SHALLOW, 0, reps, reps.count()
    while done < runs_for(recall, depth):
        runs = range(done, runs_for(recall, depth))
        reached, deep = _run(sets, runs, depth, total, path)
        done = runs.stop
        if deep is None:
            break
        depth, sets = reached, stored(sets.join(deep, "node", "left_semi"), "deep")
    return reps.sparkSession.read.schema(EDGES).parquet(path)


def _run(reps: DataFrame, runs: range, planned: int, total: int, path: str) -> tuple[int, DataFrame | None]:
    """Adds the edges of these runs to the table at path. The depth reached, and the nodes of buckets below the planned depth, if there are any.

    First buckets are measured against all sets (total), also if only some of them run again."""
    rows = stored(reps.mapInArrow(_first_split(runs), "path long, node long").withColumn("before", F.lit(total).cast("long")), "paths")
    deep = None
    for depth in range(1, DEPTH + 1):
        if depth == planned + 1:
            deep = stored(rows.select("node").distinct(), "deep")
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.first("before").alias("before")).where("n > 1")
        sizes = stored(sizes, "sizes")
        split = (F.col("n") > BUCKET) & (F.col("n") < DENSE * F.col("before")) if depth < DEPTH else F.lit(False)
        ready = attach(rows.drop("before"), sizes.where(~split), ["path"], "n", ["n"], ["node"]).where("n is not null")
        ready = ready.join(reps.select("node", F.col("low")), "node").select("path", "node", "n", "low")
        appended(_in_blocks(ready, "path", SKETCH_BLOCK).mapInArrow(_compare, EDGES), path)
        large = sizes.where(split)
        if depth == DEPTH or large.isEmpty():
            return depth, deep
        on = attach(rows.drop("before"), large, ["path"], "n", ["n"], ["node"]).where("n is not null")
        rows = stored(on.join(reps.select("node", "sketch"), "node").select("path", "node", "n", "sketch").mapInArrow(_next_split, "path long, node long, before long"), "paths")


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, and k1, k2 (its key) and stays.

    Texts are sequences of lower-case words. Documents with one sequence are copies, which one of them represents.
    Sets of WORDS-word shingles of different sequences are linked from a Jaccard similarity of THRESHOLD on; classes
    are the connected components of links. class_id is the smallest doc_id of the class, n_links the number of
    other sequences linked with the document's. The row that stays in a class is that of class_id.

    Candidates come from chosen paths: a set is embedded as TOKENS min-wise values; a bucket splits on values it
    samples, 1 / THRESHOLD of them on average, so that a similar pair is expected together in one child; small
    buckets, and those that hardly shrink, are compared in full by sketches, the latter in pairs of blocks. Runs
    repeat (runs_for) until a pair at the threshold is met with the given recall, for sets of buckets that split on
    below SHALLOW as often as the depth reached takes. A bucket yields a spanning forest, never its pairs. Components of candidates are then compared exactly on whole sets, in pairs of blocks, so that
    links within them are complete.

    Defined cases: null, empty and blank texts have no shingles: they are copies of one another with no link; texts of
    one to four words have one shingle; a text of any length is read as a whole; a null doc_id orders last; rows that repeat doc_id and text share a key and
    a result; an empty table gives an empty result; other columns of docs are ignored.
    """
    named_rows = keyed(docs.select("doc_id", "text")).drop("row", "at")
    rows = stored(named_rows.mapInArrow(_sketch, "doc_id long, k1 long, k2 long, s1 long, s2 long, n_shingles long, sketch binary"), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    names = rows.groupBy("s1", "s2").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    reps = stored(names.withColumn("node", F.monotonically_increasing_id()), "sets")
    low_bytes = F.unhex(F.concat(*[F.hex(F.substring("sketch", 4 * i + 1, 1)) for i in range(TOKENS)]))
    edges = candidates(reps.where("n_shingles > 0").select("node", "sketch", low_bytes.alias("low")), recall)

    groups = stored(components(edges), "groups")
    sizes = stored(groups.groupBy("root").agg(F.count("*").alias("n")), "group_sizes")
    members = attach(groups, sizes, ["root"], "n", ["n"], ["node"]).join(reps.select("node", "first.k1", "first.k2"), "node")
    texts = named_rows.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).join(members, ["k1", "k2"]).select("root", "n", "node", "text")
    sets = stored(texts.mapInArrow(_sets, "root long, n long, node long, shingles binary"), "shingles")
    linked = stored(_in_blocks(sets, "root", EXACT_BLOCK).mapInArrow(_verify, "node long, links long, first long"), "links")
    n_links = linked.groupBy("node").agg(F.sum("links").alias("n_links")).where("n_links > 0")
    classes = stored(components(linked.select(F.col("node").alias("a"), F.col("first").alias("b")).where("a <> b")), "classes")

    named = reps.select("node", "s1", "s2", "first", "copies").join(classes, "node", "left").join(n_links, "node", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "node")), "in_classes")
    best = stored(named.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("n")), "best")
    named = attach(named, best, ["root"], "n", ["best"], ["node"])
    named = stored(named.select("s1", "s2", "copies", "best", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    out = attach(rows.select("doc_id", "k1", "k2", "s1", "s2"), named, ["s1", "s2"], "copies", ["best", "n_links"], ["k1", "k2"])
    stays = (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))
    return out.select("doc_id", F.col("best.doc_id").alias("class_id"), "n_links", "k1", "k2", stays.alias("stays"))


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of docs that stay, all columns as they are: one of each class of near_duplicates, whose cases hold.

    Null, empty and blank texts are one class, of which one row stays. Of rows that repeat doc_id and text, one stays.
    """
    stay = near_duplicates(docs, recall).where("stays").select("k1", "k2").distinct()
    return keyed(docs).select("row", "k1", "k2").dropDuplicates(["k1", "k2"]).join(stay, ["k1", "k2"], "left_semi").select("row.*")
