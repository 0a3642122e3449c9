"""Exact top-k by inner product: a Voronoi join of queries and vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.shared import stored

SCALE = 64
#: Queries a pivot, and the most pivots there can be: their vectors and summaries are all that reaches the driver.
QUERIES_A_PIVOT, MOST_PIVOTS = 1024, 256
#: Vectors in a block of a cell, and queries that meet a block in one task, on average.
BLOCK, ASKS = 16_384, 131_072
#: Queries that are multiplied with a block at once; how much more blocks each round visits than those before.
CHUNK, GROWTH = 512, 4
WORST = np.iinfo("int64").min
#: Relative error that bounds in floating point may have.
SLACK = 1e-9


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: the components as floor(scale * x).

    Rows without an id, and vectors that are null or hold a component that is null or not finite, are left out. A finite
    component whose scaled value passes 64 bits is an error.
    """
    double = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where("vec_id is not null and embedding is not null").where(finite)
    whole = lambda x: F.when(F.abs(x * scale) < float(1 << 63), F.floor(x * scale)).otherwise(F.raise_error(F.lit("a scaled component passes 64 bits")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(double, whole).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers; a shorter vector is filled up with zeros."""
    at = column.offsets.to_numpy() - column.offsets[0].as_py()
    values, n = column.flatten().to_numpy(zero_copy_only=False), np.diff(at)
    out = np.zeros((len(column), dim), "int64")
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(at[:-1], n)] = values
    return out


def _packed(m: np.ndarray) -> pa.Array:
    raw = m.astype("<i2" if -32_000 < m.min(initial=0) and m.max(initial=0) < 32_000 else "<i8")
    return pa.array([x.tobytes() for x in raw], pa.binary())


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), "int64")
    short = pc.binary_length(column).to_numpy(zero_copy_only=False) == 2 * dim
    for rows, kind in ((np.flatnonzero(short), "<i2"), (np.flatnonzero(~short), "<i8")):
        if len(rows):
            out[rows] = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), dim)
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype("float64") ** 2).sum(1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles where they hold every partial sum, else as integers, of any size where 64 bits may not do."""
    if not (a.size and b.size):
        return np.zeros((len(a), len(b)))
    largest = float(np.abs(a.astype("float64")).max()) * float(np.abs(b.astype("float64")).max()) * a.shape[1]
    if largest < 2**53:
        return a.astype("float64") @ b.astype("float64").T
    if min(largest, _lengths(a).max() * _lengths(b).max()) < 2**62:  # a partial sum may wrap round, and back
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def _best(scores: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row that reach its bar; of equal ones, those of the first columns."""
    rows, columns = scores.shape
    bars = bars.astype(scores.dtype)
    if columns > k:
        many = np.flatnonzero((scores >= bars[:, None]).sum(1) > k)
        if len(many):
            bars[many] = np.maximum(bars[many], np.partition(scores[many], columns - k, axis=1)[:, columns - k])
    over = scores >= bars[:, None]
    ties = np.flatnonzero(over.sum(1) > 2 * k)  # many columns at the bar: the first k are enough
    for r in ties:
        over[r, np.flatnonzero(scores[r] == bars[r])[k:]] = False
    i, j = np.nonzero(over)
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(rows))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep]


def _solve(asked: pa.Table, held: pa.Table, k: int, dim: int) -> pa.Table:
    """The k best vectors of a block for each query that asks it, of those that reach the query's bar."""
    held = held.combine_chunks().sort_by("vec_id")
    ids, data = held["vec_id"].to_numpy(), _unpacked(held["m"].combine_chunks(), dim)
    asked = asked.combine_chunks()
    own, bars = asked["query_id"].to_numpy(), asked["bar"].to_numpy()
    found = []
    for a in range(0, len(own), CHUNK) if len(ids) else ():
        some = slice(a, a + CHUNK)
        scores = _products(_unpacked(asked["m"].combine_chunks()[some], dim), data)
        low, high = np.searchsorted(ids, own[some], "left"), np.searchsorted(ids, own[some], "right")
        for r in np.flatnonzero(high > low):
            scores[r, low[r] : high[r]] = 0 if scores.dtype == object else WORST
        if scores.dtype == object:
            if abs(scores).max() >= (1 << 63) - 1024:
                raise ValueError("an inner product passes 64 bits")
            scores = scores.astype("int64")
            for r in np.flatnonzero(high > low):
                scores[r, low[r] : high[r]] = WORST
        i, j = _best(scores, np.maximum(bars[some], WORST + 1024), k)
        found.append((asked["qn"].to_numpy()[some][i], own[some][i], ids[j], scores[i, j].astype("int64")))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, "int64")] * 4
    return pa.Table.from_arrays([pa.array(c) for c in columns], ["qn", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: for each query the k vectors of the highest inner product, ties to the smaller vec_id.

    vectors and queries: vec_id, v (arrays of integers, see scaled). A query's own vec_id is no candidate.

    Pivots are vectors, chosen by a hash of their id. Vectors are grouped in the cells of their nearest pivots, each cell in
    blocks of about BLOCK. A cell's summary is its size, its radius and its k + 1 smallest distances from the pivot. From the
    summaries come, for each query, a score that at least k candidates reach (its first bar), and the highest score that a
    cell can hold: pivot * q + radius * |q|. A query visits its own cell first, then cells by descending bound, in
    rounds of which each goes through GROWTH - 1 times as many blocks as those before; a round's k-th score is the next
    one's bar. A query is sent to the blocks of a cell only if the cell's bound reaches its bar, and takes from a block only
    what reaches the bar: about (GROWTH - 1) * k vectors a round, whatever the number of vectors, for rounds as many as the
    logarithm of the blocks.

    A block and at most about ASKS queries meet in one task. Blocks are dealt by place, not by value, so that a cell of
    any size, copies of one vector or one vec_id included, is many blocks.

    Defined cases: repeated vec_ids are rows of their own; a shorter vector counts as filled up with zeros; fewer
    than k candidates are all returned; without queries or vectors the result is empty; an inner product that passes 64
    bits is an error, never a wrapped value; other columns are ignored.
    """
    spark = vectors.sparkSession
    vectors, queries = stored(vectors.select("vec_id", "v"), "vectors"), stored(queries.select("vec_id", "v"), "queries")
    size, asked = (df.agg(F.count("*"), F.max(F.size("v"))).first() for df in (vectors, queries))
    dim = max(size[1] or 0, asked[1] or 0, 1)
    n_pivots = min(MOST_PIVOTS, max(4, -(-asked[0] // QUERIES_A_PIVOT)))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    if not chosen or not asked[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = np.zeros((len(chosen), dim))
    for i, row in enumerate(chosen):
        pivots[i, : len(row.v)] = row.v
    pivots = np.unique(pivots, axis=0)
    norms = np.sqrt((pivots**2).sum(1))

    def in_cells(batches):
        """m (the packed vector), its cell, its distance from the pivot, and a number that deals it into a block."""
        draw = np.random.RandomState(TaskContext.get().partitionId())
        for batch in batches:
            m = _matrix(batch["v"], dim)
            cell = (m.astype("float64") @ pivots.T - norms**2 / 2).argmax(1)
            far = np.sqrt(((m - pivots[cell]) ** 2).sum(1))
            spot = draw.randint(0, 1 << 31, len(m), dtype="int64")
            yield pa.RecordBatch.from_arrays([batch["vec_id"], _packed(m), pa.array(cell.astype("int32")), pa.array(far), pa.array(spot)], ["vec_id", "m", "cell", "far", "spot"])

    grouped = "vec_id long, m binary, cell int, far double, spot long"
    data = stored(vectors.mapInArrow(in_cells, grouped), "cells")
    nearest = data.select("cell", "far", F.row_number().over(Window.partitionBy("cell").orderBy("far")).alias("i")).where(F.col("i") <= k + 1)
    near = np.full((len(pivots), k + 1), np.inf)
    for r in nearest.collect():
        near[r.cell, r.i - 1] = r.far
    radius, blocks = np.zeros(len(pivots)), np.zeros(len(pivots), "int64")
    for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():
        radius[r.cell], blocks[r.cell] = r.radius, -(-r.n // BLOCK)
    parts = -(-asked[0] // ASKS)
    in_block = F.element_at(F.array(*[F.lit(int(b)) for b in np.maximum(blocks, 1)]), F.col("cell") + 1)
    data = data.select("vec_id", "m", "cell", (F.col("spot") % in_block).cast("int").alias("block"))
    data = stored(data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else data.withColumn("part", F.lit(0)), "blocks")

    def first_bars(batches):
        """Each query's score that k candidates reach by the summaries: the k + 1 th, as it may be a candidate itself."""
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                some = batch.slice(a, CHUNK)
                q = _unpacked(some["m"], dim).astype("float64")
                length = np.sqrt((q**2).sum(1))
                low = (q @ pivots.T)[:, :, None] - length[:, None, None] * near[None]
                low = low.reshape(len(q), -1)
                bar = np.partition(low, low.shape[1] - k - 1, axis=1)[:, low.shape[1] - k - 1]
                bar = bar - 1 - SLACK * length * (norms + radius).max()
                bar = np.where(bar > -(2.0**62), np.floor(np.clip(bar, -(2.0**62), 2.0**62)), WORST).astype("int64")
                yield pa.RecordBatch.from_arrays([some["qn"], some["vec_id"], some["m"], some["cell"], pa.array(bar)], ["qn", "query_id", "m", "cell", "bar"])

    asks = stored(queries.mapInArrow(in_cells, grouped).withColumn("qn", F.monotonically_increasing_id()), "asks")
    state = stored(asks.mapInArrow(first_bars, "qn long, query_id long, m binary, cell int, bar long"), "bars")

    def visits(low: int, high: int):
        """The queries with the blocks that they visit as their low-th to high-th one."""

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, CHUNK * 4):
                    some = batch.slice(a, CHUNK * 4)
                    q = _unpacked(some["m"], dim).astype("float64")
                    length = np.sqrt((q**2).sum(1))[:, None]
                    bound = q @ pivots.T + length * radius + SLACK * length * (norms + radius) + 1
                    rank = bound.copy()
                    rank[np.arange(len(q)), some["cell"].to_numpy()] = np.inf
                    order = np.argsort(-rank, axis=1, kind="stable")
                    n = blocks[order]
                    start = np.cumsum(n, axis=1) - n
                    first, last = np.clip(low - start, 0, n), np.clip(high - start, 0, n)
                    i, t = np.nonzero((last > first) & (np.take_along_axis(bound, order, 1) >= some["bar"].to_numpy()[:, None]))
                    count = (last - first)[i, t]
                    row = np.repeat(i, count)
                    block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[i, t], count)
                    cell = np.repeat(order[i, t], count)
                    taken = some.select(["qn", "query_id", "m", "bar"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype("int32")), pa.array(block.astype("int32"))], ["qn", "query_id", "m", "bar", "cell", "block"])

        return run

    def met(asked: pa.Table, held: pa.Table) -> pa.Table:
        return _solve(asked, held, k, dim)

    keys = ["cell", "block", "part"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, int(blocks.sum()) * parts))
    found, low, high = None, 0, 1
    while low < blocks.sum():
        going = state.mapInArrow(visits(low, high), "qn long, query_id long, m binary, bar long, cell int, block int")
        going = going.withColumn("part", F.pmod(F.xxhash64("qn"), F.lit(parts)).cast("int")).repartition(tasks, *keys)
        new = going.groupBy(*keys).cogroup(data.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(met, "qn long, query_id long, vec_id long, score long")
        every = new if found is None else found.unionByName(new)
        place = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id"))
        found = stored(every.withColumn("place", place).where(F.col("place") <= k).drop("place"), "found")
        low, high = high, high * GROWTH
        if low < blocks.sum():
            reached = found.groupBy("qn").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).drop("n")
            state = state.join(reached, "qn", "left").withColumn("bar", F.greatest("bar", "kth")).drop("kth")
            state = stored(state, "bars")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
