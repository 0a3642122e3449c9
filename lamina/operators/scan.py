"""State machines over ordered rows as an associative scan: no group, however long, is one task's."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.sources.scratch import stored

#: Rows of a group in a block, blocks (or blocks of blocks) that are composed by one task, and blocks of packed rows that are read at once.
BLOCK, FAN, WIDE = 4096, 1024, 16


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    """The condition that a's keys equal b's of the same names, which are called _name there; null equals null."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])


def _composed(steps: list[bytes], width: int) -> bytes:
    """One step that does what the steps do in turn. A step gives, for each state, the next one."""
    out = bytes(range(width))
    for step in steps:
        out = out.translate(step + bytes(256 - width))
    return out


def _last(table: pa.Table, columns: list[str]) -> dict[str, int | None]:
    """The last value of each column that isn't null."""
    return {c: (table[c].drop_null().to_pylist() or [None])[-1] for c in columns}


def _before(values: pa.ChunkedArray, entry: int | None, include: bool) -> pa.Array:
    """For each value the last one that isn't null before it (include: or itself), entry where there is none."""
    held = values.combine_chunks()
    at = np.where(held.is_valid().to_numpy(zero_copy_only=False), np.arange(len(held)), -1)
    at = np.maximum.accumulate(at)
    if not include:
        at = np.append(-1, at[:-1])
    found = held.take(pa.array(np.maximum(at, 0)))
    return pa.array([entry if i < 0 else x for i, x in zip(at.tolist(), found.to_pylist())], pa.int64())


def _ordered(part: pa.Table, name: str, down: bool = False) -> pa.Table:
    return part.sort_by([(name, "descending" if down else "ascending")])


def _maps_schema(key_types: str, carried: list[str]) -> str:
    return f"{key_types}, _block long, _step binary{''.join(f', {c} long' for c in carried)}"


def _summary(key: tuple[pa.Scalar, ...], part: pa.Table, by: list[str], step: bytes, last: dict[str, int | None]) -> pa.Table:
    """The row of a block: its key, the one step that all of its rows are, and the last values of what is carried."""
    held = [[k.as_py()] for k in key[:-1]] + [[key[-1].as_py()], [step]] + [[x] for x in last.values()]
    types = [part.schema.field(k).type for k in by] + [pa.int64(), pa.binary()] + [pa.int64()] * len(last)
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(held, types)], [*by, "_block", "_step", *last])


def _entries(maps: DataFrame, by: list[str], key_types: str, width: int, carried: list[str], start: int, fan: int) -> DataFrame:
    """by, _block, the state that each block is entered in (_entry) and what is carried into it. maps: the stored rows of all blocks, as _summary makes them."""
    keys, maps_schema = [*by, "_block"], _maps_schema(key_types, carried)

    def of_maps(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = _ordered(part, "_at")
        return _summary(key, part, by, _composed(part["_step"].to_pylist(), width), _last(part, carried))

    levels = [maps]
    low, high = levels[0].agg(F.min("_block"), F.max("_block")).first()
    span = 0 if low is None else max(abs(low), abs(high)) + 1
    while span > fan:
        upper = levels[-1].withColumn("_at", F.col("_block")).withColumn("_block", F.floor(F.col("_at") / F.lit(fan)).cast("long"))
        levels.append(stored(upper.groupBy(*keys).applyInArrow(of_maps, maps_schema), "maps"))
        span = span // fan + 1

    entry_schema = f"{key_types}, _block long, _entry int{''.join(f', {c} long' for c in carried)}"

    def entered(part: pa.Table, state: int, values: dict) -> pa.Table:
        part, states = _ordered(part, "_block"), []
        for step in part["_step"].to_pylist():
            states.append(state)
            state = step[state]
        columns = [part[k] for k in by] + [part["_block"], pa.array(states, pa.int32())] + [_before(part[c], values[c], False) for c in carried]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [*by, "_block", "_entry", *carried])

    def top(part: pa.Table) -> pa.Table:
        return entered(part, start, dict.fromkeys(carried))

    def inner(part: pa.Table) -> pa.Table:
        return entered(part, part["_entry"][0].as_py(), {c: part[f"_e{c}"][0].as_py() for c in carried})

    entries = levels[-1].groupBy(*by).applyInArrow(top, entry_schema) if by else levels[-1].groupBy(F.lit(0)).applyInArrow(top, entry_schema)
    for maps in reversed(levels[:-1]):
        above = entries.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_block").alias("__block"), "_entry", *[F.col(c).alias(f"_e{c}") for c in carried])
        maps = maps.withColumn("_up", F.floor(F.col("_block") / F.lit(fan)).cast("long"))
        joined = maps.join(above, _same(maps, above, by) & (maps["_up"] == above["__block"]))
        entries = joined.select(*keys, "_up", "_step", *carried, "_entry", *[f"_e{c}" for c in carried]).groupBy(*by, "_up").applyInArrow(inner, entry_schema)
    return entries


def states(rows: DataFrame, by: list[str], n: str, symbol: str, table: list[list[int]], carry: list[str] = [], start: int = 0, backward: bool = False, block: int = BLOCK, fan: int = FAN, derived: Derived | None = None) -> DataFrame:
    """rows with before and after, the state before and after each row of a machine that reads the rows of each group in the order of n.

    table[symbol][state] is the next state (at most 256 states), start the first one. For each column of carry
    (long) last_column is its last value so far that isn't null, the row's own included, and prior_column the same without the row's own. backward: from the largest n to the smallest.
    n (long, not null, not below 0) is unique in a group; where it has gaps, blocks hold fewer rows.
    Rows that packed made (of the same block) stay so, and come back as states_of_pieces has them, which derived is for.

    Each block of rows becomes a map from every state that it may be entered in to the one that it is left in; maps are
    composed, a tree of `fan` wide, which gives each block's true entry; then blocks are read again. A task holds one block, or `fan` maps.

    Defined cases: a null symbol changes nothing; a null group is a group; an empty table gives an empty result.
    """
    if isinstance(rows.schema[symbol].dataType, T.BinaryType):
        return states_of_pieces(rows, by, symbol, table, carry, start, backward, block, fan, derived)
    width = len(table[0])
    step_of = [bytes(row) for row in table]
    same = bytes(range(width))
    carried = [f"_c{i}" for i in range(len(carry))]
    place = -F.col(n) if backward else F.col(n)
    rows = rows.withColumn("_block", F.floor(place / F.lit(block)).cast("long"))
    keys = [*by, "_block"]
    key_types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)
    maps_schema = _maps_schema(key_types, carried)

    def of_rows(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = _ordered(part, "_n", backward)
        return _summary(key, part, by, _composed([same if s is None else step_of[s] for s in part["_s"].to_pylist()], width), _last(part, carried))

    short = rows.select(*keys, F.col(n).cast("long").alias("_n"), F.col(symbol).alias("_s"), *[F.col(c).cast("long").alias(a) for c, a in zip(carry, carried)])
    entries = _entries(stored(short.groupBy(*keys).applyInArrow(of_rows, maps_schema), "maps"), by, key_types, width, carried, start, fan)
    known = entries.select(*[F.col(k).alias(f"_{k}") for k in keys], "_entry", *[F.col(c).alias(f"_e{c}") for c in carried])
    joined = rows.join(known, _same(rows, known, keys)).select(*rows.columns, "_entry", *[f"_e{c}" for c in carried])
    kept = [c for c in rows.columns if c != "_block"]

    def replayed(part: pa.Table) -> pa.Table:
        part, found = _ordered(part, n, backward), []
        state = part["_entry"][0].as_py()
        for s in part[symbol].to_pylist():
            before = state
            state = state if s is None else table[s][state]
            found.append((before, state))
        columns = [part[c].combine_chunks() for c in kept] + [pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)]
        columns += [_before(part[c].cast(pa.int64()), part[f"_e{a}"][0].as_py(), own) for own in (True, False) for c, a in zip(carry, carried)]
        return pa.Table.from_arrays(columns, [*kept, "before", "after", *[f"{when}_{c}" for when in ("last", "prior") for c in carry]])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_block"]
    out_schema = ", ".join([*fields, "before int", "after int", *[f"{when}_{c} long" for when in ("last", "prior") for c in carry]])
    return joined.groupBy(*keys).applyInArrow(replayed, out_schema)


#: The types of numbers in pieces, by the letter that their bytes begin with. The least number stands for a missing one.
LETTERS = {"byte": b"b", "short": b"h", "int": b"i", "long": b"q"}


def _bytes(values: np.ndarray, kind: str) -> bytes:
    dtype = np.dtype(LETTERS[kind].decode())
    missing = np.ma.getmaskarray(values)
    held = np.ma.getdata(values).astype(dtype)
    return LETTERS[kind] + (np.where(missing, np.iinfo(dtype).min, held) if missing.any() else held).astype(dtype).tobytes()


def _text_bytes(texts: pa.Array) -> bytes:
    """How many bytes there are, and, compressed, how long each text is and the texts themselves."""
    _, starts, data = texts.buffers()
    begins = np.frombuffer(starts, np.int32, len(texts) + 1, 4 * texts.offset)
    held = np.diff(begins).tobytes() + (data.slice(int(begins[0]), int(begins[-1] - begins[0])).to_pybytes() if data else b"")
    return len(held).to_bytes(8, "little") + pa.compress(held, "zstd", asbytes=True)


def packed(rows: DataFrame, by: list[str], n: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """rows in pieces: by, n (the first row's), upto (the last row's), at (how far behind the one before each row is) and each column, as bytes that Pieces reads.

    A piece has rows of one group and block, in the order of n, that come to Python together, so that nothing is shuffled: rows that lie in order make pieces of about
    a block, others more and shorter ones. A piece is named by by and n, as n (long, not null) is unique in a group. Up to 10,000 rows are held at a time.
    Columns are strings (not null) or whole numbers.
    """
    rows = rows.select(*by, F.col(n).cast("long").alias("n"), *columns)
    kinds = {c: {T.StringType(): "text", T.ByteType(): "byte", T.ShortType(): "short", T.IntegerType(): "int", T.LongType(): "long"}[rows.schema[c].dataType] for c in columns}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            group = np.zeros(batch.num_rows, np.int64)
            for k in by:
                code = batch[k].dictionary_encode("encode").indices.to_numpy()
                group = group * (int(code.max()) + 1) + code
            places = batch["n"].to_numpy()
            turn = np.diff(group)
            if ((turn < 0) | ((turn == 0) & (np.diff(places) < 0))).any():
                order = np.lexsort((places, group))
                batch, group, places = batch.take(pa.array(order)), group[order], places[order]
            first = np.append(0, np.flatnonzero((np.diff(group) != 0) | (np.diff(places // block) != 0)) + 1)
            ends = np.append(first[1:], len(places))
            cuts = list(zip(first.tolist(), ends.tolist()))
            arrays = [batch[k].take(pa.array(first)) for k in by] + [pa.array(places[first]), pa.array(places[ends - 1])]
            arrays.append(pa.array([_bytes(np.diff(places[i:j], prepend=places[i]), "short" if block < 1 << 15 else "int") for i, j in cuts], pa.binary()))
            for c, kind in kinds.items():
                values = batch[c] if kind == "text" else _masked(batch[c])
                arrays.append(pa.array([_text_bytes(values[i:j]) if kind == "text" else _bytes(values[i:j], kind) for i, j in cuts], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, [*by, "n", "upto", "at", *columns])

    types = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by] + ["n long, upto long, at binary"] + [f"`{c}` binary" for c in columns])
    return rows.mapInArrow(pieces, types)


def dealt(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """pieces by keys in as many parts as the session has: they are few bytes for the work that they are, so that parts should not be merged by size."""
    return pieces.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _masked(values: pa.Array) -> np.ma.MaskedArray:
    return np.ma.masked_array((values.fill_null(0) if values.null_count else values).to_numpy(), values.is_null().to_numpy(zero_copy_only=False))


class Pieces:
    """The rows of some pieces as columns, one value for each row; missing numbers are masked."""

    def __init__(self, part: pa.Table):
        self.part = part
        at = [np.cumsum(self._numbers(x), dtype=np.int64) for x in part["at"]]
        self.offsets = np.append(0, np.cumsum([len(x) for x in at]))
        self.places = np.repeat(part["n"].to_numpy(), np.diff(self.offsets)) + np.concatenate(at)

    @staticmethod
    def _numbers(value: pa.Scalar) -> np.ndarray:
        held = value.as_buffer()
        return np.frombuffer(held.slice(1), held.slice(0, 1).to_pybytes().decode())

    def values(self, name: str) -> np.ma.MaskedArray:
        held = np.concatenate([self._numbers(x) for x in self.part[name]])
        return np.ma.masked_array(held, held == np.iinfo(held.dtype).min)

    def texts(self, name: str) -> pa.Array:
        found = []
        for value, size in zip(self.part[name], np.diff(self.offsets).tolist()):
            held = value.as_buffer()
            held = pa.decompress(held.slice(8), int.from_bytes(held.slice(0, 8).to_pybytes(), "little"), "zstd")
            begins = np.append(0, np.cumsum(np.frombuffer(held, np.int32, size))).astype(np.int32)
            found.append(pa.StringArray.from_buffers(size, pa.py_buffer(begins), held.slice(4 * size)))
        return pa.concat_arrays(found)

    def table(self, kept: Iterable[str], new: dict[str, np.ndarray], kinds: dict[str, str]) -> pa.Table:
        """The pieces' columns kept, and new ones."""
        cuts = list(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()))
        made = [pa.array([_bytes(x[i:j], kinds[c]) for i, j in cuts], pa.binary()) for c, x in new.items()]
        return pa.Table.from_arrays([*[self.part[c].combine_chunks() for c in kept], *made], [*kept, *new])


#: What a step of Python gives of each row of pieces: names with their types, and the function from columns of all rows to them.
Derived = tuple[dict[str, str], Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]]


def _carried(values: np.ma.MaskedArray, entry: int | None, include: bool) -> np.ma.MaskedArray:
    """For each value the last one that isn't missing before it (include: or itself), entry where there is none."""
    at = np.maximum.accumulate(np.where(np.ma.getmaskarray(values), -1, np.arange(len(values))))
    if not include:
        at = np.append(-1, at[:-1])
    return np.ma.masked_array(np.where(at < 0, entry or 0, values.data[np.maximum(at, 0)]), (at < 0) & (entry is None))


def states_of_pieces(rows: DataFrame, by: list[str], symbol: str, table: list[list[int]], carry: list[str] = [], start: int = 0, backward: bool = False, block: int = BLOCK, fan: int = FAN, derived: Derived | None = None) -> DataFrame:
    """What states does, of rows in pieces (see packed): by, n, upto and at, and the other columns, before, after, last_column and prior_column.

    derived: of these, which are given to its function as columns of all rows (n: each row's own, follows: whether no row of another piece
    stands between it and the one before it in its piece), only what it makes of them comes back.
    """
    width = len(table[0])
    steps = [bytes(row) for row in table] + [bytes(range(width))]
    padded = [step + bytes(256 - width) for step in steps]
    carried = [f"_c{i}" for i in range(len(carry))]
    own = F.floor(F.col("n") / F.lit(block * WIDE)).cast("long")
    rows = rows.withColumn("_block", -own if backward else own)
    keys = [*by, "_block"]
    key_types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)

    def read(part: pa.Table, symbol: str) -> tuple[Pieces, np.ndarray, list[int]]:
        """The rows, their order and their symbols in it."""
        pieces = Pieces(part)
        order = np.argsort(pieces.places, kind="stable")[:: -1 if backward else 1]
        return pieces, order, pieces.values(symbol).astype(np.int64).filled(len(table))[order].tolist() if width > 1 else []

    def of_rows(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        pieces, order, symbols = read(part, "_s")
        step = bytes(range(width))
        for s in symbols:
            step = step.translate(padded[s])
        last = {c: x[-1:].tolist()[0] if len(x := pieces.values(c)[order].compressed()) else None for c in carried}
        return _summary(key, part, by, step, last)

    short = rows.select(*keys, "n", "at", F.col(symbol).alias("_s"), *[F.col(c).alias(a) for c, a in zip(carry, carried)])
    maps = stored(dealt(short, keys).groupBy(*keys).applyInArrow(of_rows, _maps_schema(key_types, carried)), "maps")
    entries = _entries(maps, by, key_types, width, carried, start, fan)
    others = [c for c in rows.columns if c not in (*keys, "n", "upto", "at")]
    when = [("last", True), ("prior", False)]
    given, make = derived or ({"before": "int", "after": "int"} | {f"{name}_{c}": "long" for name, _ in when for c in carry}, None)
    kept = [*by, "n", "upto", "at", *([] if make else others)]

    def replayed(part: pa.Table, known: pa.Table) -> pa.Table:
        pieces, order, symbols = read(part, symbol)
        state = entry = known["_entry"][0].as_py()
        found = []
        for s in symbols:
            state = steps[s][state]
            found.append(state)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        after = np.array(found, np.int32) if width > 1 else np.zeros(len(order), np.int32)
        new = {"before": np.append(np.int32(entry), after[:-1])[back], "after": after[back]}
        for c, a in zip(carry, carried):
            values = pieces.values(c)[order]
            new |= {f"{name}_{c}": _carried(values, known[a][0].as_py(), include)[back] for name, include in when}
        if make:
            follows = np.append(False, np.abs(np.diff(back)) == 1)
            new = make({c: pieces.values(c) for c in others} | {"n": pieces.places, "follows": follows} | new)
        return pieces.table(kept, {c: new[c] for c in given}, given)

    out = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} binary" for c in given]
    return dealt(rows, keys).groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(replayed, ", ".join(out))
