"""Gates of a build: checks of every row in one pass that name what they find, coverage of keys, and a write that a hard gate stops."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lamina.operators.nested import CONTROLS

_FOUND = "array<struct<path: string, problem: string>>"


@dataclass(frozen=True)
class Gate:
    """A check of a row. found: an array of (path, problem), empty where the row passes. Hard gates fail a build, others warn and record."""

    name: str
    hard: bool
    found: Column


class GateFailure(Exception):
    """A hard gate found something. counts: findings by gate; sample: some of the rows, as (key, path, problem)."""

    def __init__(self, counts: dict[str, int], broken: list[str], sample: list[tuple]):
        super().__init__(f"hard gates failed: {', '.join(f'{g} ({counts[g]})' for g in broken)}; first: {sample}")
        self.counts, self.broken, self.sample = counts, broken, sample


def _finding(path: Column, problem: Column) -> Column:
    return F.struct(path.alias("path"), problem.alias("problem"))


def _none() -> Column:
    return F.array().cast(_FOUND)


def differs(path: str, recorded: Column, expected: Column) -> Column:
    """A recorded value that isn't the expected one; a missing one differs from any other."""
    show = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    said = F.concat(F.lit(f"{path}="), show(recorded), F.lit(", expected "), show(expected))
    return F.when(recorded.eqNullSafe(expected), _none()).otherwise(F.array(_finding(F.lit(path), said)))


def not_owned(fields: Column, owners: dict[str, str]) -> Column:
    """Fields (a map of name to a struct with source) from another source than their owner, or that no source owns."""
    owner = F.create_map(*[F.lit(x) for pair in owners.items() for x in pair])

    def judge(e: Column) -> Column:
        should, source = F.try_element_at(owner, e["key"]), e["value"]["source"]
        wrong = F.concat(F.lit("source="), F.coalesce(source, F.lit("null")), F.lit(", expected "), should)
        return F.when(should.isNull(), "not in the ownership table").when(~source.eqNullSafe(should), wrong)

    found = F.transform(F.map_entries(fields), lambda e: _finding(e["key"], judge(e)))
    return F.coalesce(F.filter(found, lambda x: x["problem"].isNotNull()), _none())


@F.pandas_udf(ArrayType(StringType()))
def _not_composed(names: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else [n for n, v in zip(a, b) if not unicodedata.is_normalized("NFC", v)] for a, b in zip(names, values)], dtype=object)


def codes(text: Column, pattern: str) -> Column:
    """The distinct characters of a text that match a class, as U+.... in ascending order, joined by spaces."""
    # code points in UTF-32 sort as numbers, and are hex digits once their leading zeros go
    of = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))), lambda c: F.hex(F.encode(c, "UTF-32")))
    return F.array_join(F.transform(F.array_sort(of), lambda h: F.concat(F.lit("U+"), F.regexp_replace(h, "^0{1,4}", ""))), " ")


def _outside(entries: Column, name: str, pattern: str) -> Column:
    mine = F.filter(entries, lambda e: (e["key"] == name) & e["value"]["value"].rlike(pattern))
    return F.transform(mine, lambda e: _finding(e["key"], F.concat(F.lit("charset "), codes(e["value"]["value"], pattern))))


def badly_encoded(fields: Column, charsets: dict[str, str]) -> Column:
    """Values (fields: a map of name to a struct with value) that aren't composed, hold control characters, or characters of the class that charsets names for a field.

    Only values with a character from U+0300 on are looked at in Python: all others are composed by definition.
    """
    entries = F.filter(F.map_entries(fields), lambda e: e["value"]["value"].isNotNull())
    odd = F.filter(entries, lambda e: e["value"]["value"].rlike(r"[^\x00-\x{2FF}]"))
    raw = _not_composed(F.transform(odd, lambda e: e["key"]), F.transform(odd, lambda e: e["value"]["value"]))
    plain = F.transform(raw, lambda n: _finding(n, F.lit("not composed")))
    ruled = F.filter(entries, lambda e: e["value"]["value"].rlike(CONTROLS))
    controls = F.transform(ruled, lambda e: _finding(e["key"], F.concat(F.lit("control "), codes(e["value"]["value"], CONTROLS))))
    return F.coalesce(F.concat(plain, controls, *[_outside(entries, name, pattern) for name, pattern in charsets.items()]), _none())


def odd_segments(path: str, text: Column, split: str, vowels: str, least: int, most: int) -> Column:
    """Segments of a text, numbered from 0 among those that aren't blank, with fewer or more vowels (of the characters given) than a line of verse has."""
    parts = F.filter(F.split(text, split), lambda s: s.rlike(r"\S"))
    counted = F.transform(parts, lambda s, i: F.struct(i.alias("i"), (F.length(s) - F.length(F.translate(s, vowels, ""))).alias("n")))
    odd = F.filter(counted, lambda x: (x["n"] < least) | (x["n"] > most))
    return F.coalesce(F.transform(odd, lambda x: _finding(F.concat(F.lit(f"{path}["), x["i"].cast("string"), F.lit("]")), F.concat(x["n"].cast("string"), F.lit(" vowels")))), _none())


def title_absent(path: str, title: Column, body: Column, least: int = 5) -> Column:
    """A title with words of least letters or more, of which the body has none."""
    words = F.filter(F.split(F.regexp_replace(F.lower(title), r"[^\p{L}\s]", " "), r"\s+"), lambda w: F.length(w) >= least)
    # as the variable of a lambda, the body is folded once, not once for each word
    absent = (F.size(words) > 0) & ~F.transform(F.array(F.lower(body)), lambda b: F.exists(words, lambda w: F.contains(b, w)))[0]
    return F.when(absent, F.array(_finding(F.lit(path), F.array_join(words, " ")))).otherwise(_none())


def checked(rows: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """rows with findings: an array of (gate, hard, path, problem). One projection: however many gates there are, rows are read once and not shuffled."""
    return rows.withColumn("findings", F.concat(*[_named(g) for g in gates]))


def _named(gate: Gate) -> Column:
    return F.transform(gate.found, lambda x: F.struct(F.lit(gate.name).alias("gate"), F.lit(gate.hard).alias("hard"), x["path"].alias("path"), x["problem"].alias("problem")))


def violations(rows: DataFrame, key: str, gates: Sequence[Gate]) -> DataFrame:
    """key, gate, hard, path and problem of all that the gates find."""
    return checked(rows, gates).select(key, F.explode("findings").alias("x")).select(key, "x.*")


def report(rows: DataFrame, key: str, gates: Sequence[Gate]) -> DataFrame:
    """gate, hard, n_rows, violations, first (the smallest key with one), passed, build_ok: one row for each gate, from one pass and one partial aggregate.

    Defined cases: an empty table passes all gates; a gate that warns passes whatever it finds.
    """
    sizes = rows.select(F.col(key).alias("_key"), *[F.size(g.found).alias(f"_n{i}") for i, g in enumerate(gates)])
    wide = sizes.agg(
        F.count("*").alias("n_rows"), *[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_s{i}") for i in range(len(gates))],
        *[F.min(F.when(F.col(f"_n{i}") > 0, F.col("_key"))).alias(f"_f{i}") for i in range(len(gates))],
    )
    ok = sum((F.col(f"_s{i}") for i, g in enumerate(gates) if g.hard), F.lit(0)) == 0
    lines = [F.struct(F.lit(g.name).alias("gate"), F.lit(g.hard).alias("hard"), F.col(f"_s{i}").alias("violations"), F.col(f"_f{i}").alias("first")) for i, g in enumerate(gates)]
    flat = wide.select("n_rows", ok.alias("build_ok"), F.explode(F.array(*lines)).alias("g"))
    return flat.select("g.gate", "g.hard", "n_rows", "g.violations", "g.first", (~F.col("g.hard") | (F.col("g.violations") == 0)).alias("passed"), "build_ok")


def closure(covered: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, state and n (times covered) of keys that aren't covered once: missing, repeated, or unknown (not expected). Null keys don't count.

    Both sides are added up together, so that a key with a third of all rows is a partial count in each task, and nothing is joined. Missing and unknown
    keys break a build; repeated ones are listed only.
    """
    both = covered.select(F.col(key).alias("key"), F.lit(1).alias("c"), F.lit(0).alias("e")).unionByName(expected.select(F.col(key).alias("key"), F.lit(0).alias("c"), F.lit(1).alias("e")))
    counts = both.where("key is not null").groupBy("key").agg(F.sum("c").alias("n"), F.max("e").alias("e"))
    state = F.when(F.col("e") == 0, "unknown").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "repeated")
    return counts.select("key", state.alias("state"), "n").where("state is not null")


def publish(rows: DataFrame, key: str, gates: Sequence[Gate], path: str, sample: int = 10) -> dict[str, int]:
    """Write rows with their findings to path as Parquet, unless a hard gate finds something; the number of findings of each gate.

    One pass: counts are observed while the rows are written beside path, and the folder is renamed once they are known. If a hard gate failed,
    the sample is read from the written findings, the folder is removed and GateFailure raised, so that path never holds rows that didn't pass.
    """
    spark, staged = rows.sparkSession, f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    files = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(jpath(path)):
        raise FileExistsError(path)
    seen = Observation()
    of = lambda name: F.size(F.filter("findings", lambda x: x["gate"] == name))
    counts = [F.coalesce(F.sum(of(g.name)), F.lit(0)).alias(g.name) for g in gates]
    try:
        checked(rows, gates).observe(seen, F.count("*").alias("_rows"), *counts).write.parquet(staged)
        found = {g.name: seen.get[g.name] for g in gates}
        broken = [g.name for g in gates if g.hard and found[g.name]]
        if broken:
            hard = spark.read.parquet(staged).select(F.col(key).alias("key"), F.explode(F.filter("findings", lambda x: x["hard"])).alias("x"))
            raise GateFailure(found, broken, [tuple(r) for r in hard.select("key", "x.path", "x.problem").orderBy("key", "path").limit(sample).collect()])
        if not files.rename(jpath(staged), jpath(path)):
            raise OSError(f"could not rename {staged}")
    finally:
        files.delete(jpath(staged), True)
    return found
