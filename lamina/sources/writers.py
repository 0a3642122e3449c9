"""Sinks: JSON lines, flat CSV, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """One record a line, nulls too; by: a folder for each value, which a later run replaces alone, so that a run that broke off goes on with what is missing."""
    writer = df.write.option("ignoreNullFields", False).mode("overwrite")
    if by:
        writer = writer.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def flat_csv(df: DataFrame, path: str) -> None:
    """Arrays joined by semicolons, nulls as empty cells."""
    flat = lambda f: F.array_join(F.transform(f.name, lambda x: x.cast("string")), ";") if isinstance(f.dataType, ArrayType) else F.col(f.name).cast("string")
    df.select(*[F.coalesce(flat(f), F.lit("")).alias(f.name) for f in df.schema]).write.option("header", True).option("emptyValue", "").option("escape", '"').mode("overwrite").csv(path)


def report_json(report: DataFrame) -> str:
    """A report's rows (a few: aggregates) as indented JSON; more than 10,000 rows fail."""
    rows = [r[0] for r in report.select(F.to_json(F.struct("*"))).limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("a report has at most 10,000 rows")
    return json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False)


def report_markdown(report: DataFrame, title: str) -> str:
    """A report's rows as a Markdown table: n/a for nulls and NaN, four places for other numbers with a fraction."""
    rows = json.loads(report_json(report.select(*[F.col(c).cast("string").alias(c) if t == "boolean" else F.col(c) for c, t in report.dtypes])))
    show = lambda x: "n/a" if x is None or x == "NaN" else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns)]
    return "\n".join([*lines, *["| " + " | ".join(show(r.get(c)) for c in report.columns) + " |" for r in rows]]) + "\n"
