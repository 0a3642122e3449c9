"""Questions by conditions: every cell a row with a state, added to a table by what it lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(questions: DataFrame, contexts: dict[str, Column]) -> DataFrame:
    """A row for each question and condition: the columns of questions, condition, context."""
    each = [F.struct(F.lit(name).alias("condition"), c.cast("string").alias("context")) for name, c in contexts.items()]
    return questions.select("*", F.explode(F.array(*each)).alias("_cell")).select(*questions.columns, "_cell.condition", "_cell.context")


def state(found: Column, answer: Column) -> Column:
    """no_results where nothing was found (0; null: nothing was looked for), failed where there is no answer, else ok. Failures are rows, so that one ends no run."""
    return F.when(F.coalesce(found == 0, F.lit(False)), "no_results").when(answer.isNull(), "failed").otherwise("ok")


def resumed(rows: DataFrame, path: str, keys: list[str], answer: Callable[[DataFrame], DataFrame], conditions: list[str]) -> DataFrame:
    """The table at path, after the cells that it lacks have been answered and added, a condition at a time.

    rows: cells with keys (never null, condition among them), of which no two are equal; answer: what is added for them, with the same keys. What a run has
    written before it ends early, whole conditions, is there for the next, which answers the rest alone.
    """
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    for name in conditions:
        todo = rows.where(F.col("condition") == name)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            todo = todo.join(spark.read.parquet(path).where(F.col("condition") == name).select(*keys), keys, "left_anti")
        answer(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def within_budget(text: Column, budget: int, by: str, order: str) -> Column:
    """The text's beginning that the texts before it, of the same by, leave room for in a budget of characters."""
    before = F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return F.substring(text, F.lit(1), F.greatest(F.lit(0), F.lit(budget) - F.coalesce(before, F.lit(0))).cast("int"))
