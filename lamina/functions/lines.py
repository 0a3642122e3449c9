"""Expressions on lines, headers, sections and spellings."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def truncated(text: Column, markers: list[str]) -> Column:
    """Text before the first of the markers, without white space at its end."""
    head = reduce(lambda t, m: F.substring_index(t, m, 1), markers, text)
    return F.regexp_replace(head, r"\s+$", "")


def without_noise(lines: Column, footer: str) -> Column:
    """Lines that are neither blank, nor a page number, nor like the footer's pattern."""
    return F.filter(lines, lambda x: ~x.rlike(r"^\s*[0-9]*\s*$") & ~x.rlike(footer))


def joined_lines(text: Column) -> Column:
    """Lines joined by single spaces, or by nothing after a hyphen within a word."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"([^\s])-\n[\n ]*", "$1-"), r"[ ]*\n[\n ]*", " "))


def without_controls(text: Column) -> Column:
    """Text without control characters but tabs and line feeds."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f]", "")


@F.udf(StringType(), useArrow=False)
def nfc(text: str | None) -> str | None:
    """The composed form, which no built-in function gives. Rows are sent a hundred at a time, so that long texts don't add up in a worker."""
    return None if text is None else unicodedata.normalize("NFC", text)


@F.pandas_udf(StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Letters without their marks, other characters beyond ASCII left out, in lower case; the compatible form has no built-in function."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower())


def folded(text: Column) -> Column:
    """Composed, lower case, with one sign for the nasal and without spaces, hyphens, apostrophes and marks."""
    return F.regexp_replace(F.translate(F.lower(nfc(text)), "ṃṅ", "ṁṁ"), r"""[\s.,;:!?"“”’'-]""", "")


def pair_class(a: Column, b: Column) -> Column:
    """exact, boundary (one is the other's beginning or end after folding) or distinct."""
    x, y = folded(a), folded(b)
    ends = F.startswith(x, y) | F.endswith(x, y) | F.startswith(y, x) | F.endswith(y, x)
    return F.when(a == b, "exact").when(ends, "boundary").otherwise("distinct")


def header_range(text: Column) -> Column:
    """The numbers of a header Dhp a or Dhp a-b, with a hyphen, an en or an em dash; null without one."""
    pattern = r"Dhp\s+(\d+)(?:\s*[-–—]\s*(\d+))?"
    a, b = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    first = F.when(a != "", a).cast("long")
    return F.sequence(first, F.coalesce(F.when(b != "", b).cast("long"), first))


def line_language(line: Column, stop_words: list[str], marked: str) -> Column:
    """english, marked or unknown, by how many words are stop words or have marked characters."""
    words = F.split(F.lower(line), r"\s+")
    e, m = F.size(F.filter(words, lambda w: w.isin(stop_words))), F.size(F.filter(words, lambda w: w.rlike(marked)))
    return F.when((e == 0) & (m == 0), "unknown").when(e >= m, "english").otherwise("marked")


def sections(text: Column) -> list[Column]:
    """opening (the first sentence, if it ends within 600 characters) and closing (after the last line feed); empty if there is none."""
    return [F.regexp_extract(text, r"(?s)^(.{0,600}?[.!?])\s", 1).alias("opening"), F.regexp_extract(text, r"(?s)^.*\n(.+)$", 1).alias("closing")]


def corrected(text: Column, typos: dict[str, str]) -> list[Column]:
    """text with whole words replaced, and n, the number of replacements. Letters of any script are parts of words."""
    new = reduce(lambda t, x: F.regexp_replace(t, rf"(?U)\b{x[0]}\b", x[1]), typos.items(), text)
    n = reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(rf"(?U)\b{x}\b")) for x in typos])
    return [new.alias("text"), n.cast("long").alias("n")]


def within_budget(rows: DataFrame, by: str, order: str, budget: int, marker: str = " [...]") -> DataFrame:
    """Rows of each group in order until their texts have budget characters; the one that passes it is cut and marked, later ones go."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    rows = rows.withColumn("_left", left).where((F.col("_left") > 0) | (F.length("text") <= F.col("_left")))
    cut = F.when(F.length("text") <= F.col("_left"), F.col("text")).otherwise(F.concat(F.expr("substring(text, 1, cast(_left as int))"), F.lit(marker)))
    return rows.withColumn("text", cut).drop("_left").where("text is not null")


def number_range(numbers: Column) -> Column:
    """Sorted numbers as a-b where they follow one another, else as a list."""
    last = F.element_at(numbers, -1)
    follow = (F.size(numbers) > 1) & (last - numbers[0] + 1 == F.size(numbers))
    text = F.transform(numbers, lambda x: x.cast("string"))
    return F.when(follow, F.concat_ws("-", numbers[0].cast("string"), last.cast("string"))).otherwise(F.array_join(text, ", "))


# What may stand before and after a footnote's number in running text, and page numbers of editions in brackets.
BEFORE_MARK, AFTER_MARK = r"(?<=[\p{L}.,;:!?’”)\]–—])(?<![0-9][.,])", r"(?=[\s.,;:!?’”)\]]|$)"
PAGE_CRUMB = r" ?(?:\{[0-9]+\.[0-9]+\}|\[[0-9]+(?:\.[0-9]+)?\])"


def without_marks(text: Column, marks: Column) -> Column:
    """Text without the footnote numbers among marks (an array of digits) that stand after a letter or a sign, but for the ends of grouped numbers (80,000). Without marks the text stays."""
    pattern = F.concat(F.lit(f"{BEFORE_MARK}(?:"), F.array_join(marks, "|"), F.lit(f"){AFTER_MARK}"))
    return F.when(F.size(marks) > 0, F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)


def body(text: Column, marks: Column) -> Column:
    """Lines that aren't blank, their indents kept and other runs of spaces made one, without form feeds, page crumbs and footnote numbers."""
    bare = without_marks(F.regexp_replace(F.replace(text, F.lit("\f"), F.lit("")), PAGE_CRUMB, ""), marks)
    held = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    tidy = F.transform(held, lambda x: F.concat(F.regexp_extract(x, "^( *)", 1), F.regexp_replace(F.regexp_replace(x, "^ +", ""), " {2,}", " ")))
    return F.array_join(tidy, "\n")
