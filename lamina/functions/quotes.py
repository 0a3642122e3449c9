"""Expressions on quotes: where they come from, how much they cover, texts without the quote that closes them, excerpts, likeness."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lamina.functions.lines import folded, nfc
from lamina.functions.text import tokens

# What stands for text that is left out, and the words before a closing quote.
OMITTED = "[omitted: narrative budget exhausted]"
CUT = " [... narrative truncated ...]"
RESUMED = "[... narrative truncated; excerpt resumes near the passage that matched this question ...] "
ANNOUNCED = r"pronounc\w*\s+the\s+following\s+(?:verse|stanza)s?\s*:?"


def quote_match(quote: Column, sources: dict[str, Column]) -> Column:
    """tier (exact, variant or null), field and source of a quote: the first text that holds it as it is, else the first that holds it once both are folded.

    An exact place in a later text goes before a folded one in an earlier. Null and empty sources hold nothing; a null
    quote is nowhere.
    """

    def found(tier: str, name: str, text: Column, holds: Column) -> Column:
        place = F.struct(F.lit(tier).alias("tier"), F.lit(name).alias("field"), text.alias("source"))
        return F.when((text != "") & holds, place)

    exact = [found("exact", n, t, F.contains(nfc(t), nfc(quote))) for n, t in sources.items()]
    variant = [found("variant", n, t, F.contains(folded(t), folded(quote))) for n, t in sources.items()]
    return F.coalesce(*exact, *variant)


def coverage(quote: Column, source: Column) -> Column:
    """Length of the folded quote by that of the folded source; null if nothing of the source is left."""
    return F.try_divide(F.length(folded(quote)), F.length(folded(source)))


def without_closing_quote(text: Column, own: Column, most: int = 110) -> Column:
    """Text before its last announcement of verses, if what follows quotes the last of the text's own verses.

    own: the text's numbers, an array. What follows must name at least one of them, those it names must be the highest
    ones, and it may hold at most so many words a verse; otherwise the text stays whole.
    """
    pattern = f"(?is)^(.*){ANNOUNCED}(.*)$"
    after = F.regexp_extract(text, pattern, 2)
    named = F.transform(F.regexp_extract_all(after, F.lit(r"(?<![\d.])(\d{1,3})\.\s"), F.lit(1)), lambda n: n.cast("long"))
    own = F.array_distinct(own.cast("array<long>"))
    quoted = F.array_intersect(named, own)
    rest = F.array_except(own, quoted)
    last = (F.size(rest) == 0) | (F.array_max(rest) < F.array_min(quoted))
    short = F.size(tokens(after)) <= F.size(quoted) * most
    goes = text.rlike(pattern) & (F.size(quoted) > 0) & last & short
    return F.when(goes, F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\s+$", "")).otherwise(text)


def window_offset(text: Column, window: Column, step: int) -> Column:
    """Characters before the first word of a window (from 0) of a text whose windows start every step words; past the text, its last character."""
    words = F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0))
    first = (window * step).cast("int")
    lead = F.length(F.regexp_extract(text, r"^\s*", 0))
    there = lead + F.length(F.array_join(F.slice(words, F.lit(1), first), ""))
    return F.when(window <= 0, F.lit(0)).when(first < F.size(words), there).otherwise(F.greatest(F.lit(0), F.length(text) - 1))


def excerpt(text: Column, budget: Column, at: Column) -> Column:
    """At most budget characters of a text around a place: a quarter of them before it, with marks where text is left out."""
    start = F.greatest(F.lit(0), at - F.floor(budget / 4).cast("int"))
    end = F.least(F.length(text), start + budget)
    middle = F.regexp_replace(F.substring(text, start + 1, end - start), r"^\s+|\s+$", "")
    before, after = F.when(start > 0, RESUMED).otherwise(""), F.when(end < F.length(text), CUT).otherwise("")
    return F.when(budget <= 0, OMITTED).when(F.length(text) <= budget, text).otherwise(F.concat(before, middle, after))


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters of matching blocks by all characters (Ratcliff and Obershelp), four places; built-in functions only have other measures."""
    return pd.Series([None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a, b)], dtype="float64")
