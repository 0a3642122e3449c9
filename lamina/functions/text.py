"""Text expressions: all built-in, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in comparisons of texts.
STOP_WORDS = (
    "the a an is are was were be been of in to and or that this with as for by on at "
    "it its one who not but from his her their"
).split()


def tokens(text: Column) -> Column:
    """Words between white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def windows(text: Column, width: int, overlap: int) -> Column:
    """Overlapping word windows: a text of at most width words as it is, else words joined by single spaces; the last window ends with the text."""
    if not 0 <= overlap < width:
        raise ValueError("overlap must be smaller than width")
    step = width - overlap

    def cut(words: Column) -> Column:
        last = F.ceil((F.size(words) - width) / F.lit(step)).cast("int")
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, width), " "))
        return F.when(F.size(words) <= width, F.array(text)).otherwise(many)

    # as the variable of a lambda, the words are split off once for a text, not once for each window
    return F.transform(F.array(tokens(text)), cut)[0]


def plain(text: Column) -> Column:
    """Lower-case letters, digits and underscores, all else as spaces."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")


def is_content(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(STOP_WORDS)


def content_words(text: Column) -> Column:
    """Distinct lower-case words of over two characters that aren't stop words."""
    return F.array_distinct(F.filter(F.split(plain(text), r"\s+"), is_content))


def containment(claim: Column, source: Column, least: int = 6) -> Column:
    """Share of the claim's content words that the source has; 0 for claims of fewer than least words and for empty sources. Both: arrays of content_words."""
    return F.when((F.size(claim) >= least) & (F.size(source) > 0), F.size(F.array_intersect(claim, source)) / F.size(claim)).otherwise(0.0)


def group_id(raw: Column) -> Column:
    """The chapter.story form of an identifier (1 to 26, 1 to 999) without brackets and known prefixes, or null."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(raw, r"^[\s\[\(]+|[\s\]\)]+$", "")), r"(?i)^(?:[\s_-]*(?:story|group|grp|dhp|g|#))+[\s_-]*", "")
    return F.when(bare.rlike(r"^(?:[1-9]|1[0-9]|2[0-6])\.[1-9][0-9]{0,2}$"), bare)


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r ]+", " "))
