"""Blocks of HTML pages by built-in expressions, so that whole pages never leave the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities and their characters; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def plain(html: Column) -> Column:
    """Text of a fragment: tags go, entities are resolved, white space is collapsed."""
    text = F.regexp_replace(html, r"<[^>]*>", " ")
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)
    return F.trim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))


def visible(html: Column) -> Column:
    """A page without comments, scripts, styles, navigation and footer."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>", "")


def first_of(html: Column, tag: str) -> Column:
    """Text of the first element of a tag; empty without one."""
    return plain(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def paragraphs(html: Column) -> Column:
    """Texts of a page's paragraphs, which their tags begin whether or not they are closed; none that are empty."""
    parts = F.split(visible(html), r"(?i)<p(?:\s[^>]*)?>")
    return F.filter(F.transform(F.slice(parts, 2, 1 << 30), lambda x: plain(x)), lambda x: x != "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))
