"""Interlinear pages: records of bold lines and what follows them, closed by a number in brackets. Built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.operators.pages import ENTITIES

# The classes of a record's block, of a note (a span, its text in a span within it) and of a record's number.
BLOCKS = r'(?is)<div\b[^>]*\bclass="verse[^"]*"[^>]*>(.*?)</div>'
PARAGRAPHS = r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|$)"
NOTE_SPAN = r'(?i)^<span\b[^>]*\bclass="(?:[^"]* )?TT(?: [^"]*)?"'
NUMBER_SPAN = r'(?i)^<span\b[^>]*\bclass="(?:[^"]* )?number(?: [^"]*)?"'
NUMBER = r"\[(\d+)\]"


def cleaned(text: Column) -> Column:
    """Entities resolved, white space collapsed."""
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def paragraph(html: Column) -> Column:
    """bold, plain, number (null without one), notes and has_bold of a paragraph.

    A fold over its tags and texts, with a counter for each kind of open element: what is in a note goes to the notes (of its inner span,
    if it has one), what is in the first number to the number, what is in the first bold element to bold, and all else but notes and number is text.
    """
    start = F.struct(
        *[F.lit(0).alias(c) for c in ("note", "inner", "number", "bold")], F.lit(False).alias("has_bold"), F.lit(False).alias("has_number"),
        *[F.lit("").alias(c) for c in ("text", "bold_text", "note_text", "inner_text", "number_text")], F.array().cast("array<string>").alias("notes"),
    )

    def step(acc: Column, token: Column) -> Column:
        tag = F.startswith(token, F.lit("<"))
        opens, closes = token.rlike(r"(?i)^<span\b"), token.rlike(r"(?i)^</span\b")
        in_note, in_number = acc["note"] > 0, acc["number"] > 0
        free = ~in_note & ~in_number
        begins_note, begins_number = free & token.rlike(NOTE_SPAN), free & ~acc["has_number"] & token.rlike(NUMBER_SPAN)
        depth = lambda inside, begins, c: F.when(inside & opens, acc[c] + 1).when(inside & closes, acc[c] - 1).when(begins, 1).otherwise(acc[c])
        note = depth(in_note, begins_note, "note")
        ends_note = in_note & (note == 0)
        # the inner span: 0 not yet, 1 in it, 2 behind it
        inner = F.when(begins_note, 0).when(in_note & opens & (acc["inner"] == 0), 1).when(in_note & closes & (acc["inner"] == 1) & (note == 1), 2).otherwise(acc["inner"])
        bold_tag = free & token.rlike(r"(?i)^<b(?:\s[^>]*)?>")
        bold = F.when(bold_tag & ((acc["bold"] > 0) | ~acc["has_bold"]), acc["bold"] + 1).when(free & (acc["bold"] > 0) & token.rlike(r"(?i)^</b\s*>"), acc["bold"] - 1).otherwise(acc["bold"])
        add = lambda c, where: F.concat(acc[c], F.when(~tag & where, token).otherwise(""))
        one = cleaned(F.when(acc["inner"] > 0, acc["inner_text"]).otherwise(acc["note_text"]))
        return F.struct(
            note.alias("note"), inner.alias("inner"), depth(in_number, begins_number, "number").alias("number"), bold.alias("bold"), (acc["has_bold"] | bold_tag).alias("has_bold"),
            (acc["has_number"] | begins_number).alias("has_number"), add("text", free).alias("text"), add("bold_text", free & (acc["bold"] > 0)).alias("bold_text"),
            F.when(begins_note, "").otherwise(add("note_text", in_note)).alias("note_text"), F.when(begins_note, "").otherwise(add("inner_text", in_note & (acc["inner"] == 1))).alias("inner_text"),
            add("number_text", in_number).alias("number_text"), F.when(ends_note & (one != ""), F.array_append(acc["notes"], one)).otherwise(acc["notes"]).alias("notes"),
        )

    def fields(acc: Column) -> Column:
        bold, text = cleaned(acc["bold_text"]), cleaned(acc["text"])
        at = F.when(bold == "", 0).otherwise(F.position(bold, text))
        rest = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(bold), F.length(text)))).otherwise(text)
        return F.struct(
            bold.alias("bold"), cleaned(rest).alias("plain"), F.nullif(F.regexp_extract(acc["number_text"], NUMBER, 1), F.lit("")).cast("long").alias("number"), acc["notes"].alias("notes"), acc["has_bold"].alias("has_bold"),
        )

    return F.aggregate(F.regexp_extract_all(html, F.lit(r"<[^>]*>|[^<]+"), F.lit(0)), start, step, fields)


def records(html: Column) -> Column:
    """The records of a page in order: number, bold and plain (their lines joined by spaces) and notes.

    Paragraphs of record blocks are lines; those without a bold element are passed over. Lines are gathered until one has a number, which closes the record.

    Defined cases: null: null; a page without record blocks has none; lines behind the last number make no record; an unclosed
    paragraph ends where the next one begins; a number of more than 18 digits is an error of the cast.
    """
    found = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(BLOCKS), F.lit(1)), lambda d: F.regexp_extract_all(d, F.lit(PARAGRAPHS), F.lit(1))))
    lines = F.filter(F.transform(found, paragraph), lambda x: x["has_bold"])
    none = F.array().cast("array<string>")
    kind = "array<struct<number: bigint, bold: string, plain: string, notes: array<string>>>"
    start = F.struct(F.array().cast(kind).alias("done"), none.alias("bold"), none.alias("plain"), none.alias("notes"))

    def step(acc: Column, x: Column) -> Column:
        bold, notes = F.array_append(acc["bold"], x["bold"]), F.concat(acc["notes"], x["notes"])
        plain = F.when(x["plain"] != "", F.array_append(acc["plain"], x["plain"])).otherwise(acc["plain"])
        closed = F.struct(x["number"].alias("number"), F.array_join(bold, " ").alias("bold"), F.array_join(plain, " ").alias("plain"), notes.alias("notes"))
        ends = x["number"].isNotNull()
        return F.struct(F.when(ends, F.array_append(acc["done"], closed)).otherwise(acc["done"]).cast(kind).alias("done"), *[F.when(ends, none).otherwise(v).alias(c) for c, v in (("bold", bold), ("plain", plain), ("notes", notes))])

    return F.aggregate(lines, start, step, lambda acc: acc["done"])
