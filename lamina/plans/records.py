"""Nested records made from documents: characters that no text should hold, wherever they are, and budgets for narratives."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import nested as N
from lamina.registry import query, table

SQL_STRINGS = r"""d AS (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, 'story.text' AS path, t || CASE WHEN doc_id % 5 = 0 THEN chr(7) || chr(27) || chr(7) ELSE '' END AS value FROM d
  UNION ALL SELECT doc_id, 'story.origin.lang', lang || CASE WHEN doc_id % 7 = 0 THEN chr(8213) ELSE '' END FROM d
  UNION ALL SELECT doc_id, 'notes[' || i || '].note', t[1:10] || CASE WHEN (doc_id + i) % 4 = 0 THEN chr(12) || chr(8214) ELSE '' END FROM d, range(0, 3) r(i)
  UNION ALL SELECT doc_id, 'extra[source]', source || CASE WHEN doc_id % 3 = 0 THEN chr(1) ELSE '' END FROM d
)"""


def _records(spark, d):
    """A struct in a struct, an array of structs and a map; some strings get characters that don't belong there."""
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    odd = lambda condition, s: F.when(condition, s).otherwise("")
    story = F.struct(F.concat(t, odd(i % 5 == 0, "\x07\x1b\x07")).alias("text"), F.length(t).alias("n"), F.struct(F.concat("lang", odd(i % 7 == 0, "―")).alias("lang")).alias("origin"))
    notes = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(k.alias("k"), F.concat(F.substring(t, 1, 10), odd((i + k) % 4 == 0, "\x0c‖")).alias("note")))
    extra = F.create_map(F.lit("source"), F.concat("source", odd(i % 3 == 0, "\x01")))
    return table(spark, d, "documents").where("doc_id is not null").select("doc_id", story.alias("story"), notes.alias("notes"), extra.alias("extra"))


def _sql_codes(characters: str) -> str:
    return rf"""WITH {SQL_STRINGS}, c AS (SELECT doc_id, path, list_distinct(regexp_extract_all(value, '[{characters}]')) AS c FROM s)
SELECT doc_id, path, array_to_string(list_sort(list_transform(c, lambda x: 'U+' || lpad(printf('%X', unicode(x)), 4, '0'))), ' ') AS codes FROM c WHERE len(c) > 0"""


@query(_sql_codes(r"\x00-\x08\x0b-\x1f"))
def flt_control_characters(spark, d):
    """Control characters in any string of nested records: where, and which."""
    return N.code_points(_records(spark, d), "doc_id", N.CONTROLS)


@query(_sql_codes("―‖"))
def flt_quote_glyphs(spark, d):
    """Glyphs that stand for quotes by a fault of extraction, in any string of nested records."""
    return N.code_points(_records(spark, d), "doc_id", N.BAD_QUOTES)


#: Tokens that the narratives of a document (its lines) may take, at four characters each.
BUDGET = 300


@query(rf"""WITH d AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)) AS n FROM documents),
m AS (SELECT doc_id, n, list_max(n) AS longest FROM d),
b AS (SELECT doc_id, longest, unnest(list_distinct(list_concat(n, range(0, {4 * BUDGET + 4})))) AS b FROM m),
f AS (SELECT b.doc_id, b.longest, b.b FROM b JOIN m USING (doc_id) WHERE b.b <= b.longest AND list_sum(list_transform(m.n, lambda x: (least(x, b.b) + 3) // 4)) <= {BUDGET})
SELECT m.doc_id, m.longest, coalesce(max(f.b), -1)::BIGINT AS budget FROM m LEFT JOIN f USING (doc_id) GROUP BY m.doc_id, m.longest""")
def fn_narrative_budget(spark, d):
    """The most characters that each line of a document may keep so that all lines together stay within a budget of tokens."""
    n = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x).cast("bigint"))
    rows = table(spark, d, "documents").select("doc_id", n.alias("n")).withColumn("longest", F.array_max("n"))
    cost = lambda b: F.aggregate("n", F.lit(0).cast("bigint"), lambda total, x: total + F.floor((F.least(x, b) + 3) / 4))
    return rows.select("doc_id", "longest", N.largest(lambda b: cost(b) <= BUDGET, F.col("longest")).alias("budget"))
