"""Books laid out from documents, one for each language, and what their lines are: stories, titles, metadata, footnotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import books as B
from lamina.operators import evaluation as E
from lamina.registry import query, table
from lamina.sources.scratch import stored

#: A story is laid out from each document: title block, verses, metadata, rating, body in lines of 68 characters, footnotes, noise, chapters' headings.
SQL_LINES = r"""docs AS (
  SELECT lang AS book, doc_id, doc_id::BIGINT AS d, coalesce(flatten(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''), lambda x: regexp_extract_all(x, '([^\n]{1,68})(?: |\z)', 1))), []) AS w
  FROM documents WHERE doc_id IS NOT NULL
), laid AS (
  SELECT book, d, flatten([
    [((d // 40) % 26 + 1) || '.' || (d % 40 + 1) || ' The Story of ' || coalesce(w[1], 'nothing')[1:40]],
    CASE WHEN d % 3 = 0 THEN ['   and what came of it'] ELSE [] END,
    ['              ' || coalesce(w[1], 'nothing')[1:10] || '-vatthu', ''],
    CASE WHEN d % 17 = 6 THEN ['Dhp 7'] ELSE [] END,
    CASE WHEN d % 17 <> 5 THEN ['Dhp ' || (d % 423 + 1) || CASE d % 4 WHEN 1 THEN '-' || (d % 423 + 3) WHEN 2 THEN '.' ELSE '' END] ELSE [] END,
    CASE WHEN d % 2 = 0 THEN ['CST4: ' || coalesce(w[1], 'nothing')[1:12]] ELSE [] END,
    CASE WHEN d % 5 = 1 THEN ['Compare: ' || d || ' and others,', 'of the same kind-', 'red matter'] ELSE [] END,
    CASE WHEN d % 6 <> 0 THEN w[2:3] ELSE [] END,
    CASE WHEN d % 5 < 2 THEN ['Cast: Ananda, Kali,', 'Visakha,', '  the night-', 'quarters'] ELSE [] END,
    CASE WHEN d % 9 <> 4 THEN ['Keywords: a, b'] ELSE [] END,
    [''],
    CASE WHEN d % 11 <> 3 THEN [repeat('*', (2 + d % 4)::INTEGER)] ELSE [] END,
    list_transform(w[4:], lambda x, i: CASE WHEN i = 11 AND d % 3 > 0 THEN '      ' || (d % 423 + 1) || '. Manopubbaṅgamā dhammā, manoseṭṭhā manomayā,' WHEN i = 12 THEN '      manasā ce paduṭṭhena bhāsatī vā'
      WHEN i = 13 AND d % 2 = 0 THEN '      The mind goes before all states' WHEN i % 9 = 4 THEN '      ' || x[1:40] WHEN i % 9 = 5 THEN '      ' || x[1:30] || (d * 7 % 10) || ' ' || x[31:40]
      WHEN i % 9 = 7 THEN x || (d * 3 % 10) ELSE x END),
    CASE WHEN d % 7 = 0 THEN ['12. The Chapter about X, Y - 345', chr(12) || '   129'] ELSE [] END,
    CASE WHEN d % 4 = 1 THEN ['   ' || (d % 10), '     BG: ' || coalesce(w[1], 'nothing')[1:30], '   continued here'] ELSE [] END,
    CASE WHEN d % 8 = 1 THEN ['  ' || ((d + 3) % 10), '     A note without a name'] ELSE [] END,
    CASE WHEN d % 4 = 1 THEN ['', 'behind the notes'] ELSE [] END,
    CASE WHEN d % 13 = 12 THEN ['      3. The Chapter about Thieves,'] ELSE [] END,
    CASE WHEN d % 26 = 12 THEN ['      or what they took, Coravagga'] ELSE [] END,
    CASE WHEN d % 13 = 12 THEN ['A preface line', ''] ELSE [] END,
    CASE WHEN d % 101 = 100 THEN ['  Conclusion, Nigamanakathā', 'the end of it'] ELSE [] END]) AS ls
  FROM docs
), raw AS (SELECT book, d, i, ls[i] AS line FROM laid, range(1, len(ls) + 1) t(i)),
lines AS (
  SELECT book, (row_number() OVER (PARTITION BY book ORDER BY d, i) - 1)::BIGINT AS n, line FROM raw
  WHERE NOT regexp_matches(line, '^[ \t\f\r]*\d+\.[ \t\f\r]+.+ - \d+[ \t\f\r]*$') AND NOT regexp_matches(line, '^\f[ \t\f\r]*\d{1,4}[ \t\f\r]*$')
)"""


def _lines(spark, d):
    """The same layout: book, n and line. Documents are dealt by ranges, and each is laid out where its lines are numbered."""
    docs = table(spark, d, "documents").where("doc_id is not null").select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "doc_id").withColumn("w", F.expr(r"""
      coalesce(flatten(transform(filter(split(coalesce(text, ''), '\n'), x -> x <> ''), x -> regexp_extract_all(x, '([^\\n]{1,68})(?: |\\z)', 1))), array())"""))  # fmt: skip
    i, first = F.col("doc_id"), F.coalesce(F.try_element_at("w", F.lit(1)), F.lit("nothing"))
    text = lambda c: c.cast("string")
    only = lambda condition, *lines: F.when(condition, F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])).otherwise(F.array().cast("array<string>"))
    always = F.lit(True)

    def body(x, k):
        k = k + 1
        verse = F.concat(F.lit("      "), text(i % 423 + 1), F.lit(". Manopubbaṅgamā dhammā, manoseṭṭhā manomayā,"))
        quoted = F.when((k == 11) & (i % 3 > 0), verse).when(k == 12, "      manasā ce paduṭṭhena bhāsatī vā").when((k == 13) & (i % 2 == 0), "      The mind goes before all states")
        inner = F.concat(F.lit("      "), F.substring(x, 1, 30), text(i * 7 % 10), F.lit(" "), F.substring(x, 31, 10))
        return quoted.when(k % 9 == 4, F.concat(F.lit("      "), F.substring(x, 1, 40))).when(k % 9 == 5, inner).when(k % 9 == 7, F.concat(x, text(i * 3 % 10))).otherwise(x)

    verses = F.concat(F.lit("Dhp "), text(i % 423 + 1), F.when(i % 4 == 1, F.concat(F.lit("-"), text(i % 423 + 3))).when(i % 4 == 2, ".").otherwise(""))
    laid = F.flatten(F.array(
        only(always, F.concat(text(F.floor(i / 40) % 26 + 1), F.lit("."), text(i % 40 + 1), F.lit(" The Story of "), F.substring(first, 1, 40))),
        only(i % 3 == 0, "   and what came of it"),
        only(always, F.concat(F.lit("              "), F.substring(first, 1, 10), F.lit("-vatthu")), ""),
        only(i % 17 == 6, "Dhp 7"),
        only(i % 17 != 5, verses),
        only(i % 2 == 0, F.concat(F.lit("CST4: "), F.substring(first, 1, 12))),
        only(i % 5 == 1, F.concat(F.lit("Compare: "), text(i), F.lit(" and others,")), "of the same kind-", "red matter"),
        F.when(i % 6 != 0, F.slice("w", 2, 2)).otherwise(F.array().cast("array<string>")),
        only(i % 5 < 2, "Cast: Ananda, Kali,", "Visakha,", "  the night-", "quarters"),
        only(i % 9 != 4, "Keywords: a, b"),
        only(always, ""),
        only(i % 11 != 3, F.repeat(F.lit("*"), (i % 4 + 2).cast("int"))),
        F.transform(F.slice("w", 4, F.greatest(F.size("w"), F.lit(1))), body),
        only(i % 7 == 0, "12. The Chapter about X, Y - 345", "\f   129"),
        only(i % 4 == 1, F.concat(F.lit("   "), text(i % 10)), F.concat(F.lit("     BG: "), F.substring(first, 1, 30)), "   continued here"),
        only(i % 8 == 1, F.concat(F.lit("  "), text((i + 3) % 10)), "     A note without a name"),
        only(i % 4 == 1, "", "behind the notes"),
        only(i % 13 == 12, "      3. The Chapter about Thieves,"),
        only(i % 26 == 12, "      or what they took, Coravagga"),
        only(i % 13 == 12, "A preface line", ""),
        only(i % 101 == 100, "  Conclusion, Nigamanakathā", "the end of it"),
    ))
    rows = docs.select(F.col("lang").alias("book"), i.alias("d"), F.posexplode(laid).alias("k", "line")).where(~B.is_noise(F.col("line")))
    return E.numbered(rows, ["book"], ["d", "k"], dealt=True, compression="zstd").select("book", F.col("i").alias("n"), "line")


def _parts(spark, d):
    return stored(B.segmented(_lines(spark, d)), "parts")


SQL_PARTS = SQL_LINES + r""", k AS (
  SELECT *, regexp_matches(line, '^[ \t\f\r]*Dhp[ \t\f\r]+(\d+)(?:[ \t\f\r]*[-–—][ \t\f\r]*(\d+))?\.?[ \t\f\r]*$') AS verses,
    CASE WHEN regexp_matches(line, '^[ \t\f\r]*$') THEN 'b' WHEN regexp_matches(line, '^[ \t\f\r]*\d+\.\d+[ \t\f\r]+[^ \t\f\r]') THEN 'h' ELSE 'x' END AS sign,
    regexp_matches(line, '^[ \t\f\r]*\d{1,3}[ \t\f\r]*$') AND NOT starts_with(line, chr(12)) AND
      coalesce(regexp_matches(lead(line) OVER (PARTITION BY book ORDER BY n), '^[ \t\f\r]+((AJ|BG):|[ \t\f\r]\p{L})'), false) AS opens
  FROM lines
), h0 AS (
  SELECT *, length(regexp_extract(reverse(coalesce(string_agg(sign, '') OVER (PARTITION BY book ORDER BY n ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '')), '^b*x*h')) AS back FROM k
), h1 AS (SELECT *, CASE WHEN verses AND back > 0 THEN n - back END AS header FROM h0),
h2 AS (SELECT *, list(header) OVER (PARTITION BY book ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS later FROM h1),
h3 AS (SELECT *, coalesce(list_contains(later, n), false) AS starts, header IS NOT NULL AND NOT coalesce(list_contains(later, header), false) AS first_line FROM h2),
s0 AS (SELECT *, max(CASE WHEN starts THEN n END) OVER (PARTITION BY book ORDER BY n) AS story FROM h3),
s1 AS (SELECT *, max(CASE WHEN first_line THEN n END) OVER (PARTITION BY book, story) AS meta_from FROM s0),
s2 AS (SELECT *, min(CASE WHEN n > meta_from AND regexp_matches(line, '^[ \t\f\r]*\*{2,5}[ \t\f\r]*$') THEN n END) OVER (PARTITION BY book, story) AS rating_n,
  min(CASE WHEN n > meta_from AND regexp_matches(line, '^[ \t\f\r]*Keywords:') THEN n END) OVER (PARTITION BY book, story) AS key_n FROM s1),
s3 AS (SELECT *, coalesce(rating_n + 1, min(CASE WHEN sign = 'b' AND n > key_n THEN n END) OVER (PARTITION BY book, story)) AS body_from FROM s2),
s4 AS (SELECT *, coalesce(n >= body_from, false) AS inside FROM s3),
s5 AS (SELECT *, coalesce(inside AND last_value(CASE WHEN inside AND opens THEN 1 WHEN inside AND sign IN ('b', 'h') THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY book, story ORDER BY n) = 1, false) AS noted FROM s4),
s6 AS (SELECT *, min(CASE WHEN inside AND NOT noted AND regexp_matches(line, '^[ \t\f\r]{4,}\d{1,2}\. The (Chapter about|Miscellaneous Chapter)\b') THEN n END) OVER (PARTITION BY book, story) AS chapter_n,
  min(CASE WHEN inside AND NOT noted AND regexp_matches(line, '^[ \t\f\r]*Conclusion, Nigamanakathā') THEN n END) OVER (PARTITION BY book, story) AS colophon_n FROM s5),
s7 AS (SELECT *, min(CASE WHEN n > chapter_n AND NOT noted AND regexp_matches(line, 'vagga[ \t\f\r]*$') THEN n END) OVER (PARTITION BY book, story) AS end_n FROM s6),
parts AS MATERIALIZED (
  SELECT book, n, line, story, CASE WHEN noted THEN max(CASE WHEN inside AND opens THEN n END) OVER (PARTITION BY book, story ORDER BY n) END AS note,
    CASE WHEN story IS NULL THEN 'none' WHEN n < meta_from THEN 'title' WHEN n = rating_n THEN 'rating' WHEN NOT inside THEN 'meta' WHEN noted THEN 'footnote'
      WHEN n < least(coalesce(chapter_n, n + 1), coalesce(colophon_n, n + 1)) THEN 'body' WHEN chapter_n IS NULL OR colophon_n < chapter_n THEN 'colophon'
      WHEN n = chapter_n OR n <= end_n THEN 'heading' ELSE 'preface' END AS part
  FROM s7
)"""


@query(f"WITH {SQL_PARTS} SELECT * FROM parts")
def str_book_parts(spark, d):
    """Each line of each book, and what it is: the segmentation by machines of states, in blocks of lines."""
    return B.segmented(_lines(spark, d))


SQL_BARE = r"regexp_replace({0}, '^[ \t\f\r]+|[ \t\f\r]+$', '', 'g')"
SQL_WRAPPED = r"replace(regexp_replace(array_to_string(list_filter({0}, lambda x: x <> ''), chr(10)), '(\p{{L}})-\n', '\1-', 'g'), chr(10), ' ')"
SQL_BOOK_TITLES = rf"""t0 AS (SELECT book, story, list({SQL_BARE.format('line')} ORDER BY n) AS t FROM parts WHERE part = 'title' AND NOT regexp_matches(line, '^[ \t\f\r]*$') GROUP BY book, story),
t1 AS (SELECT book, story, arg_min(line, n) AS v FROM parts WHERE part = 'meta' AND regexp_matches(line, '^[ \t\f\r]*Dhp[ \t\f\r]+\d') GROUP BY book, story),
titles AS (SELECT t0.book, t0.story, regexp_extract(t[1], '^(\d+\.\d+)', 1) AS group_id, regexp_extract(v, 'Dhp\s+(\d+)', 1)::BIGINT AS first_verse,
  coalesce(nullif(regexp_extract(v, '[-–—]\s*(\d+)', 1), ''), regexp_extract(v, 'Dhp\s+(\d+)', 1))::BIGINT AS last_verse,
  array_to_string(list_concat([regexp_extract(t[1], '^\d+\.\d+\s+(.*)$', 1)], t[2:len(t) - 1]), ' ') AS title, CASE WHEN len(t) > 1 THEN t[-1] END AS second_title
  FROM t0 JOIN t1 ON t0.story = t1.story AND t0.book IS NOT DISTINCT FROM t1.book)"""


@query(rf"""WITH {SQL_PARTS}, {SQL_BOOK_TITLES},
m0 AS (SELECT *, {SQL_BARE.format('line')} AS text, regexp_extract(line, '^[ \t\f\r]*(CST4|Burlingame|Compare|Cast|Keywords):', 1) AS label FROM parts WHERE part IN ('meta', 'rating')),
m1 AS (SELECT *, text = '' OR part = 'rating' OR regexp_matches(line, '^[ \t\f\r]*Dhp[ \t\f\r]+\d') AS plain, CASE WHEN label <> '' THEN regexp_extract(text, ':[ \t\f\r]*(.*)$', 1) ELSE text END AS value FROM m0),
m2 AS (SELECT *, max(CASE WHEN label <> '' THEN n END) OVER w AS label_n, max(CASE WHEN plain OR (label = '' AND NOT ends_with(value, ',')) THEN n END) OVER before AS stop_n,
  max(CASE WHEN label <> '' AND NOT ends_with(value, ',') THEN n END) OVER before AS short_n FROM m1
  WINDOW w AS (PARTITION BY book, story ORDER BY n), before AS (PARTITION BY book, story ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m3 AS (SELECT *, CASE WHEN label <> '' THEN n WHEN NOT plain AND label_n > coalesce(stop_n, -1) AND label_n > coalesce(short_n, -1) THEN label_n END AS run FROM m2),
m4 AS (SELECT book, story, run, max(label) AS label, {SQL_WRAPPED.format("list(value ORDER BY n)")} AS value FROM m3 WHERE run IS NOT NULL GROUP BY ALL),
m5 AS (SELECT book, story, arg_max(value, run) FILTER (label = 'CST4') AS cst4, arg_max(value, run) FILTER (label = 'Burlingame') AS burlingame, arg_max(value, run) FILTER (label = 'Compare') AS compare,
  arg_max(value, run) FILTER (label = 'Cast') AS cast, arg_max(value, run) FILTER (label = 'Keywords') AS keywords FROM m4 GROUP BY book, story),
m6 AS (SELECT book, story, nullif({SQL_WRAPPED.format("coalesce(list(value ORDER BY n) FILTER (run IS NULL AND NOT plain), [])")}, '') AS synopsis, max(CASE WHEN part = 'rating' THEN length(text) END)::BIGINT AS rating FROM m3 GROUP BY book, story),
c AS (SELECT book, story, count(*) FILTER (part = 'body' AND NOT regexp_matches(line, '^[ \t\f\r]*$')) AS n_body, count(DISTINCT note) AS n_notes FROM parts WHERE story IS NOT NULL GROUP BY book, story)
SELECT t.*, m5.* EXCLUDE (book, story), m6.synopsis, m6.rating, c.n_body, c.n_notes FROM titles t JOIN m6 ON t.story = m6.story AND t.book IS NOT DISTINCT FROM m6.book
JOIN c ON t.story = c.story AND t.book IS NOT DISTINCT FROM c.book LEFT JOIN m5 ON t.story = m5.story AND t.book IS NOT DISTINCT FROM m5.book""")
def dom_book_stories(spark, d):
    """Each story of each book with its title block, metadata, and numbers of body lines and footnotes."""
    parts = _parts(spark, d)
    filled = (F.col("part") == "body") & ~F.col("line").rlike(B.BLANK)
    counts = parts.where("story is not null").groupBy(F.col("book").alias("_b"), F.col("story").alias("_s")).agg(F.count_if(filled).alias("n_body"), F.count_if((F.col("part") == "footnote") & (F.col("note") == F.col("n"))).alias("n_notes"))
    t, m = B.titles(parts), B.metadata(parts)
    m = m.select(F.col("book").alias("_book"), F.col("story").alias("_story"), *[c for c in m.columns if c not in ("book", "story")])
    rows = t.join(m, t["book"].eqNullSafe(m["_book"]) & (t["story"] == m["_story"])).drop("_book", "_story")
    return rows.join(counts, rows["book"].eqNullSafe(counts["_b"]) & (rows["story"] == counts["_s"])).drop("_b", "_s")


SQL_NOTES = rf"""n0 AS (SELECT book, story, note, list(line ORDER BY n) AS t FROM parts WHERE part = 'footnote' GROUP BY book, story, note),
notes AS (SELECT book, story, note, {SQL_BARE.format('t[1]')} AS marker, coalesce(nullif(regexp_extract(t[2], '^[ \t\f\r]*(AJ|BG):', 1), ''), 'unlabeled') AS author,
  {SQL_WRAPPED.format(f"list_transform(list_concat([regexp_replace(t[2], '^[ {chr(92)}t{chr(92)}f{chr(92)}r]*((AJ|BG):)?', '')], t[3:]), lambda x: {SQL_BARE.format('x')})")} AS text FROM n0)"""


@query(f"WITH {SQL_PARTS}, {SQL_NOTES} SELECT * FROM notes")
def str_footnotes(spark, d):
    """The footnotes of each story: number, author and text in one line."""
    return B.footnotes(_parts(spark, d))


#: DuckDB knows no look-behind; whether a number stands in a line as a footnote's needs none.
SQL_HOLDS = r"""CASE WHEN contains({0}, {1}) THEN regexp_matches({0}, '((^|[^0-9])[.,]|[\p{{L}};:!?’”)\]–—])' || {1} || '([ \t\n\f\r.,;:!?’”)\]]|$)') ELSE false END"""


@query(rf"""WITH RECURSIVE {SQL_PARTS}, {SQL_NOTES}, ks AS (SELECT book, story, row_number() OVER (PARTITION BY book ORDER BY story) - 1 AS k FROM (SELECT DISTINCT book, story FROM parts WHERE story IS NOT NULL)),
markers AS (SELECT DISTINCT marker FROM notes),
p AS MATERIALIZED (SELECT parts.*, k FROM parts JOIN ks USING (book, story)),
kept AS MATERIALIZED (SELECT notes.*, k FROM notes JOIN ks USING (book, story) WHERE NOT EXISTS (
  SELECT 1 FROM p WHERE p.book = notes.book AND p.story = notes.story AND p.part = 'colophon' AND {SQL_HOLDS.format('p.line', 'notes.marker')})),
b0 AS MATERIALIZED (SELECT DISTINCT book, k, marker, 0 AS has, 1 AS found FROM p JOIN markers ON {SQL_HOLDS.format('p.line', 'marker')} WHERE part IN ('title', 'body') OR (part = 'meta' AND NOT regexp_matches(line, '^[ \t\f\r]*Keywords:'))),
b1 AS MATERIALIZED (SELECT book, k, marker, max(has) AS has, max(found) AS found FROM (SELECT * FROM b0 UNION ALL SELECT book, k, marker, 1, 0 FROM kept) GROUP BY ALL),
b2 AS MATERIALIZED (SELECT x.*, coalesce(a.has, 0) AS has_a, coalesce(a.found, 0) AS found_a, coalesce(z.has, 0) AS has_z, coalesce(z.found, 0) AS found_z, row_number() OVER (PARTITION BY x.book, x.marker ORDER BY x.k) AS r
  FROM b1 x LEFT JOIN b1 a ON a.book = x.book AND a.marker = x.marker AND a.k = x.k - 1 LEFT JOIN b1 z ON z.book = x.book AND z.marker = x.marker AND z.k = x.k + 1),
steps AS (
  SELECT book, marker, r, k, 0 AS own_taken, CASE WHEN found = 0 OR has = 1 THEN 0 WHEN has_a = 1 AND found_a = 0 THEN 1 WHEN has_z = 1 AND found_z = 0 THEN 2 ELSE 0 END AS took FROM b2 WHERE r = 1
  UNION ALL
  SELECT y.book, y.marker, y.r, y.k, (y.k = s.k + 1 AND s.took = 2)::INTEGER AS own_taken,
    CASE WHEN y.found = 0 OR (y.has = 1 AND NOT (y.k = s.k + 1 AND s.took = 2)) THEN 0 WHEN y.has_a = 1 AND y.found_a = 0 AND NOT (y.k = s.k + 1 AND s.own_taken = 1) THEN 1
      WHEN y.has_z = 1 AND y.found_z = 0 THEN 2 ELSE 0 END AS took
  FROM steps s JOIN b2 y ON y.book = s.book AND y.marker = s.marker AND y.r = s.r + 1
), moves AS (SELECT book, marker, CASE took WHEN 1 THEN k - 1 ELSE k + 1 END AS k, k AS target FROM steps WHERE took > 0)
SELECT kept.book, kept.story, kept.note, kept.marker, kept.author, kept.text, ks.story AS home FROM kept LEFT JOIN moves USING (book, marker, k) JOIN ks ON ks.book = kept.book AND ks.k = coalesce(moves.target, kept.k)""")
def jn_notes_home(spark, d):
    """Footnotes, each with the story whose text has its number: its own or a neighbour, by a machine over stories."""
    parts = _parts(spark, d)
    return B.returned(parts, B.footnotes(parts))


_LETTERS = B.MARKED_LETTERS
_ENGLISH = ", ".join(f"'{w}'" for w in B.ENGLISH)
SQL_BODY = rf"""y0 AS (SELECT book, story, n, regexp_replace(regexp_replace(replace(line, chr(12), ''), ' ?(?:\{{[0-9]+\.[0-9]+\}}|\[[0-9]+(?:\.[0-9]+)?\])', '', 'g'), '\s+$', '') AS x FROM parts WHERE part = 'body'),
y1 AS (SELECT book, story, n, length(regexp_extract(x, '^ *')) AS indent, regexp_replace(regexp_replace(x, '^ +', ''), ' {{2,}}', ' ', 'g') AS bare FROM y0 WHERE x <> ''),
y2 AS (SELECT *, regexp_extract_all(lower(bare), '\p{{L}}+') AS ws FROM y1),
y3 AS (SELECT *, len(list_filter(ws, lambda w: w IN ({_ENGLISH}))) AS e, len(list_filter(ws, lambda w: regexp_matches(w, '[{_LETTERS}]'))) AS p FROM y2),
y4 AS (SELECT *, indent >= 3 AS indented, CASE WHEN e = 0 AND p = 0 THEN 'unknown' WHEN p > e THEN 'pali' ELSE 'english' END AS tongue, regexp_extract(bare, '^(\d{{1,3}})\.\s+\S', 1) AS num,
  regexp_extract(bare, '^\d{{1,3}}\.\s+(\S.*)$', 1) AS tail FROM y3)"""


@query(rf"""WITH {SQL_PARTS}, {SQL_BODY},
z0 AS (SELECT *, indented AND (length(bare) < 55 OR num <> '' OR tongue = 'pali') AS verse FROM y4),
z1 AS (SELECT *, lead(n) OVER w IS NULL AS last, lead(indent) OVER w AS indent2, lead(length(bare)) OVER w AS length2, lead(tongue) OVER w AS tongue2, lead(verse) OVER w AS verse2, lead(indented) OVER w AS indented2
  FROM z0 WINDOW w AS (PARTITION BY book, story ORDER BY n)),
z2 AS (SELECT *, verse AND NOT coalesce(NOT regexp_matches(bare, '[.,;:!?–—’”]$') AND indent2 = indent AND length2 >= 60 AND tongue2 <> 'pali', false) AS alone,
  last OR (regexp_matches(bare, '[.!?:;”’)–]$') AND (length(bare) < 62 - indent OR verse2 OR indented2 <> indented)) AS ends FROM z1),
z3 AS (SELECT *, coalesce(last_value(CASE WHEN ends THEN 0 WHEN NOT alone THEN 1 END IGNORE NULLS) OVER (PARTITION BY book, story ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM z2),
z4 AS (SELECT *, alone AND open = 0 AS kept FROM z3),
z5 AS (SELECT *, CASE WHEN kept THEN NOT coalesce(lag(kept) OVER (PARTITION BY book, story ORDER BY n), false) ELSE open = 0 END AS starts FROM z4),
z6 AS (SELECT *, max(CASE WHEN starts THEN n END) OVER (PARTITION BY book, story ORDER BY n) AS first_line FROM z5)
SELECT book, story, first_line, CASE WHEN bool_or(kept) THEN 'verse' ELSE 'paragraph' END AS kind,
  CASE WHEN bool_or(kept) THEN string_agg(bare, chr(10) ORDER BY n) ELSE {SQL_WRAPPED.format(f"list({SQL_BARE.format('bare')} ORDER BY n)")} END AS text FROM z6 GROUP BY book, story, first_line""")
def str_reflow(spark, d):
    """Bodies as paragraphs and verses: wrapped lines are joined, lines of verse stay."""
    return B.reflow(B.segmented(_lines(spark, d)))


@query(rf"""WITH {SQL_PARTS}, {SQL_BOOK_TITLES}, {SQL_BODY},
v0 AS (SELECT y4.*, num <> '' AND try_cast(num AS BIGINT) BETWEEN first_verse AND last_verse AND length(regexp_replace(tail, '[^\p{{L}}]', '', 'g')) >= 8
  AND length(regexp_replace(lower(tail), '[^{_LETTERS}]', '', 'g')) > 0.1 * length(regexp_replace(tail, '[^\p{{L}}]', '', 'g')) AS match
  FROM y4 JOIN titles t ON t.story = y4.story AND t.book IS NOT DISTINCT FROM y4.book),
v1 AS (SELECT *, min(CASE WHEN match THEN n END) OVER (PARTITION BY book, story) AS start_n FROM v0),
v2 AS (SELECT *, min(CASE WHEN n > start_n AND NOT (indented AND num = '' AND tongue <> 'english') THEN n END) OVER (PARTITION BY book, story) AS end_n FROM v1),
v3 AS (SELECT *, min(CASE WHEN n >= end_n AND NOT (indented AND tongue <> 'pali') THEN n END) OVER (PARTITION BY book, story) AS stop_n FROM v2)
SELECT book, story, max(CASE WHEN n = start_n THEN num::BIGINT END) AS number, string_agg(CASE WHEN n = start_n THEN tail ELSE bare END, ' ' ORDER BY n) FILTER (n < coalesce(end_n, n + 1)) AS original,
  string_agg(bare, ' ' ORDER BY n) FILTER (n >= end_n AND n < coalesce(stop_n, n + 1)) AS translation FROM v3 WHERE n >= start_n GROUP BY book, story""")
def str_verse_blocks(spark, d):
    """The first of its own verses that each story quotes: number, original and translation."""
    return B.verses(_parts(spark, d))
