"""Gates over records made from documents, coverage of keys, and preconditions of an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.operators import gates as G
from lamina.registry import query, table
from lamina.sources import index_table as I
from lamina.sources.scratch import scratch_path

# The bounds of a segment's vowels, where segments end, and the letters and marks that a checked field may hold.
LEAST_VOWELS, MOST_VOWELS, SEGMENT_END, VOWELS = 4, 18, "[,;:–?!.]", "aāiīuūeoĕŏAĀIĪUŪEOĔŎ"
CHARSET = r"[^a-zA-ZāīūṁṃṅñṭḍṇḷĕŏĀĪŪṀṂṄÑṬḌṆḶĔŎ\s.,;:?!()'‘’“”—–-]"
OWNERS = {"text": "main", "note": "side"}

SQL_RECORDS = r"""r AS (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN doc_id // 100 + 1 ELSE doc_id // 100 END AS part,
  coalesce(text, '') || CASE WHEN doc_id % 61 = 0 THEN chr(12) || chr(1) || chr(12) ELSE '' END AS t, CASE WHEN doc_id % 53 = 0 THEN 'side' ELSE 'main' END AS t_source,
  coalesce(lang, '') || CASE WHEN doc_id % 59 = 0 THEN 'o' || chr(776) ELSE '' END || CASE WHEN doc_id % 67 = 0 THEN ' 17' || chr(128512) || '7' ELSE ' ŏ–' END AS note, doc_id % 89 = 0 AS extra
  FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, 'text' AS path, t AS value, t_source AS source FROM r UNION ALL SELECT doc_id, 'note', note, 'side' FROM r UNION ALL SELECT doc_id, 'old', 'x', 'gone' FROM r WHERE extra),
seg AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '[,;:–?!.]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM r),
cnt AS (SELECT doc_id, unnest(range(0, len(s))) AS i, unnest(list_transform(s, lambda x: len(regexp_extract_all(x, '[aāiīuūeoĕŏAĀIĪUŪEOĔŎ]')))) AS n FROM seg),
tt AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(string_split(t, chr(10))[1]), '[^\p{L}\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 5) AS w,
  lower(CASE WHEN contains(t, chr(10)) THEN substring(t, strpos(t, chr(10)) + 1) ELSE '' END) AS body FROM r),
v AS (SELECT doc_id, 'structure' AS gate, true AS hard, 'part' AS path, 'part=' || part || ', expected ' || (doc_id // 100) AS problem FROM r WHERE part <> doc_id // 100
UNION ALL SELECT doc_id, 'ownership', true, path, 'source=' || source || ', expected ' || CASE path WHEN 'text' THEN 'main' ELSE 'side' END FROM f WHERE path <> 'old' AND source <> CASE path WHEN 'text' THEN 'main' ELSE 'side' END
UNION ALL SELECT doc_id, 'ownership', true, path, 'not in the ownership table' FROM f WHERE path = 'old'
UNION ALL SELECT doc_id, 'encoding', true, path, 'not composed' FROM f WHERE nfc_normalize(value) <> value
UNION ALL SELECT doc_id, 'encoding', true, path, 'control ' || array_to_string(list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(value, '[\x00-\x08\x0b-\x1f]'), lambda c: unicode(c)))), lambda c: 'U+' || printf('%04X', c)), ' ') FROM f WHERE regexp_matches(value, '[\x00-\x08\x0b-\x1f]')
UNION ALL SELECT doc_id, 'encoding', true, path, 'charset ' || array_to_string(list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(value, '{charset}'), lambda c: unicode(c)))), lambda c: 'U+' || printf('%04X', c)), ' ') FROM f WHERE path = 'note' AND regexp_matches(value, '{charset}')
UNION ALL SELECT doc_id, 'meter', false, 'text[' || i || ']', n || ' vowels' FROM cnt WHERE n < 4 OR n > 18
UNION ALL SELECT doc_id, 'title', false, 'title', array_to_string(w, ' ') FROM tt WHERE len(w) > 0 AND len(list_filter(w, lambda x: contains(body, x))) = 0)""".replace("{charset}", CHARSET.replace("'", "''"))


def records(spark, d):
    """A part's number, a map of fields with value and source, a title and a body, some of them wrong."""
    i, odd = F.col("doc_id"), lambda n, a, b="": F.when(F.col("doc_id") % n == 0, a).otherwise(b)
    t = F.concat(F.coalesce("text", F.lit("")), odd(61, "\x0c\x01\x0c"))
    note = F.concat(F.coalesce("lang", F.lit("")), odd(59, "ö"), odd(67, " 17\U0001f6007", " ŏ–"))
    field = lambda name, value, source: F.struct(F.lit(name).alias("key"), F.struct(value.alias("value"), source.alias("source")).alias("value"))
    old = F.when(i % 89 == 0, F.array(field("old", F.lit("x"), F.lit("gone")))).otherwise(F.array().cast("array<struct<key: string, value: struct<value: string, source: string>>>"))
    fields = F.map_from_entries(F.concat(F.array(field("text", F.col("t"), odd(53, "side", "main")), field("note", note, F.lit("side"))), old))
    rows = table(spark, d, "documents").where("doc_id is not null").withColumn("t", t)
    title = F.substring_index("t", "\n", 1)
    return rows.select(i, F.when(i % 97 == 0, F.expr("doc_id div 100 + 1")).otherwise(F.expr("doc_id div 100")).alias("part"), fields.alias("fields"), title.alias("title"), F.substr("t", F.length(title) + 2).alias("body"))


def gates():
    fields = F.col("fields")
    return [
        G.Gate("structure", True, G.differs("part", F.col("part"), F.expr("doc_id div 100"))),
        G.Gate("ownership", True, G.not_owned(fields, OWNERS)),
        G.Gate("encoding", True, G.badly_encoded(fields, {"note": CHARSET})),
        G.Gate("meter", False, G.odd_segments("text", fields["text"]["value"], SEGMENT_END, VOWELS, LEAST_VOWELS, MOST_VOWELS)),
        G.Gate("title", False, G.title_absent("title", F.col("title"), F.col("body"))),
    ]


@query(f"WITH {SQL_RECORDS} SELECT * FROM v")
def gate_violations(spark, d):
    """All that five gates find in records: where, and what is wrong. One scan, no shuffle."""
    return G.violations(records(spark, d), "doc_id", gates())


@query(f"""WITH {SQL_RECORDS}, g AS (SELECT unnest(['structure', 'ownership', 'encoding', 'meter', 'title']) AS gate, unnest([true, true, true, false, false]) AS hard),
c AS (SELECT g.gate, g.hard, (SELECT count(*) FROM r) AS n_rows, count(v.doc_id) AS violations, min(v.doc_id) AS first FROM g LEFT JOIN v ON v.gate = g.gate GROUP BY ALL)
SELECT *, NOT hard OR violations = 0 AS passed, (SELECT count(*) FROM v WHERE v.hard) = 0 AS build_ok FROM c""")
def gate_report(spark, d):
    """Each gate's count, first row and outcome, and whether the build may go on."""
    return G.report(records(spark, d), "doc_id", gates())


@query("""WITH c AS (SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey IS NOT NULL GROUP BY o_custkey), e AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey % 11 > 0)
SELECT coalesce(c.key, e.key) AS key, CASE WHEN e.key IS NULL THEN 'unknown' WHEN c.key IS NULL THEN 'missing' ELSE 'repeated' END AS state, coalesce(n, 0) AS n
FROM c FULL JOIN e ON c.key = e.key WHERE e.key IS NULL OR c.key IS NULL OR n > 1""")
def gate_closure(spark, d):
    """Customers that no order covers, or several do, and orders of customers that aren't expected."""
    covered = table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("key"))
    return G.closure(covered, table(spark, d, "customer").where("c_custkey % 11 > 0").select(F.col("c_custkey").alias("key")), "key")


#: The most words of a text that an encoder takes.
MOST_WORDS = 512


@query(f"""SELECT doc_id AS key, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''))::BIGINT AS length FROM documents
WHERE len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) > {MOST_WORDS}""")
def src_too_long(spark, d):
    """Texts that an encoder would cut: an index over these rows is refused."""
    return I.too_long(table(spark, d, "documents"), "doc_id", F.size(T.tokens(F.col("text"))), MOST_WORDS)


@query("""WITH u AS (SELECT doc_id AS key, 1 AS texts, 0 AS labels, 0 AS vectors FROM documents UNION ALL SELECT doc_id, 0, 1, 0 FROM labels UNION ALL SELECT vec_id, 0, 0, 1 FROM embeddings),
c AS (SELECT key, sum(texts)::BIGINT AS texts, sum(labels)::BIGINT AS labels, sum(vectors)::BIGINT AS vectors FROM u GROUP BY key) SELECT * FROM c WHERE texts <> 1 OR labels <> 1 OR vectors <> 1""")
def src_artifact_keys(spark, d):
    """Keys that aren't exactly once in texts, labels and vectors."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return I.mismatches({"texts": table(spark, d, "documents"), "labels": table(spark, d, "labels"), "vectors": vectors}, "doc_id")


@query("""WITH i AS (SELECT vec_id, label FROM embeddings), k AS (SELECT DISTINCT doc_id AS vec_id FROM documents WHERE doc_id % 50 = 0 UNION SELECT DISTINCT -o_custkey FROM orders)
SELECT k.vec_id, CASE WHEN i.vec_id IS NULL THEN 'missing' ELSE 'found' END AS state, i.label FROM k LEFT JOIN i ON i.vec_id = k.vec_id""")
def snk_index_lookup(spark, d):
    """Labels by vector from a written index: numbers of documents divisible by 50, and some that no vector has."""
    path = scratch_path(spark, "index")
    I.write_index(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", path, buckets=8)
    asked = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("k"))
    return I.Index(spark, path).join(asked.union(table(spark, d, "orders").select((-F.col("o_custkey")).alias("k"))))
