"""Quotes and citations of claims, texts without their closing quotes, excerpts, chunks of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import lines as L
from lamina.functions import quotes as Q
from lamina.functions import text as T
from lamina.operators import audit as A
from lamina.operators import chunks as C
from lamina.registry import SQL_TOKENS, query, table

LEAST = 0.6
SQL_FOLD = r"""regexp_replace(translate(lower(nfc_normalize({0})), 'ṃṅ', 'ṁṁ'), '[\s.,;:!?"“”’''-]', '', 'g')"""
SQL_QUOTES = f"""q AS (SELECT p_partkey, p_name, p_type, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_name, ' ', '-')) WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN p_name || ' indeed' WHEN 4 THEN p_type END AS quote FROM part),
m AS (SELECT p_partkey, quote, CASE WHEN contains(p_name, quote) OR contains(p_type, quote) THEN 'exact' WHEN contains({SQL_FOLD.format('p_name')}, {SQL_FOLD.format('quote')}) OR contains({SQL_FOLD.format('p_type')}, {SQL_FOLD.format('quote')}) THEN 'variant' END AS tier,
  CASE WHEN contains(p_name, quote) THEN 'name' WHEN contains(p_type, quote) THEN 'type' WHEN contains({SQL_FOLD.format('p_name')}, {SQL_FOLD.format('quote')}) THEN 'name' WHEN contains({SQL_FOLD.format('p_type')}, {SQL_FOLD.format('quote')}) THEN 'type' END AS field, p_name, p_type FROM q WHERE quote IS NOT NULL),
v AS (SELECT p_partkey, tier, field, round(length({SQL_FOLD.format('quote')}) / length({SQL_FOLD.format("CASE field WHEN 'name' THEN p_name WHEN 'type' THEN p_type END")})::DOUBLE, 4) AS covered FROM m)"""


def _quotes(spark, d):
    """Quotes of parts' names and types: whole, in other spelling, in part, made up, of the second text, none."""
    k = F.col("p_partkey") % 6
    quote = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).when(k == 2, F.split_part("p_name", F.lit(" "), F.lit(1)))
    quote = quote.when(k == 3, F.concat("p_name", F.lit(" indeed"))).when(k == 4, F.col("p_type"))
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_type", quote.alias("quote")).where("quote is not null")
    rows = rows.select("p_partkey", "quote", Q.quote_match(F.col("quote"), {"name": F.col("p_name"), "type": F.col("p_type")}).alias("m"))
    return rows.select("p_partkey", "m.tier", "m.field", F.round(Q.coverage(F.col("quote"), F.col("m.source")), 4).alias("covered"))


@query(f"WITH {SQL_QUOTES} SELECT p_partkey, tier, field, covered FROM v")
def str_quote_match(spark, d):
    """Where quotes come from, how near they are to it and how much of it they cover."""
    return _quotes(spark, d)


@query(f"""WITH {SQL_QUOTES} SELECT p_partkey, 'PALI_QUOTE_NOT_IN_SOURCE' AS code, 'error' AS severity FROM v WHERE tier IS NULL
UNION ALL SELECT p_partkey, 'PALI_QUOTE_ORTHOGRAPHIC_VARIANT', 'warning' FROM v WHERE tier = 'variant' UNION ALL SELECT p_partkey, 'PALI_QUOTE_TRUNCATED', 'warning' FROM v WHERE covered < {LEAST}""")
def aud_quotes(spark, d):
    """Quotes that are nowhere, in other spelling, or of less than 0.6 of their text; one may get two codes."""
    nowhere = F.when(F.col("tier").isNull(), "PALI_QUOTE_NOT_IN_SOURCE").when(F.col("tier") == "variant", "PALI_QUOTE_ORTHOGRAPHIC_VARIANT")
    codes = F.array(nowhere, F.when(F.col("covered") < LEAST, "PALI_QUOTE_TRUNCATED"))
    return A.warnings(_quotes(spark, d).select("p_partkey", F.explode(codes).alias("code")), F.col("code"), ["p_partkey"])


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS verse, c_custkey % 8 AS k FROM customer), r AS (SELECT n_regionkey AS gid, n_nationkey AS verse FROM nation WHERE n_regionkey < 4 AND n_nationkey <> 3),
x AS (SELECT c_custkey, CASE WHEN k = 7 THEN 'SYNTHESIS_WITH_CITATION' WHEN k = 6 THEN 'MISSING_PROVENANCE'
  WHEN k IN (SELECT gid FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.gid = k AND r.verse = c.verse) THEN 'VERSE_GROUP_MISMATCH' WHEN k = 5 AND verse NOT IN (SELECT verse FROM r) THEN 'VERSE_NOT_RETRIEVED' END AS code FROM c)
SELECT c_custkey, code, CASE code WHEN 'SYNTHESIS_WITH_CITATION' THEN 'info' ELSE 'error' END AS severity FROM x WHERE code IS NOT NULL""")
def aud_citations(spark, d):
    """Customers as claims that cite a region (0 to 4; 5 is none, 6 is left out, 7 a synthesis) and their nation, against the nations of some regions as the context."""
    k = F.col("c_custkey") % 8
    claims = table(spark, d, "customer").select(
        "c_custkey", F.when(k == 7, "synthesis").otherwise("commentary").alias("layer"), F.when(k != 6, k).alias("cited"), F.when(k < 5, k).alias("gid"), F.col("c_nationkey").alias("verse")
    )
    held = table(spark, d, "nation").where("n_regionkey < 4 and n_nationkey <> 3").select(F.col("n_regionkey").alias("gid"), F.col("n_nationkey").alias("verse"))
    return A.warnings(A.citation_codes(claims, held, []), F.col("code"), ["c_custkey"])


@query(rf"""WITH n AS (SELECT doc_id, text, doc_id % 300 + 1 AS n, doc_id % 6 AS k FROM documents WHERE text IS NOT NULL), c AS (SELECT *, text || CASE k WHEN 0 THEN '' WHEN 1 THEN ' He pronounced the following verses: ' || n || '. alpha beta. ' || (n + 1) || '. gamma delta.'
  WHEN 2 THEN ' pronouncing the following stanza: ' || (n + 2) || '. alpha' WHEN 3 THEN ' pronounced the following verse ' || n || '. alpha' WHEN 4 THEN ' pronounced the following verse: ' || (n + 1) || '. ' || text
  ELSE ' PRONOUNCED the following verse: 999. other. Later pronounced the following verse: ' || (n + 1) || '. omega' END AS t FROM n)
SELECT doc_id, md5(CASE WHEN k IN (1, 5) OR k = 4 AND len({SQL_TOKENS.format('text')}) + 1 <= 110 THEN regexp_replace(regexp_extract(t, '(?is)^(.*)pronounc\w*\s+the\s+following\s+(?:verse|stanza)s?\s*:?', 1), '\s+$', '') ELSE t END) AS digest FROM c""")
def str_closing_quote(spark, d):
    """Texts without the quote of their own numbers that closes them; such closings are added: own, another's, the first alone, a long one, after another's."""
    n, k = F.col("doc_id") % 300 + 1, F.col("doc_id") % 6
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    tail = F.when(k == 0, "").when(k == 1, s(" He pronounced the following verses: ", n, ". alpha beta. ", n + 1, ". gamma delta.")).when(k == 2, s(" pronouncing the following stanza: ", n + 2, ". alpha"))
    tail = tail.when(k == 3, s(" pronounced the following verse ", n, ". alpha")).when(k == 4, s(" pronounced the following verse: ", n + 1, ". ", F.col("text")))
    tail = tail.otherwise(s(" PRONOUNCED the following verse: 999. other. Later pronounced the following verse: ", n + 1, ". omega"))
    text = Q.without_closing_quote(F.concat("text", tail), F.array(n, n + 1))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text).alias("digest"))


SIZE = 400


@query(rf"""WITH t AS (SELECT doc_id, text, {SQL_TOKENS.format('text')} AS w, regexp_extract_all(text, '\S+\s*') AS p FROM documents WHERE text IS NOT NULL), i AS (SELECT *, greatest(0, ceil((coalesce(list_position(list_transform(w, lambda x: contains(x, '@')), true), 0) - 200) / 160.0))::INTEGER AS i FROM t),
o AS (SELECT doc_id, text, CASE WHEN i = 0 THEN 0 ELSE length(regexp_extract(text, '^\s*')) + length(array_to_string(p[1:i * 160], '')) END AS o FROM i), s AS (SELECT doc_id, text, greatest(0, o - {SIZE // 4}) AS s, least(length(text), greatest(0, o - {SIZE // 4}) + {SIZE}) AS e FROM o)
SELECT doc_id, CASE WHEN length(text) <= {SIZE} THEN text ELSE CASE WHEN s > 0 THEN '{Q.RESUMED}' ELSE '' END || regexp_replace(substr(text, s + 1, (e - s)::INTEGER), '^\s+|\s+$', '', 'g') || CASE WHEN e < length(text) THEN '{Q.CUT}' ELSE '' END END AS excerpt FROM s""")
def str_excerpt(spark, d):
    """Four hundred characters around the first window of a text that has an at sign, or its beginning."""
    window = F.array_position(F.transform(T.windows(F.col("text"), 200, 40), lambda w: F.contains(w, F.lit("@"))), True) - 1
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.greatest(window, F.lit(0)).alias("i"))
    return rows.select("doc_id", Q.excerpt(F.col("text"), F.lit(SIZE), Q.window_offset(F.col("text"), F.col("i"), 160)).alias("excerpt"))


@query()
def str_likeness(spark, d):
    """How alike the names of a part and of the part with the next number are, once folded. SQL has no such measure."""
    parts = table(spark, d, "part").select("p_partkey", L.folded(F.col("p_name")).alias("a"))
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return parts.join(after, "p_partkey").select("p_partkey", Q.likeness("a", "b").alias("likeness"))


SQL_CHUNKS = rf"""f AS (SELECT 'story:' || doc_id AS p, doc_id AS n, unnest([{{'s': 'titles', 'k': 'story_titles', 't': lang || ' ' || source, 'w': 0, 'o': 0}},
 {{'s': 'alignment', 'k': 'story_alignment', 't': 'Number ' || doc_id || ' is explained by text ' || doc_id || ' of ' || source || '.', 'w': 0, 'o': 0}},
 {{'s': 'corpus_fact0', 'k': 'story_corpus_fact', 't': CASE WHEN length(text) > 1000 THEN 'Text ' || doc_id || ' has over 1,000 characters.' END, 'w': 0, 'o': 0}},
 {{'s': 'cast', 'k': 'story_cast', 't': 'Cast of story ' || doc_id || ': ' || source, 'w': 0, 'o': 0}},
 {{'s': 'keywords', 'k': 'story_keywords', 't': array_to_string((({SQL_TOKENS.format('text')}))[1:5], ', '), 'w': 0, 'o': 0}},
 {{'s': 'synopsis', 'k': 'story_synopsis', 't': CASE WHEN doc_id % 2 = 0 THEN text END, 'w': 100, 'o': 20}},
 {{'s': 'nidana', 'k': 'story_nidana', 't': regexp_extract(text, '(?s)^(.{{0,600}}?[.!?])\s', 1), 'w': 0, 'o': 0}},
 {{'s': 'vatthu', 'k': 'story_vatthu', 't': text, 'w': 200, 'o': 40}},
 {{'s': 'desanavasane', 'k': 'story_desanavasane', 't': regexp_extract(text, '(?s)^.*\n(.+)$', 1), 'w': 200, 'o': 40}}]) AS c FROM documents
UNION ALL SELECT 'verse:' || item_id, item_id, unnest([{{'s': 'pali_interlinear', 'k': 'verse_pali_interlinear', 't': text, 'w': 100, 'o': 20}}, {{'s': 'en_interlinear', 'k': 'verse_en_interlinear', 't': 'EN ' || text, 'w': 200, 'o': 40}},
 {{'s': 'notes', 'k': 'verse_notes', 't': CASE WHEN item_id % 3 = 0 THEN text || ' ' || text END, 'w': 200, 'o': 40}}, {{'s': 'en_narrative', 'k': 'verse_en_narrative', 't': lower(text), 'w': 200, 'o': 40}}]) FROM benchmark),
w AS (SELECT p || ':' || c.s AS base, n, c.k, c.t, c.w, c.w - c.o AS step, {SQL_TOKENS.format('c.t')} AS l FROM f WHERE c.t <> ''),
k AS (SELECT *, CASE WHEN w = 0 OR len(l) <= w THEN 1 ELSE ceil((len(l) - w) / step::DOUBLE)::INTEGER + 1 END AS many FROM w), i AS (SELECT *, unnest(range(many)) AS i FROM k)"""


@query(f"""WITH {SQL_CHUNKS} SELECT n AS number, CASE WHEN many > 1 THEN base || ':w' || i ELSE base END AS chunk_id, k AS chunk_type, CASE WHEN many > 1 THEN array_to_string(l[i * step + 1 : i * step + w], ' ') ELSE t END AS text,
CASE WHEN many > 1 THEN i END::INTEGER AS window_index, CASE WHEN many > 1 THEN many END AS n_windows, CASE WHEN i > 0 THEN base || ':w' || (i - 1) END AS prev_chunk_id, CASE WHEN i < many - 1 THEN base || ':w' || (i + 1) END AS next_chunk_id FROM i""")
def dom_chunks(spark, d):
    """The thirteen kinds of chunks: nine of documents in the place of stories, four of benchmark items in that of verses."""
    text, number = F.col("text"), F.col("doc_id").cast("string")
    opening, closing = L.sections(text)
    stories = [
        C.Emitter("titles", "story_titles", F.concat("lang", F.lit(" "), "source"), None),
        C.Emitter("alignment", "story_alignment", F.concat(F.lit("Number "), number, F.lit(" is explained by text "), number, F.lit(" of "), "source", F.lit(".")), None),
        C.Emitter("corpus_fact0", "story_corpus_fact", F.when(F.length(text) > 1000, F.concat(F.lit("Text "), number, F.lit(" has over 1,000 characters."))), None),
        C.Emitter("cast", "story_cast", F.concat(F.lit("Cast of story "), number, F.lit(": "), "source"), None),
        C.Emitter("keywords", "story_keywords", F.array_join(F.slice(T.tokens(text), 1, 5), ", "), None),
        C.Emitter("synopsis", "story_synopsis", F.when(F.col("doc_id") % 2 == 0, text), (100, 20)),
        C.Emitter("nidana", "story_nidana", opening, None),
        C.Emitter("vatthu", "story_vatthu", text),
        C.Emitter("desanavasane", "story_desanavasane", closing),
    ]
    verses = [
        C.Emitter("pali_interlinear", "verse_pali_interlinear", text, (100, 20)),
        C.Emitter("en_interlinear", "verse_en_interlinear", F.concat(F.lit("EN "), text)),
        C.Emitter("notes", "verse_notes", F.when(F.col("item_id") % 3 == 0, F.concat(text, F.lit(" "), text))),
        C.Emitter("en_narrative", "verse_en_narrative", F.lower(text)),
    ]
    docs = table(spark, d, "documents").withColumn("number", F.col("doc_id"))
    items = table(spark, d, "benchmark").withColumn("number", F.col("item_id"))
    return C.emit(docs, F.concat(F.lit("story:"), number), stories, ["number"]).unionByName(C.emit(items, F.concat(F.lit("verse:"), F.col("item_id").cast("string")), verses, ["number"]))
