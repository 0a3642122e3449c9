"""Text work on documents, conversations and names: cleaning, folding, lines, sections, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import lines as L
from lamina.functions import text as T
from lamina.registry import SQL_TOKENS, query, table

TYPOS = {"the": "THE", "and": "AND", "der": "DER"}
ENGLISH, MARKED = ["the", "and", "of", "in", "that", "to"], "[äöüßéèêñóíç]"


@query(r"""WITH t AS (SELECT doc_id, text || chr(12) || 'colophon' AS t, doc_id % 3 AS k FROM documents), p AS (SELECT doc_id, CASE WHEN k = 0 THEN replace(t, '. ', chr(12)) ELSE t END AS t FROM t)
SELECT doc_id, regexp_replace(split_part(split_part(t, chr(12), 1), 'tion', 1), '[\s]+$', '') AS head FROM p""")
def str_truncate_page_break(spark, d):
    """Texts up to their first form feed or marker. A form feed is added at the end, and for each full stop of every third text."""
    t = F.concat("text", F.lit("\fcolophon"))
    t = F.when(F.col("doc_id") % 3 == 0, F.replace(t, F.lit(". "), F.lit("\f"))).otherwise(t)
    return table(spark, d, "documents").select("doc_id", L.truncated(t, ["\f", "tion"]).alias("head"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_lines, len(list_filter(l, lambda x: NOT regexp_matches(x, '^\s*[0-9]*\s*$') AND NOT regexp_matches(x, '(?i)copyright|license|cookie')))::BIGINT AS n_kept FROM l""")
def str_strip_noise_lines(spark, d):
    """Lines without blank ones, page numbers and footers."""
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(L.without_noise(lines, "(?i)copyright|license|cookie")).cast("long").alias("n_kept"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '. ', '-' || chr(10)), '([^\s])-\n[\n ]*', '\1-', 'g'), '[ ]*\n[\n ]*', ' ', 'g'), ' ') AS joined FROM documents""")
def str_join_wrapped(spark, d):
    """Wrapped lines joined, those that end in a hyphen without a space. Full stops are made hyphens at line ends, so that there are some."""
    return table(spark, d, "documents").select("doc_id", L.joined_lines(F.replace("text", F.lit(". "), F.lit("-\n"))).alias("joined"))


@query(r"""SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g') AS text FROM (SELECT doc_id, replace(text, 'e', chr(7) || 'e') AS text FROM documents WHERE length(text) < 500)""")
def str_strip_control(spark, d):
    """Texts without control characters but tabs and line feeds; a bell is put in first."""
    rows = table(spark, d, "documents").where(F.length("text") < 500)
    return rows.select("doc_id", L.without_controls(F.replace("text", F.lit("e"), F.lit("\x07e"))).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(replace(text, 'e', chr(7) || 'e'), '[\x00-\x08\x0b-\x1f]', '', 'g') AS text FROM documents""")
def str_strip_control_all(spark, d):
    """As str_strip_control, over texts of any length."""
    return table(spark, d, "documents").select("doc_id", L.without_controls(F.replace("text", F.lit("e"), F.lit("\x07e"))).alias("text"))


@query(r"""SELECT p_partkey, regexp_replace(translate(lower(nfc_normalize(p_name)), 'ṃṅ', 'ṁṁ'), '[\s.,;:!?"“”’''-]', '', 'g') AS folded FROM part""")
def str_orthographic_fold(spark, d):
    """Names as spellings that only differ in marks share them."""
    return table(spark, d, "part").select("p_partkey", L.folded(F.col("p_name")).alias("folded"))


def _composed(rows: DataFrame) -> DataFrame:
    """Texts in composed form, and whether that is another text."""
    return rows.withColumn("composed", L.nfc("text")).select("doc_id", F.col("composed").alias("text"), (F.col("composed") != F.col("text")).alias("changed"))


@query("SELECT doc_id, nfc_normalize(replace(text, 'o', 'o' || chr(776))) AS text, text IS NOT NULL AND contains(text, 'o') AS changed FROM documents WHERE length(text) < 500")
def str_nfc(spark, d):
    """Composed forms; every o gets a combining mark first."""
    t = F.replace("text", F.lit("o"), F.lit("o\u0308"))
    rows = table(spark, d, "documents").where(F.length("text") < 500).select("doc_id", t.alias("text"))
    return _composed(rows)


@query("SELECT doc_id, nfc_normalize(replace(text, 'o', 'o' || chr(776))) AS text, text IS NOT NULL AND contains(text, 'o') AS changed FROM documents")
def str_nfc_all(spark, d):
    """As str_nfc, over texts of any length; a null text isn't changed."""
    rows = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("o"), F.lit("o\u0308")).alias("text"))
    return _composed(rows).withColumn("changed", F.coalesce("changed", F.lit(False)))


@query(r"SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^\x00-\x7f]', '', 'g')) AS folded FROM documents")
def str_ascii_fold(spark, d):
    """Texts in ASCII: marks go, other characters beyond it too."""
    return table(spark, d, "documents").select("doc_id", L.ascii_fold("text").alias("folded"))


@query("""WITH h AS (SELECT o_orderkey, o_orderkey % 400 + 1 AS a, (o_orderkey // 7) % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 3 THEN NULL ELSE array_to_string(range(a, a + k + 1), ',') END AS verses FROM h""")
def str_range_header(spark, d):
    """Ranges of numbers in headers as lists: a single one, or a-b. Headers are made from order numbers."""
    a, k = F.col("o_orderkey") % 400 + 1, F.expr("o_orderkey div 7") % 4
    header = F.when(k == 3, "no numbers").when(k == 0, F.concat(F.lit("Dhp "), a.cast("string"), F.lit(". "))).otherwise(F.concat(F.lit("(Dhp "), a.cast("string"), F.lit("-"), (a + k).cast("string"), F.lit(")")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(L.header_range(header), lambda x: x.cast("string")), ",").alias("verses"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), w AS (SELECT doc_id, l, string_split_regex(lower(l), '\\s+') AS w FROM l WHERE trim(l) <> ''),
n AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains(['the', 'and', 'of', 'in', 'that', 'to'], x))) AS e, len(list_filter(w, lambda x: regexp_matches(x, '[äöüßéèêñóíç]'))) AS m FROM w)
SELECT doc_id, count(*) FILTER (e >= m AND e > 0) AS english, count(*) FILTER (m > e) AS marked, count(*) FILTER (e = 0 AND m = 0) AS unknown FROM n GROUP BY doc_id""".replace("\\\\", "\\"))
def str_line_language(spark, d):
    """Lines by language: stop words against words with marks; ties are English, none of both unknown."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l") != "")
    kind = rows.select("doc_id", L.line_language(F.col("l"), ENGLISH, MARKED).alias("k"))
    return kind.groupBy("doc_id").agg(*[F.count_if(F.col("k") == x).alias(x) for x in ("english", "marked", "unknown")])


@query(r"""SELECT doc_id, regexp_extract(text, '(?s)^(.{0,600}?[.!?])\s', 1) AS opening, coalesce(regexp_extract(text, '(?s)^.*\n(.+)$', 1), '') AS closing FROM documents WHERE text IS NOT NULL""")
def str_sections(spark, d):
    """The first sentence, if it ends within 600 characters, and what follows the last line feed."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", *L.sections(F.col("text")))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\bthe\\b', 'THE', 'g'), '\\band\\b', 'AND', 'g'), '\\bder\\b', 'DER', 'g') AS text, (len(regexp_extract_all(text, '\\bthe\\b')) + len(regexp_extract_all(text, '\\band\\b')) + len(regexp_extract_all(text, '\\bder\\b')))::BIGINT AS n FROM documents WHERE regexp_matches(text, '^[\\x00-\\x7f]*$')".replace("\\\\", "\\"))
def str_typo_corrections(spark, d):
    """A dictionary of whole words replaced, and how many were. Texts in ASCII, as engines differ in what a word's end is in others."""
    rows = table(spark, d, "documents").where(F.col("text").rlike(r"^[\x00-\x7f]*$"))
    return rows.select("doc_id", *L.corrected(F.col("text"), TYPOS))


@query()
def str_typo_corrections_all(spark, d):
    """As str_typo_corrections, over all texts. Without SQL, as engines differ in where a word with letters beyond ASCII ends."""
    return table(spark, d, "documents").select("doc_id", *L.corrected(F.col("text"), TYPOS))


BUDGET = 600
SQL_BUDGET = f"""o AS (SELECT conv_id, turn, role, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations),
b AS (SELECT conv_id, turn, role, CASE WHEN before + length(text) <= {BUDGET} THEN text WHEN before < {BUDGET} THEN substr(text, 1, ({BUDGET} - before)::INTEGER) || ' [...]' END AS text FROM o)"""


def _budgeted(spark, d):
    turns = table(spark, d, "conversations")
    return L.within_budget(turns, "conv_id", "turn", BUDGET)


@query(f"WITH {SQL_BUDGET} SELECT conv_id, turn, text FROM b WHERE text IS NOT NULL")
def str_budget_trim(spark, d):
    """Turns of each conversation up to 600 characters; what is cut is marked."""
    return _budgeted(spark, d).select("conv_id", "turn", "text")


@query(f"WITH {SQL_BUDGET} SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS context, (sum(length(text)) // 4)::BIGINT AS n_tokens FROM b WHERE text IS NOT NULL GROUP BY conv_id")
def str_context(spark, d):
    """A conversation's prompt and the estimate of its tokens. What is gathered is bounded by the budget: empty turns past it are left out too."""
    line = F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.col("text")).alias("line"))
    rows = _budgeted(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("l"), F.sum(F.length("text")).alias("n"))
    return rows.select("conv_id", F.array_join(F.col("l.line"), "\n").alias("context"), F.expr("n div 4").alias("n_tokens"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[,;:–?!.]')) AS s FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(lower(s), '[aeiouäöüéèêóíāīū]')) AS v FROM s WHERE trim(s) <> '')
SELECT doc_id, count(*) AS segments, count(*) FILTER (v < 4 OR v > 18) AS anomalies, round(count(*) FILTER (v < 4 OR v > 18) / count(*)::DOUBLE, 4) AS rate FROM n GROUP BY doc_id""")
def agg_segment_anomalies(spark, d):
    """Parts of texts between marks whose number of vowels is outside 4 to 18."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "[,;:–?!.]")).alias("s")).where(F.trim("s") != "")
    v = F.regexp_count(F.lower("s"), F.lit("[aeiouäöüéèêóíāīū]"))
    odd = F.count_if((v < 4) | (v > 18))
    return rows.groupBy("doc_id").agg(F.count("*").alias("segments"), odd.alias("anomalies"), F.round(odd / F.count("*"), 4).alias("rate"))


@query("""WITH n AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey)
SELECT l_orderkey, 'lines ' || CASE WHEN len(n) > 1 AND n[-1] - n[1] + 1 = len(n) THEN n[1] || '-' || n[-1] ELSE array_to_string(n, ', ') END || CASE WHEN len(n) = 1 THEN ' was' ELSE ' were' END || ' returned or accepted' AS fact FROM n""")
def str_facts(spark, d):
    """A sentence for each order, with a range where its numbers follow one another."""
    rows = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    verb = F.when(F.size("n") == 1, " was").otherwise(" were")
    return rows.select("l_orderkey", F.concat(F.lit("lines "), L.number_range(F.col("n")), verb, F.lit(" returned or accepted")).alias("fact"))


@query("SELECT md5(concat_ws('|', conv_id, trim(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), ' '))) AS signature, count(*) AS n FROM conversations GROUP BY signature".replace("\\\\", "\\"))
def str_claim_signature(spark, d):
    """Turns of a conversation that only differ in white space share a signature."""
    key = F.md5(F.concat_ws("|", F.col("conv_id").cast("string"), T.collapsed(F.col("text"))))
    return table(spark, d, "conversations").groupBy(key.alias("signature")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT conv_id, turn, {SQL_TOKENS.format('text')} AS w FROM conversations), n AS (SELECT *, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM c)
SELECT conv_id, turn, len(list_filter(list_distinct(w), lambda y: NOT list_contains(x, y))) AS own FROM n WHERE x IS NOT NULL""")
def str_separating_words(spark, d):
    """How many distinct words of a turn the next one hasn't."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    rows = rows.withColumn("x", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("x is not null")
    return rows.select("conv_id", "turn", F.size(F.array_except("w", "x")).cast("long").alias("own"))


@query(r"""SELECT doc_id, regexp_replace(text, '([0-9])\. ', '\1.977 ', 'g') AS text FROM documents WHERE text IS NOT NULL""")
def str_footnote_marks(spark, d):
    """Texts without footnote numbers, which every full stop gets; after a digit they belong to the number and stay."""
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", L.without_marks(F.replace("text", F.lit(". "), F.lit(".977 ")), F.array(F.lit("12"), F.lit("977"))).alias("text"))


@query(r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, ' ?(?:\{[0-9]+\.[0-9]+\}|\[[0-9]+(?:\.[0-9]+)?\])', '', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, list_filter(list_transform(l, lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> '') AS l FROM t),
i AS (SELECT doc_id, list_transform(l, lambda x: '   ' || trim(regexp_replace(regexp_replace(x, '^ +', ''), ' {2,}', ' ', 'g'), ' ')) AS l FROM f)
SELECT doc_id, array_to_string(l, chr(10)) AS text FROM i""")
def str_body(spark, d):
    """Lines of texts cleaned; indents, page numbers in brackets, blank lines and form feeds are put in first."""
    t = F.regexp_replace("text", r"(?m)^ *(?=\S)", "   ")
    t = F.replace(F.replace(t, F.lit(", "), F.lit(" [12.3],  ")), F.lit("\n"), F.lit(" {1.22}\n \f\n"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", L.body(t, F.array().cast("array<string>")).alias("text"))
