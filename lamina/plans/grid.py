"""The validation grid: items of benchmark ask documents under six conditions.

A document found is a story: its first line is the verse, the rest the narrative, its source the title; eight in a row explain
one verse. The answer is the share of the question's content words that the context has, as no language model is at hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.operators import grid as G
from lamina.operators import retrieval as R
from lamina.plans.search import SQL_POSTINGS, _asked, _postings, _weighted
from lamina.registry import SQL_CONTENT, query, table
from lamina.sources.scratch import scratch_path, stored

CONDITIONS = ["no_retrieval", "verse_only", "commentary_only", "flat", "full", "production_full"]
#: Hits of a question, and characters of narrative that its contexts hold.
HITS, BUDGET = 5, 12_000


@query(f"""WITH t AS (SELECT doc_id AS id, text FROM documents), {SQL_POSTINGS}, b AS (SELECT item_id AS q, unnest({SQL_CONTENT.format('text')}) AS term FROM benchmark),
h AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY sum(wq) DESC, id) AS rank FROM b JOIN i USING (term) JOIN p USING (term) WHERE wq > 0 GROUP BY q, id QUALIFY rank <= {HITS}),
s AS (SELECT q, id, rank, lang, source, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS verse FROM h JOIN documents ON doc_id = id),
n AS (SELECT *, substr(text, length(verse) + 2) AS narrative FROM s),
w AS (SELECT *, substr(narrative, 1, greatest(0, {BUDGET} - coalesce(sum(length(narrative)) OVER (PARTITION BY q ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT) AS body FROM n),
l AS (SELECT *, '=== ' || (id // 8) || ' ===' || chr(10) || verse AS vl, 'Story ' || id || ' (covers ' || (id // 8) || ')' || chr(10) || 'Title: ' || coalesce(source, '') || CASE WHEN narrative = '' THEN '' ELSE chr(10) || 'Narrative: ' || body END AS sl FROM w),
g AS (SELECT q, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids, string_agg(vl, chr(10) ORDER BY rank) AS verse_only, string_agg(sl, chr(10) ORDER BY rank) AS commentary_only,
  string_agg('[' || coalesce(lang, '') || '] ' || text, chr(10) ORDER BY rank) AS flat, string_agg(vl || chr(10) || sl, chr(10) ORDER BY rank) AS whole FROM l GROUP BY q),
k AS (SELECT 'Documents: ' || count(*) || ', sources: ' || count(DISTINCT source) AS summary FROM documents),
x AS (SELECT item_id AS q, chr((65 + item_id % 5)::INTEGER) AS section, {SQL_CONTENT.format('text')} AS asked, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, verse_only, commentary_only, flat, whole, summary FROM benchmark LEFT JOIN g ON q = item_id CROSS JOIN k),
c AS (SELECT q, section, asked, n, ids, condition, CASE condition WHEN 'verse_only' THEN coalesce(verse_only, '') WHEN 'commentary_only' THEN coalesce(commentary_only, '') WHEN 'flat' THEN coalesce(flat, '')
  WHEN 'full' THEN CASE WHEN section = 'E' THEN summary ELSE coalesce(whole, '') END END AS context FROM x, (SELECT unnest({CONDITIONS}) AS condition)),
a AS (SELECT *, CASE WHEN condition = 'no_retrieval' THEN NULL ELSE n END AS found, CASE WHEN len(asked) > 0 THEN round(len(list_intersect(asked, {SQL_CONTENT.format('context')})) / len(asked), 6) END AS answer FROM c)
SELECT q, section, condition, md5(context) AS context_md5, length(context) AS context_chars, CASE WHEN condition <> 'no_retrieval' THEN ids END AS retrieved, CASE WHEN found = 0 THEN NULL ELSE answer END AS answer,
  CASE WHEN found = 0 THEN 'no_results' WHEN answer IS NULL THEN 'failed' ELSE 'ok' END AS state FROM a""")
def evl_validation_grid(spark, d):
    """Every question under every condition, with what was retrieved, the context, the answer and the cell's state."""
    docs = table(spark, d, "documents")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")
    asked = stored(_postings(items.select(F.col("q").alias("id"), "text")).select(F.col("id").alias("q"), "term"), "asked")
    postings, n = _asked(docs.select(F.col("doc_id").alias("id"), "text"), asked)
    hits = R.bounded_sparse_arm(_weighted(asked, postings, n), postings, HITS).select("q", "id", "rank")

    found = hits.join(docs.select(F.col("doc_id").alias("id"), "lang", "source", F.coalesce("text", F.lit("")).alias("text")), "id")
    found = found.withColumn("verse", F.substring_index("text", "\n", 1))
    found = found.withColumn("narrative", F.expr("substring(text, length(verse) + 2)")).withColumn("body", G.within_budget(F.col("narrative"), BUDGET, "q", "rank"))
    number, blank = F.expr("id div 8"), F.lit("")
    told = F.when(F.col("narrative") == "", "").otherwise(F.concat(F.lit("\nNarrative: "), "body"))
    verse = F.concat(F.lit("=== "), number, F.lit(" ===\n"), "verse")
    story = F.concat(F.lit("Story "), "id", F.lit(" (covers "), number, F.lit(")\nTitle: "), F.coalesce("source", blank), told)
    lines = {"ids": F.col("id").cast("string"), "verse_only": verse, "commentary_only": story, "flat": F.concat(F.lit("["), F.coalesce("lang", blank), F.lit("] "), "text"), "full": F.concat(verse, F.lit("\n"), story)}
    one = found.select("q", F.struct("rank", *[c.alias(name) for name, c in lines.items()]).alias("x")).groupBy("q").agg(F.array_sort(F.collect_list("x")).alias("x"))
    joined = [F.array_join(F.col("x")[name], "," if name == "ids" else "\n").alias(name) for name in lines]
    summary = docs.agg(F.concat(F.lit("Documents: "), F.count("*"), F.lit(", sources: "), F.count_distinct("source")).alias("summary"))
    rows = items.join(one.select("q", F.size("x").alias("n"), *joined), "q", "left").crossJoin(F.broadcast(summary))
    rows = rows.withColumn("section", F.char(F.lit(65) + F.col("q") % 5))

    text = {c: F.coalesce(c, blank) for c in ("verse_only", "commentary_only", "flat", "full")}
    text["full"] = F.when(F.col("section") == "E", F.col("summary")).otherwise(text["full"])
    asks = rows.select("q", "section", F.col("text").alias("question"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", blank).alias("ids"), *[c.alias(name) for name, c in text.items()])
    nothing = F.lit(None).cast("string")
    grid = G.cells(asks, {c: F.col(c) if c in text else nothing for c in CONDITIONS})
    grid = stored(grid.select("q", "section", "condition", "question", "n", "ids", "context"), "grid")

    def answers(todo):
        words = T.content_words(F.col("question"))
        share = F.round(F.try_divide(F.size(F.array_intersect(words, T.content_words(F.col("context")))), F.size(words)), 6)
        looked = F.col("condition") != "no_retrieval"
        out = todo.withColumns({"found": F.when(looked, F.col("n")), "share": share})
        return out.select(
            "q", "section", "condition", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("context_chars"), F.when(looked, F.col("ids")).alias("retrieved"),
            F.when(F.coalesce(F.col("found") != 0, F.lit(True)), F.col("share")).alias("answer"), G.state(F.col("found"), F.col("share")).alias("state"),
        )

    return G.resumed(grid, scratch_path(spark, "answers"), ["q", "condition"], answers, CONDITIONS)
