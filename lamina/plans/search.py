"""The composed search over texts and vectors, from questions to bundles of verses and stories.

A chunk is a row of documents with its row of embeddings (doc_id = vec_id); every 50th asks. Eight chunks in a row tell of one
verse, four verses are a chapter, and chapter and label name a story, which explains the verses of its chunks. Every third
chunk belongs to its verse alone. The pair score of the rerank is a formula, as no model is at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.operators import joins as J
from lamina.operators import retrieval as R
from lamina.plans.hybrid import PARTS, SQL_DOT
from lamina.registry import SQL_CONTENT, query, table
from lamina.sources.scratch import stored


def _postings(texts: DataFrame) -> DataFrame:
    """term, id, w: one for each content word of a text. texts: id, text."""
    words = texts.select("id", F.explode(F.array_distinct(F.split(T.plain(F.col("text")), r"\s+"))).alias("term"))
    return words.where(T.is_content(F.col("term"))).withColumn("w", F.lit(1).cast("long"))


def _asked(texts: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of terms, and n, the number of texts that have a content word at all. texts: id, text; terms: term."""
    n = texts.where(F.exists(F.split(T.plain(F.col("text")), r"\s+"), T.is_content)).agg(F.count_distinct("id").alias("n"))
    return stored(_postings(texts).join(terms.select("term").distinct(), "term", "left_semi"), "postings"), n


def _weighted(terms: DataFrame, postings: DataFrame, n: DataFrame) -> DataFrame:
    """q, term, wq: the whole part of the binary logarithm of how rare a term is; terms of over half the rows weigh nothing and go. terms: q, term; n: a row with the number of rows that have terms."""
    df = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    rare = df.select("term", (F.length(F.bin(F.expr("n div df"))) - 1).cast("long").alias("wq")).where("wq > 0")
    return terms.join(rare, "term").select("q", "term", "wq")


SQL_POSTINGS = f"p AS (SELECT id, unnest({SQL_CONTENT.format('text')}) AS term FROM t), i AS (SELECT term, length(bin((SELECT count(DISTINCT id) FROM p) // count(*))) - 1 AS wq FROM p GROUP BY term)"


@query(f"""WITH t AS (SELECT doc_id AS id, text FROM documents), {SQL_POSTINGS}, b AS (SELECT item_id AS q, unnest({SQL_CONTENT.format('text')}) AS term FROM benchmark)
SELECT q, id, score, (row_number() OVER (PARTITION BY q ORDER BY score DESC, id))::INTEGER AS rank FROM (
  SELECT q, p.id, sum(wq)::BIGINT AS score FROM b JOIN i USING (term) JOIN p USING (term) WHERE wq > 0 GROUP BY q, p.id) QUALIFY rank <= 20""")
def rnk_sparse_bounded(spark, d):
    """Lexical top-k of benchmark items over documents by rare words; rows that can't reach an item's k-th place aren't returned by any task."""
    asked = stored(_postings(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")).select(F.col("id").alias("q"), "term"), "asked")
    postings, n = _asked(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), asked)
    return R.bounded_sparse_arm(_weighted(asked, postings, n), postings, 20)


def _story() -> Column:
    return F.when(F.col("vec_id") % 3 > 0, F.concat_ws(".", F.expr("vec_id div 32"), "label")).alias("own")


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """chunks (id, verse, own, label) and explains (story, verse)."""
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 8").alias("verse"), _story(), "label")
    return chunks, stored(chunks.where("own is not null").select(F.col("own").alias("story"), "verse").distinct(), "explains")


SQL_CORPUS = """ch AS (SELECT vec_id AS id, vec_id // 8 AS verse, CASE WHEN vec_id % 3 > 0 THEN (vec_id // 32) || '.' || label END AS own, label FROM embeddings),
ex AS (SELECT DISTINCT own AS story, verse FROM ch WHERE own IS NOT NULL)"""
SQL_BUNDLES = SQL_CORPUS + """, ow AS (SELECT c.id, c.own, e.verse FROM ch c JOIN ex e ON e.story = c.own UNION ALL SELECT id, own, verse FROM ch WHERE own IS NULL),
st AS (SELECT DISTINCT id, own, story FROM ow JOIN ex USING (verse)),
bu AS (SELECT id, (SELECT string_agg(verse, ',' ORDER BY verse) FROM (SELECT DISTINCT e.verse FROM st s JOIN ex e USING (story) WHERE s.id = n.id)) AS verses, stories
  FROM (SELECT id, string_agg(story, ',' ORDER BY story IS DISTINCT FROM own, story) AS stories FROM st GROUP BY id) n)"""
SQL_RANK = """{0} AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM ({1}) QUALIFY rank <= 100)"""
SQL_SEARCH = ", ".join([
    "e AS (SELECT vec_id AS id, embedding, text FROM embeddings JOIN documents ON doc_id = vec_id), t AS (SELECT id, text FROM e)",
    SQL_POSTINGS,
    SQL_RANK.format("dense", f"SELECT a.id AS q, b.id, round({SQL_DOT.format('a.embedding', 'b.embedding')}, 6) AS score FROM e a, e b WHERE a.id % 50 = 0"),
    SQL_RANK.format("sparse", "SELECT a.id AS q, b.id, sum(wq)::BIGINT AS score FROM p a JOIN i USING (term) JOIN p b USING (term) WHERE a.id % 50 = 0 AND wq > 0 GROUP BY ALL"),
    f"""both_arms AS (SELECT q, id FROM dense WHERE rank <= 50 UNION SELECT q, id FROM sparse WHERE rank <= 50),
best AS (SELECT c.q, c.id, i, max({SQL_DOT.format("a.embedding[i*16+1:i*16+16]", "b.embedding[j*16+1:j*16+16]")}) AS best
  FROM both_arms c JOIN e a ON a.id = c.q JOIN e b ON b.id = c.id, range(4) x(i), range(4) y(j) GROUP BY ALL),
multi AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (SELECT q, id, round(avg(best), 6) AS score FROM best GROUP BY ALL)),
fused AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, arm, r, id) AS rank FROM (
  SELECT q, id, round(sum(1.0 / (60 + rank)), 12) AS score, min(arm) AS arm, arg_min(rank, arm) AS r
  FROM (SELECT q, id, rank, 0 AS arm FROM dense UNION ALL SELECT q, id, rank, 1 FROM sparse UNION ALL SELECT q, id, rank, 2 FROM multi) GROUP BY q, id)),
hits AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY (label * 7 + id) % 101 DESC, rank) AS rank FROM fused JOIN ch USING (id) WHERE rank <= 30 AND id <> q),
f AS (SELECT h.*, verses, stories, min(rank) OVER (PARTITION BY q, verses) AS fr FROM hits h JOIN bu USING (id)),
o AS (SELECT *, dense_rank() OVER (PARTITION BY q ORDER BY fr) AS group_rank FROM f),
c AS (SELECT *, max(CASE WHEN group_rank = 5 THEN fr END) OVER (PARTITION BY q) AS cut FROM o)""",
])


@query(f"""WITH {SQL_BUNDLES}, {SQL_SEARCH}, g AS (SELECT q, group_rank, verses, arg_min(id, rank) AS best_id, arg_min(stories, rank) AS stories, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids
  FROM c WHERE group_rank <= 5 AND (cut IS NULL OR rank <= cut) GROUP BY ALL)
SELECT q, group_rank::INTEGER AS group_rank, verses, stories, best_id, ids, md5(coalesce(text, '')) AS passage_md5 FROM g JOIN documents ON doc_id = best_id""")
def dom_search(spark, d):
    """The whole search: dense, lexical and late-interaction arms, fused, the first 30 reranked, resolved to bundles, the first five bundles with all their verses and stories, the chunks found in them and the best passage."""
    e = stored(table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id"), "chunks")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    postings = stored(_postings(e.select(F.col("vec_id").alias("id"), "text")), "postings")
    dense = stored(R.dense_arm(q, v, 100), "dense")
    asked = postings.where("id % 50 = 0").select(F.col("id").alias("q"), "term")
    sparse = stored(R.bounded_sparse_arm(_weighted(asked, postings, postings.agg(F.count_distinct("id").alias("n"))), postings, 100), "sparse")
    both = dense.where("rank <= 50").select("q", "id").union(sparse.where("rank <= 50").select("q", "id")).distinct()
    fused = R.rrf([dense, sparse, R.max_sim(both, q, v, PARTS)])
    chunks, explains = _corpus(spark, d)
    named = fused.where("rank <= 30 and id <> q").select("q", "id", "rank").join(chunks, "id")
    hits = stored(R.rerank_head(named, (F.col("label") * 7 + F.col("id")) % 101).drop("rank").withColumnRenamed("new_rank", "rank"), "hits")
    held = J.bundles(hits.select("id", "verse", "own").distinct(), explains)
    held = stored(held.select("id", F.array_join(F.col("verses").cast("array<string>"), ",").alias("g"), F.array_join("stories", ",").alias("stories")), "bundles")
    first = R.group_dedupe(hits.select("q", "id", "rank").join(held.select("id", "g"), "id"), 5).withColumnRenamed("g", "verses")
    best = first.join(held.select(F.col("id").alias("best_id"), "stories"), "best_id").join(e.select(F.col("vec_id").alias("best_id"), "text"), "best_id")
    return best.select("q", "group_rank", "verses", "stories", "best_id", "ids", F.md5(F.coalesce("text", F.lit(""))).alias("passage_md5"))


@query(f"""WITH {SQL_CORPUS}, vs AS (SELECT DISTINCT a.verse AS key, b.verse FROM ex a JOIN ex b USING (story))
SELECT 'verse' AS kind, a.key, a.verses, b.stories FROM (SELECT key::VARCHAR AS key, string_agg(verse, ',' ORDER BY verse) AS verses FROM vs GROUP BY ALL) a
JOIN (SELECT verse::VARCHAR AS key, string_agg(story, ',' ORDER BY story) AS stories FROM ex GROUP BY ALL) b USING (key)
UNION ALL SELECT 'story', story, string_agg(verse, ',' ORDER BY verse), story FROM ex GROUP BY story""")
def dom_assemble_by(spark, d):
    """Bundles by verse (all stories that explain it, with all their verses) and by story (its verses, without the other stories that explain them)."""
    _, explains = _corpus(spark, d)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",")
    reach = explains.join(explains.select("story", F.col("verse").alias("other")), "story")
    by_verse = reach.groupBy("verse").agg(listed("other").alias("verses"), listed("story").alias("stories")).select(F.lit("verse").alias("kind"), F.col("verse").cast("string").alias("key"), "verses", "stories")
    by_story = explains.groupBy("story").agg(listed("verse").alias("verses")).select(F.lit("story").alias("kind"), F.col("story").alias("key"), "verses", F.col("story").alias("stories"))
    return by_verse.unionByName(by_story)
