"""Hybrid search by unlike arms, its ablations, and what is read off them. Every 50th vector asks.

A vector stands for a chunk: as a whole it is the dense vector, its components of CUT or more are the sparse weights,
its PARTS slices are the vectors of late interaction. The label tells the type of chunk (VERSE: below it, verse_text,
else commentary), label and identifier the bundle (label * 8 + id % 8). Gold bundles of a query are those of its label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.operators import evaluation as E
from lamina.operators import retrieval as R
from lamina.registry import query, table
from lamina.sources.scratch import stored

CUT, PARTS, VERSE = 0.125, 4, 5
ARMS = ("dense", "sparse", "multi", "fused")


def _vectors(spark: SparkSession, d: str, verse_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries (q, qv) and vectors (id, v); verse_only: the mask is applied before anything is ranked."""
    e = table(spark, d, "embeddings")
    chunk_type = F.when(F.col("label") < VERSE, "verse_text").otherwise("commentary")
    v = e.where(chunk_type.startswith("verse_")) if verse_only else e
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _hybrid(q: DataFrame, v: DataFrame) -> dict[str, DataFrame]:
    """The four arms: dense and sparse top 100, late interaction over the union of their top 50, and the three fused."""
    weights = lambda c: F.transform(c, lambda x: F.when(x >= CUT, x).otherwise(F.lit(0.0).cast("float")))
    dense = stored(R.dense_arm(q, v, 100), "dense")
    sparse = stored(R.dense_arm(q.withColumn("qv", weights("qv")), v.withColumn("v", weights("v")), 100), "sparse")
    both = dense.where("rank <= 50").select("q", "id").union(sparse.where("rank <= 50").select("q", "id")).distinct()
    multi = stored(R.max_sim(both, q, v, PARTS), "multi")
    return {"dense": dense, "sparse": sparse, "multi": multi, "fused": R.rrf([dense, sparse, multi])}


def _with_labels(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """hits with their label and bundle."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("label") * 8 + F.col("vec_id") % 8).alias("g"))
    return hits.join(labels, "id")


def _union(rows: dict[str, DataFrame], name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(x)) for x, df in rows.items()])


def _conditions(spark: SparkSession, d: str) -> DataFrame:
    """condition, q, g, label, rank: chunks of five conditions (flat), or the first of each bundle, by the bundle's place. The query's own chunk is no hit."""
    whole = _hybrid(*_vectors(spark, d))
    fused = stored(whole["fused"], "fused")
    verse = _hybrid(*_vectors(spark, d, verse_only=True))["fused"]

    def reranked(hits: DataFrame) -> DataFrame:
        named = _with_labels(spark, d, hits.select("q", "id", "rank"))
        return R.rerank_head(named, (F.col("label") * 7 + F.col("id")) % 101).select("q", "id", "label", "g", F.col("new_rank").alias("rank"))

    base = stored(reranked(fused), "baseline")
    plain = _with_labels(spark, d, fused.select("q", "id", "rank")).select("q", "id", "label", "g", "rank")
    rows = _union({"baseline": base, "verse_only": reranked(verse), "dense_only": reranked(whole["dense"]), "no_rerank": plain, "flat": base}, "condition").where("id <> q")
    w = Window.partitionBy("condition", "q")
    first = rows.groupBy("condition", "q", "g", F.when(F.col("condition") == "flat", F.col("id")).alias("chunk")).agg(F.min("rank").alias("at"), F.first("label").alias("label"))
    return first.select("condition", "q", "g", "label", F.row_number().over(w.orderBy("at")).alias("rank"))


SQL_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
SQL_WEIGHTS = "list_transform({0}.embedding, lambda x: CASE WHEN x >= 0.125 THEN x ELSE 0 END)"
SQL_TOP = """{{p}}{name} AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (
  SELECT a.vec_id AS q, b.vec_id AS id, round({dot}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {{mask}}) QUALIFY rank <= 100)"""
SQL_HYBRID = ", ".join([
    SQL_TOP.format(name="dense", dot=SQL_DOT.format("a.embedding", "b.embedding")),
    SQL_TOP.format(name="sparse", dot=SQL_DOT.format(SQL_WEIGHTS.format("a"), SQL_WEIGHTS.format("b"))),
    f"""{{p}}union50 AS (SELECT q, id FROM {{p}}dense WHERE rank <= 50 UNION SELECT q, id FROM {{p}}sparse WHERE rank <= 50),
{{p}}best AS (SELECT c.q, c.id, i, max({SQL_DOT.format("a.embedding[i*16+1:i*16+16]", "b.embedding[j*16+1:j*16+16]")}) AS best
  FROM {{p}}union50 c JOIN embeddings a ON a.vec_id = c.q JOIN embeddings b ON b.vec_id = c.id, range(4) x(i), range(4) y(j) GROUP BY ALL),
{{p}}multi AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (SELECT q, id, round(avg(best), 6) AS score FROM {{p}}best GROUP BY ALL)),
{{p}}fused AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, arm, r, id) AS rank FROM (
  SELECT q, id, round(sum(1.0 / (60 + rank)), 12) AS score, min(arm) AS arm, arg_min(rank, arm) AS r
  FROM (SELECT q, id, rank, 0 AS arm FROM {{p}}dense UNION ALL SELECT q, id, rank, 1 FROM {{p}}sparse UNION ALL SELECT q, id, rank, 2 FROM {{p}}multi) GROUP BY q, id))""",
])
SQL_WHOLE = SQL_HYBRID.format(p="", mask="true")
SQL_VERSE = SQL_HYBRID.format(p="v_", mask="starts_with(CASE WHEN b.label < 5 THEN 'verse_text' ELSE 'commentary' END, 'verse_')")
SQL_RERANK = """{0} AS (SELECT q, id, label, label * 8 + id % 8 AS g, row_number() OVER (PARTITION BY q ORDER BY (rank > 30), CASE WHEN rank <= 30 THEN (label * 7 + id) % 101 END DESC NULLS LAST, rank) AS rank
  FROM {1} JOIN embeddings ON vec_id = id)"""
SQL_CONDITIONS = ", ".join([SQL_WHOLE, SQL_VERSE, *(SQL_RERANK.format(f"r_{x}", x) for x in ("fused", "v_fused", "dense"))]) + """,
rows AS (SELECT 'baseline' AS condition, * FROM r_fused UNION ALL SELECT 'verse_only', * FROM r_v_fused UNION ALL SELECT 'dense_only', * FROM r_dense
  UNION ALL SELECT 'no_rerank', q, id, label, label * 8 + id % 8, rank FROM fused JOIN embeddings ON vec_id = id UNION ALL SELECT 'flat', * FROM r_fused),
c AS (SELECT condition, q, g, label, row_number() OVER (PARTITION BY condition, q ORDER BY spot) AS rank FROM (
  SELECT condition, q, g, label, CASE WHEN condition = 'flat' THEN id END AS chunk, min(rank) AS spot FROM rows WHERE id <> q GROUP BY ALL))"""


@query(f"WITH {SQL_WHOLE} SELECT q, id, rank::INTEGER AS rank FROM fused WHERE rank <= 10")
def rnk_hybrid(spark, d):
    """Hybrid search: three unlike arms, fused."""
    return _hybrid(*_vectors(spark, d))["fused"].where("rank <= 10").select("q", "id", "rank")


@query(f"WITH {SQL_WHOLE} " + " UNION ALL ".join(f"SELECT '{x}' AS arm, q, id, rank::INTEGER AS rank FROM {x} WHERE rank <= 10" for x in ARMS))
def rnk_arms(spark, d):
    """The arms of the hybrid search side by side."""
    return _union(_hybrid(*_vectors(spark, d)), "arm").where("rank <= 10").select("arm", "q", "id", "rank")


@query(f"WITH {SQL_WHOLE}, h AS (" + " UNION ALL ".join(f"SELECT '{x}' AS arm, q, id, rank FROM {x} WHERE rank <= 10" for x in ARMS) + """),
f AS (SELECT arm, h.q, min(rank) AS rank FROM h JOIN embeddings e ON e.vec_id = h.id JOIN embeddings o ON o.vec_id = h.q WHERE h.id <> h.q AND e.label = o.label GROUP BY ALL),
m AS (SELECT x.arm, o.vec_id AS q, f.rank FROM embeddings o CROSS JOIN (SELECT unnest(['dense', 'sparse', 'multi', 'fused']) AS arm) x LEFT JOIN f ON f.arm = x.arm AND f.q = o.vec_id WHERE o.vec_id % 50 = 0)
SELECT m.arm, count(*) AS n, count(m.rank) AS found, round(avg(m.rank), 4) AS mean_rank, count(*) FILTER (m.rank IS NOT DISTINCT FROM b.rank) AS as_fused FROM m JOIN m b ON b.q = m.q AND b.arm = 'fused' GROUP BY m.arm""")
def agg_arm_diagnosis(spark, d):
    """For each arm: questions with a gold chunk in the first ten, its mean rank over those (null: none), and how often the rank is the fused arm's (both without one, too)."""
    own = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("own"))
    hits = _with_labels(spark, d, rnk_arms(spark, d)).join(own, "q").where("id <> q and label = own")
    at: dict[str, Column] = {x: F.min(F.when(F.col("arm") == x, F.col("rank"))).alias(x) for x in ARMS}
    ranks = own.select("q").join(hits.groupBy("q").agg(*at.values()), "q", "left")
    each = ranks.select("fused", F.explode(F.array(*[F.struct(F.lit(x).alias("arm"), F.col(x).alias("rank")) for x in ARMS])).alias("x")).select("x.*", "fused")
    same = F.count_if(F.col("rank").eqNullSafe(F.col("fused")))
    return each.groupBy("arm").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.round(F.avg("rank"), 4).alias("mean_rank"), same.alias("as_fused"))


@query(f"""WITH {SQL_CONDITIONS}, hit AS (SELECT condition, c.q, min(rank) AS rank FROM c JOIN embeddings o ON o.vec_id = c.q WHERE c.label = o.label GROUP BY ALL)
SELECT x.condition, o.vec_id AS q, o.label AS own, rank::INTEGER AS rank, CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_10, round(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) ELSE 0 END, 6) AS ndcg_10, round(coalesce(1.0::DOUBLE / rank, 0), 6) AS mrr
FROM embeddings o CROSS JOIN (SELECT unnest(['baseline', 'verse_only', 'dense_only', 'no_rerank', 'flat']) AS condition) x LEFT JOIN hit ON hit.q = o.vec_id AND hit.condition = x.condition WHERE o.vec_id % 50 = 0""")
def evl_ablations(spark, d):
    """Five conditions: all arms reranked; under the verse mask; dense only; without a rerank; chunks in place of bundles."""
    own = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("own"))
    hit = _conditions(spark, d).join(own, "q").where("label = own").groupBy("condition", "q").agg(F.min("rank").alias("rank"))
    names = F.explode(F.array(*map(F.lit, ("baseline", "verse_only", "dense_only", "no_rerank", "flat")))).alias("condition")
    return E.ir_metrics(own.select("*", names).join(hit, ["condition", "q"], "left")).select("condition", "q", "own", "rank", "recall_10", "ndcg_10", "mrr")


@query(f"""WITH {SQL_CONDITIONS}, p AS (SELECT q, g FROM c WHERE condition <> 'flat' AND rank <= 3 UNION SELECT vec_id, label * 8 + vec_id % 8 FROM embeddings WHERE vec_id % 50 = 0 UNION SELECT vec_id, (label + 1) % 10 * 8 + vec_id % 8 FROM embeddings WHERE vec_id % 50 = 0)
SELECT q, g, (row_number() OVER (PARTITION BY q ORDER BY md5('lamina:' || q || ':' || g), g))::INTEGER AS place FROM p""")
def rnk_candidate_pool(spark, d):
    """Bundles to be judged: gold, distractors (the next label's), the first three of four conditions; each once, in an order by keyed hash that doesn't tell where one is from."""
    e = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "label")
    bundle = lambda label: (label * 8 + F.col("q") % 8).alias("g")
    found = _conditions(spark, d).where("condition <> 'flat' and rank <= 3").select("q", "g")
    pool = found.union(e.select("q", bundle(F.col("label")))).union(e.select("q", bundle((F.col("label") + 1) % 10))).distinct()
    key = F.md5(F.concat_ws(":", F.lit("lamina"), F.col("q").cast("string"), F.col("g").cast("string")))
    return pool.select("q", "g", F.row_number().over(Window.partitionBy("q").orderBy(key, "g")).alias("place"))
