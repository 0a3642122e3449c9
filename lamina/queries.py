"""The registered queries of the reference's operators, and their SQL. Names begin with the survey's categories."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.operators import evaluation as E
from lamina.operators import joins as J
from lamina.operators import retrieval as R
from lamina.plans import audits, books, gates, grid, hybrid, pages, quotes, records, reports, search, tables, texts  # noqa: F401  they register queries too
from lamina.registry import ORACLES, QUERIES, SQL_CONTENT, SQL_TOKENS, query, table  # noqa: F401
from lamina.sources.scratch import stored

# --- retrieval: every 100th vector asks, in queries named _50 every 50th; a vector's label is its group --------------


def _arms(spark: SparkSession, d: str, k: int = 50, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """Two arms: inner product of whole vectors, and of their first 16 components."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    head = lambda c: F.slice(c, 1, 16)
    return R.dense_arm(q, v, k), R.dense_arm(q.withColumn("qv", head("qv")), v.withColumn("v", head("v")), k)


def _labelled(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    return hits.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("g")), "id")


SQL_ARM = """{name} AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (
  SELECT a.vec_id AS q, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding{cut}, b.embedding{cut}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) QUALIFY rank <= {k})"""
SQL_ARMS = SQL_ARM.format(name="a", cut="", k=50) + ", " + SQL_ARM.format(name="b", cut="[1:16]", k=50)
SQL_RRF = """f AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, arm, r, id) AS rank FROM (
  SELECT q, id, round(sum(1.0 / ({k} + rank)), 12) AS score, min(arm) AS arm, arg_min(rank, arm) AS r FROM (SELECT q, id, rank, 0 AS arm FROM a UNION ALL SELECT q, id, rank, 1 FROM b) GROUP BY q, id))"""


@query(f"WITH {SQL_ARMS} SELECT q, id, rank::INTEGER AS rank FROM a WHERE rank <= 10")
def rnk_dense_topk(spark, d, every=100):
    """Exact dense top-k. Here and below: ranks, not scores, are returned, as sums of doubles depend on their order."""
    return _arms(spark, d, every=every)[0].where("rank <= 10").select("q", "id", "rank")


def _terms(df: DataFrame, id: str, name: str) -> DataFrame:
    """A row for each word of a text, as often as it is there."""
    words = F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}_\s]", " ")), r"\s+")
    return df.select(F.col(id).alias(name), F.explode(words).alias("term")).where("term <> ''")


SQL_TERMS = "SELECT {id} AS {name}, term, count(*) AS w FROM (SELECT {id}, unnest(" + SQL_TOKENS.format("lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'))") + ") AS term FROM {table}) GROUP BY ALL"


@query(
    "WITH qt AS (" + SQL_TERMS.format(id="item_id", name="q", table="benchmark") + "), p AS (" + SQL_TERMS.format(id="doc_id", name="id", table="documents") + """)
SELECT q, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (
  SELECT q, id, sum(qt.w * p.w)::BIGINT AS score FROM qt JOIN p ON qt.term = p.term GROUP BY q, id)) WHERE rank <= 20"""
)
def rnk_sparse_topk(spark, d):
    """Lexical top-k of benchmark items over documents by term counts."""
    terms = _terms(table(spark, d, "benchmark"), "item_id", "q").groupBy("q", "term").agg(F.count("*").alias("wq"))
    return R.sparse_arm(terms, _terms(table(spark, d, "documents"), "doc_id", "id").withColumn("w", F.lit(1)), 20)


@query(
    "WITH qt AS (" + SQL_TERMS.format(id="item_id", name="q", table="benchmark") + "), p AS (" + SQL_TERMS.format(id="doc_id", name="id", table="documents") + """),
s AS (SELECT q, id, sum(qt.w * p.w)::BIGINT AS score FROM qt JOIN p ON qt.term = p.term GROUP BY q, id),
o AS (SELECT b.q, d.id, coalesce(s.score, 0) AS score FROM (SELECT DISTINCT item_id AS q FROM benchmark) b CROSS JOIN (SELECT DISTINCT doc_id AS id FROM documents) d LEFT JOIN s ON s.q = b.q AND s.id = d.id)
SELECT q, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM o) WHERE rank <= 20"""
)
def rnk_sparse_topk_filled(spark, d):
    """As rnk_sparse_topk, but every item gets 20 rows: rows without a common term score zero and fill up, smallest ids first."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("q"))
    return R.filled(stored(rnk_sparse_topk(spark, d), "hits"), items, table(spark, d, "documents").select(F.col("doc_id").alias("id")), 20)


@query(f"WITH {SQL_ARMS}, {SQL_RRF.format(k=60)} SELECT q, id, rank::INTEGER AS rank FROM f")
def rnk_rrf(spark, d, every=100):
    return R.rrf(list(_arms(spark, d, every=every))).select("q", "id", "rank")


@query(
    "WITH " + SQL_ARMS + ", " + ", ".join(f"k{k} AS (WITH {SQL_RRF.format(k=k)} SELECT * FROM f)" for k in (10, 20, 40, 60))
    + " " + " UNION ALL ".join(f"SELECT {k} AS k, q, id, rank::INTEGER AS rank FROM k{k} WHERE rank <= 10" for k in (10, 20, 40, 60))
)
def rnk_rrf_k_sweep(spark, d, every=100):
    arms = [stored(a, "arm") for a in _arms(spark, d, every=every)]
    out = None
    for k in (10, 20, 40, 60):
        one = R.rrf(arms, k).where("rank <= 10").select(F.lit(k).alias("k"), "q", "id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


SQL_SCALED = "SELECT q, id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM {0} WINDOW w AS (PARTITION BY q)"


@query(f"""WITH {SQL_ARMS}, s AS (SELECT q, id, round(sum(s), 6) AS score FROM ({SQL_SCALED.format('a')} UNION ALL {SQL_SCALED.format('b')}) GROUP BY q, id)
SELECT q, id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, id))::INTEGER AS rank FROM s""")
def rnk_score_fusion(spark, d, every=100):
    return R.score_fusion(list(_arms(spark, d, every=every))).select("q", "id", "rank")


@query(f"""WITH {SQL_ARMS}, {SQL_RRF.format(k=60)}, s AS (SELECT f.*, (e.label * 7 + f.id) % 101 AS pair FROM f JOIN embeddings e ON e.vec_id = f.id)
SELECT q, id, rank::INTEGER AS rank, (row_number() OVER (PARTITION BY q ORDER BY (rank > 30), CASE WHEN rank <= 30 THEN pair END DESC NULLS LAST, rank))::INTEGER AS new_rank FROM s""")
def rnk_rerank_head_tail(spark, d, every=100):
    """The first 30 by another score, a stand-in for a cross-encoder; the tail keeps its order."""
    hits = _labelled(spark, d, R.rrf(list(_arms(spark, d, every=every))))
    return R.rerank_head(hits, (F.col("g") * 7 + F.col("id")) % 101).select("q", "id", "rank", "new_rank")


SQL_DEDUPE = """h AS (SELECT f.q, f.id, f.rank, e.label AS g FROM f JOIN embeddings e ON e.vec_id = f.id WHERE f.rank <= 30),
p AS (SELECT *, min(rank) OVER (PARTITION BY q, g) AS fr FROM h),
o AS (SELECT *, dense_rank() OVER (PARTITION BY q ORDER BY fr) AS group_rank FROM p),
c AS (SELECT *, max(CASE WHEN group_rank = {k} THEN fr END) OVER (PARTITION BY q) AS cut FROM o)"""


@query(f"""WITH {SQL_ARMS}, {SQL_RRF.format(k=60)}, {SQL_DEDUPE.format(k=5)}
SELECT q, group_rank::INTEGER AS group_rank, g, arg_min(id, rank) AS best_id, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids
FROM c WHERE group_rank <= 5 AND (cut IS NULL OR rank <= cut) GROUP BY q, group_rank, g""")
def dom_query(spark, d, every=100):
    """Hybrid retrieval of whole groups: two arms, fused, deduplicated to the first five groups."""
    hits = _labelled(spark, d, R.rrf(list(_arms(spark, d, every=every))).where("rank <= 30"))
    return R.group_dedupe(hits, 5)


# --- evaluation ------------------------------------------------------------------------------------------------------


def _first_hits(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    """Condition, query, its group, and the rank of the first other vector of the query's label (null: none)."""
    e = table(spark, d, "embeddings")
    own = e.select(F.col("vec_id").alias("q"), F.col("label").alias("own")).where(f"q % {every} = 0")
    dense, head = _arms(spark, d, every=every)
    out = None
    for name, hits in (("dense_only", dense), ("head_only", head), ("fused", R.rrf([dense, head]))):
        hit = _labelled(spark, d, hits).where("id <> q").join(own.select("q", "own"), "q").where("g = own").groupBy("q").agg(F.min("rank").alias("rank"))
        one = own.join(hit, "q", "left").withColumn("condition", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


SQL_HITS = f"""{SQL_ARMS}, {SQL_RRF.format(k=60)}, own AS (SELECT vec_id AS q, label AS own FROM embeddings WHERE vec_id % 100 = 0),
r AS (SELECT 'dense_only' AS condition, * FROM a UNION ALL SELECT 'head_only', * FROM b UNION ALL SELECT 'fused', * FROM f),
hit AS (SELECT condition, r.q, min(rank) AS rank FROM r JOIN embeddings e ON e.vec_id = r.id JOIN own ON own.q = r.q WHERE r.id <> r.q AND e.label = own.own GROUP BY ALL),
m AS (SELECT c.condition, own.q, own.own, hit.rank FROM own CROSS JOIN (SELECT DISTINCT condition FROM r) c LEFT JOIN hit ON hit.q = own.q AND hit.condition = c.condition),
x AS (SELECT *, CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_1, CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_3, CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_5,
  CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_10, round(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) ELSE 0 END, 6) AS ndcg_10, round(coalesce(1.0::DOUBLE / rank, 0), 6) AS mrr FROM m)"""


@query(f"WITH {SQL_HITS} SELECT condition, q, own, rank::INTEGER AS rank, recall_1, recall_3, recall_5, recall_10, ndcg_10, mrr FROM x")
def evl_ir_metrics(spark, d, every=100):
    return E.ir_metrics(_first_hits(spark, d, every))


@query(f"""WITH {SQL_HITS} SELECT condition, own, grouping(own)::INTEGER AS level, count(*) AS n, round(avg(recall_1), 4) AS recall_1, round(avg(recall_10), 4) AS recall_10, round(avg(ndcg_10), 4) AS ndcg_10, round(avg(mrr), 4) AS mrr
FROM x GROUP BY GROUPING SETS ((condition), (condition, own))""")
def evl_grouping_sets(spark, d, every=100):
    """Means over all questions and by type, in one pass."""
    sets = E.ir_metrics(_first_hits(spark, d, every)).groupingSets([["condition"], ["condition", "own"]], "condition", "own")
    means = [F.round(F.avg(c), 4).alias(c) for c in ("recall_1", "recall_10", "ndcg_10", "mrr")]
    return sets.agg(F.grouping("own").cast("int").alias("level"), F.count("*").alias("n"), *means)


@query(f"""WITH {SQL_HITS}, g AS (SELECT condition, round(avg(ndcg_10), 4) AS m FROM x GROUP BY condition)
SELECT g.condition, round(b.m - g.m, 4) AS delta FROM g CROSS JOIN (SELECT m FROM g WHERE condition = 'fused') b WHERE g.condition <> 'fused'""")
def evl_delta(spark, d, every=100):
    """What each ablation costs against the baseline: the difference of the means as reported, that is, of four digits."""
    means = E.ir_metrics(_first_hits(spark, d, every)).groupBy("condition").agg(F.round(F.avg("ndcg_10"), 4).alias("m"))
    base = means.where("condition = 'fused'").select(F.col("m").alias("base"))
    return means.where("condition <> 'fused'").crossJoin(F.broadcast(base)).select("condition", F.round(F.col("base") - F.col("m"), 4).alias("delta"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY c) - 1 AS i, num, den FROM (SELECT doc_id % 997 AS c, sum((quality = toxic)::INTEGER) AS num, count(*) AS den FROM labels GROUP BY c)),
n AS (SELECT count(*) AS n FROM r),
dr AS (SELECT b, (floor(('0x' || substr(md5(concat_ws(':', b, slot, 'lamina')), 1, 8))::BIGINT * n.n / 4294967296.0))::BIGINT AS i FROM n, range(0, 200) t(b), (SELECT i AS slot FROM r)),
m AS (SELECT b, round(sum(num)::DOUBLE / sum(den), 9) AS m FROM dr JOIN r USING (i) GROUP BY b),
s AS (SELECT list_sort(list(m)) AS s FROM m)
SELECT (SELECT round(sum(num)::DOUBLE / sum(den), 9) FROM r) AS mean, s[6] AS low, s[196] AS high FROM s""")
def boot_paired(spark, d):
    """Interval of the agreement of two labels, in at most 997 clusters of rows, not paired; boot_paired_delta is the paired one. Draws are hashes, so that other engines make the same."""
    agree = F.sum((F.col("quality") == F.col("toxic")).cast("int"))
    return E.bootstrap(_numbered(table(spark, d, "labels").groupBy((F.col("doc_id") % 997).alias("c")).agg(agree.alias("num"), F.count("*").alias("den"))), 200, "lamina")


def _numbered(clusters: DataFrame) -> DataFrame:
    """Clusters (997 at most) with their number, from 0."""
    return clusters.select((F.row_number().over(Window.orderBy("c")) - 1).cast("long").alias("i"), "num", "den")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY c) - 1 AS i, num, den FROM (SELECT conv_id % 997 AS c, sum((role = 'user')::INTEGER) AS num, count(*) AS den FROM conversations GROUP BY c)),
n AS (SELECT count(*) AS n FROM r),
dr AS (SELECT b, (floor(('0x' || substr(md5(concat_ws(':', b, slot, 'cluster')), 1, 8))::BIGINT * n.n / 4294967296.0))::BIGINT AS i FROM n, range(0, 200) t(b), (SELECT i AS slot FROM r)),
m AS (SELECT b, round(sum(num)::DOUBLE / sum(den), 9) AS m FROM dr JOIN r USING (i) GROUP BY b),
s AS (SELECT list_sort(list(m)) AS s FROM m)
SELECT (SELECT round(sum(num)::DOUBLE / sum(den), 9) FROM r) AS mean, s[6] AS low, s[196] AS high FROM s""")
def boot_cluster(spark, d):
    """Interval of a ratio of sums, resampled by 997 clusters of conversations at most; boot_cluster_conversations has no such bound."""
    user = F.count_if(F.col("role") == "user")
    return E.bootstrap(_numbered(table(spark, d, "conversations").groupBy((F.col("conv_id") % 997).alias("c")).agg(user.alias("num"), F.count("*").alias("den"))), 200, "cluster")


@query(f"""WITH {SQL_ARM.format(name="a", cut="", k=10).replace("vec_id % 100", "vec_id % 50")},
h AS (SELECT a.q, a.id, a.rank, e.vec_id // 8 AS key, CASE WHEN e.vec_id % 3 > 0 THEN e.label END AS own FROM a JOIN embeddings e ON e.vec_id = a.id),
m AS (SELECT DISTINCT vec_id // 8 AS key, label AS g FROM embeddings),
x AS (SELECT q, id, rank, key, own AS g, 0 AS late FROM h WHERE own IS NOT NULL UNION ALL SELECT q, id, rank, key, m.g, 1 FROM h JOIN m USING (key) WHERE h.own IS NULL OR m.g <> h.own)
SELECT q, id, rank::INTEGER AS rank, key, g AS "group", (row_number() OVER (PARTITION BY q, id ORDER BY late, g) - 1)::INTEGER AS place FROM x""")
def dom_assemble(spark, d):
    """The groups that each of a question's ten hits stands for. Eight vectors share a key; a group is a label; every third vector stands for its key alone."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    hits = R.dense_arm(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)
    keys = e.select(F.col("vec_id").alias("id"), F.expr("vec_id div 8").alias("key"), "label")
    own = F.when(F.col("id") % 3 > 0, F.col("label")).alias("own")
    found = J.assembled(hits.join(keys, "id").select("q", "id", "rank", "key", own), keys.select("key", F.col("label").alias("group")))
    return found.select("q", "id", "rank", "key", "group", "place")


#: Searches whose query set is every 50th vector too, as name_50: their SQL differs in that only.
SEARCHES = [dom_query, rnk_dense_topk, rnk_rrf, rnk_rrf_k_sweep, rnk_score_fusion, rnk_rerank_head_tail, evl_ir_metrics, evl_grouping_sets, evl_delta, tables.rnk_max_sim]
for _f in SEARCHES:
    QUERIES[f"{_f.__name__}_50"] = partial(_f, every=50)
    ORACLES[f"{_f.__name__}_50"] = re.sub(r"vec_id % (100|250) = 0", "vec_id % 50 = 0", ORACLES[_f.__name__])


SQL_BOOT = """n AS (SELECT count(*) AS n FROM r),
dr AS (SELECT b, (floor(('0x' || substr(md5(concat_ws(':', b, slot, '{seed}')), 1, 8))::BIGINT * n.n / 4294967296.0))::BIGINT AS i FROM n, range(0, 2000) t(b), (SELECT i AS slot FROM r)),
m AS (SELECT b, round(sum(num)::DOUBLE / sum(den), 9) AS m FROM dr JOIN r USING (i) GROUP BY b),
s AS (SELECT list_sort(list(m)) AS s FROM m)
SELECT (SELECT round(sum(num)::DOUBLE / sum(den), 9) FROM r) AS mean, s[51] AS low, s[1951] AS high FROM s"""


@query(f"""WITH r AS (WITH {SQL_HITS.replace('vec_id % 100', 'vec_id % 50')}, p AS (SELECT q, sum(CASE condition WHEN 'fused' THEN 1 WHEN 'dense_only' THEN -1 ELSE 0 END * round(ndcg_10 * 1000000)::BIGINT)::BIGINT AS num, 1000000 AS den FROM x GROUP BY q) SELECT row_number() OVER (ORDER BY q) - 1 AS i, num, den FROM p),
{SQL_BOOT.format(seed='delta')}""")
def boot_paired_delta(spark, d):
    """Interval of the mean difference in nDCG of fused and dense_only, paired by question: 2,000 resamples of questions. Differences are whole millionths, so that sums are exact."""
    sign = F.when(F.col("condition") == "fused", 1).when(F.col("condition") == "dense_only", -1).otherwise(0)
    pairs = E.ir_metrics(_first_hits(spark, d, 50)).groupBy("q").agg(F.sum(sign * F.round(F.col("ndcg_10") * 1000000).cast("long")).alias("num"))
    return E.bootstrap(E.numbered(pairs, [], ["q"]).select("i", "num", F.lit(1000000).cast("long").alias("den")), 2000, "delta")


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY c) - 1 AS i, num, den FROM (SELECT conv_id AS c, sum((role = 'user')::INTEGER) AS num, count(*) AS den FROM conversations GROUP BY c)), {SQL_BOOT.format(seed='cluster')}""")
def boot_cluster_conversations(spark, d):
    """Interval of a ratio of sums: 2,000 resamples of whole conversations, each a unit of its own."""
    user = F.count_if(F.col("role") == "user")
    sums = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("c")).agg(user.alias("num"), F.count("*").alias("den"))
    return E.bootstrap(E.numbered(sums, [], ["c"]).select("i", "num", "den"), 2000, "cluster")


SQL_POISSON = f"""h AS (SELECT g, md5(concat_ws(':', g, c, '{{seed}}')) AS h, num, den FROM r, range(0, 500) t(g)),
v AS (SELECT 4 * g + j AS b, ('0x' || substr(h, 8 * j + 1, 8))::BIGINT AS v, num, den FROM h, range(0, 4) u(j)),
w AS (SELECT b, {' + '.join(f'(v >= {t})::INTEGER' for t in E.POISSON)} AS w, num, den FROM v),
m AS (SELECT b, CASE WHEN sum(w * den) = 0 THEN 0 ELSE round(sum(w * num)::DOUBLE / sum(w * den), 9) END AS m FROM w GROUP BY b),
s AS (SELECT list_sort(list(m)) AS s FROM m)
SELECT (SELECT round(sum(num)::DOUBLE / sum(den), 9) FROM r) AS mean, s[51] AS low, s[1951] AS high FROM s"""


@query(f"""WITH r AS (SELECT conv_id AS c, sum((role = 'user')::INTEGER) AS num, count(*) AS den FROM conversations GROUP BY c), {SQL_POISSON.format(seed='cluster')}""")
def boot_poisson_conversations(spark, d):
    """As boot_cluster_conversations, with weights in place of draws: no draw is a row that is shuffled."""
    user = F.count_if(F.col("role") == "user")
    return E.poisson_bootstrap(table(spark, d, "conversations").groupBy(F.col("conv_id").alias("c")).agg(user.alias("num"), F.count("*").alias("den")), "c", 2000, "cluster")


@query(f"""WITH r AS (SELECT doc_id AS c, sum((quality = 1)::INTEGER - (toxic = 1)::INTEGER)::BIGINT AS num, count(*) AS den FROM labels GROUP BY c), {SQL_POISSON.format(seed='delta')}""")
def boot_poisson_delta(spark, d):
    """Interval of the mean difference of two 0/1 marks, paired by document: 2,000 weighted resamples."""
    paired = F.sum((F.col("quality") == 1).cast("long") - (F.col("toxic") == 1).cast("long"))
    return E.poisson_bootstrap(table(spark, d, "labels").groupBy(F.col("doc_id").alias("c")).agg(paired.alias("num"), F.count("*").alias("den")), "c", 2000, "delta")


ROLES = ["user", "assistant", "system"]


def _role_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's role, and the role that follows from its place: the first of a conversation, or even and odd turns."""
    said = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    return table(spark, d, "conversations").select(F.col("role").alias("gold"), said.alias("predicted"))


SQL_MATRIX = """p AS (SELECT role AS gold, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS predicted FROM conversations),
dom AS (SELECT unnest(['user', 'assistant', 'system']) AS l), mat AS (SELECT g.l AS gold, q.l AS predicted, (SELECT count(*) FROM p WHERE p.gold = g.l AND p.predicted = q.l) AS n FROM dom g, dom q)"""


@query(f"WITH {SQL_MATRIX} SELECT * FROM mat")
def agg_confusion_dense(spark, d):
    return E.confusion(_role_pairs(spark, d), ROLES)


SQL_PRF = """h AS (SELECT l AS label, (SELECT sum(n) FROM mat WHERE gold = l) AS support, (SELECT sum(n) FROM mat WHERE predicted = l) AS found, (SELECT sum(n) FROM mat WHERE gold = l AND predicted = l) AS hit FROM dom),
pr AS (SELECT label, support::BIGINT AS support, CASE WHEN found = 0 THEN 0 ELSE hit::DOUBLE / found END AS p, CASE WHEN support = 0 THEN 0 ELSE hit::DOUBLE / support END AS r FROM h)"""


@query(f"WITH {SQL_MATRIX}, {SQL_PRF} SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr")
def agg_precision_recall(spark, d):
    return E.precision_recall(E.confusion(_role_pairs(spark, d), ROLES))


@query(f"""WITH {SQL_MATRIX}, {SQL_PRF}, f AS (SELECT support, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr)
SELECT round(avg(f1), 5) AS macro_f1_all, round(avg(f1) FILTER (support > 0), 5) AS macro_f1_supported FROM f""")
def agg_macro_f1(spark, d):
    """Both definitions: over all labels, and over those that occur."""
    f = E.precision_recall(E.confusion(_role_pairs(spark, d), ROLES))
    return f.agg(F.round(F.avg("f1"), 5).alias("macro_f1_all"), F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 5).alias("macro_f1_supported"))


@query("""WITH j AS (SELECT d.lang, l.quality AS a, l.toxic AS b FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT lang, count(*) AS n, avg((a = b)::INTEGER) AS po, avg(a) AS pa, avg(b) AS pb FROM j GROUP BY GROUPING SETS ((), (lang)))
SELECT lang, n, round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) = 1 THEN 1 ELSE (po - pa * pb - (1 - pa) * (1 - pb)) / (1 - pa * pb - (1 - pa) * (1 - pb)) END, 6) AS kappa FROM s""")
def agg_kappa(spark, d):
    """Agreement of two annotators, overall and by stratum."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.rollup("lang").agg(F.count("*").alias("n"), F.round(E.kappa(F.col("quality"), F.col("toxic")), 6).alias("kappa"))


@query("SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY o_orderstatus")
def agg_pivot_clean(spark, d):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", names).count().na.fill(0)


@query("SELECT l_returnflag, min(l_quantity) AS low, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS high, round(coalesce(stddev_samp(l_quantity), 0), 6) AS sd FROM lineitem GROUP BY l_returnflag")
def agg_spread(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min(q).alias("low"), F.round(F.avg(q), 6).alias("mean"), F.max(q).alias("high"), F.round(F.coalesce(F.stddev_samp(q), F.lit(0.0)), 6).alias("sd"))


@query("""WITH f AS (SELECT unnest([CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_quantity > 45 THEN 'large' END]) AS flag FROM lineitem)
SELECT flag, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 4) AS rate FROM f WHERE flag IS NOT NULL GROUP BY flag""")
def agg_flag_rates(spark, d):
    """Counts and rates of flags, several to a row; the rows are counted in the same pass."""
    flags = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "discounted"), F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_quantity") > 45, "large"), F.lit("all")))
    counts = table(spark, d, "lineitem").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    total = counts.where("flag = 'all'").select(F.col("n").alias("total"))
    return counts.where("flag <> 'all'").crossJoin(F.broadcast(total)).select("flag", "n", F.round(F.col("n") / F.col("total"), 4).alias("rate"))


@query("""WITH c AS (SELECT i AS k FROM range(0, (SELECT max(o_orderkey) FROM orders) + 1) t(i)), o AS (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey)
SELECT (SELECT count(*) FROM c) AS domain, (SELECT count(*) FROM o) AS present, (SELECT count(*) FROM c WHERE k NOT IN (SELECT o_orderkey FROM o)) AS missing, (SELECT count(*) FROM o WHERE n > 1) AS duplicated""")
def agg_coverage_report(spark, d):
    """Which keys of a dense domain are there, missing or there twice."""
    o = table(spark, d, "orders").groupBy("o_orderkey").agg(F.count("*").alias("n"))
    s = o.agg((F.max("o_orderkey") + 1).alias("domain"), F.count("*").alias("present"), F.count_if(F.col("n") > 1).alias("duplicated"))
    return s.select("domain", "present", (F.col("domain") - F.col("present")).alias("missing"), "duplicated")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def jn_left_default(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0)


@query("SELECT l_suppkey, string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS order_keys FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey")
def jn_invert_explode(spark, d):
    """A relation turned round: each supplier's orders, in order."""
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", F.col("l_orderkey").cast("string").alias("k")).distinct()
    return rows.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("order_keys"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 25 THEN 'medium' ELSE 'large' END AS band FROM part WHERE p_size BETWEEN 1 AND 50")
def jn_range_band(spark, d):
    bands = spark.createDataFrame([("small", 1, 10), ("medium", 11, 25), ("large", 26, 50)], "band string, low int, high int")
    return J.range_band(table(spark, d, "part"), bands, "p_size").select("p_partkey", "band")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn_anti_todo(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, coalesce(a.v, b.v) AS verdict FROM orders LEFT JOIN (SELECT o_orderkey AS k, 'own' AS v FROM orders WHERE o_totalprice > 300000) a ON a.k = o_orderkey LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal > 5000) b ON b.k = o_custkey")
def jn_fallback_coalesce(spark, d):
    """A verdict by the row's own key, else by a wider one."""
    o = table(spark, d, "orders")
    own = o.where("o_totalprice > 300000").select("o_orderkey", F.lit("own").alias("v"))
    wide = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("w"))
    return o.select("o_orderkey", "o_custkey").join(own, "o_orderkey", "left").join(wide, "o_custkey", "left").select("o_orderkey", F.coalesce("v", "w").alias("verdict"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_nationkey < 12 THEN -1 ELSE s_nationkey END AS s_nationkey, s_suppkey % 3 = 0 AND s_nationkey < 12 AS applied FROM supplier")
def jn_compare_and_set(spark, d):
    """Corrections that apply only where the value is the expected one."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    expected = F.when(F.col("s_nationkey") < 12, F.col("s_nationkey")).otherwise(F.lit(-5))
    fixes = s.where("s_suppkey % 3 = 0").select("s_suppkey", expected.alias("expected"), F.lit(-1).alias("after"))
    return J.compare_and_set(s, fixes, "s_suppkey", "s_nationkey")


@query("SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_linenumber, l_partkey) = 1")
def jn_prefer_canonical(spark, d):
    order = [F.desc(F.col("l_returnflag") == "R"), F.col("l_linenumber"), F.col("l_partkey")]
    return J.prefer(table(spark, d, "lineitem"), "l_orderkey", order).select("l_orderkey", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn_composite_strict(spark, d):
    """Every line must have its order; one without fails the query."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return J.must_match(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"])


# --- sets ------------------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_intersect(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem")
def set_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").select("l_partkey"))


# --- text ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({SQL_TOKENS.format('text')}) AS n_tokens, len({SQL_CONTENT.format('text')}) AS n_content FROM documents")
def str_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(T.content_words(F.col("text"))).cast("long").alias("n_content"))


@query(f"""WITH t AS (SELECT doc_id, text, {SQL_TOKENS.format('text')} AS w FROM documents), n AS (SELECT *, greatest(0, ceil((len(w) - 200) / 160.0))::INTEGER AS last FROM t),
x AS (SELECT doc_id, i, last, CASE WHEN len(w) <= 200 THEN text ELSE array_to_string(w[i * 160 + 1 : i * 160 + 200], ' ') END AS chunk FROM n, range(0, 10000) r(i) WHERE i <= last)
SELECT doc_id, i::INTEGER AS i, doc_id || CASE WHEN last > 0 THEN ':w' || i ELSE '' END AS chunk_id, CASE WHEN i > 0 THEN doc_id || ':w' || (i - 1) END AS prev_id, CASE WHEN i < last THEN doc_id || ':w' || (i + 1) END AS next_id, chunk FROM x""")
def str_window_chain(spark, d):
    """Windows of 200 words that overlap by 40, each with its id and those before and after."""
    rows = table(spark, d, "documents").select("doc_id", T.windows(F.col("text"), 200, 40).alias("w")).select("doc_id", F.size("w").alias("n"), F.posexplode("w").alias("i", "chunk"))
    name = lambda i: F.concat(F.col("doc_id").cast("string"), F.lit(":w"), i.cast("string"))
    i, n = F.col("i"), F.col("n")
    return rows.select("doc_id", "i", F.when(n > 1, name(i)).otherwise(F.col("doc_id").cast("string")).alias("chunk_id"), F.when(i > 0, name(i - 1)).alias("prev_id"), F.when(i < n - 1, name(i + 1)).alias("next_id"), "chunk")


@query(f"""WITH n AS (SELECT len({SQL_TOKENS.format('text')}) AS n FROM documents) SELECT round(sum(least(n, 200)) / sum(n)::DOUBLE, 6) AS first_window_share, sum(n)::BIGINT AS words FROM n""")
def agg_window_coverage(spark, d):
    n = F.size(T.tokens(F.col("text"))).cast("long")
    return table(spark, d, "documents").select(n.alias("n")).agg(F.round(F.sum(F.least("n", F.lit(200))) / F.sum("n"), 6).alias("first_window_share"), F.sum("n").alias("words"))


@query(f"""WITH c AS (SELECT conv_id, turn, {SQL_CONTENT.format('text')} AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM c)
SELECT conv_id, turn, round(CASE WHEN len(w) >= 6 AND len(s) > 0 THEN len(list_intersect(w, s)) / len(w)::DOUBLE ELSE 0 END, 6) AS contained FROM p WHERE s IS NOT NULL""")
def str_containment(spark, d):
    """Share of a turn's content words that the turn before has."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.content_words(F.col("text")).alias("w"))
    rows = rows.withColumn("s", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("s is not null")
    return rows.select("conv_id", "turn", F.round(T.containment(F.col("w"), F.col("s")), 6).alias("contained"))


@query("""WITH s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), m AS (SELECT *, sum(CASE WHEN before = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM s)
SELECT conv_id, run::BIGINT AS run, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM m GROUP BY conv_id, run, role""")
def rnk_runs(spark, d):
    return E.runs(table(spark, d, "conversations"), "conv_id", "turn", "role")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), s AS (SELECT *, greatest(1, n // 5) AS step FROM r)
SELECT lang, doc_id FROM s WHERE i % step = 0 AND i // step < 5""")
def rnk_systematic_sample(spark, d):
    """Five documents of each language, evenly spaced."""
    r = E.numbered(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"])
    step = F.greatest(F.lit(1), F.expr("n div 5"))
    return r.withColumn("step", step).where("i % step = 0 and i div step < 5").select("lang", "doc_id")


# --- gates -----------------------------------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT doc_id, unnest(list_sort(list_distinct(regexp_extract_all(text, '[^\p{L}\p{N}\s.,!?]')))) AS ch FROM documents)
SELECT doc_id, string_agg(ch, '' ORDER BY ch) AS chars, count(*) AS n FROM c GROUP BY doc_id""")
def flt_charset(spark, d):
    """The characters of each text that aren't letters, digits, white space or plain marks."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\p{L}\p{N}\s.,!?]"), F.lit(0))))
    return table(spark, d, "documents").select("doc_id", found.alias("c")).where(F.size("c") > 0).select("doc_id", F.array_join("c", "").alias("chars"), F.size("c").cast("long").alias("n"))


@query("SELECT doc_id, length(text) AS length, length(text) < 200 AS short FROM documents WHERE length(text) < 200 OR length(text) > 20000")
def flt_length_outliers(spark, d):
    n = F.length("text").cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("length"), (n < 200).alias("short")).where((n < 200) | (n > 20000))


@query("""WITH d AS (SELECT doc_id, text, doc_id % 17 = 0 AS broken FROM documents), t AS (SELECT doc_id, CASE WHEN broken THEN text || chr(12) ELSE text END AS text FROM d),
g AS (SELECT 'structure' AS gate, true AS hard, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'ownership', true, (SELECT count(*) FROM documents WHERE lang NOT IN ('en', 'de', 'fr', 'es'))
UNION ALL SELECT 'encoding', true, (SELECT count(*) FROM t WHERE regexp_matches(text, '[\\x00-\\x08\\x0b-\\x1f]'))
UNION ALL SELECT 'closure', true, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'length', false, (SELECT count(*) FROM documents WHERE n_chars <> length(text)))
SELECT gate, hard, violations, violations = 0 AS passed, max(CASE WHEN hard AND violations > 0 THEN 1 ELSE 0 END) OVER () = 0 AS build_ok FROM g""".replace("\\\\", "\\"))
def gate_summary(spark, d):
    """Hard gates fail a build, others warn. Every 17th text gets a form feed, so that the encoding gate has something to find."""
    docs = table(spark, d, "documents")
    broken = F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("\f"))).otherwise(F.col("text"))
    one = docs.agg(
        F.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("ownership"), F.count_if(broken.rlike(r"[\x00-\x08\x0b-\x1f]")).alias("encoding"), F.count_if(F.col("n_chars") != F.length("text")).alias("length")
    )
    twice = docs.groupBy("doc_id").count().agg(F.count_if(F.col("count") > 1).alias("structure"))
    open_ = table(spark, d, "labels").join(docs, "doc_id", "left_anti").agg(F.count("*").alias("closure"))
    wide = one.crossJoin(twice).crossJoin(open_)
    hard = ["structure", "ownership", "encoding", "closure"]
    ok = sum((F.col(g) for g in hard), F.lit(0)) == 0
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(g in hard).alias("hard"), F.col(g).alias("violations")) for g in [*hard, "length"]])
    return wide.select(ok.alias("build_ok"), F.explode(rows).alias("g")).select("g.gate", "g.hard", "g.violations", (F.col("g.violations") == 0).alias("passed"), "build_ok")
