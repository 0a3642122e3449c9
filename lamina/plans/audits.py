"""Audit rules on the turns of conversations as claims, and clusters of claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.operators import audit as A
from lamina.registry import ORACLES, SQL_CONTENT, query, table
from lamina.sources.scratch import stored

CLAIM = ["conv_id", "turn"]
MARKERS, LABELS = ["http", "@", "tion."], ["and", "the"]
WORDS = SQL_CONTENT.format("text")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, 'CITATION_IN_TEXT' AS code, 'error' AS severity FROM conversations WHERE contains(text, 'http') OR contains(text, '@') OR contains(text, 'tion.')")
def aud_citation_in_text(spark, d):
    return A.warnings(_turns(spark, d).where(A.contains_any(F.col("text"), MARKERS)), "CITATION_IN_TEXT", CLAIM)


@query("SELECT conv_id, turn, 'LABEL_IN_TEXT' AS code, 'error' AS severity FROM conversations WHERE starts_with(lower(trim(text)), 'and') OR starts_with(lower(trim(text)), 'the')")
def aud_label_in_text(spark, d):
    return A.warnings(_turns(spark, d).where(A.starts_with_any(F.col("text"), LABELS)), "LABEL_IN_TEXT", CLAIM)


@query(f"""WITH b AS (SELECT item_id, {WORDS} AS c FROM benchmark), s AS (SELECT doc_id, {WORDS} AS s FROM documents)
SELECT item_id, doc_id, 'VERSE_TEXT_AS_COMMENTARY' AS code, 'error' AS severity FROM b JOIN s ON len(c) >= 6 AND len(list_intersect(c, s)) / len(c)::DOUBLE > 0.6""")
def aud_verse_text_as_commentary(spark, d):
    """Items of which a document has over 0.6 of the content words."""
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("claim"), T.content_words(F.col("text")).alias("words"))
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("source"), T.content_words(F.col("text")).alias("words"))
    found = A.containments(claims, sources, [], 0.6).where("contained > 0.6")
    return A.warnings(found.select(F.col("claim").alias("item_id"), F.col("source").alias("doc_id")), "VERSE_TEXT_AS_COMMENTARY", ["item_id", "doc_id"])


@query(f"""WITH c AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations),
p AS (SELECT conv_id, turn, w, lag(w) OVER x AS a, lag(w, 2) OVER x AS b FROM c WINDOW x AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, CASE WHEN len(w) >= 6 AND len(a) > 0 THEN len(list_intersect(w, a)) / len(w)::DOUBLE ELSE 0 END AS n, CASE WHEN len(w) >= 6 AND len(b) > 0 THEN len(list_intersect(w, b)) / len(w)::DOUBLE ELSE 0 END AS v FROM p)
SELECT conv_id, turn, 'NOTE_TEXT_AS_OTHER_LAYER' AS code, 'error' AS severity FROM s WHERE n >= 0.1 AND n > v""")
def aud_note_text_as_other_layer(spark, d):
    """Turns nearer to the turn before (the note; a share of 0.1 here) than to the one before that."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _turns(spark, d).select(*CLAIM, T.content_words(F.col("text")).alias("w"))
    rows = rows.select(*CLAIM, "w", F.lag("w").over(w).alias("a"), F.lag("w", 2).over(w).alias("b"))
    note, verse = T.containment(F.col("w"), F.col("a")), T.containment(F.col("w"), F.col("b"))
    return A.warnings(rows.where((note >= 0.1) & (note > verse)), "NOTE_TEXT_AS_OTHER_LAYER", CLAIM)


@query("SELECT conv_id, turn, 'NOTE_NOT_IN_CONTEXT' AS code, 'error' AS severity FROM conversations c WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id)")
def aud_note_not_in_context(spark, d):
    """Answers whose number has no label."""
    rows = _turns(spark, d).where("role = 'assistant'")
    return A.warnings(rows.join(table(spark, d, "labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_anti"), "NOTE_NOT_IN_CONTEXT", CLAIM)


SQL_RAW = "CASE conv_id % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'Story ' WHEN 2 THEN '[' ELSE '' END || (conv_id % 30)::VARCHAR || '.' || (turn + 1)::VARCHAR || CASE conv_id % 5 WHEN 2 THEN ']' ELSE '' END"


@query(f"""WITH r AS (SELECT conv_id, turn, {SQL_RAW} AS raw FROM conversations), n AS (SELECT *, regexp_replace(raw, '[^0-9.]', '', 'g') AS bare FROM r),
c AS (SELECT conv_id, turn, CASE WHEN NOT regexp_full_match(bare, '([1-9]|1[0-9]|2[0-6])\\.[1-9][0-9]{{0,2}}') THEN 'UNPARSEABLE_GROUP_ID' WHEN bare <> raw THEN 'MALFORMED_GROUP_ID' END AS code FROM n)
SELECT conv_id, turn, code, CASE code WHEN 'MALFORMED_GROUP_ID' THEN 'warning' ELSE 'error' END AS severity FROM c WHERE code IS NOT NULL""")
def aud_group_id(spark, d):
    """Identifiers that aren't ones, or that were only after cleaning."""
    k = F.col("conv_id") % 5
    number = F.concat((F.col("conv_id") % 30).cast("string"), F.lit("."), (F.col("turn") + 1).cast("string"))
    raw = F.when(k == 0, F.concat(F.lit("g"), number)).when(k == 1, F.concat(F.lit("Story "), number)).when(k == 2, F.concat(F.lit("["), number, F.lit("]"))).otherwise(number)
    rows = _turns(spark, d).select(*CLAIM, raw.alias("raw"), T.group_id(raw).alias("id"))
    return A.warnings(rows, F.when(F.col("id").isNull(), "UNPARSEABLE_GROUP_ID").when(F.col("id") != F.col("raw"), "MALFORMED_GROUP_ID"), CLAIM)


@query("""SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN 'UNKNOWN_GROUP_ID' ELSE 'GROUP_NOT_RETRIEVED' END AS code, 'error' AS severity
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE c_custkey IS NULL OR c_mktsegment <> 'BUILDING'""")
def aud_group_known(spark, d):
    """Orders whose customer isn't among those in credit (the corpus), or not in one segment (what was retrieved)."""
    corpus = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(corpus, "o_custkey", "left")
    return A.warnings(rows, F.when(F.col("c_mktsegment").isNull(), "UNKNOWN_GROUP_ID").when(F.col("c_mktsegment") != "BUILDING", "GROUP_NOT_RETRIEVED"), ["o_orderkey", "o_custkey"])


@query("""SELECT l_orderkey, 'ALIGNMENT_RANGE_INCOMPLETE' AS code, 'warning' AS severity FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
HAVING max(l_linenumber) - min(l_linenumber) + 1 <> count(DISTINCT l_linenumber)""")
def aud_alignment_range(spark, d):
    """Orders whose returned lines aren't a whole range of numbers."""
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg((F.max(n) - F.min(n) + 1).alias("span"), F.count_distinct(n).alias("held"))
    return A.warnings(rows.where("span <> held"), "ALIGNMENT_RANGE_INCOMPLETE", ["l_orderkey"])


SQL_SIMILAR = f"""c AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations),
e AS (SELECT a.conv_id, a.turn AS a, b.turn AS b FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn
  WHERE greatest(CASE WHEN len(a.w) >= 6 THEN len(list_intersect(a.w, b.w)) / len(a.w)::DOUBLE ELSE 0 END, CASE WHEN len(b.w) >= 6 THEN len(list_intersect(a.w, b.w)) / len(b.w)::DOUBLE ELSE 0 END) SHARE)"""


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", F.col("turn").alias("claim"), T.content_words(F.col("text")).alias("words"))


@query(f"WITH {SQL_SIMILAR.replace('SHARE', '> 0.2')} SELECT DISTINCT conv_id, b AS turn, 'DUPLICATE_CLAIM' AS code, 'warning' AS severity FROM e")
def aud_duplicate_claim(spark, d):
    """Turns like an earlier one of their conversation; a share of 0.2 here, as the invented texts repeat little."""
    pairs = A.similar_claims(_claims(spark, d), ["conv_id"], 0.2).where("similarity > 0.2")
    return A.warnings(pairs.select("conv_id", F.col("b").alias("turn")).distinct(), "DUPLICATE_CLAIM", CLAIM)


@query("""SELECT conv_id, -1 AS turn, 'NO_COMMENTARY_ENGAGEMENT' AS code, 'warning' AS severity FROM conversations GROUP BY conv_id
HAVING bool_or(coalesce(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')), 0) >= 40) AND count(*) FILTER (role = 'assistant') < 3""")
def aud_no_commentary(spark, d):
    """Conversations with a turn of 40 words, but fewer than three answers."""
    long = F.size(T.tokens(F.col("text"))) >= 40
    rows = _turns(spark, d).groupBy("conv_id").agg(F.bool_or(long).alias("there"), F.count_if(F.col("role") == "assistant").alias("cited"))
    return A.warnings(rows.where("there and cited < 3").withColumn("turn", F.lit(-1)), "NO_COMMENTARY_ENGAGEMENT", CLAIM)


@query("""WITH s AS (SELECT l_orderkey, l_suppkey, bool_or(l_returnflag <> 'A') AS offered, bool_or(l_linestatus = 'F') AS disposed, bool_or(l_quantity > 40) AS cited FROM lineitem GROUP BY ALL),
c AS (SELECT l_orderkey, l_suppkey, CASE WHEN offered AND NOT disposed THEN 'MISSING_DISPOSITION' WHEN disposed AND NOT offered THEN 'UNKNOWN_DISPOSITION_GROUP' WHEN disposed AND cited THEN 'DISPOSITION_CONTRADICTS_CLAIMS' END AS code FROM s)
SELECT l_orderkey, l_suppkey, code, CASE code WHEN 'MISSING_DISPOSITION' THEN 'error' ELSE 'warning' END AS severity FROM c WHERE code IS NOT NULL""")
def aud_disposition(spark, d):
    """What was offered, disposed of and cited, compared as sets in one pass over their rows."""
    some = lambda c, name: F.bool_or(F.expr(c)).alias(name)
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(some("l_returnflag <> 'A'", "offered"), some("l_linestatus = 'F'", "disposed"), some("l_quantity > 40", "cited"))
    code = F.when(F.expr("offered and not disposed"), "MISSING_DISPOSITION").when(F.expr("disposed and not offered"), "UNKNOWN_DISPOSITION_GROUP").when(F.expr("disposed and cited"), "DISPOSITION_CONTRADICTS_CLAIMS")
    return A.warnings(rows, code, ["l_orderkey", "l_suppkey"])


RULES = [aud_citation_in_text, aud_label_in_text, aud_note_text_as_other_layer, aud_note_not_in_context, aud_group_id, aud_duplicate_claim, aud_no_commentary]


@query("WITH w AS (" + " UNION ALL ".join(f"SELECT code, severity FROM ({ORACLES[f.__name__]})" for f in RULES) + """)
SELECT 'severity' AS kind, severity AS name, count(*) AS n FROM w GROUP BY severity UNION ALL SELECT 'code', code, count(*) FROM w GROUP BY code""")
def aud_summary(spark, d):
    """Counts by severity and by code of all rules on turns."""
    rows = reduce(DataFrame.unionByName, [f(spark, d).select("code", "severity") for f in RULES])
    both = F.explode(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name")), F.struct(F.lit("code").alias("kind"), F.col("code").alias("name"))))
    return rows.groupBy("code", "severity").agg(F.count("*").alias("m")).select(both.alias("x"), "m").groupBy("x.kind", "x.name").agg(F.sum("m").alias("n"))


SQL_CLUSTERS = f"""RECURSIVE {SQL_SIMILAR.replace('SHARE', '>= 0.2')}, g AS (SELECT * FROM e UNION ALL SELECT conv_id, b, a FROM e),
r AS (SELECT conv_id, turn AS claim, turn AS seen FROM c UNION SELECT r.conv_id, r.claim, g.b FROM r JOIN g ON g.conv_id = r.conv_id AND g.a = r.seen),
k AS (SELECT conv_id, claim AS turn, min(seen) AS cluster FROM r GROUP BY ALL)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn and cluster. Turns get stored numbers, so that those of conversations of any length never meet."""
    claims = _claims(spark, d)
    ids = stored(claims.select("conv_id", F.col("claim").alias("turn")).distinct().withColumn("id", F.monotonically_increasing_id()), "claims")
    numbered = claims.withColumnRenamed("claim", "turn").join(ids, CLAIM).select("conv_id", F.col("id").alias("claim"), "words")
    rows = A.claim_clusters(numbered, ["conv_id"], 0.2).withColumnRenamed("claim", "id").join(ids, "id")
    first = rows.groupBy(F.col("cluster").alias("root")).agg(F.min("turn").alias("first"))
    return rows.join(first, F.col("cluster") == F.col("root")).select("conv_id", "turn", F.col("first").alias("cluster"))


@query(f"WITH {SQL_CLUSTERS} SELECT conv_id, turn, cluster FROM k")
def dom_claim_clusters(spark, d):
    """Clusters of like turns of a conversation, by their first turn."""
    return _clusters(spark, d)


@query(f"""WITH {SQL_CLUSTERS}, m AS (SELECT conv_id, cluster, count(*) AS n, count(DISTINCT role) AS roles FROM k JOIN conversations USING (conv_id, turn) GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) AS groups, coalesce(sum((roles = 1)::INTEGER), 0)::BIGINT AS stable FROM m""")
def agg_tag_stability(spark, d):
    """Clusters of several turns, and how many of them have one role."""
    rows = _clusters(spark, d).join(_turns(spark, d).drop("text"), CLAIM).groupBy("conv_id", "cluster").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"))
    return rows.where("n > 1").agg(F.count("*").alias("groups"), F.count_if(F.col("roles") == 1).alias("stable"))
