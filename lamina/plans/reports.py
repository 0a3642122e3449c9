"""Report rows: conflation of two classes, dispositions against gold, coverage of a domain, presence of metrics, code points."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.registry import query, table

#: Values of the domain that agg_domain_coverage expects.
DOMAIN = 45
METRICS = ("quality", "toxic", "toxic_only")


@query("""WITH p AS (SELECT role AS gold, CASE WHEN turn % 3 = 0 THEN 'user' WHEN turn % 3 = 1 THEN 'assistant' ELSE 'system' END AS predicted FROM conversations)
SELECT count(*) AS n, round(avg((gold = predicted)::INTEGER), 6) AS accuracy, count(*) FILTER (predicted IN ('user', 'assistant')) AS n_pair,
  count(*) FILTER (gold = 'user' AND predicted = 'assistant') AS user_as_assistant, count(*) FILTER (gold = 'assistant' AND predicted = 'user') AS assistant_as_user,
  round(coalesce(count(*) FILTER (gold IN ('user', 'assistant') AND predicted IN ('user', 'assistant') AND gold <> predicted)::DOUBLE / nullif(count(*) FILTER (predicted IN ('user', 'assistant')), 0), 0), 6) AS conflation FROM p""")
def agg_conflation(spark, d):
    """Accuracy, the share of predictions of either class of a pair whose gold is the other one (none: 0), and both directions, in one pass."""
    said = F.when(F.col("turn") % 3 == 0, "user").when(F.col("turn") % 3 == 1, "assistant").otherwise("system")
    as_user, as_assistant = (F.count_if((F.col("gold") == g) & (F.col("predicted") == p)) for g, p in (("assistant", "user"), ("user", "assistant")))
    n_pair = F.count_if(F.col("predicted").isin("user", "assistant"))
    return table(spark, d, "conversations").select(F.col("role").alias("gold"), said.alias("predicted")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("int")), 6).alias("accuracy"), n_pair.alias("n_pair"),
        as_assistant.alias("user_as_assistant"), as_user.alias("assistant_as_user"), F.round(F.coalesce((as_user + as_assistant) / F.nullif(n_pair, F.lit(0)), F.lit(0.0)), 6).alias("conflation"),
    )


def _dispositions(spark, d):
    """Lines of orders in place of retrieved groups: what was said of each (null: nothing), and whether it is gold."""
    said = F.when(F.col("l_linenumber") % 5 != 0, F.when(F.col("l_returnflag") == "A", "used").when(F.col("l_returnflag") == "R", "partially_relevant").otherwise("not_relevant"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), said.alias("disposition"), (F.col("l_linenumber") <= 2).alias("gold"))


SQL_DISPOSITIONS = """x AS (SELECT l_orderkey AS q, CASE WHEN l_linenumber % 5 <> 0 THEN CASE l_returnflag WHEN 'A' THEN 'used' WHEN 'R' THEN 'partially_relevant' ELSE 'not_relevant' END END AS disposition, l_linenumber <= 2 AS gold FROM lineitem)"""


@query(f"WITH {SQL_DISPOSITIONS}, c AS (SELECT disposition, count(*) AS n, count(*) FILTER (gold) AS on_gold, count(*) FILTER (NOT gold) AS on_noise FROM x WHERE disposition IS NOT NULL GROUP BY 1) SELECT *, round(n / (sum(n) OVER ())::DOUBLE, 6) AS share FROM c")
def agg_dispositions(spark, d):
    """Dispositions with their share, and how many are of gold groups (dismissed gold is a failure, dismissed noise isn't)."""
    counts = _dispositions(spark, d).where("disposition is not null").groupBy("disposition").agg(F.count("*").alias("n"), F.count_if("gold").alias("on_gold"), F.count_if(~F.col("gold")).alias("on_noise"))
    total = counts.agg(F.sum("n").alias("total"))  # three rows at most
    return counts.crossJoin(F.broadcast(total)).select("disposition", "n", "on_gold", "on_noise", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(f"WITH {SQL_DISPOSITIONS}, g AS (SELECT q, count(*) = count(disposition) AS covered FROM x GROUP BY q) SELECT count(*) AS questions, count(*) FILTER (covered) AS covered FROM g")
def set_disposition_coverage(spark, d):
    """Questions of which every retrieved group has a disposition: a subset test as a count, so that no set is gathered."""
    each = _dispositions(spark, d).groupBy("q").agg((F.count("*") == F.count("disposition")).alias("covered"))
    return each.agg(F.count("*").alias("questions"), F.count_if("covered").alias("covered"))


@query(f"""WITH c AS (SELECT l_suppkey, l_quantity::INTEGER AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT s_suppkey, count(v) FILTER (v BETWEEN 1 AND {DOMAIN}) AS covered, array_to_string(list_sort(list_filter(range(1, {DOMAIN} + 1), lambda x: NOT list_contains(coalesce(list(v) FILTER (v IS NOT NULL), []), x))), ',') AS missing,
  coalesce(string_agg(v || ':' || n, ',' ORDER BY v) FILTER (n > 1 AND v BETWEEN 1 AND {DOMAIN}), '') AS repeated, coalesce(string_agg(v::VARCHAR, ',' ORDER BY v) FILTER (v NOT BETWEEN 1 AND {DOMAIN}), '') AS outside
FROM supplier LEFT JOIN c ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def agg_domain_coverage(spark, d):
    """For each key of a dense table: values of the domain that it has, those it lacks, repeated ones with their number, and values outside, collected rather than dropped.

    Values are counted first, so that a key has a row for each value, not for each line."""
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("v")).agg(F.count("*").alias("n"))
    inside = F.col("v").between(1, DOMAIN)
    named = F.array_sort(F.collect_list(F.when(inside & (F.col("n") > 1), F.struct("v", "n"))))
    rows = table(spark, d, "supplier").select("s_suppkey").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey").agg(
        F.count_if(inside).alias("covered"), F.collect_set("v").alias("all"), named.alias("many"), F.array_sort(F.collect_list(F.when(~inside, F.col("v")))).alias("out")
    )
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    pair = lambda x: F.concat(x["v"].cast("string"), F.lit(":"), x["n"].cast("string"))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(DOMAIN)), "all")
    return rows.select("s_suppkey", "covered", joined(missing).alias("missing"), F.array_join(F.transform("many", pair), ",").alias("repeated"), joined("out").alias("outside"))


@query("""WITH r AS (SELECT d.lang, l.quality, l.toxic, CASE WHEN l.toxic = 1 THEN 1 END AS toxic_only FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
u AS (SELECT lang, unnest(['quality', 'toxic', 'toxic_only']) AS metric, unnest([quality, toxic, toxic_only]) AS x FROM r)
SELECT lang, metric, bool_and(x IS NOT NULL) AS present, round(coalesce(avg(x), 0), 6) AS mean FROM u GROUP BY lang, metric""")
def flt_metric_presence(spark, d):
    """Metrics by language: whether every row has it, and its mean, 0.0 where no row has. One pass, then a column for each metric becomes a row."""
    only = F.when(F.col("toxic") == 1, 1).alias("toxic_only")
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left").select("lang", "quality", "toxic", only)
    stats = [F.struct(F.lit(m).alias("metric"), F.bool_and(F.col(m).isNotNull()).alias("present"), F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias("mean")).alias(m) for m in METRICS]
    return rows.groupBy("lang").agg(*stats).select("lang", F.inline(F.array(*METRICS)))


@query("""WITH c AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x7F]'))) AS chars FROM documents)
SELECT doc_id, array_to_string(list_transform(chars, lambda c: printf('U+%04X', unicode(c)) || ' ' || c), ',') AS found FROM c WHERE len(chars) > 0""")
def flt_charset_codes(spark, d):
    """Characters of a text outside the allowed set, each once in order of code points, by code point."""
    chars = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0))))
    name = lambda c: F.concat(F.lit("U+"), F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0{1,4}", ""), F.lit(" "), c)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(chars, name), ",").alias("found")).where("found <> ''")
