"""Aggregates, rankings, joins and checks on the tables of orders, events, vectors and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import retrieval as R
from lamina.registry import query, table


@query("""WITH c AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id)
SELECT roles, count(*) AS conversations, round(avg(n), 4) AS mean, min(n) AS low, max(n) AS high FROM c GROUP BY roles""")
def agg_layer_counts(spark, d):
    """How many roles conversations have, and the number of turns of those."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"))
    return c.groupBy("roles").agg(F.count("*").alias("conversations"), F.round(F.avg("n"), 4).alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"))


@query("""WITH c AS (SELECT 'quality' AS f, quality AS v, count(*) AS n FROM labels GROUP BY v UNION ALL SELECT 'toxic', toxic, count(*) FROM labels GROUP BY toxic)
SELECT f AS field, arg_max(v, n) AS top, round(max(n) / sum(n)::DOUBLE, 4) AS share, max(n) / sum(n)::DOUBLE > 0.85 AS degenerate FROM c GROUP BY f""")
def agg_degenerate(spark, d):
    """Labels of which one class has over 0.85 of the rows."""
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("quality", "toxic")]))
    counts = table(spark, d, "labels").select(both.alias("x")).groupBy("x.field", "x.v").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return counts.groupBy("field").agg(F.max_by("v", "n").alias("top"), F.round(share, 4).alias("share"), (share > 0.85).alias("degenerate"))


@query("""SELECT event_type, count(*) AS n, round(avg((value >= 50)::INTEGER), 3) AS clean_rate, round(avg(try_cast(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE (event_id % 100)::VARCHAR END AS DOUBLE)), 6) AS latency,
CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS place FROM events GROUP BY event_type""")
def agg_sweep_summary(spark, d):
    """Events by type in a fixed order: rate of clean ones, mean latency without values that aren't numbers."""
    latency = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("event_id") % 100).cast("string")).try_cast("double")
    place = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") >= 50).cast("int")), 3).alias("clean_rate"), F.round(F.avg(latency), 6).alias("latency"), F.first(place).alias("place"))


@query("""SELECT event_type, count(*) AS attempts, round(count(*) FILTER (value > 20) / count(*)::DOUBLE, 4) AS clean_of_all, round(sum(event_id % 3) FILTER (value > 20) / nullif(count(*) FILTER (value > 20), 0)::DOUBLE, 4) AS errors_of_done FROM events GROUP BY event_type""")
def agg_rates_of_attempts(spark, d):
    """A rate over all attempts, failures too, beside one over those that succeeded."""
    done = F.col("value") > 20
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("attempts"), F.round(F.count_if(done) / F.count("*"), 4).alias("clean_of_all"),
        F.round(F.sum(F.when(done, F.col("event_id") % 3)) / F.nullif(F.count_if(done), F.lit(0)), 4).alias("errors_of_done"),
    )


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), s AS (SELECT count(*) AS groups FROM c)
SELECT o_custkey, n, groups FROM c, s ORDER BY n DESC, o_custkey LIMIT 5""")
def agg_structure_summary(spark, d):
    """The five largest groups, beside the number of groups."""
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "o_custkey").limit(5).crossJoin(F.broadcast(c.agg(F.count("*").alias("groups"))))


@query("""WITH c AS (SELECT l_shipmode, l_returnflag, avg(l_quantity) AS score FROM (SELECT 'm' || (l_orderkey % 7) AS l_shipmode, l_returnflag, l_quantity FROM lineitem) GROUP BY ALL)
SELECT l_shipmode, l_returnflag FROM c QUALIFY row_number() OVER (PARTITION BY l_shipmode ORDER BY round(score, 6) DESC, l_returnflag) = 1""")
def rnk_argmax(spark, d):
    """The condition of the best mean; the first wins ties."""
    mode = F.concat(F.lit("m"), (F.col("l_orderkey") % 7).cast("string")).alias("l_shipmode")
    c = table(spark, d, "lineitem").groupBy(mode, "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("score"))
    return c.groupBy("l_shipmode").agg(F.min_by("l_returnflag", F.struct((-F.col("score")).alias("s"), "l_returnflag")).alias("l_returnflag"))


@query("SELECT doc_id, length(text) AS length FROM documents ORDER BY length(text) DESC NULLS LAST, doc_id LIMIT 20")
def rnk_top_longest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("length")).orderBy(F.desc_nulls_last("length"), "doc_id").limit(20)


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('lamina:' || doc_id), doc_id) <= 6")
def rnk_hash_sample(spark, d):
    """Six documents of each source, in the order of a keyed hash: the same at every run."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("lamina:"), F.col("doc_id").cast("string"))), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).alias("i")).where("i <= 6").select("source", "doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(event_id) AS last_id FROM events GROUP BY user_id")
def rnk_last_wins(spark, d):
    """A key's last row, as an aggregate."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("event_id").alias("last_id"))


SQL_SIM = """q AS (SELECT label % 3 AS q, vec_id, embedding FROM embeddings WHERE vec_id % 250 = 0), s AS (SELECT q.q, q.vec_id AS part, e.label AS id, max(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))) AS best FROM q, embeddings e GROUP BY ALL),
m AS (SELECT q, id, round(avg(best), 6) AS score FROM s GROUP BY ALL)"""


@query(f"WITH {SQL_SIM} SELECT q, id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, id))::INTEGER AS rank FROM m QUALIFY rank <= 10")
def rnk_max_sim(spark, d, every=250):
    """Groups of vectors by the mean, over a query's vectors, of the best inner product with one of theirs."""
    e = table(spark, d, "embeddings")
    q = e.where(f"vec_id % {every} = 0").select((F.col("label") % 3).alias("q"), F.col("vec_id").alias("part"), F.col("embedding").alias("qv"))
    best = R.best_of_groups(q, e.select(F.col("label").alias("id"), F.col("embedding").alias("v")))
    means = best.groupBy("q", "id").agg(F.round(F.avg("best"), 6).alias("m"))
    return R.ranked(means, F.col("m"), 10).select("q", "id", "rank")


@query("""WITH g AS (SELECT o_custkey, array_agg(DISTINCT o_orderpriority) AS gold FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), t AS (SELECT o_custkey, array_agg(DISTINCT o_orderpriority) AS top FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT o_custkey, round(len(list_intersect(gold, coalesce(top, []))) / len(gold)::DOUBLE, 6) AS gold_recall FROM g LEFT JOIN t USING (o_custkey)""")
def rnk_multi_gold(spark, d):
    """Share of each gold set that was found: two conditional sets in one pass. Both hold at most the five priorities."""
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(of("F").alias("gold"), of("O").alias("top")).where("size(gold) > 0")
    return rows.select("o_custkey", F.round(F.size(F.array_intersect("gold", "top")) / F.size("gold"), 6).alias("gold_recall"))


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::INTEGER)::BIGINT AS k FROM events GROUP BY event_type")
def fn_from_json(spark, d):
    """Fields of JSON texts by a schema."""
    p = F.from_json("props", "k int", {"mode": "FAILFAST"})
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(p["k"]).alias("k"))


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(value) FILTER (i = floor(n * 0.025)) AS low, min(value) FILTER (i = floor(n * 0.975)) AS high FROM s GROUP BY event_type""")
def fn_index_percentiles(spark, d):
    """The sorted values at int(0.025 n) and int(0.975 n). Counts of distinct values come first, so that a running count over them, not the rows, is sorted."""
    counts = table(spark, d, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("m"))
    w = Window.partitionBy("event_type")
    c = counts.withColumns({"upto": F.sum("m").over(w.orderBy("value")), "n": F.sum("m").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("value")))
    return c.groupBy("event_type").agg(at(0.025).alias("low"), at(0.975).alias("high"))


@query("""SELECT s_suppkey, field, field = 'phone' AND s_nationkey > 12 AS violates FROM supplier, (SELECT unnest(['name', 'phone']) AS field) WHERE field <> 'name' OR s_suppkey % 2 = 0""")
def gate_field_ownership(spark, d):
    """Fields with the source each comes from, and whether that source owns it."""
    owner = F.create_map(*[F.lit(x) for x in ("name", "a", "phone", "b")])
    source = F.when(F.col("s_nationkey") > 12, "a").otherwise("b")
    fields = F.map_filter(F.create_map(F.lit("name"), F.lit("a"), F.lit("phone"), source), lambda k, v: (k != "name") | (F.col("s_suppkey") % 2 == 0))
    rows = table(spark, d, "supplier").select("s_suppkey", F.explode(fields).alias("field", "source"))
    return rows.select("s_suppkey", "field", (F.col("source") != owner[F.col("field")]).alias("violates"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS a, list_sort(coalesce(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'N'), [])) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, a = b AS equal, len(b) = 0 AS none FROM s""")
def set_equality(spark, d):
    """Whether all of an order's line numbers, or none, are among those that weren't returned."""
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(n).alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "N", n)).alias("b"))
    return rows.select("l_orderkey", (F.array_sort("a") == F.array_sort("b")).alias("equal"), (F.size("b") == 0).alias("none"))


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' ELSE (o_orderkey % 2)::VARCHAR END AS cell FROM orders)
SELECT count(*) FILTER (trim(cell) = '') AS unlabelled, count(*) FILTER (cell = '0') AS no, count(*) FILTER (cell = '1') AS yes FROM c""")
def flt_three_way(spark, d):
    """Cells of a sheet: blank, 0 or 1; any other one fails the query."""
    k = F.col("o_orderkey")
    cell = F.trim(F.when(k % 4 == 0, " ").otherwise((k % 2).cast("string")))
    kind = F.when(cell == "", "unlabelled").when(cell == "0", "no").when(cell == "1", "yes").otherwise(F.raise_error(F.concat(F.lit("not a label: "), cell)))
    return table(spark, d, "orders").select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == x).alias(x) for x in ("unlabelled", "no", "yes")])


@query("""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN length(before) > coalesce(length(after), 0) THEN -1 WHEN after IS NOT NULL THEN 1 ELSE 0 END AS moved FROM t""")
def jn_adjacent(spark, d):
    """Where a turn's note goes: to the longer neighbour."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length(F.lag("text").over(w)).alias("b"), F.length(F.lead("text").over(w)).alias("a"))
    return rows.select("conv_id", "turn", F.when(F.expr("b > coalesce(a, 0)"), -1).when(F.col("a").isNotNull(), 1).otherwise(0).alias("moved"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT a.l_suppkey, o.o_custkey FROM a JOIN orders o ON o.o_orderkey = a.l_orderkey)
SELECT l_suppkey, c_nationkey, count(*) AS customers FROM b JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def jn_two_hop(spark, d):
    """Suppliers to the nations of those who returned their parts, by orders and customers."""
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", F.col("l_orderkey").alias("o_orderkey")).distinct()
    b = a.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("l_suppkey", F.col("o_custkey").alias("c_custkey")).distinct()
    return b.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy("l_suppkey", "c_nationkey").agg(F.count("*").alias("customers"))
