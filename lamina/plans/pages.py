"""Pages as records: titles, paragraphs, verse and translation, one page of each address."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import lines as L
from lamina.operators import interlinear as I
from lamina.operators import joins as J
from lamina.operators import pages as P
from lamina.registry import query, table

SQL_TEXT = "regexp_replace({0}, '<[^>]*>', ' ', 'g')"
for _entity, _char in P.ENTITIES.items():
    SQL_TEXT = f"replace({SQL_TEXT}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
SQL_TEXT = f"trim(regexp_replace({SQL_TEXT}, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ')"
SQL_VISIBLE = "regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>', '', 'g')"


def _sql_first(tag: str) -> str:
    return SQL_TEXT.format(f"regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)")


SQL_PARTS = f"p AS (SELECT page_id, list_filter(list_transform(string_split_regex({SQL_VISIBLE}, '(?i)<p(?:\\s[^>]*)?>')[2:], lambda x: {SQL_TEXT.format('x')}), lambda x: x <> '') AS t FROM pages)"


@query(f"WITH {SQL_PARTS} SELECT page_id, unnest(range(0, len(t)))::INTEGER AS i, unnest(t) AS text FROM p")
def src_page_paragraphs(spark, d):
    """Numbered paragraphs of each page, without navigation, scripts and footer."""
    return table(spark, d, "pages").select("page_id", F.posexplode(P.paragraphs(F.col("html"))).alias("i", "text"))


@query(f"""WITH t AS (SELECT page_id, {_sql_first('title')} AS title, {_sql_first('h1')} AS heading, {_sql_first('b')} AS bold FROM pages)
SELECT page_id, title, heading, bold FROM t""")
def src_page_records(spark, d):
    """Title, heading and first bold part of each page."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", P.first_of(h, "title").alias("title"), P.first_of(h, "h1").alias("heading"), P.first_of(h, "b").alias("bold"))


SQL_FOLD = "regexp_replace(translate(lower(nfc_normalize({0})), 'ṃṅ', 'ṁṁ'), '[\\s.,;:!?\"“”’''-]', '', 'g')"


@query(f"""WITH {SQL_PARTS}, t AS (SELECT page_id, {_sql_first('title')} AS a FROM pages), x AS (SELECT page_id, a, t[1] AS b FROM t JOIN p USING (page_id) WHERE len(t) > 0),
f AS (SELECT *, {SQL_FOLD.format('a')} AS x, {SQL_FOLD.format('b')} AS y FROM x)
SELECT page_id, CASE WHEN a = b THEN 'exact' WHEN starts_with(x, y) OR ends_with(x, y) OR starts_with(y, x) OR ends_with(y, x) THEN 'boundary' ELSE 'distinct' END AS class FROM f""")
def str_pair_class(spark, d):
    """A page's title against its first paragraph: the same, one at an end of the other, or distinct."""
    rows = table(spark, d, "pages").select("page_id", P.first_of(F.col("html"), "title").alias("a"), F.get(P.paragraphs(F.col("html")), F.lit(0)).alias("b"))
    return rows.where("b is not null").select("page_id", L.pair_class(F.col("a"), F.col("b")).alias("class"))


@query(f"""WITH {SQL_PARTS}, t AS (SELECT page_id, list_filter(string_split({_sql_first('title')}, ' '), lambda w: length(w) > 4) AS n FROM pages),
x AS (SELECT page_id, n, lower(array_to_string(t, ' ')) AS body FROM t JOIN p USING (page_id))
SELECT page_id, len(n)::BIGINT AS n_words, len(list_filter(n, lambda w: NOT contains(body, lower(w))))::BIGINT AS n_missing FROM x WHERE len(n) > 0""")
def flt_title_body(spark, d):
    """How many of a title's words of over four characters there are, and how many of them the body hasn't."""
    rows = table(spark, d, "pages").select("page_id", F.filter(F.split(P.first_of(F.col("html"), "title"), " "), lambda w: F.length(w) > 4).alias("n"), F.lower(F.array_join(P.paragraphs(F.col("html")), " ")).alias("body"))
    missing = F.filter("n", lambda w: ~F.contains(F.col("body"), F.lower(w)))
    return rows.where("size(n) > 0").select("page_id", F.size("n").cast("long").alias("n_words"), F.size(missing).cast("long").alias("n_missing"))


SQL_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@query(f"SELECT {SQL_HOST} AS host, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY {SQL_HOST} ORDER BY page_id) = 1")
def src_keep_first(spark, d):
    """The first page of each host: the smallest number is an aggregate, so nothing is sorted."""
    return table(spark, d, "pages").groupBy(P.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("page_id"))


@query(f"""SELECT {SQL_HOST} AS host, page_id, regexp_extract(html, '(?i)<html lang="([a-z]+)"', 1) AS lang FROM pages
QUALIFY row_number() OVER (PARTITION BY {SQL_HOST} ORDER BY contains(url, '/en/') DESC, page_id) = 1""")
def jn_prefer_own(spark, d):
    """A host's page in the preferred language, else its first."""
    rows = table(spark, d, "pages").select(P.host(F.col("url")).alias("host"), "page_id", F.regexp_extract("html", '(?i)<html lang="([a-z]+)"', 1).alias("lang"), F.contains("url", F.lit("/en/")).alias("own"))
    return J.prefer(rows, "host", [F.desc("own"), F.col("page_id")]).select("host", "page_id", "lang")


@query(rf"""WITH {SQL_PARTS}, q AS (SELECT page_id, i, string_split(t[i + 1], ' ') AS w FROM p, range(0, len(t)) r(i)),
x AS (SELECT page_id, i, array_to_string(w[1:2], '') AS bold, array_to_string(w[3:], ' ') AS plain, CASE WHEN i % 3 = 1 THEN 'Note on ' || w[1] WHEN i % 7 = 2 THEN '*' END AS note,
  CASE WHEN i % 2 = 1 THEN page_id * 100 + i END AS number FROM q WHERE i % 5 <> 4),
y AS (SELECT *, min(number) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS record FROM x)
SELECT page_id, record::BIGINT AS number, string_agg(bold, ' ' ORDER BY i) AS bold, coalesce(string_agg(nullif(plain, ''), ' ' ORDER BY i), '') AS plain, coalesce(string_agg(note, '|' ORDER BY i), '') AS notes
FROM y WHERE record IS NOT NULL GROUP BY page_id, record""")
def str_interlinear(spark, d):
    """Records of interlinear pages that are made from the paragraphs of each page: bold words, the rest, notes, numbers that close a record."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.col("page_id")

    def line(t, i):
        w = F.split(escaped(t), " ")
        bold = F.concat(F.lit("<b><i>"), w[0], F.lit("</i>"), F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.lit("</b><br>\n "))
        plain = F.array_join(F.slice(w, 3, F.size(w)), " ")
        note = F.when(i % 3 == 1, F.concat(F.lit('<span class="x TT">*<span><i>Note</i> on '), w[0], F.lit("</span> more</span>"))).when(i % 7 == 2, '<span class="TT">*</span>').otherwise("")
        number = F.when(i % 2 == 1, F.concat(F.lit(' <span class="number">['), (page * 100 + i).cast("string"), F.lit("]</span>"))).otherwise("")
        text = F.when(i % 5 == 4, plain).otherwise(F.concat(bold, plain, note, number))
        return F.concat(F.lit('<div class="verse'), i.cast("string"), F.lit('"><p>'), text, F.when(i % 2 == 0, "</p>").otherwise(""), F.lit("</div>"))

    html = F.array_join(F.transform(P.paragraphs(F.col("html")), line), "\n")
    found = table(spark, d, "pages").select("page_id", F.explode(I.records(html)).alias("r"))
    return found.select("page_id", "r.number", "r.bold", "r.plain", F.array_join("r.notes", "|").alias("notes"))
