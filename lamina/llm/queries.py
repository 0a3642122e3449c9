"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import centroids, exact_dedup, fill_middle, jaccard, languages, line_dedup, packing, pieces, pii, resampling, sstable, toxicity, voronoi


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = sstable.write_tables(_table(spark, sf_dir, "documents"), sstable.table_folder(spark), path, spaced=False, end_id=2)
    return sstable.read_tables(manifest)


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = voronoi.scaled(_table(spark, sf_dir, "embeddings"))
    return voronoi.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids_crc32", "round_trip")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = languages.predict(docs, languages.fit(docs.where(~languages.held_out(F.col("doc_id")))))
    return found.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform(_table(spark, sf_dir, "documents"), with_output=False)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(centroids.scaled(_table(spark, sf_dir, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_sstable, op3_voronoi_knn, op4_packing, op5_exact_dedup, op6_sentencepiece, op7_jaccard, op8_toxicity, op9_resampling, op10_pii,
        op11_language_id, op12_fill_middle, op13_centroids,
    )
}


def _clustering_sql() -> str:
    """Rounds of clustering one after another: a is each vector's nearest centroid, c the next centroids."""
    nearest = """a{0} AS MATERIALIZED (
  SELECT row, vec_id, v, min(d) AS distance, arg_min(cid, (d, cid)) AS cluster FROM (
    SELECT k.row, k.vec_id, k.v, c.cid, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, c{0} c
  ) GROUP BY row, vec_id, v
)"""
    moved = """m{0} AS (
  SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{0}, range(1, 65) t(i) GROUP BY cluster, i
), c{1} AS MATERIALIZED (
  SELECT c.cid, coalesce(x.v, c.v) AS v FROM c{0} c
  LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{0} GROUP BY cluster) x ON x.cluster = c.cid
)"""
    steps = ",\n".join(nearest.format(r) + (",\n" + moved.format(r, r + 1) if r < 5 else "") for r in range(6))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cid, v FROM kept QUALIFY cid < 40
), {steps}
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a5 a JOIN c5 c ON c.cid = a.cluster"""


#: DuckDB SQL for the rows of those that SQL can express.
ORACLES = {
    "op1_line_dedup": r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, i, ls[i] AS line, trim(regexp_replace(ls[i], '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS form
  FROM split, range(1, len(ls) + 1) t(i)
), units AS (
  SELECT *, sum(CASE WHEN form <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM lines
), full_lines AS (
  SELECT doc_id, unit, form FROM units WHERE form <> ''
), windows AS (
  SELECT doc_id, unit, form || chr(10) || lead(form, 1) OVER w || chr(10) || lead(form, 2) OVER w AS win
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY unit)
), later AS (
  SELECT doc_id, unit FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, unit) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT DISTINCT doc_id, unit + k AS unit FROM later, range(0, 3) t(k)
), kept AS (
  SELECT u.doc_id, string_agg(u.line, chr(10) ORDER BY u.i) AS text
  FROM units u LEFT JOIN covered c ON u.doc_id = c.doc_id AND u.unit = c.unit WHERE c.unit IS NULL GROUP BY u.doc_id
), counts AS (
  SELECT f.doc_id, count(*) AS n_lines, count(c.unit) AS n_removed
  FROM full_lines f LEFT JOIN covered c ON f.doc_id = c.doc_id AND f.unit = c.unit GROUP BY f.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(n.n_lines, 0)::BIGINT AS n_lines, coalesce(n.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts n ON d.doc_id = n.doc_id""",
    "op3_voronoi_knn": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""",
    "op12_fill_middle": r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), d AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(u[greatest(x, y) + 1:], '') AS suffix FROM d
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    "op13_centroids": _clustering_sql(),
}
