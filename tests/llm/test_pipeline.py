"""The pipeline's stages, each on what the stage before it kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from lamina.llm import jaccard, toxicity
from lamina.llm.shared import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    (_, toxic), (_, lines), (_, near), (_, private), (_, pack) = corpus_pipeline.STAGES
    kept = stored(toxic(spark, docs, SF), "a")
    assert kept.columns == docs.columns
    rejected = toxicity.score(docs, toxicity.fit(docs, labels)).where("score >= 0.7")
    assert kept.count() + rejected.count() == docs.count()
    clean = stored(lines(spark, kept, SF), "b")
    assert clean.columns == docs.columns and clean.where(F.col("n_chars") != F.length("text")).count() == 0
    one = stored(near(spark, clean, SF), "c")
    assert one.columns == docs.columns and jaccard.near_duplicates(one).where("not stays or n_links > 0").count() == 0
    safe = stored(private(spark, one, SF), "d")
    assert safe.columns == docs.columns and safe.count() == one.count()
    assert safe.where(r"text rlike '@mail\\d\\.example\\.com'").count() == 0
    packed = pack(spark, safe, SF)
    assert packed.select("doc_id").distinct().count() == safe.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 2048").count() <= 1


def test_stages_on_odd_rows_and_an_empty_table(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n"), (None, base), (5, base), (5, base), (6, "a\nb\nc\nd"), (7, "a\nb\nc\nx"), (8, "z " * 20_000), (9, "mail x.y@host.example.com")]
    docs = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, k1 long, at string")
    for rows in (docs, docs.limit(0)):
        kept, n = rows, []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stored(stage(spark, kept, SF), name)
            assert kept.columns == docs.columns
            n.append(kept.count())
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
        if n[0]:
            # no text is toxic, no document loses its every line, blank texts are one class and so are the copies; 7 keeps one line
            assert n == [10, 10, 6, 6], n
            assert "host" not in kept.where("doc_id = 9").first().text and kept.where("doc_id = 7").first().text == "x"
            assert packed.count() >= 6
        else:
            assert n == [0, 0, 0, 0] and packed.count() == 0
