"""Audit rules over claims: each rule is a DataFrame of warnings; similar claims by shared words and their clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.graph import components
from lamina.operators.retrieval import scored
from lamina.sources.scratch import stored

# The severity of each code.
SEVERITY = {
    "MISSING_PROVENANCE": "error",
    "VERSE_GROUP_MISMATCH": "error",
    "VERSE_NOT_RETRIEVED": "error",
    "PALI_QUOTE_NOT_IN_SOURCE": "error",
    "PALI_QUOTE_ORTHOGRAPHIC_VARIANT": "warning",
    "PALI_QUOTE_TRUNCATED": "warning",
    "SYNTHESIS_WITH_CITATION": "info",
    "CITATION_IN_TEXT": "error",
    "LABEL_IN_TEXT": "error",
    "VERSE_TEXT_AS_COMMENTARY": "error",
    "NOTE_TEXT_AS_OTHER_LAYER": "error",
    "NOTE_NOT_IN_CONTEXT": "error",
    "UNPARSEABLE_GROUP_ID": "error",
    "MALFORMED_GROUP_ID": "warning",
    "UNKNOWN_GROUP_ID": "error",
    "GROUP_NOT_RETRIEVED": "error",
    "ALIGNMENT_RANGE_INCOMPLETE": "warning",
    "DUPLICATE_CLAIM": "warning",
    "NO_COMMENTARY_ENGAGEMENT": "warning",
    "MISSING_DISPOSITION": "error",
    "UNKNOWN_DISPOSITION_GROUP": "warning",
    "DISPOSITION_CONTRADICTS_CLAIMS": "warning",
}


def warnings(rows: DataFrame, code: str | Column, claim: list[str]) -> DataFrame:
    """A warning for each row: the claim's columns, code and severity. A code that is a column may be null: no warning."""
    code = F.lit(code) if isinstance(code, str) else code
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return rows.select(*claim, code.alias("code")).where("code is not null").withColumn("severity", severity[F.col("code")])


def contains_any(text: Column, markers: list[str]) -> Column:
    """Whether the text holds one of the markers."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def starts_with_any(text: Column, labels: list[str]) -> Column:
    """Whether the trimmed lower-case text starts with one of the labels."""
    bare = F.lower(F.trim(text))
    return reduce(lambda a, b: a | b, [F.startswith(bare, F.lit(x)) for x in labels])


def containments(claims: DataFrame, sources: DataFrame, keys: list[str], share: float, least: int = 6) -> DataFrame:
    """keys, claim, source and contained: pairs of equal keys in which the source has at least that share of the claim's words.

    claims: keys, claim, words; sources: keys, source, words (arrays of distinct words). A source with a share s of n
    words has one of any n - ceil(s n) + 1 of them, so that a claim meets sources by its rarest words only, and no
    pair is lost. Counting the words and joining on them share one exchange. Without keys, claims and sources may all meet:
    common words are then counted in cells (retrieval.scored), from which only pairs of that share come (or more, where rows of one name add up).
    """
    if keys:
        big = claims.where(F.size("words") >= least).select(*keys, "claim", F.size("words").alias("n"), F.explode("words").alias("word"))
        posted = sources.select(*keys, "source", F.explode("words").alias("word"))
        counts = posted.groupBy(*keys, "word").agg(F.count("*").alias("seen"))
        order = Window.partitionBy(*keys, "claim").orderBy("seen", "word")
        rare = big.join(counts, [*keys, "word"], "left").withColumn("seen", F.coalesce("seen", F.lit(0))).withColumn("place", F.row_number().over(order))
        rare = rare.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1)
        met = rare.join(posted, [*keys, "word"]).select(*keys, "claim", "source").distinct()
    else:
        n = F.size("words")
        asked = claims.where(n >= least).select(F.col("claim").alias("q"), F.lit(1).alias("wq"), F.ceil(n * share - 1e-9).alias("bar"), F.explode("words").alias("term"))
        posted = sources.select(F.col("source").alias("id"), F.explode("words").alias("term"), F.lit(1).alias("w"))
        met = stored(scored(asked, posted).select(F.col("q").alias("claim"), F.col("id").alias("source")), "met")
        claims = claims.where(n >= least)
    met = met.join(claims.select(*keys, "claim", F.col("words").alias("c")), [*keys, "claim"]).join(sources.select(*keys, "source", F.col("words").alias("s")), [*keys, "source"])
    contained = F.size(F.array_intersect("c", "s")) / F.size("c")
    return met.select(*keys, "claim", "source", contained.alias("contained")).where(F.col("contained") >= share)


def similar_claims(claims: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys, a, b (a < b) and similarity: claims of equal keys of which one holds the share of the other's words. claims: keys, claim, words."""
    sources = claims.withColumnRenamed("claim", "source")
    pairs = containments(claims, sources, keys, share).where("claim <> source")
    pairs = pairs.select(*keys, F.least("claim", "source").alias("a"), F.greatest("claim", "source").alias("b"), "contained")
    return pairs.groupBy(*keys, "a", "b").agg(F.max("contained").alias("similarity"))


def claim_clusters(claims: DataFrame, keys: list[str], share: float) -> DataFrame:
    """claim and cluster (the smallest claim that it is connected with) of claims whose numbers are unique over all keys.

    Claims of one word set under equal keys are one node, so that groups of copies make no pairs.
    """
    first = Window.partitionBy(*keys, "name")
    named = claims.withColumn("name", F.sha2(F.array_join(F.array_sort("words"), " "), 256)).withColumn("node", F.min("claim").over(first))
    named = named.withColumn("node", F.when(F.size("words") > 0, F.col("node")).otherwise(F.col("claim")))
    nodes = named.where("claim = node").select(*keys, "claim", "words")
    roots = components(similar_claims(nodes, keys, share).select("a", "b")).withColumnRenamed("root", "cluster")
    return named.select("claim", "node").join(roots, "node", "left").select("claim", F.coalesce("cluster", "node").alias("cluster"))


def citation_codes(claims: DataFrame, retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """claims with code (null: nothing found): what a claim cites against what its context holds.

    claims: keys, layer, cited (the group as it was written), gid (null if that is no group) and verse; retrieved: keys,
    gid, verse. Each fact about the context is a left join on distinct keys, so that a context may be of any size.
    """
    mark = lambda rows, name: rows.distinct().withColumn(name, F.lit(True))
    groups = mark(retrieved.select(*keys, "gid"), "_group")
    pairs = mark(retrieved.select(*keys, "gid", "verse"), "_pair")
    verses = mark(retrieved.select(*keys, "verse"), "_verse")
    rows = claims.join(groups, [*keys, "gid"], "left").join(pairs, [*keys, "gid", "verse"], "left").join(verses, [*keys, "verse"], "left")
    made_up = F.col("layer") == "synthesis"
    code = (
        F.when(made_up, F.when(F.col("cited").isNotNull() | F.col("verse").isNotNull(), "SYNTHESIS_WITH_CITATION"))
        .when(F.col("cited").isNull() | F.col("verse").isNull(), "MISSING_PROVENANCE")
        .when(F.col("_group") & F.col("_pair").isNull(), "VERSE_GROUP_MISMATCH")
        .when(F.col("gid").isNull() & F.col("_verse").isNull(), "VERSE_NOT_RETRIEVED")
    )
    return rows.select(*claims.columns, code.alias("code"))
