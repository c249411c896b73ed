"""Result documents of vectors and features: a summary of bounded size, the rest as JSON
lines, one per page or pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators import scaling, vector_join
from pagelens.plans.semantic import SemanticReport
from pagelens.sources.results import write_json, write_result

VISUAL_LIMIT = 0.8  # fixed value: from here on two pages look very similar


def vector_summary(vectors: DataFrame) -> DataFrame:
    """One row: how many pages, the mean similarity over the full matrix, the dimension."""
    means = vector_join.mean_similarity(vectors)
    size = vectors.agg(F.max(F.size("vector")).cast("bigint").alias("embedding_dimension"))
    return means.join(F.broadcast(size)).select(  # one-row tables
        F.col("vectors").alias("total_files"),
        F.col("mean_full").alias("average_similarity"),
        "embedding_dimension",
    )


def save_visual(vectors: DataFrame, path: str, min_similarity: float = VISUAL_LIMIT) -> str:
    """`summary`, the analysed pages with their vectors, and the matrix entries from
    `min_similarity` on, copies folded (see `similar_pairs`)."""
    parts = {"files": vectors, "similar": vector_join.similar_pairs(vectors, min_similarity)}
    return write_result(path, vector_summary(vectors), parts)


def save_text_embeddings(report: SemanticReport, path: str) -> str:
    """`summary`, the text vectors, the pages without one and why, the neighbours."""
    parts = {"embeddings": report.vectors, "missing": report.missing, "neighbours": report.neighbours}
    return write_result(path, vector_summary(report.vectors), parts)


def feature_maps(features: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """The feature names and their statistics as one row of maps, and a map of features
    for every page."""
    names = scaling.numeric_columns(scaling.numeric_features(features, key), key)
    profile = scaling.profile(features, key)
    stats = [c for c in profile.columns if c != "feature"]
    each = F.create_map(*[x for c in stats for x in (F.lit(c), F.col(c).cast("double"))])
    # As many entries as there are features.
    document = profile.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", each))).alias("feature_stats")
    ).withColumn("feature_names", F.array(*[F.lit(n) for n in names]))
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    return document, features.select(key, F.create_map(*pairs).alias("features"))


def save_features(features: DataFrame, path: str, key: str = "page_id") -> str:
    document, pages = feature_maps(features, key)
    write_json(pages, f"{path}/page_features")
    return write_result(path, document, {})
