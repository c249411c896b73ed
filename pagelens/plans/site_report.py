"""The site report: feature vectors, lens by lens similarity, top pairs and coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators import scaling, vector_join
from pagelens.operators.dom import parse_pages
from pagelens.operators.features import feature_vector
from pagelens.session import written
from pagelens.sources.results import write_json, write_result

FIELDS = ("tag", "attrs", "classes")
TOP_PAIRS = 10


@dataclass
class SiteReport:
    features: DataFrame
    lenses: dict[str, DataFrame]  # lens -> (id, vector)
    top: DataFrame
    summary: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def structural_features(pages: DataFrame) -> DataFrame:
    return written(feature_vector(parse_pages(pages, fields=FIELDS)), "features")


def lens_vectors(
    features: DataFrame, visual: DataFrame | None = None, signals: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Vectors per lens. `visual(id, vector)` comes from any image model; `signals`
    (page_id + numbers) are joined to the features as more columns."""
    table = features if signals is None else features.join(signals, "page_id", "left")
    lenses = {"structural": written(scaling.standard_vectors(table), "structural")}
    if visual is not None:
        lenses["visual"] = visual.select("id", F.col("vector").cast("array<double>"))
        combined = scaling.combine(lenses["structural"], lenses["visual"])
        lenses["combined"] = written(combined, "combined-vectors")
    return lenses


def top_similar(lenses: dict[str, DataFrame], urls: DataFrame, k: int = TOP_PAIRS) -> DataFrame:
    """The k most similar pairs of every lens, with both URLs."""
    parts = [
        vector_join.top_pairs(vectors, k).withColumn("lens", F.lit(lens))
        for lens, vectors in lenses.items()
    ]
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.unionByName(part)
    # k rows per lens against the URL table.
    named = F.broadcast(ranked)
    first = urls.select(F.col("page_id").alias("a"), F.col("url").alias("url1"))
    second = urls.select(F.col("page_id").alias("b"), F.col("url").alias("url2"))
    joined = second.join(F.broadcast(first.join(named, "a")), "b")
    return joined.select("lens", "rank", "a", "b", "similarity", "url1", "url2")


def lens_coverage(pages: DataFrame, lenses: dict[str, DataFrame]) -> DataFrame:
    """One row per lens: pages in all, pages covered, dimension, mean similarities."""
    total = pages.agg(F.count("*").alias("total_pages"))
    parts = None
    for lens, vectors in lenses.items():
        means = vector_join.mean_similarity(vectors)
        size = vectors.agg(F.max(F.size("vector")).cast("bigint").alias("dimension"))
        row = means.join(F.broadcast(size)).select(
            F.lit(lens).alias("lens"), "vectors", "dimension", "mean_full", "mean_upper"
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts.join(F.broadcast(total))


def analyse(
    pages: DataFrame, visual: DataFrame | None = None, signals: DataFrame | None = None
) -> SiteReport:
    """Run the whole site analysis of `pages(page_id, url, html)`."""
    features = structural_features(pages)
    lenses = lens_vectors(features, visual, signals)
    urls = pages.select("page_id", "url")
    summary = lens_coverage(urls, lenses).withColumn("analysed_at", F.current_timestamp())
    return SiteReport(features, lenses, top_similar(lenses, urls), summary)


def save(report: SiteReport, path: str) -> str:
    write_json(scaling.profile(report.features), f"{path}/feature_profile")
    parts = {"top_similar": report.top, "page_features": report.features}
    return write_result(path, report.summary, parts)
