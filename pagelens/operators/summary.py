"""Summaries of corpora and pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators.dom import parse_pages
from pagelens.operators.features import DEPTH_LIMIT, class_tokens, count_of, long_size, tags
from pagelens.operators.ranks import quantiles, running_counts

SCORE_DIGITS = 6  # spread statistics are taken on scores rounded to this many places


def type_members(members: DataFrame, typed: DataFrame) -> DataFrame:
    """(sig, page_type, pages): pages of each type under each signature."""
    return members.join(typed, "page_id").groupBy("sig", "page_type").agg(
        F.count("*").alias("pages")
    )


def type_document(distribution: DataFrame) -> DataFrame:
    """One row: pages in all and pages by type (as many entries as there are types)."""
    entries = F.collect_list(F.struct("page_type", "pages"))
    return distribution.agg(
        F.sum("pages").alias("total_files"),
        F.map_from_entries(entries).alias("page_type_distribution"),
    )


def within_type_pairs(similar: DataFrame, by_type: DataFrame) -> DataFrame:
    """Similar structures whose pages share a type: (page_type, a, b, page_pairs, scores).

    `page_pairs` counts pairs of pages of that type, so types with one page give none.
    """
    left = by_type.select(F.col("sig").alias("a"), "page_type", F.col("pages").alias("n_a"))
    right = by_type.select(F.col("sig").alias("b"), "page_type", F.col("pages").alias("n_b"))
    joined = similar.select("a", "b", "score_ab", "score_ba").join(left, "a")
    typed = joined.join(right, ["b", "page_type"])
    same = F.expr("n_a * (n_a - 1) div 2")
    pairs = F.when(F.col("a") == F.col("b"), same).otherwise(F.col("n_a") * F.col("n_b"))
    counted = typed.withColumn("page_pairs", pairs).where("page_pairs > 0")
    return counted.select("page_type", "a", "b", "page_pairs", "score_ab", "score_ba")


def within_type_spread(pairs: DataFrame, by_type: DataFrame) -> DataFrame:
    """Box-plot numbers of the scores above the limit of `pairs`, by type, types by falling
    median; `pairs_possible` counts all pairs of the type's pages.

    Both orders of each pair count. Quartiles interpolate; whiskers are the furthest
    scores within 1.5 x IQR of the quartiles.
    """
    sizes = by_type.groupBy("page_type").agg(F.sum("pages").alias("n"))
    possible = sizes.select("page_type", F.expr("n * (n - 1) div 2").alias("pairs_possible"))
    order = F.array("score_ab", "score_ba")
    scores = pairs.select("page_type", "page_pairs", F.explode(order).alias("raw"))
    rounded = scores.withColumn("score", F.round("raw", SCORE_DIGITS))
    counts = running_counts(rounded, "page_type", "score", F.col("page_pairs"))
    quarters = quantiles(counts, "page_type", "score", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    score = F.col("score")
    low, high = F.col("q1") - reach, F.col("q3") + reach
    whiskers = counts.join(quarters, "page_type").groupBy("page_type", "q1", "median", "q3").agg(
        F.min(F.when(score >= low, score)).alias("whisker_low"),
        F.max(F.when(score <= high, score)).alias("whisker_high"),
        F.max("total").alias("scores"),
    )
    # One row per type on both sides.
    return whiskers.join(possible, "page_type").orderBy(F.desc("median"), "page_type")


def typed_pair_analysis(
    similar: DataFrame, by_type: DataFrame, focus: str = "product"
) -> DataFrame:
    """Similar pairs among pages of one type (the product-page report)."""
    return within_type_pairs(similar, by_type.where(F.col("page_type") == focus))


def first_of_types(typed: DataFrame, first: str = "product", second: str = "cart") -> DataFrame:
    """The first page of each of two types as one pair (a, b); none if a type is absent or
    the first type has a single page."""
    picks = typed.agg(
        F.min(F.when(F.col("page_type") == first, F.col("page_id"))).alias("a"),
        F.min(F.when(F.col("page_type") == second, F.col("page_id"))).alias("b"),
        F.count_if(F.col("page_type") == first).alias("n"),
    )
    return picks.where("n >= 2 and a is not null and b is not null").select("a", "b")


def mean_of_pairs(pairs: DataFrame, pages: DataFrame, score: str = "similarity") -> DataFrame:
    """How many of all pairs of `pages` the table stands for (those above its limit), and
    their mean, weighted by `page_pairs`. It is no mean over all pairs."""
    weight = F.col("page_pairs")
    above = pairs.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("pairs_above_limit"),
        (F.sum(F.col(score) * weight) / F.sum(weight)).alias("mean_above_limit"),
    )
    possible = pages.agg(F.expr("count(*) * (count(*) - 1) div 2").alias("pairs_possible"))
    return above.join(F.broadcast(possible))  # one-row tables


def feature_sample(pages: DataFrame, count: int = 3) -> DataFrame:
    """The first pages with a few of their features (a report line, three by default).

    The pages are picked before they are parsed.
    """
    first = pages.select("page_id", "html").orderBy("page_id").limit(count)
    parsed = parse_pages(first, fields=("tag", "classes", "depth"), texts=False)
    depths = F.slice(F.transform("elements", lambda e: e["depth"]), 1, DEPTH_LIMIT)
    return parsed.select(
        "page_id",
        long_size(F.array_distinct(tags())).alias("unique_tags"),
        long_size(F.array_distinct(class_tokens())).alias("unique_classes"),
        count_of(tags(), "form").alias("form_count"),
        F.coalesce(F.array_max(depths), F.lit(0)).cast("bigint").alias("max_depth"),
    )
