"""Exact joins of sparse rows through an inverted index: sets by Jaccard, counts by cosine.

Both rest on prefixes. All rows list their items in one order, rare items first. A pair that
is similar enough must share an item among the first ones of both, so only these are
indexed, and a rare item is in few rows. What a shared item, its place and the
size of both rows still allow is bounded before a pair is passed on; pairs that remain
are compared whole. Equal rows are one row beforehand, so that copies make no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.session import written

_SLACK = 1e-9


def _in_order(entries: DataFrame) -> DataFrame:
    """(id, item, ...) with `place` from 1: the items of a row from rare to frequent."""
    frequency = entries.groupBy("item").agg(F.count("*").alias("rows"))
    order = W.partitionBy("id").orderBy("rows", "item")
    return entries.join(frequency, "item").withColumn("place", F.row_number().over(order))


# -- sets --------------------------------------------------------------------------


def fold_sets(sets: DataFrame, items: str) -> DataFrame:
    """One row per distinct set of sets(id, <items>): id (the lowest), pages, items (sorted,
    each once). Empty and null sets are left out: no set is similar to them."""
    each = sets.select("id", F.array_sort(F.array_distinct(F.array_compact(items))).alias("items"))
    return each.where(F.size("items") > 0).groupBy("items").agg(
        F.min("id").alias("id"), F.count("*").alias("pages")
    )


def set_probes(folded: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: pairs of sets that share an item of their prefixes and whose sizes and
    places allow a Jaccard similarity of `least`; one row for each such item."""
    sized = folded.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    # |x & y| >= least * |x | y| >= least * n, so at most n - ceil(least * n) items are missed.
    prefix = F.col("n") - F.ceil(F.col("n") * least - _SLACK) + 1
    index = written(_in_order(sized).where(F.col("place") <= prefix).select("item", "id", "n", "place"), "prefixes")
    x, y = index.alias("x"), index.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    fits = (n >= m * least - _SLACK) & (m >= n * least - _SLACK)
    # This item and what follows it in both is the most the sets can share from here on; what
    # they share before it would be a probe of its own with an earlier place.
    shared = F.least(n - F.col("x.place"), m - F.col("y.place")) + F.least("x.place", "y.place")
    enough = shared >= F.ceil((n + m) * (least / (1 + least)) - _SLACK)
    met = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.id") < F.col("y.id")))
    return met.where(fits & enough).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def similar_sets(sets: DataFrame, items: str, least: float = 0.8) -> DataFrame:
    """(a, b, page_pairs, jaccard): every pair of distinct sets of sets(id, <items>) with a
    Jaccard similarity of at least `least` (above 0).

    A set stands for all rows that hold it, under their lowest id; `page_pairs` is the number
    of pairs of rows, and a = b stands for the rows of one set among themselves."""
    if least <= 0:
        raise ValueError("least must be above 0, or no pair can be ruled out")
    folded = written(fold_sets(sets, items), "sets")
    pairs = set_probes(folded, least).distinct()
    one = folded.select(F.col("id").alias("a"), F.col("items").alias("x"), F.col("pages").alias("p"))
    two = folded.select(F.col("id").alias("b"), F.col("items").alias("y"), F.col("pages").alias("q"))
    both = F.size(F.array_intersect("x", "y"))
    jaccard = both / (F.size("x") + F.size("y") - both)
    met = pairs.join(one, "a").join(two, "b").withColumn("jaccard", jaccard)
    across = met.where(F.col("jaccard") >= least).select(
        "a", "b", (F.col("p") * F.col("q")).alias("page_pairs"), "jaccard"
    )
    return across.unionByName(_within(folded).withColumn("jaccard", F.lit(1.0)))


def _within(folded: DataFrame) -> DataFrame:
    pairs = F.expr("pages * (pages - 1) div 2").alias("page_pairs")
    return folded.where("pages > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), pairs)


# -- counts ------------------------------------------------------------------------


def count_probes(rows: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: pairs of rows(id, counts: array of (tag, n)) that can have a cosine of
    `least`; one row for each item of both prefixes that lets them meet.

    The rows are taken as unit vectors. A prefix ends where the rest is shorter than `least`:
    two rows that share no item of both prefixes have all they share in the rest of one. And as
    their distance is at most sqrt(2 - 2 * least), so is the difference of every weight: an
    item is indexed in buckets of that width and meets the two neighbouring ones only. What
    comes before and after the item is bounded by its length."""
    width = max((2.0 - 2.0 * least) ** 0.5, 1e-6)
    square = F.aggregate("counts", F.lit(0.0), lambda s, e: s + e["n"] * e["n"])
    unit = rows.withColumn("length", F.sqrt(square)).where("length > 0")
    entries = unit.select("id", "length", F.explode("counts").alias("e")).select(
        "id", F.col("e.tag").alias("item"), (F.col("e.n") / F.col("length")).alias("weight")
    )
    before = W.partitionBy("id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(before), F.lit(0.0))
    ordered = _in_order(entries).withColumn("before", passed)
    indexed = ordered.where(1.0 - F.col("before") >= least * least - _SLACK)
    bucket = F.floor(F.col("weight") / width)
    index = written(indexed.select("item", "id", "weight", "before", bucket.alias("bucket")), "count-index")
    near = F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)]))
    x = index.withColumn("bucket", near).alias("x")
    y = index.alias("y")
    met = x.join(
        y,
        (F.col("x.item") == F.col("y.item"))
        & (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.id") < F.col("y.id")),
    )

    def rest(side: str) -> Column:
        weight = F.col(f"{side}.weight")
        return F.sqrt(F.greatest(1.0 - F.col(f"{side}.before") - weight * weight, F.lit(0.0)))

    most = (
        F.sqrt(F.col("x.before") * F.col("y.before"))
        + F.col("x.weight") * F.col("y.weight")
        + rest("x") * rest("y")
    )
    return met.where(most >= least - _SLACK).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def alike_counts(rows: DataFrame, least: float) -> DataFrame:
    """The pairs of `count_probes`, each once."""
    if least <= 0:
        raise ValueError("least must be above 0, or no pair can be ruled out")
    return count_probes(rows, least).distinct()
