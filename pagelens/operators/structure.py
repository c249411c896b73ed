"""Structural similarity of pages: signatures, pair terms, composite score.

The composite score of two pages depends on their structure alone, so pages of equal
structure (one template) are folded into one signature first and scored once. The
reference scale is kept: the score is a mean of weighted terms and goes up to 1.3.

The full n x n matrix is not built. `similar_structures` finds every pair that scores
at least `min_score`, which is exact and follows from upper bounds on the terms: the
numbers of a signature go through the block join of `vector_join`, whose tasks hand
back only the pairs that can still reach the score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.barrier import settled
from pagelens.operators.features import (
    FORM_TAGS,
    SEQUENCE_COMPARED,
    class_tokens,
    count_of,
    id_class_patterns,
    id_values,
    long_size,
    tags,
)
from pagelens.operators.matching import with_ratios
from pagelens.operators.set_join import alike_counts, similar_sets
from pagelens.operators.vector_join import candidate_pairs
from pagelens.session import written

# Weights of the sequence term and of the pattern term; the others weigh 1.
SEQUENCE_WEIGHT = 2.0
PATTERN_WEIGHT = 1.5

# Most frequent names that get a place of their own in a count vector. The others share
# one last place, which can only raise a similarity, so candidates stay complete.
TAG_PLACES = 127
TOKEN_PLACES = 255
PATTERN_BUCKETS = 64

# Element fields the signature reads.
SIGNATURE_FIELDS = ("tag", "attrs", "classes")

FORM_COUNTS = [f"{tag}_count" for tag in FORM_TAGS]
STRUCTURE = ["seq", "counts", "unique_classes", "unique_ids", *FORM_COUNTS, "patterns"]


# -- signatures --------------------------------------------------------------------


def with_tally(rows: DataFrame, names: str, name: str = "counts") -> DataFrame:
    """`rows` with (tag, n) of each name of an array, in name order. The names are sorted once;
    a name's run in that order is its count."""
    starts = F.filter(
        F.transform("__sorted", lambda tag, i: F.struct(tag.alias("tag"), i.alias("at"))),
        lambda e, i: (i == 0) | (F.get("__sorted", i - 1) != e["tag"]),
    )
    counted = F.transform(
        "__starts",
        lambda e, i: F.struct(
            e["tag"],
            (F.coalesce(F.get("__starts", i + 1)["at"], F.size("__sorted")) - e["at"])
            .cast("bigint")
            .alias("n"),
        ),
    )
    step = rows.withColumn("__sorted", settled(F.sort_array(names)))
    step = step.withColumn("__starts", settled(starts)).withColumn(name, settled(counted))
    return step.drop("__sorted", "__starts")


def page_structures(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per page: everything the score reads, and `structure`, a digest of it."""
    flat = parsed.select(
        "page_id",
        *keep,
        tags().alias("tags"),
        class_tokens().alias("classes"),
        id_values().alias("ids"),
        F.array_sort(F.array_distinct(id_class_patterns())).alias("patterns"),
    )
    tag_array = F.col("tags")
    described = with_tally(flat, "tags").select(
        "page_id",
        *keep,
        F.slice(tag_array, 1, SEQUENCE_COMPARED).alias("seq"),
        "counts",
        long_size(F.array_distinct("classes")).alias("unique_classes"),
        long_size(F.array_distinct("ids")).alias("unique_ids"),
        *[count_of(tag_array, tag).alias(f"{tag}_count") for tag in FORM_TAGS],
        "patterns",
    )
    return described.withColumn("structure", F.md5(F.to_json(F.struct(*STRUCTURE))))


def signatures(structures: DataFrame) -> DataFrame:
    """One row per distinct structure: `sig` (its lowest page id), pages, the structure.

    Grouped with partial aggregation, so a template held by a third of all pages is one
    row per task before the shuffle.
    """
    described = F.struct(*STRUCTURE)
    grouped = structures.groupBy("structure").agg(
        F.min("page_id").alias("sig"), F.count("*").alias("pages"), F.min(described).alias("s")
    )
    return grouped.select("structure", "sig", "pages", "s.*")


def membership(structures: DataFrame, sigs: DataFrame, *keep: str) -> DataFrame:
    """(page_id, sig): which signature each page has."""
    slim = structures.select("page_id", *keep, "structure")
    return slim.join(sigs.select("structure", "sig"), "structure").drop("structure")


# -- pair terms, as expressions over two signature rows -----------------------------


def relative_difference(x: Column, y: Column) -> Column:
    return F.abs(x - y) / F.greatest(x, y, F.lit(1))


def with_lookup(rows: DataFrame) -> DataFrame:
    """Add what the tag term reads: counts as a map, and their sum of squares."""
    square = F.aggregate(
        "counts", F.lit(0).cast("bigint"), lambda total, e: total + e["n"] * e["n"]
    )
    by_tag = F.map_from_entries("counts")
    return rows.withColumn("tag_map", by_tag).withColumn("square", square)


def tag_similarity(a: Column, b: Column) -> Column:
    """Cosine of the tag counts; null when neither page has tags, 0 when one has none."""
    zero = F.lit(0).cast("bigint")
    dot = F.aggregate(
        a["counts"],
        zero,
        lambda total, e: total + e["n"] * F.coalesce(F.element_at(b["tag_map"], e["tag"]), zero),
    )
    lengths = F.sqrt(a["square"]) * F.sqrt(b["square"])
    some = (a["square"] > 0) | (b["square"] > 0)
    return F.when(some, F.when(lengths > 0, dot / lengths).otherwise(0.0))


def css_similarity(a: Column, b: Column) -> Column:
    parts = [relative_difference(a[c], b[c]) for c in ("unique_classes", "unique_ids")]
    return F.lit(1.0) - (parts[0] + parts[1]) / 2


def form_similarity(a: Column, b: Column) -> Column:
    total = F.lit(0.0)
    for name in FORM_COUNTS:
        total = total + relative_difference(a[name], b[name])
    return F.lit(1.0) - total / len(FORM_COUNTS)


def pattern_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the pattern sets; null when neither page has patterns."""
    union = F.size(F.array_union(a["patterns"], b["patterns"]))
    both = F.size(F.array_intersect(a["patterns"], b["patterns"]))
    return F.when(union > 0, both / union)


def composite(sequence: Column, tag: Column, css: Column, form: Column, pattern: Column) -> Column:
    """Mean of the weighted terms that are present."""
    total = (
        sequence * SEQUENCE_WEIGHT
        + F.coalesce(tag, F.lit(0.0))
        + css
        + form
        + F.coalesce(pattern, F.lit(0.0)) * PATTERN_WEIGHT
    )
    return total / (F.lit(3) + tag.isNotNull().cast("int") + pattern.isNotNull().cast("int"))


def normalised(score: Column, tag: Column, pattern: Column) -> Column:
    """Score over the greatest score its terms allow, so that equal structures have 1."""
    terms = F.lit(3) + tag.isNotNull().cast("int") + pattern.isNotNull().cast("int")
    weight = (
        F.lit(SEQUENCE_WEIGHT + 2)
        + tag.isNotNull().cast("double")
        + pattern.isNotNull().cast("double") * PATTERN_WEIGHT
    )
    return score * terms / weight


# -- the joins ---------------------------------------------------------------------


def frequent_names(rows: DataFrame, names: Column, places: int) -> list[str]:
    """The names most rows hold: at most `places` strings come back."""
    single = rows.select(F.explode(F.array_distinct(names)).alias("name"))
    counted = single.groupBy("name").count().orderBy(F.desc("count"), "name").limit(places)
    return [row.name for row in counted.select("name").collect()]


def count_vector(vocabulary: list[str], square: Column) -> Column:
    """Counts of the vocabulary's tags from `tag_map`, and the length of all the rest."""
    listed = F.transform(
        F.lit(vocabulary) if vocabulary else F.array().cast("array<string>"),
        lambda name: F.coalesce(F.element_at("tag_map", name), F.lit(0)).cast("double"),
    )
    held = F.aggregate(listed, F.lit(0.0), lambda total, n: total + n * n)
    return F.concat(listed, F.array(F.sqrt(F.greatest(square - held, F.lit(0.0)))))


def similar_structures(sigs: DataFrame, min_score: float = 1.2) -> DataFrame:
    """Every pair of signatures whose composite score, in either order, is at least
    `min_score` (above 0.9: below, no sequence overlap is needed and nothing is pruned).

    With all other terms at their greatest, the score needs a sequence ratio of at least
    (5 min_score - 4.5) / 2. The ratio is at most the Dice overlap of the tag multisets,
    and that is at most the cosine of the vectors of numbered tags (`p#1`, `p#2`, ...).
    So a cosine join on these finds every pair; its tasks also bound the whole score from
    the counts, and only pairs that can reach it go to the matcher.

    A row stands for `page_pairs` pairs of pages; a = b stands for the pages of one
    signature among themselves.
    """
    needed = (5 * min_score - (3 + PATTERN_WEIGHT)) / SEQUENCE_WEIGHT
    if needed <= 0:
        raise ValueError("min_score must be above 0.9, or no pair can be ruled out")
    numbered = F.transform(
        "seq",
        lambda tag, i: F.concat(
            tag,
            F.lit("#"),
            F.size(F.filter(F.slice("seq", F.lit(1), i + 1), lambda t: t == tag)).cast("string"),
        ),
    )
    base = written(
        with_lookup(sigs.drop("structure")).withColumn("tokens", numbered), "signatures"
    )
    met = candidate_pairs(_shapes(base), min(needed, 1.0) - 1e-9, _can_reach(min_score))
    ratios = with_ratios(met, base.select(F.col("sig").alias("id"), "seq"))
    # What else the score reads joins only pairs whose ratio can still reach it.
    able = ratios.where(F.greatest("seq_ab", "seq_ba") >= needed - 1e-9)
    payload = F.struct(*[c for c in base.columns if c not in ("tokens", "seq")])
    one = base.select(F.col("sig").alias("a"), payload.alias("one"))
    two = base.select(F.col("sig").alias("b"), payload.alias("two"))
    scored = able.join(one, "a").join(two, "b").select(
        "a",
        "b",
        F.col("one.pages").alias("pages_a"),
        F.col("two.pages").alias("pages_b"),
        (F.col("one.pages") * F.col("two.pages")).alias("page_pairs"),
        "seq_ab",
        "seq_ba",
        *[term.alias(name) for name, term in _other_terms(F.col("one"), F.col("two")).items()],
    )
    alone = base.where("pages > 1").select(
        F.col("sig").alias("a"),
        F.col("sig").alias("b"),
        F.col("pages").alias("pages_a"),
        F.col("pages").alias("pages_b"),
        F.expr("pages * (pages - 1) div 2").alias("page_pairs"),
        F.lit(1.0).alias("seq_ab"),
        F.lit(1.0).alias("seq_ba"),
        *[term.alias(name) for name, term in _other_terms(payload, payload).items()],
    )
    return with_scores(scored.unionByName(alone)).where(
        F.greatest("score_ab", "score_ba") >= min_score
    )


_NUMBERS = ["unique_classes", "unique_ids", *FORM_COUNTS]


def _shapes(base: DataFrame) -> DataFrame:
    """(id, vector, extra): numbered tags as a 0/1 vector, and what the bound reads.

    Tags without a place of their own count, all together, as the root of their number in
    one last place: the product of two roots is at least the smaller number. Patterns are
    counted by hash bucket: two sets share at most the sum of the smaller counts.
    """
    tokens = frequent_names(base, F.col("tokens"), TOKEN_PLACES)
    names = frequent_names(base, F.map_keys("tag_map"), TAG_PLACES)
    listed = F.transform(
        F.lit(tokens) if tokens else F.array().cast("array<string>"),
        lambda token: F.array_contains("tokens", token).cast("double"),
    )
    held = F.aggregate(listed, F.lit(0.0), lambda total, n: total + n)
    others = F.sqrt(F.greatest(F.size("tokens") - held, F.lit(0.0)))
    hashed = F.transform(
        "patterns", lambda p: F.pmod(F.xxhash64(p), F.lit(PATTERN_BUCKETS)).cast("int")
    )
    buckets = F.transform(
        F.sequence(F.lit(0), F.lit(PATTERN_BUCKETS - 1)),
        lambda b: F.size(F.filter(hashed, lambda h: h == b)).cast("double"),
    )
    extra = F.concat(
        F.array(
            F.size("seq").cast("double"), *[F.col(name).cast("double") for name in _NUMBERS]
        ),
        buckets,
        count_vector(names, F.col("square")),
    )
    return base.select(
        F.col("sig").alias("id"), F.concat(listed, F.array(others)).alias("vector"), extra.alias("extra")
    )


def _can_reach(min_score: float):
    """Test for blocks of shapes: can the score of a pair be `min_score` or more?"""
    numbers = 1 + len(_NUMBERS)
    tags_from = numbers + PATTERN_BUCKETS

    def keep(left: np.ndarray, right: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        def apart(c: int) -> np.ndarray:
            x, y = left[:, c][:, None], right[:, c][None, :]
            return np.abs(x - y) / np.maximum(np.maximum(x, y), 1.0)

        sizes = left[:, 0][:, None], right[:, 0][None, :]
        overlap = cosines * np.sqrt(sizes[0] * sizes[1])
        dice = np.minimum(2.0 * overlap / (sizes[0] + sizes[1]), 1.0)
        tags = [side[:, tags_from:] for side in (left, right)]
        lengths = [np.linalg.norm(t, axis=1) for t in tags]
        tag = np.minimum((tags[0] @ tags[1].T) / np.outer(*lengths), 1.0)
        css = 1.0 - (apart(1) + apart(2)) / 2
        form = 1.0 - sum(apart(3 + n) for n in range(len(FORM_COUNTS))) / len(FORM_COUNTS)
        total = SEQUENCE_WEIGHT * dice + tag + css + form
        buckets = [side[:, numbers:tags_from] for side in (left, right)]
        held = [b.sum(axis=1) for b in buckets]
        patterned = np.maximum.outer(held[0], held[1]) > 0
        passed = (total + PATTERN_WEIGHT * patterned) / (4.0 + patterned) >= min_score - 1e-9
        # Where patterns count, the greatest Jaccard their buckets allow, pair by pair.
        xs, ys = np.nonzero(passed & patterned)
        for at in range(0, len(xs), _PAIRS_AT_ONCE):
            x, y = xs[at:at + _PAIRS_AT_ONCE], ys[at:at + _PAIRS_AT_ONCE]
            shared = np.minimum(buckets[0][x], buckets[1][y]).sum(axis=1)
            jaccard = shared / (held[0][x] + held[1][y] - shared)
            score = (total[x, y] + PATTERN_WEIGHT * jaccard) / 5.0
            passed[x, y] = score >= min_score - 1e-9
        return passed

    return keep


_PAIRS_AT_ONCE = 100_000


def _other_terms(a: Column, b: Column) -> dict[str, Column]:
    return {
        "tag_sim": tag_similarity(a, b),
        "css_sim": css_similarity(a, b),
        "form_sim": form_similarity(a, b),
        "pattern_sim": pattern_similarity(a, b),
    }


def with_scores(terms: DataFrame) -> DataFrame:
    """Add the raw score in both orders and the normalised score to rows of pair terms."""
    tag, css, form, pattern = (
        F.col(name) for name in ("tag_sim", "css_sim", "form_sim", "pattern_sim")
    )
    ab = composite(F.col("seq_ab"), tag, css, form, pattern)
    ba = composite(F.col("seq_ba"), tag, css, form, pattern)
    scored = terms.withColumn("score_ab", ab).withColumn("score_ba", ba)
    return scored.withColumn("score_norm", normalised(F.col("score_ab"), tag, pattern))


def score_listed(pairs: DataFrame, structures: DataFrame) -> DataFrame:
    """All terms and scores of listed page pairs (a, b)."""
    row = F.struct(*[c for c in STRUCTURE if c != "seq"], "tag_map", "square")
    looked_up = with_lookup(structures)
    left = looked_up.select(F.col("page_id").alias("a"), row.alias("x"))
    right = looked_up.select(F.col("page_id").alias("b"), row.alias("y"))
    ratios = with_ratios(pairs, structures.select(F.col("page_id").alias("id"), "seq"))
    terms = ratios.join(left, "a").join(right, "b").select(
        *pairs.columns,
        "seq_ab",
        "seq_ba",
        *[term.alias(name) for name, term in _other_terms(F.col("x"), F.col("y")).items()],
    )
    return with_scores(terms)


def similar_patterns(structures: DataFrame, least: float = 0.8) -> DataFrame:
    """Every pair of distinct id and class pattern sets with a Jaccard similarity of at least
    `least`; pages without patterns have no term and take no part."""
    return similar_sets(structures.select(F.col("page_id").alias("id"), "patterns"), "patterns", least)


# -- the tag-count lens ------------------------------------------------------------


def page_tag_counts(parsed: DataFrame) -> DataFrame:
    return with_tally(parsed.select("page_id", tags().alias("tags")), "tags").select("page_id", "counts")


def tag_groups(counted: DataFrame) -> DataFrame:
    """One row per distinct set of tag counts: `sig` (its lowest page id), pages, counts."""
    return counted.groupBy("counts").agg(
        F.min("page_id").alias("sig"), F.count("*").alias("pages")
    )


def group_membership(counted: DataFrame, groups: DataFrame) -> DataFrame:
    return counted.join(groups.select("counts", "sig"), "counts").select("page_id", "sig")


def similar_tag_counts(groups: DataFrame, min_similarity: float) -> DataFrame:
    """Every pair of tag-count groups with cosine of at least `min_similarity` (> 0).

    An inverted index of the tags that can decide finds every pair (`set_join`); the
    similarity itself comes from the whole counts. A row stands for
    `page_pairs` pairs of pages; a = b stands for the pages of one group among themselves.
    """
    if min_similarity <= 0:
        raise ValueError("min_similarity must be above 0, or no pair can be ruled out")
    base = written(with_lookup(groups), "tag-counts")
    met = alike_counts(base.select(F.col("sig").alias("id"), "counts"), min_similarity)
    payload = F.struct("pages", "counts", "tag_map", "square")
    one = base.select(F.col("sig").alias("a"), payload.alias("one"))
    two = base.select(F.col("sig").alias("b"), payload.alias("two"))
    pairs = met.join(one, "a").join(two, "b").select(
        "a",
        "b",
        (F.col("one.pages") * F.col("two.pages")).alias("page_pairs"),
        tag_similarity(F.col("one"), F.col("two")).alias("tag_sim"),
    )
    within = base.where("pages > 1 and square > 0").select(
        F.col("sig").alias("a"),
        F.col("sig").alias("b"),
        F.expr("pages * (pages - 1) div 2").alias("page_pairs"),
        F.lit(1.0).alias("tag_sim"),
    )
    return pairs.where(F.col("tag_sim") >= min_similarity).unionByName(within)
