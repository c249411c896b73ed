"""Per-page features as expressions over a parsed page's `elements` array.

None of the per-page features shuffles, nor do the tag counters. The counters of open
key sets (classes, ids, input types, meta names) group on page and key with partial
aggregation; a page sits in one task, so what is shuffled is one row per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.barrier import settled
from pagelens.functions.text import word_count

# How many leading elements each feature looks at.
SEQUENCE_LIMIT = 200
SEQUENCE_COMPARED = 100
DEPTH_LIMIT = 100
PATTERN_ELEMENTS = 100
PATTERN_LIMIT = 50
TOP_TAGS = 20
TOP_CLASSES = 10

# Element counts that make up the form structure, and the HTML5 tags counted.
FORM_TAGS = ["form", "input", "button", "select"]
SEMANTIC_TAGS = ["header", "nav", "main", "article", "section", "aside", "footer"]
RATIO_TAGS = ["div", "span", "p", "img"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
INDICATOR_TAGS = ["table", "video", "audio", "canvas", "svg"]

# The 28 numbers of the feature vector, in order.
VECTOR_FEATURES = (
    ["total_tags", "unique_tags", "tag_diversity"]
    + [f"{tag}_ratio" for tag in RATIO_TAGS]
    + ["total_classes", "unique_classes", "total_ids", "unique_ids"]
    + ["form_count", "input_count", "button_count", "select_count"]
    + ["internal_links", "external_links", "nav_elements"]
    + ["text_length", "word_count", "heading_count"]
    + [f"semantic_{tag}" for tag in SEMANTIC_TAGS]
)


# -- expressions over `elements` ---------------------------------------------------


def tags(elements: Column | None = None) -> Column:
    source = F.col("elements") if elements is None else elements
    return F.transform(source, lambda e: e["tag"])


def class_tokens() -> Column:
    return F.flatten(F.transform("elements", lambda e: e["classes"]))


def id_values() -> Column:
    ids = F.transform("elements", lambda e: e["attrs"]["id"])
    return F.filter(ids, lambda i: i.isNotNull() & (i != ""))


def hrefs() -> Column:
    links = F.filter(
        "elements", lambda e: (e["tag"] == "a") & F.map_contains_key(e["attrs"], "href")
    )
    return F.transform(links, lambda e: e["attrs"]["href"])


def long_size(array: Column) -> Column:
    return F.size(array).cast("bigint")


def count_of(tag_array: Column, *wanted: str) -> Column:
    return long_size(F.filter(tag_array, lambda t: t.isin(*wanted)))


def count_where(array: Column, test: Callable[[Column], Column]) -> Column:
    return long_size(F.filter(array, test))


def is_external_strict(href: Column) -> Column:
    """External link, rule A: starts with http:// or https://."""
    return F.startswith(href, F.lit("http://")) | F.startswith(href, F.lit("https://"))


def is_external_loose(href: Column) -> Column:
    """External link, rule B: starts with http."""
    return F.startswith(href, F.lit("http"))


def id_class_patterns() -> Column:
    """`id:` and `class:` patterns of the first elements, in order."""

    def of_element(e: Column) -> Column:
        ident = e["attrs"]["id"]
        numbered = F.concat(F.lit("id:"), F.regexp_replace(ident, r"(?U)\d+", "N"))
        classes = F.concat(F.lit("class:"), F.array_join(F.array_sort(e["classes"]), "."))
        return F.array(
            F.when(ident.isNotNull() & (ident != ""), numbered),
            F.when(F.size(e["classes"]) > 0, classes),
        )

    first = F.slice("elements", 1, PATTERN_ELEMENTS)
    found = F.filter(F.flatten(F.transform(first, of_element)), lambda p: p.isNotNull())
    return F.slice(found, 1, PATTERN_LIMIT)


# -- per-page features -------------------------------------------------------------


def tag_sequence(parsed: DataFrame, limit: int = SEQUENCE_LIMIT) -> DataFrame:
    return parsed.select("page_id", F.slice(tags(), 1, limit).alias("tags"))


def css_fingerprint(parsed: DataFrame) -> DataFrame:
    flat = parsed.select("page_id", class_tokens().alias("classes"), id_values().alias("ids"))
    return flat.select(
        "page_id",
        long_size(F.array_distinct("classes")).alias("unique_classes"),
        long_size(F.col("classes")).alias("total_classes"),
        long_size(F.array_distinct("ids")).alias("unique_ids"),
    )


def form_structure(parsed: DataFrame) -> DataFrame:
    flat = parsed.select("page_id", tags().alias("tags"))
    counts = [count_of(F.col("tags"), tag).alias(f"{tag}_count") for tag in FORM_TAGS]
    return flat.select("page_id", *counts)


def link_structure(parsed: DataFrame) -> DataFrame:
    flat = parsed.select("page_id", tags().alias("tags"), hrefs().alias("hrefs"))
    return flat.select(
        "page_id",
        long_size(F.col("hrefs")).alias("total_links"),
        count_where(F.col("hrefs"), lambda h: ~is_external_strict(h)).alias("internal_links"),
        count_where(F.col("hrefs"), is_external_strict).alias("external_links"),
        count_of(F.col("tags"), "nav").alias("nav_links"),
    )


def link_prefix_counts(parsed: DataFrame) -> DataFrame:
    flat = parsed.select("page_id", hrefs().alias("hrefs"))
    return flat.select(
        "page_id",
        count_where(F.col("hrefs"), lambda h: ~is_external_loose(h)).alias("internal_links"),
        count_where(F.col("hrefs"), is_external_loose).alias("external_links"),
    )


def depth_statistics(parsed: DataFrame) -> DataFrame:
    """Max, mean and population variance of depth over the first elements; 0 for none.

    Sums stay whole numbers up to the last division, so results do not depend on order.
    """
    first = F.slice(F.transform("elements", lambda e: e["depth"]), 1, DEPTH_LIMIT)
    flat = parsed.select("page_id", first.alias("depths"))
    zero = F.lit(0).cast("bigint")
    sums = flat.select(
        "page_id",
        F.size("depths").alias("n"),
        F.coalesce(F.array_max("depths"), F.lit(0)).cast("bigint").alias("max_depth"),
        F.aggregate("depths", zero, lambda s, d: s + d).alias("s"),
        F.aggregate("depths", zero, lambda s, d: s + d * d).alias("s2"),
    )
    has = F.col("n") > 0
    variance = (F.col("n") * F.col("s2") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n"))
    return sums.select(
        "page_id",
        "max_depth",
        F.when(has, F.col("s") / F.col("n")).otherwise(0.0).alias("avg_depth"),
        F.when(has, variance).otherwise(0.0).alias("depth_variance"),
    )


def pattern_list(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", id_class_patterns().alias("patterns"))


def feature_vector(parsed: DataFrame, *keep: str) -> DataFrame:
    """The 28 numbers, five indicators, one row per page (`keep`: more columns to pass on)."""
    flat = parsed.select(
        "page_id",
        *keep,
        "page_text",
        tags().alias("tags"),
        class_tokens().alias("classes"),
        id_values().alias("ids"),
        hrefs().alias("hrefs"),
    )
    tag_array = F.col("tags")
    total = F.size(tag_array)

    def ratio(count: Column) -> Column:
        return F.when(total > 0, count / total).otherwise(0.0)

    values = {
        "total_tags": long_size(tag_array),
        "unique_tags": long_size(F.array_distinct(tag_array)),
        "tag_diversity": ratio(long_size(F.array_distinct(tag_array))),
        "total_classes": long_size(F.col("classes")),
        "unique_classes": long_size(F.array_distinct("classes")),
        "total_ids": long_size(F.col("ids")),
        "unique_ids": long_size(F.array_distinct("ids")),
        "internal_links": count_where(F.col("hrefs"), lambda h: ~is_external_loose(h)),
        "external_links": count_where(F.col("hrefs"), is_external_loose),
        "nav_elements": count_of(tag_array, "nav"),
        "text_length": F.length("page_text").cast("bigint"),
        "word_count": word_count(F.col("page_text")),
        "heading_count": count_of(tag_array, *HEADING_TAGS),
    }
    values |= {f"{tag}_ratio": ratio(count_of(tag_array, tag)) for tag in RATIO_TAGS}
    values |= {f"{tag}_count": count_of(tag_array, tag) for tag in FORM_TAGS}
    values |= {f"semantic_{tag}": count_of(tag_array, tag) for tag in SEMANTIC_TAGS}
    numbers = [values[name].alias(name) for name in VECTOR_FEATURES]
    flags = [F.array_contains(tag_array, tag).alias(f"has_{tag}") for tag in INDICATOR_TAGS]
    return flat.select("page_id", *keep, *numbers, *flags)


def boolean_indicators(parsed: DataFrame) -> DataFrame:
    flat = parsed.select("page_id", tags().alias("tags"))
    flags = [F.array_contains("tags", tag).alias(f"has_{tag}") for tag in INDICATOR_TAGS]
    return flat.select("page_id", *flags)


# -- counters: one row per page and key --------------------------------------------


def counter(keyed: DataFrame, key: str) -> DataFrame:
    """Occurrences of `key` per page, with the first position for breaking ties."""
    return keyed.groupBy("page_id", key).agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos")
    )


def tag_tallies(parsed: DataFrame) -> DataFrame:
    """(page_id, tally): (tag, n, first_pos) of each tag of a page, in order of first
    appearance, counted inside the row. Tags are sorted with their places once; a tag's
    run in that order gives its first place and its count."""
    placed = F.transform(tags(), lambda tag, i: F.struct(tag.alias("tag"), i.cast("bigint").alias("first_pos")))
    step = parsed.select("page_id", F.sort_array(placed).alias("sorted"))
    starts = F.filter(
        F.transform(
            "sorted", lambda e, i: F.struct(e["tag"], e["first_pos"], i.cast("bigint").alias("at"))
        ),
        lambda e, i: (i == 0) | (F.get("sorted", i - 1)["tag"] != e["tag"]),
    )
    step = step.select("page_id", F.size("sorted").cast("bigint").alias("size"), starts.alias("starts"))
    counted = F.transform(
        "starts",
        lambda e, i: F.struct(
            e["first_pos"],
            e["tag"],
            (F.coalesce(F.get("starts", i + 1)["at"], F.col("size")) - e["at"]).alias("n"),
        ),
    )
    return step.select("page_id", settled(F.sort_array(counted)).alias("tally"))


def tag_counts(parsed: DataFrame) -> DataFrame:
    each = F.transform("tally", lambda e: F.struct(e["tag"], e["n"], e["first_pos"]))
    return tag_tallies(parsed).select("page_id", F.inline(each))


def top_tags(parsed: DataFrame, k: int = TOP_TAGS) -> DataFrame:
    """The k most frequent tags of each page, ties by first appearance; no shuffle."""
    by_count = F.array_sort(
        F.transform(
            "tally",
            lambda e: F.struct((-e["n"]).alias("less"), e["first_pos"], e["tag"], e["n"]),
        )
    )
    ranked = F.transform(
        F.slice(by_count, 1, k),
        lambda e, i: F.struct(e["tag"], e["n"], (i + 1).cast("bigint").alias("rank")),
    )
    return tag_tallies(parsed).select("page_id", F.inline(ranked))


def class_counts(parsed: DataFrame) -> DataFrame:
    keyed = parsed.select("page_id", F.posexplode(class_tokens()).alias("pos", "class"))
    return counter(keyed, "class")


def id_counts(parsed: DataFrame) -> DataFrame:
    keyed = parsed.select("page_id", F.posexplode(id_values()).alias("pos", "id"))
    return counter(keyed, "id")


def input_types(parsed: DataFrame) -> DataFrame:
    """Type of each input element, `text` where it names none, counted per page."""
    inputs = F.filter("elements", lambda e: e["tag"] == "input")
    types = F.transform(inputs, lambda e: F.coalesce(e["attrs"]["type"], F.lit("text")))
    keyed = parsed.select("page_id", F.posexplode(types).alias("pos", "input_type"))
    return counter(keyed, "input_type")


def meta_info(parsed: DataFrame) -> DataFrame:
    """name (or property) and content of each page's meta elements; the last wins."""
    metas = F.filter("elements", lambda e: e["tag"] == "meta")
    entries = F.transform(
        metas,
        lambda e: F.struct(
            F.coalesce(
                F.nullif(e["attrs"]["name"], F.lit("")), F.nullif(e["attrs"]["property"], F.lit(""))
            ).alias("name"),
            F.nullif(e["attrs"]["content"], F.lit("")).alias("content"),
        ),
    )
    rows = parsed.select("page_id", F.posexplode(entries).alias("pos", "entry"))
    named = rows.where("entry.name is not null and entry.content is not null")
    return named.groupBy("page_id", F.col("entry.name").alias("name")).agg(
        F.max_by("entry.content", "pos").alias("content")
    )


def top_k(counts: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys of each page; ties go to the first seen."""
    order = W.partitionBy("page_id").orderBy(F.desc("n"), "first_pos")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("page_id", key, "n", F.col("rank").cast("bigint").alias("rank"))
