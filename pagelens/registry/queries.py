"""Every registered query: a function of (spark, table folder) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import labels as labels_fn
from pagelens.functions import text as text_fn
from pagelens.functions import urls as urls_fn
from pagelens.functions import vectors as vectors_fn
from pagelens.operators import (
    blend,
    embed,
    features,
    fusion,
    incremental,
    interactables,
    page_types,
    project,
    scaling,
    structure,
    summary,
    vector_index,
    vector_join,
    weblog,
)
from pagelens.operators.dom import ALL_FIELDS, elements, parse_pages
from pagelens.plans import documents, semantic, site_report
from pagelens.registry import inputs
from pagelens.session import scratch_path, ship_package, written
from pagelens.sources import cache as cache_source
from pagelens.sources import folders, results
from pagelens.sources.tables import read_pages, read_table
from pagelens.streaming import intake
from pagelens.streaming import requests as request_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VISUAL_LIMIT = 0.3
STRUCTURAL_LIMIT = 0.95
TAG_LIMIT = 0.99
WIDE_TAG_LIMIT = 0.9
PATTERN_LIMIT = 0.8
INTAKE_FILES = 4
ROW_GROUP = 4 << 20
PAUSE = 2  # seconds between the batches of the throttled intake
SCORE_LIMIT = 1.2
DRESSED_SCORE_LIMIT = 1.27
SCORE_COLUMNS = [
    "seq_ab", "seq_ba", "score_ab", "score_ba", "score_norm",
    "tag_sim", "css_sim", "form_sim", "pattern_sim",
]


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf)

    QUERIES[function.__name__] = run
    return run


def parsed(
    spark: SparkSession, sf: str, fields: tuple[str, ...] = ALL_FIELDS, texts: bool = False
) -> DataFrame:
    return parse_pages(read_pages(spark, sf), fields=fields, texts=texts)


def joined(array, separator: str = ","):
    return F.array_join(array, separator)


def long_vectors(vectors: DataFrame, digits: int = 6) -> DataFrame:
    each = vectors.select("id", F.posexplode("vector").alias("dim", "x"))
    return each.select("id", F.col("dim").cast("bigint").alias("dim"), F.round("x", digits).alias("value"))


def both_values() -> list:
    """The values of the two-dimensional vectors the document state has."""
    return [F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second")]


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


# -- sources and sinks -------------------------------------------------------------


@query
def lenient_page_texts(spark, sf):
    pages = read_pages(spark, sf).select("page_id", F.encode("html", "UTF-8").alias("content"))
    return folders.page_texts(pages, markup="content")


@query
def crawl_pages(spark, sf):
    pages = folders.discover_pages(inputs.crawl_listing(spark, sf))
    return pages.select(
        "page_id",
        joined("html_files").alias("html_files"),
        joined("screenshots").alias("screenshots"),
    )


@query
def primary_html(spark, sf):
    return folders.primary_html(inputs.crawl_listing(spark, sf))


@query
def primary_html_or_first(spark, sf):
    return folders.primary_html_or_first(inputs.crawl_listing(spark, sf))


@query
def primary_screenshot(spark, sf):
    return folders.primary_screenshot(inputs.crawl_listing(spark, sf))


@query
def embedding_cache(spark, sf):
    """Two saves: the old cache, then the cache with a run's vectors; load the newest."""
    _, old, new = inputs.document_state(spark, sf)
    root = scratch_path(spark, "cache")
    cache_source.save_cache(old, root)
    held = cache_source.load_cache(spark, root)
    cache_source.save_cache(incremental.upsert_cache(held, new), root)
    loaded = cache_source.load_cache(spark, root)
    return loaded.select("page_id", "model", "content_hash", *both_values())


@query
def result_documents(spark, sf):
    """Write page types and their summary, read the parts back, compare the counts."""
    typed = page_types.classify(inputs.dressed(spark, sf, ("tag", "attrs", "classes", "own_string")))
    path = scratch_path(spark, "result")
    document = summary.type_document(page_types.type_distribution(typed))
    results.write_result(path, document, {"page_types": typed})
    schema = "page_id bigint, page_type string"
    types = results.read_result(spark, f"{path}/page_types", schema)
    back = results.read_document(spark, f"{path}/summary", document.schema)
    counts = back.select(
        "total_files", F.explode("page_type_distribution").alias("page_type", "pages")
    )
    absent = results.read_result(spark, f"{path}/visual", schema, required=False)
    again = types.groupBy("page_type").agg(F.count("*").alias("listed"))
    joined_counts = counts.join(again, "page_type")
    return joined_counts.withColumn("has_visual", F.lit(absent is not None))


@query
def visual_document(spark, sf):
    """Write the visual result, read it back: the vectors beside the summary."""
    vectors = inputs.vectors(spark, sf)
    path = documents.save_visual(vectors, scratch_path(spark, "visual"))
    files = results.read_result(spark, f"{path}/files", vectors.schema)
    schema = "total_files bigint, average_similarity double, embedding_dimension bigint"
    line = results.read_document(spark, f"{path}/summary", schema)
    return rounded(long_vectors(files).join(F.broadcast(line)), 6, "average_similarity")


@query
def feature_document(spark, sf):
    """Write the feature maps, read them back: every page's features, with their mean."""
    table = site_report.structural_features(read_pages(spark, sf))
    path = documents.save_features(table, scratch_path(spark, "feature-maps"))
    pages = results.read_result(spark, f"{path}/page_features", "page_id bigint, features map<string,double>")
    schema = "feature_names array<string>, feature_stats map<string,map<string,double>>"
    line = results.read_document(spark, f"{path}/summary", schema)
    each = pages.select("page_id", F.explode("features").alias("feature", "value"))
    stats = line.select(F.explode("feature_stats").alias("feature", "stats"), "feature_names")
    known = stats.select(
        "feature",
        F.round(F.col("stats")["mean"], 6).alias("mean"),
        F.array_position("feature_names", F.col("feature")).cast("bigint").alias("place"),
    )
    return each.join(F.broadcast(known), "feature")  # one row per feature


@query
def interactables_json(spark, sf):
    found = interactables.page_interactables(
        inputs.dressed(spark, sf, ("pos", "tag", "attrs", "classes", "text"))
    )
    path = results.write_interactables(found, scratch_path(spark, "interactables"))
    back = results.read_interactables(spark, path, found.schema)
    return back.select(
        "page_id",
        F.size("interactables").cast("bigint").alias("interactables"),
        joined(F.transform("interactables", lambda e: e["tag"])).alias("tags"),
    )


@query
def request_log(spark, sf):
    """Append the API calls, read the log: the last write of each URL."""
    calls = weblog.api_requests(inputs.requests(spark, sf))
    path = results.write_requests(calls, scratch_path(spark, "requests"))
    log = results.read_requests(spark, path)
    cookies = F.transform(
        F.array_sort(F.map_entries("cookies")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return log.select(
        "url", "method", "path", "query", "request_id", joined(cookies, "&").alias("cookies")
    )


# -- text and scalar projections ---------------------------------------------------


@query
def visible_text(spark, sf):
    pages = parsed(spark, sf, ("pos",), texts=True)
    return pages.select("page_id", text_fn.visible_text(F.col("page_text")).alias("text"))


@query
def content_hashes(spark, sf):
    documents = read_table(spark, sf, "documents")
    return documents.select("doc_id", text_fn.content_hash(F.col("text")).alias("content_hash"))


@query
def short_hash_ids(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", text_fn.short_hash(F.col("url")).alias("url_id"))


@query
def urls_from_page_ids(spark, sf):
    pages = read_table(spark, sf, "pages")
    name = F.replace(F.replace("url", F.lit("://"), F.lit("___")), F.lit("/"), F.lit("__"))
    return pages.select("page_id", urls_fn.url_from_page_id(name).alias("url"))


@query
def url_parts(spark, sf):
    url = F.col("url")
    return read_table(spark, sf, "pages").select(
        "page_id",
        urls_fn.url_host(url).alias("host"),
        urls_fn.url_path(url).alias("path"),
        urls_fn.url_query(url).alias("query"),
    )


@query
def cookie_maps(spark, sf):
    events = read_table(spark, sf, "events")
    made = events.select("event_id", urls_fn.cookie_map(F.expr(inputs.COOKIES)).alias("cookies"))
    return made.select("event_id", F.explode("cookies").alias("name", "value"))


@query
def api_requests(spark, sf):
    calls = weblog.api_requests(inputs.requests(spark, sf))
    return calls.select("url", "method", "path", "query", "request_id", "ts")


@query
def script_assets(spark, sf):
    found = weblog.script_assets(inputs.assets(spark, sf))
    return found.select("asset_id", "url", F.md5("body").alias("body_hash"))


@query
def console_payloads(spark, sf):
    return weblog.console_payloads(inputs.console(spark, sf))


@query
def console_network_calls(spark, sf):
    return weblog.console_network_calls(inputs.console(spark, sf))


@query
def api_scripts(spark, sf):
    scripts = inputs.console(spark, sf).withColumn("script", F.md5("message"))
    return weblog.api_scripts(scripts, "script", "message")


@query
def script_scores(spark, sf):
    """Pattern scores of all console messages, zeros included."""
    message = F.col("message")
    return inputs.console(spark, sf).select(
        F.md5(message).alias("message_hash"), urls_fn.script_score(message).alias("score")
    )


@query
def description_prompts(spark, sf):
    pages = inputs.dressed_pages(spark, sf)
    prompt = text_fn.description_prompt(F.col("html"))
    return pages.select(
        "page_id", F.md5(prompt).alias("prompt_hash"), F.length(prompt).cast("bigint").alias("chars")
    )


@query
def short_labels(spark, sf):
    url = F.col("url")
    return read_table(spark, sf, "pages").select(
        "page_id",
        text_fn.short_label(url, 20).alias("label20"),
        text_fn.short_label(url, 15).alias("label15"),
        text_fn.file_label(url).alias("file_label"),
    )


@query
def name_categories(spark, sf):
    message = F.col("text")
    return read_table(spark, sf, "documents").select(
        "doc_id",
        labels_fn.name_category(message).alias("category"),
        labels_fn.name_colour(message).alias("colour"),
    )


@query
def type_colours(spark, sf):
    typed = page_types.classify(inputs.dressed(spark, sf, ("tag", "attrs", "classes", "own_string")))
    return labels_fn.with_type_colour(typed).select("page_id", "page_type", "colour")


@query
def unit_vectors(spark, sf):
    vectors = inputs.vectors(spark, sf)
    return long_vectors(vectors.select("id", vectors_fn.unit(F.col("vector")).alias("vector")))


@query
def concatenated_vectors(spark, sf):
    vectors = inputs.vectors(spark, sf)
    both = F.concat("vector", F.reverse("vector")).alias("vector")
    return long_vectors(vectors.select("id", both))


@query
def averaged_vectors(spark, sf):
    """Vectors of different lengths: the longer is cut to the length of the shorter."""
    vectors = inputs.vectors(spark, sf)
    longer = F.concat(F.reverse("vector"), F.array(F.lit(1.0), F.lit(2.0)))
    mean = vectors_fn.weighted_average(F.col("vector"), longer, 0.6)
    return long_vectors(vectors.select("id", mean.alias("vector")))


# -- elements and per-page features ------------------------------------------------


@query
def page_elements(spark, sf):
    rows = elements(parsed(spark, sf, ("pos", "tag", "depth", "parent_pos", "attrs", "classes")))
    return rows.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        "tag",
        F.col("depth").cast("bigint").alias("depth"),
        F.col("parent_pos").cast("bigint").alias("parent_pos"),
        F.coalesce(F.col("attrs")["href"], F.lit("")).alias("href"),
        joined("classes", " ").alias("classes"),
    )


@query
def tag_sequences(spark, sf):
    found = features.tag_sequence(inputs.dressed(spark, sf, ("tag",)))
    return found.select("page_id", joined("tags").alias("tags"))


@query
def tag_counts(spark, sf):
    found = features.tag_counts(parsed(spark, sf, ("tag",)))
    return found.select("page_id", "tag", "n", F.col("first_pos").cast("bigint").alias("first_pos"))


@query
def css_fingerprints(spark, sf):
    return features.css_fingerprint(inputs.dressed(spark, sf, ("attrs", "classes")))


@query
def form_structures(spark, sf):
    return features.form_structure(inputs.dressed(spark, sf, ("tag",)))


@query
def link_structures(spark, sf):
    return features.link_structure(inputs.dressed(spark, sf, ("tag", "attrs")))


@query
def link_prefix_counts(spark, sf):
    return features.link_prefix_counts(inputs.dressed(spark, sf, ("tag", "attrs")))


@query
def depth_statistics(spark, sf):
    found = features.depth_statistics(
        parse_pages(
            read_pages(spark, sf),
            fields=("depth",),
            max_elements=features.DEPTH_LIMIT,
            texts=False,
        )
    )
    return rounded(found, 9, "avg_depth", "depth_variance")


@query
def id_class_patterns(spark, sf):
    found = features.pattern_list(
        parse_pages(
            inputs.dressed_pages(spark, sf),
            fields=("attrs", "classes"),
            max_elements=features.PATTERN_ELEMENTS,
            texts=False,
        )
    )
    return found.select("page_id", joined("patterns", "|").alias("patterns"))


@query
def page_type_labels(spark, sf):
    fields = ("tag", "attrs", "classes", "own_string")
    return page_types.classify(inputs.dressed(spark, sf, fields))


@query
def page_types_by_own_rules(spark, sf):
    """Other rules in place of the standard ones."""
    tags = features.tags()
    rules = [
        ("long", features.count_of(tags, "p") > 10),
        ("broken", features.count_of(tags, "b") > 1),
    ]
    return page_types.classify(parsed(spark, sf, ("tag",)), rules)


@query
def page_feature_vectors(spark, sf):
    found = features.feature_vector(parsed(spark, sf, site_report.FIELDS, texts=True))
    return rounded(found, 9, "tag_diversity", "div_ratio", "span_ratio", "p_ratio", "img_ratio")


@query
def dressed_feature_vectors(spark, sf):
    found = features.feature_vector(inputs.dressed(spark, sf, site_report.FIELDS, texts=True))
    names = ["tag_diversity", "div_ratio", "span_ratio", "p_ratio", "img_ratio"]
    return rounded(found.drop(*[f"has_{t}" for t in features.INDICATOR_TAGS]), 9, *names)


@query
def boolean_indicators(spark, sf):
    return features.boolean_indicators(inputs.dressed(spark, sf, ("tag",)))


@query
def meta_info(spark, sf):
    return features.meta_info(inputs.dressed(spark, sf, ("tag", "attrs")))


@query
def input_types(spark, sf):
    found = features.input_types(inputs.dressed(spark, sf, ("tag", "attrs")))
    return found.select("page_id", "input_type", "n")


@query
def id_counts(spark, sf):
    return features.id_counts(inputs.dressed(spark, sf, ("attrs",))).select("page_id", "id", "n")


@query
def top_tags(spark, sf):
    return features.top_tags(parsed(spark, sf, ("tag",)))


@query
def top_classes(spark, sf):
    counts = features.class_counts(inputs.dressed(spark, sf, ("classes",)))
    return features.top_k(counts, "class", features.TOP_CLASSES)


@query
def interactive_elements(spark, sf):
    found = interactables.interactables(
        inputs.dressed(spark, sf, ("pos", "tag", "attrs", "classes", "text"))
    )
    pairs = F.transform(
        F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return found.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        "tag",
        joined(pairs, "|").alias("attributes"),
        F.coalesce(joined("classes", " "), F.lit("")).alias("classes"),
        "text",
    )


@query
def page_link_texts(spark, sf):
    """Interactive elements of the given pages: links with their texts."""
    found = interactables.interactables(parsed(spark, sf, ("pos", "tag", "attrs", "classes", "text")))
    return found.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        "tag",
        F.col("attributes")["href"].alias("href"),
        "text",
    )


@query
def interactable_counts(spark, sf):
    fields = ("pos", "tag", "attrs", "classes", "text")
    return interactables.interactable_counts(inputs.dressed(spark, sf, fields))


@query
def site_interactables(spark, sf):
    fields = ("pos", "tag", "attrs", "classes", "text")
    return interactables.site_interactables(inputs.dressed(spark, sf, fields))


# -- scaling and embedding ---------------------------------------------------------


def structural_vectors(spark, sf) -> DataFrame:
    table = site_report.structural_features(read_pages(spark, sf))
    return site_report.lens_vectors(table)["structural"]


@query
def standard_vectors(spark, sf):
    return long_vectors(structural_vectors(spark, sf))


@query
def feature_profile(spark, sf):
    table = site_report.structural_features(read_pages(spark, sf))
    return rounded(scaling.profile(table), 6, "mean", "std", "min", "q25", "q50", "q75", "max")


@query
def combined_vectors(spark, sf):
    table = site_report.structural_features(read_pages(spark, sf))
    lenses = site_report.lens_vectors(table, inputs.vectors(spark, sf))
    return long_vectors(lenses["combined"])


@query
def vectors_with_signals(spark, sf):
    """An extra signal joined to the features before scaling: events per page."""
    table = site_report.structural_features(read_pages(spark, sf))
    events = read_table(spark, sf, "events")
    signals = events.groupBy(F.col("user_id").alias("page_id")).agg(F.count("*").alias("visits"))
    return long_vectors(site_report.lens_vectors(table, signals=signals)["structural"])


@query
def text_embeddings(spark, sf):
    documents = read_table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return long_vectors(
        embed.embed_texts(documents, embed.hashed_words(32)).select(
            F.col("page_id").alias("id"), F.col("embedding").alias("vector")
        )
    )


@query
def tfidf_embeddings(spark, sf):
    documents = read_table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return long_vectors(embed.tfidf_vectors(documents, 32))


@query
def described_embeddings(spark, sf):
    def describe(prompts: list[str]) -> list[str]:
        return [f"{len(p)} characters, {p.count('<p')} paragraphs" for p in prompts]

    pages = read_pages(spark, sf).select("page_id", "html")
    found = semantic.describe_then_embed(pages, describe, embed.hashed_words(16))
    return long_vectors(
        found.select(F.col("page_id").alias("id"), F.col("embedding").alias("vector"))
    )


@query
def changed_pages(spark, sf):
    current, cache, _ = inputs.document_state(spark, sf)
    return incremental.changed_pages(current, cache)


@query
def cache_upsert(spark, sf):
    _, cache, new = inputs.document_state(spark, sf)
    merged = incremental.upsert_cache(cache, new)
    return merged.select(
        "page_id", "model", "content_hash", F.col("embedding")[0].alias("first"),
        F.col("embedding")[1].alias("second"),
    )


@query
def resolved_vectors(spark, sf):
    current, cache, new = inputs.document_state(spark, sf)
    found = incremental.resolve_vectors(current, cache, new)
    return found.select("page_id", "origin", *both_values())


@query
def embedding_cost(spark, sf):
    current, cache, _ = inputs.document_state(spark, sf)
    cost = embed.batch_cost(incremental.changed_pages(current, cache))
    return rounded(cost, 6, "minutes")


# -- pairs -------------------------------------------------------------------------


@query
def structure_signatures(spark, sf):
    """Distinct structures of the given pages, with how many pages each has."""
    found = structure.signatures(
        structure.page_structures(parsed(spark, sf, structure.SIGNATURE_FIELDS))
    )
    return found.select(
        "sig", "pages", joined("seq").alias("seq"), "unique_classes", "unique_ids"
    )


@query
def similar_structures(spark, sf):
    """Every pair of page structures with a composite score of at least 1.2."""
    sigs = structure.signatures(
        structure.page_structures(parsed(spark, sf, structure.SIGNATURE_FIELDS))
    )
    return rounded(structure.similar_structures(sigs, SCORE_LIMIT), 9, *SCORE_COLUMNS)


@query
def similar_dressed_structures(spark, sf):
    """The same of the dressed pages, which have classes, ids, forms and patterns."""
    sigs = structure.signatures(
        structure.page_structures(inputs.dressed(spark, sf, structure.SIGNATURE_FIELDS))
    )
    return rounded(structure.similar_structures(sigs, DRESSED_SCORE_LIMIT), 9, *SCORE_COLUMNS)


@query
def similar_tag_counts(spark, sf):
    """Every pair of distinct tag counts with a cosine of at least 0.99."""
    groups = structure.tag_groups(structure.page_tag_counts(inputs.dressed(spark, sf, ("tag",))))
    return rounded(structure.similar_tag_counts(groups, TAG_LIMIT), 9, "tag_sim")


@query
def fairly_similar_tag_counts(spark, sf):
    """Every pair of distinct tag counts with a cosine of at least 0.9."""
    groups = structure.tag_groups(structure.page_tag_counts(inputs.dressed(spark, sf, ("tag",))))
    return rounded(structure.similar_tag_counts(groups, WIDE_TAG_LIMIT), 9, "tag_sim")


@query
def similar_patterns(spark, sf):
    """Every pair of distinct id and class pattern sets with a Jaccard similarity of 0.8."""
    structures = structure.page_structures(inputs.dressed(spark, sf, structure.SIGNATURE_FIELDS))
    return rounded(structure.similar_patterns(structures, PATTERN_LIMIT), 9, "jaccard")


@query
def listed_pair_terms(spark, sf):
    """Terms of each page paired with the page after it, and which of them are present."""
    structures = structure.page_structures(inputs.dressed(spark, sf, structure.SIGNATURE_FIELDS))
    pairs = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")
    )
    found = structure.score_listed(pairs, written(structures, "structures"))
    terms = ["tag_sim", "css_sim", "form_sim", "pattern_sim"]
    return rounded(found.select("a", "b", *terms), 9, *terms)


@query
def listed_pair_scores(spark, sf):
    """Composite scores, both orders and normalised, of the same pairs."""
    structures = structure.page_structures(inputs.dressed(spark, sf, structure.SIGNATURE_FIELDS))
    pairs = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")
    )
    found = structure.score_listed(pairs, written(structures, "structures"))
    scores = ["seq_ab", "seq_ba", "score_ab", "score_ba", "score_norm"]
    return rounded(found.select("a", "b", *scores), 9, *scores)


@query
def similar_vectors(spark, sf):
    """Visual lens: every pair with cosine of at least 0.3, its distance and band."""
    found = vector_join.similar_pairs(inputs.vectors(spark, sf), VISUAL_LIMIT)
    out = blend.with_band(found).withColumn("distance", vectors_fn.distance(F.col("similarity")))
    return rounded(out, 9, "similarity", "distance")


@query
def very_similar_vectors(spark, sf):
    """Visual lens: every pair of the band of very similar pages, cosine of at least 0.8."""
    return rounded(vector_join.similar_pairs(inputs.vectors(spark, sf), 0.8), 9, "similarity")


@query
def similar_structural_vectors(spark, sf):
    """Structural lens: every pair of scaled feature vectors with cosine of at least 0.95."""
    found = vector_join.similar_pairs(structural_vectors(spark, sf), STRUCTURAL_LIMIT)
    return rounded(found, 6, "similarity")


@query
def named_pairs(spark, sf):
    """Similarity and band of listed pairs: each vector and the next."""
    vectors = inputs.vectors(spark, sf)
    pairs = vectors.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = blend.with_band(vector_join.score_pairs(pairs, vectors))
    return rounded(found, 9, "similarity")


def blended_lenses(spark, sf) -> DataFrame:
    """(a, b, scaled, other): the pairs of ids the visual lens finds and the diagonal, under the structural
    lens, scaled by the ranges of its whole columns, and under the visual one."""
    vectors, structural = inputs.vectors(spark, sf), written(structural_vectors(spark, sf), "structural")
    ranges = written(vector_join.column_ranges(structural).withColumnRenamed("b", "id"), "ranges")
    found = vector_join.scored_pairs(vectors, VISUAL_LIMIT, ranges, structural, every=True)
    own = vectors.select("id").join(ranges, "id")
    return (
        blend.both_ends(found, "lo", "hi")
        .select("a", "b", blend.scaled("second").alias("scaled"), F.col("similarity").alias("other"))
        .unionByName(diagonal(own).select("a", "b", blend.scaled().alias("scaled"), F.lit(1.0).alias("other")))
    )


def diagonal(rows: DataFrame) -> DataFrame:
    """Every id with itself, at similarity 1, and its other columns."""
    own = F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")
    return rows.select(*own, *[c for c in rows.columns if c != "id"])


@query
def column_min_max(spark, sf):
    """Visual pairs of all ids and the diagonal, scaled by the range of the whole column."""
    vectors = inputs.vectors(spark, sf)
    ranges = written(vector_join.column_ranges(vectors).withColumnRenamed("b", "id"), "ranges")
    pairs = blend.both_ends(vector_join.scored_pairs(vectors, VISUAL_LIMIT, ranges, every=True), "lo", "hi")
    every = pairs.unionByName(diagonal(vectors.select("id").join(ranges, "id")))
    return rounded(every.select("a", "b", blend.scaled().alias("similarity")), 6, "similarity")


@query
def column_ranges(spark, sf):
    """Least and greatest similarity of each column of the structural lens."""
    return rounded(vector_join.column_ranges(structural_vectors(spark, sf)), 6, "lo", "hi")


@query
def weighted_blend(spark, sf):
    return rounded(blend.blended(blended_lenses(spark, sf), (0.7, 0.3)), 6, "similarity")


@query
def weight_sweep(spark, sf):
    return rounded(blend.swept(blended_lenses(spark, sf)), 6, "similarity")


@query
def lens_comparison(spark, sf):
    """Pairs of ids under the structural and the visual lens; a lens may not hold a pair."""
    structural = written(structural_vectors(spark, sf), "structural")
    found = vector_join.compared_pairs(
        {"structural": (structural, STRUCTURAL_LIMIT), "visual": (inputs.vectors(spark, sf), VISUAL_LIMIT)},
        every=True,
    )
    return rounded(found, 6, "structural", "visual")


@query
def lens_correlation(spark, sf):
    """Correlation of the two lenses over the pairs of ids the visual lens finds, in both orders."""
    structural = written(structural_vectors(spark, sf), "structural")
    moments = vector_join.pair_moments(inputs.vectors(spark, sf), VISUAL_LIMIT, structural, every=True)
    row = [(moments.correlation(0, 1), 2 * moments.count)]
    return rounded(spark.createDataFrame(row, "correlation double, pairs bigint"), 6, "correlation")


def fitted_lenses(spark, sf) -> tuple[dict[str, float], DataFrame, DataFrame]:
    """Weights that tell best, of the pairs of ids the visual lens finds, whether two pages bear the
    same label; the structural vectors, and the labels."""
    structural = written(structural_vectors(spark, sf), "structural")
    labels = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    moments = vector_join.pair_moments(inputs.vectors(spark, sf), VISUAL_LIMIT, structural, labels, every=True)
    weights = fusion.weights_of(moments.means, moments.products, ["structural", "visual"])
    return weights, structural, labels


@query
def fitted_lens_weights(spark, sf):
    """Weights of the lenses that tell best whether two pages bear the same label."""
    weights, _, _ = fitted_lenses(spark, sf)
    rows = [(name, round(weight, 6)) for name, weight in weights.items()]
    return spark.createDataFrame(rows, "lens string, weight double")


@query
def fused_lenses(spark, sf):
    weights, structural, labels = fitted_lenses(spark, sf)
    found = vector_join.scored_pairs(inputs.vectors(spark, sf), VISUAL_LIMIT, labels, structural, every=True)
    named = found.withColumnsRenamed({"second": "structural", "similarity": "visual"})
    return rounded(fusion.fused(blend.both_ends(named, "label"), weights), 6, "similarity")


@query
def shared_directions(spark, sf):
    """Places of the pages along two directions that the structural and the visual lens share."""
    correlations, places = fusion.canonical(structural_vectors(spark, sf), inputs.vectors(spark, sf))
    each = places.select("id", F.posexplode(F.arrays_zip("first", "second")).alias("component", "at"))
    found = F.element_at(F.lit(correlations).cast("array<double>"), F.col("component") + 1)
    flat = each.select("id", "component", "at.first", "at.second", found.alias("correlation"))
    return rounded(flat, 6, "first", "second", "correlation")


@query
def matrix_blocks(spark, sf):
    block = F.floor(F.col("id") / blend.MATRIX_BLOCK)
    view = vector_join.matrix_rows(inputs.vectors(spark, sf), VISUAL_LIMIT, block)
    scores = F.transform("similarities", lambda s: F.format_number(s, 6))
    return view.select(
        "a", "block", joined("columns").alias("columns"), joined(scores, ";").alias("similarities")
    )


@query
def mean_similarity(spark, sf):
    found = vector_join.mean_similarity(inputs.vectors(spark, sf))
    return rounded(found, 9, "mean_full", "mean_upper")


# -- summaries ---------------------------------------------------------------------


@query
def type_distribution(spark, sf):
    fields = ("tag", "attrs", "classes", "own_string")
    return page_types.type_distribution(page_types.classify(inputs.dressed(spark, sf, fields)))


def scores_by_type(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Structures with a composite score above the limit, and page types per structure."""
    fields = ("tag", "attrs", "classes", "own_string")
    pages = written(inputs.dressed(spark, sf, fields), "parsed")
    structures = written(structure.page_structures(pages), "structures")
    sigs = written(structure.signatures(structures), "sigs")
    similar = written(structure.similar_structures(sigs, DRESSED_SCORE_LIMIT), "similar")
    by_type = summary.type_members(structure.membership(structures, sigs), page_types.classify(pages))
    return similar, written(by_type, "by-type")


@query
def within_type_pairs(spark, sf):
    found = summary.within_type_pairs(*scores_by_type(spark, sf))
    return rounded(found, 9, "score_ab", "score_ba")


@query
def within_type_spread(spark, sf):
    similar, by_type = scores_by_type(spark, sf)
    found = summary.within_type_spread(summary.within_type_pairs(similar, by_type), by_type)
    return rounded(found, 6, "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def product_pairs(spark, sf):
    found = summary.typed_pair_analysis(*scores_by_type(spark, sf), "product").drop("page_type")
    return rounded(found, 9, "score_ab", "score_ba")


@query
def product_against_cart(spark, sf):
    """The first product page against the first cart page."""
    fields = ("tag", "attrs", "classes", "own_string")
    pages = written(inputs.dressed(spark, sf, fields), "parsed")
    pair = summary.first_of_types(page_types.classify(pages))
    found = structure.score_listed(pair, structure.page_structures(pages))
    return rounded(found.select("a", "b", *SCORE_COLUMNS), 9, *SCORE_COLUMNS)


@query
def site_coverage(spark, sf):
    """Per lens: pages in all, pages covered, dimension and mean similarities."""
    pages = read_pages(spark, sf)
    table = site_report.structural_features(pages)
    lenses = site_report.lens_vectors(table, inputs.vectors(spark, sf))
    return rounded(site_report.lens_coverage(pages, lenses), 6, "mean_full", "mean_upper")


@query
def feature_sample(spark, sf):
    """The first three pages with a few of their features: a report line."""
    return summary.feature_sample(read_table(spark, sf, "pages"))


@query
def similar_pair_summary(spark, sf):
    """Page pairs above the limit, their mean similarity, and all pairs there are."""
    vectors = structural_vectors(spark, sf)
    found = vector_join.similar_pairs(vectors, STRUCTURAL_LIMIT)
    return rounded(summary.mean_of_pairs(found, vectors), 6, "mean_above_limit")


# -- top pairs, neighbours, layouts ------------------------------------------------


@query
def top_similar_pairs(spark, sf):
    """The ten most similar pairs of the structural, visual and combined lens, with URLs."""
    pages = read_pages(spark, sf)
    table = site_report.structural_features(pages)
    visual = inputs.vectors(spark, sf).join(pages.select(F.col("page_id").alias("id")), "id")
    lenses = site_report.lens_vectors(table, visual)
    found = site_report.top_similar(lenses, pages.select("page_id", "url"))
    return rounded(found, 6, "similarity")


@query
def nearest_neighbours(spark, sf):
    found = vector_join.nearest(inputs.vectors(spark, sf), 15)
    return rounded(found, 6, "similarity")


def searched(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Neighbours of every hundredth vector: by the index, and exact."""
    vectors = inputs.vectors(spark, sf)
    asked = vectors.where("id % 100 = 0")
    found = vector_index.search(vector_index.fit(vectors, 15), asked, 15)
    return found, vector_index.exact(vectors, asked, 15)


@query
def approximate_neighbours(spark, sf):
    """What the index finds for every hundredth vector: exact scores of approximate neighbours."""
    return rounded(searched(spark, sf)[0], 6, "similarity")


@query
def neighbour_index_recall(spark, sf):
    """Share of the exact neighbours of every hundredth vector that the index finds."""
    measured = vector_index.recall(*searched(spark, sf))
    return measured.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("recall_reached"))


@query
def principal_components(spark, sf):
    return rounded(project.pca_2d(structural_vectors(spark, sf)), 6, "x", "y")


@query
def metric_layout(spark, sf):
    """Layout of the neighbour graph of the visual lens."""
    near = vector_join.nearest(inputs.vectors(spark, sf), 5)
    edges = near.select(F.col("id").alias("a"), F.col("neighbour").alias("b"), "similarity")
    layout, _ = project.metric_layout(edges, iterations=10)
    return rounded(layout, 6, "x", "y")


# -- request logs and streams ------------------------------------------------------


@query
def seen_urls(spark, sf):
    return weblog.seen_urls(inputs.requests(spark, sf))


@query
def last_request_per_url(spark, sf):
    calls = inputs.requests(spark, sf).withColumn("cookies", F.lit(None))
    found = weblog.last_request_per_url(calls)
    return found.select("url", "method", F.col("headers")["cookie"].alias("cookie"), "ts")


@query
def last_cookies(spark, sf):
    """Last value of each cookie on one domain's successful responses."""
    rows = inputs.requests(spark, sf)
    set_cookies = rows.select(
        "url", "status", "ts", F.explode(urls_fn.cookie_map(F.col("cookie"))).alias("name", "value")
    )
    return weblog.last_cookies(set_cookies, "example.net")


def table_stream(spark, sf, name: str) -> DataFrame:
    """Files of a table, which may be one file or a folder of them: a stream takes
    a single file only as what a glob finds."""
    schema = read_table(spark, sf, name).schema
    return intake.page_stream(spark, f"{sf}/{{{name}.parquet}}", schema, "*", files_per_trigger=1)


@query
def streamed_last_values(spark, sf):
    """Last value per user of successful events, kept by a stream in update mode."""
    events = table_stream(spark, sf, "events").where("event_type <> 'error'")
    latest = request_streams.last_values(events, "user_id", "ts", "event_type", "value")
    path = scratch_path(spark, "last-values")
    request_streams.run_to_table(latest, path, "update").awaitTermination()
    states = spark.read.parquet(f"{path}/data")
    return weblog.last_per_key(states, "user_id", F.col("batch"), "ts", "event_type", "value")


@query
def streamed_seen_urls(spark, sf):
    pages = table_stream(spark, sf, "pages").select(urls_fn.url_host(F.col("url")).alias("host"))
    path = scratch_path(spark, "seen")
    seen = request_streams.seen_keys(pages, "host")
    request_streams.run_to_table(seen, path, "append").awaitTermination()
    return spark.read.parquet(f"{path}/data").select("host")


def write_batch_files(pages: DataFrame, folder: str, files: int) -> None:
    """Pages in a few files, in row groups of ROW_GROUP bytes: a batch is one or a few files, and
    a file is parsed by as many tasks as it has row groups."""
    dealt = pages.repartition(files, "page_id").write.mode("append")
    dealt.option("parquet.block.size", ROW_GROUP).parquet(folder)


@query
def streamed_page_intake(spark, sf):
    """Pages taken in as a stream of files, several a batch: texts embedded and cached under
    page, model and hash. Files of outdated versions of some pages come first."""
    pages = read_table(spark, sf, "pages").select("page_id", "html")
    folder, root = scratch_path(spark, "intake-pages"), scratch_path(spark, "intake")
    outdated = pages.where("page_id % 3 = 0").withColumn("html", F.concat(F.lit("old "), "html"))
    for part in (outdated, *[pages.where(F.pmod("page_id", F.lit(2)) == n) for n in range(2)]):
        write_batch_files(part, folder, INTAKE_FILES)
    stream = intake.page_stream(spark, folder, pages.schema, files_per_trigger=INTAKE_FILES)
    intake.start_intake(stream, root, embed.hashed_words(16)).awaitTermination()
    return cached_values(spark, root)


def cached_values(spark, root: str) -> DataFrame:
    cached = cache_source.load_cache(spark, root)
    return cached.select(
        "page_id", "model", "content_hash", F.posexplode("embedding").alias("dim", "value")
    ).select(
        "page_id", "model", "content_hash",
        F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"),
    )


def page_of_path() -> Column:
    return F.regexp_extract("path", r"page_id=([^/]*)\.txt$", 1).cast("bigint")


def markup_folder(spark, sf) -> str:
    """The given pages as a crawl leaves them: a file of markup for each."""
    folder = scratch_path(spark, "markup")
    folders.write_html_files(read_table(spark, sf, "pages"), folder)
    return folder


@query
def html_folder_pages(spark, sf):
    """Markup files read strictly: the page of each, its size and digest. The line end that the
    file ends with is left out."""
    found = folders.html_folder(spark, markup_folder(spark, sf), "*.txt", page_of_path())
    html = F.substring("html", F.lit(1), F.length("html") - 1)
    return found.select(
        "page_id",
        F.length(html).cast("bigint").alias("chars"),
        F.md5(html).alias("digest"),
    )


@query
def streamed_html_folder(spark, sf):
    """A folder of markup files as a stream of three batches, embedded and cached."""
    folder, root = markup_folder(spark, sf), scratch_path(spark, "html-intake")
    count = read_table(spark, sf, "pages").count()
    stream = intake.html_stream(spark, folder, "*.txt", -(-count // 3) or 1, page_of_path())
    intake.start_intake(stream, root, embed.hashed_words(16)).awaitTermination()
    return cached_values(spark, root)


@query
def throttled_page_intake(spark, sf):
    """The intake with a pause between batches of one file each: pages cached, and whether
    no batch began before its pause was over."""
    folder, root = scratch_path(spark, "paced-pages"), scratch_path(spark, "paced")
    pages = read_table(spark, sf, "pages").select("page_id", "html")
    write_batch_files(pages, folder, 3)
    stream = intake.page_stream(spark, folder, pages.schema, files_per_trigger=1)
    running = intake.start_intake(stream, root, embed.hashed_words(4), throttled=True, pause=PAUSE)
    try:
        running.processAllAvailable()
        starts = [p["timestamp"] for p in running.recentProgress if p["numInputRows"]]
    finally:
        running.stop()
    times = [datetime.fromisoformat(t) for t in starts]
    gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:], strict=False)]
    cached = cache_source.load_cache(spark, root)
    return cached.agg(
        F.count_distinct("page_id").alias("pages"),
        F.lit(all(gap > PAUSE - 0.5 for gap in gaps)).alias("pauses_kept"),
    )
