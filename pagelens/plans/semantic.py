"""The semantic job: texts, incremental embedding, neighbour graph, 2-D view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import description_prompt
from pagelens.operators import vector_join
from pagelens.operators.embed import Provider, embed_texts
from pagelens.operators.incremental import changed_pages, resolve_vectors
from pagelens.operators.project import pca_2d
from pagelens.session import written
from pagelens.sources.cache import append_cache, load_cache
from pagelens.sources.folders import page_texts


@dataclass
class SemanticReport:
    vectors: DataFrame
    missing: DataFrame  # page_id, model, error
    neighbours: DataFrame
    layout: DataFrame


def analyse(
    pages: DataFrame, root: str, provider: Provider, model: str = "offline", k: int = 15
) -> SemanticReport:
    """Embed what is new or changed in `pages(page_id, html)`, keep the cache under
    `root`, and lay the current pages out."""
    texts = written(page_texts(pages).withColumn("model", F.lit(model)), "texts")
    key_type = pages.schema["page_id"].dataType.simpleString()
    cache = load_cache(pages.sparkSession, root, key_type)
    todo = changed_pages(texts, cache)
    made = written(embed_texts(todo, provider, keep=("model", "content_hash")), "embedded")
    append_cache(made, root)
    resolved = written(resolve_vectors(texts, cache, made), "resolved")
    found = resolved.where("embedding is not null")
    vectors = found.select(F.col("page_id").alias("id"), F.col("embedding").alias("vector"))
    absent = resolved.where("origin = 'missing'").select("page_id", "model")
    errors = made.where("error is not null").select("page_id", "model", "error")
    missing = absent.join(errors, ["page_id", "model"], "left")
    return SemanticReport(vectors, missing, vector_join.nearest(vectors, k), pca_2d(vectors))


def describe_then_embed(pages: DataFrame, describer, provider: Provider) -> DataFrame:
    """Prompt, describe, embed: (page_id, embedding, error).

    `describer` is a function from a list of prompts to a list of descriptions; both steps
    run as one provider, so a page that fails in either has its error in its row.
    """
    prompts = pages.select("page_id", description_prompt(F.col("html")).alias("text"))

    def run(batch: list[str]) -> list[list[float]]:
        return provider(describer(batch))

    return embed_texts(prompts, run)
