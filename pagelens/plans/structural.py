"""The structural job: parse once, type the pages, find similar structures, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators import structure, summary
from pagelens.operators.dom import parse_pages
from pagelens.operators.page_types import Rules, page_type, type_distribution
from pagelens.session import written
from pagelens.sources.results import write_result

FIELDS = ("tag", "attrs", "classes", "own_string")


@dataclass
class StructuralReport:
    page_types: DataFrame
    distribution: DataFrame
    similar: DataFrame
    within_types: DataFrame
    sample: DataFrame
    summary: DataFrame


def analyse(
    pages: DataFrame, min_score: float = 1.2, rules: Rules | None = None
) -> StructuralReport:
    """Run the whole structural analysis of `pages(page_id, html)`."""
    parsed = written(parse_pages(pages, fields=FIELDS, texts=False), "parsed")
    typed = parsed.select("page_id", page_type(rules).alias("page_type"))
    structures = written(structure.page_structures(parsed), "structures")
    sigs = written(structure.signatures(structures), "sigs")
    similar = written(structure.similar_structures(sigs, min_score), "similar")
    by_type = summary.type_members(structure.membership(structures, sigs), typed)
    within = summary.within_type_pairs(similar, by_type)
    distribution = type_distribution(typed)
    sample = summary.feature_sample(pages)
    counts = summary.type_document(distribution)
    means = summary.mean_of_pairs(similar, typed, "score_ab")
    line = F.struct(*sample.columns)
    lines = sample.agg(F.array_sort(F.collect_list(line)).alias("structural_features_sample"))
    # One-row tables side by side.
    document = counts.join(F.broadcast(means)).join(F.broadcast(lines))
    return StructuralReport(typed, distribution, similar, within, sample, document)


def save(report: StructuralReport, path: str) -> str:
    parts = {"page_types": report.page_types, "similar": report.similar}
    return write_result(path, report.summary, parts)
