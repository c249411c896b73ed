"""The interactables job: crawl tree to lists of interactive elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelens.operators.dom import parse_pages
from pagelens.operators.interactables import page_interactables
from pagelens.sources.folders import crawl_files, primary_html, read_picked
from pagelens.sources.results import write_interactables

FIELDS = ("pos", "tag", "attrs", "classes", "text")


def extract(pages: DataFrame) -> DataFrame:
    return page_interactables(parse_pages(pages, fields=FIELDS, texts=False))


def extract_crawl(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Interactive elements of every page of a crawl tree, written to `out`."""
    picked = primary_html(crawl_files(spark, root))
    found = extract(read_picked(spark, root, picked))
    write_interactables(found, out)
    return spark.read.schema(found.schema).json(out)
