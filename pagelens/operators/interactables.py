"""Interactive elements of each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.markup import EVENT_ATTRIBUTES, INTERACTIVE_ROLES, INTERACTIVE_TAGS


def is_interactive(e: Column) -> Column:
    names = F.map_keys(e["attrs"])
    handlers = F.array(*[F.lit(name) for name in EVENT_ATTRIBUTES])
    return (
        e["tag"].isin(INTERACTIVE_TAGS)
        | F.arrays_overlap(names, handlers)
        | F.array_contains(names, "tabindex")
        | F.coalesce(e["attrs"]["role"].isin(INTERACTIVE_ROLES), F.lit(False))
    )


def kept_attributes(e: Column) -> Column:
    """Handlers, href of links, tabindex, listed roles and id; class stays an array."""
    return F.map_filter(
        e["attrs"],
        lambda name, value: name.isin([*EVENT_ATTRIBUTES, "tabindex", "id"])
        | ((name == "href") & (e["tag"] == "a"))
        | ((name == "role") & value.isin(INTERACTIVE_ROLES)),
    )


def page_interactables(parsed: DataFrame) -> DataFrame:
    """One row per page: the list of its interactive elements, in document order."""
    found = F.transform(
        F.filter("elements", is_interactive),
        lambda e: F.struct(
            e["pos"].alias("pos"),
            e["tag"].alias("tag"),
            kept_attributes(e).alias("attributes"),
            F.when(F.map_contains_key(e["attrs"], "class"), e["classes"]).alias("classes"),
            e["text"].alias("text"),
        ),
    )
    return parsed.select("page_id", found.alias("interactables"))


def interactables(parsed: DataFrame) -> DataFrame:
    """One row per interactive element."""
    return page_interactables(parsed).select("page_id", F.inline("interactables"))


def interactable_counts(parsed: DataFrame) -> DataFrame:
    """Interactive elements per page, pages without any included."""
    found = page_interactables(parsed)
    return found.select("page_id", F.size("interactables").cast("bigint").alias("interactables"))


def site_interactables(parsed: DataFrame) -> DataFrame:
    """Site-wide count of interactive elements by tag."""
    return interactables(parsed).groupBy("tag").agg(
        F.count("*").alias("elements"), F.count_distinct("page_id").alias("pages")
    )
