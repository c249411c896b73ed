"""Category, colour and similarity-band expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Colour of each page type, and of every other type.
PAGE_TYPE_COLOURS = {
    "product": "#FF6B6B",
    "cart": "#4ECDC4",
    "checkout": "#45B7D1",
    "homepage": "#96CEB4",
    "contact": "#DDA0DD",
    "form-page": "#FFD93D",
    "other": "#95A5A6",
}
DEFAULT_COLOUR = "#95A5A6"

# Colour by file-name category, in the order the rules apply.
NAME_COLOURS = {
    "stan": "#FF6B6B",
    "pdp": "#4ECDC4",
    "cart": "#45B7D1",
    "checkout": "#96CEB4",
    "other": "#FFD93D",
}

# Lower ends of the similarity bands.
VERY_SIMILAR = 0.8
MODERATELY_SIMILAR = 0.6


def name_category(name: Column) -> Column:
    low = F.lower(name)

    def has(word: str) -> Column:
        return F.contains(low, F.lit(word))

    return (
        F.when(has("stan") & ~has("pdp"), "stan")
        .when(has("pdp"), "pdp")
        .when(has("cart"), "cart")
        .when(has("checkout"), "checkout")
        .otherwise("other")
    )


def name_colour(name: Column) -> Column:
    category = name_category(name)
    colour = F.lit(NAME_COLOURS["other"])
    for label, value in NAME_COLOURS.items():
        colour = F.when(category == label, value).otherwise(colour)
    return colour


def colour_table(spark: SparkSession) -> DataFrame:
    rows = list(PAGE_TYPE_COLOURS.items())
    return spark.createDataFrame(rows, "page_type string, colour string")


def with_type_colour(typed: DataFrame) -> DataFrame:
    """Add the colour of `page_type`; the lookup has seven fixed rows, so it is broadcast."""
    lookup = F.broadcast(colour_table(typed.sparkSession))
    joined = typed.join(lookup, "page_type", "left")
    return joined.withColumn("colour", F.coalesce("colour", F.lit(DEFAULT_COLOUR)))


def similarity_band(similarity: Column) -> Column:
    return (
        F.when(similarity > VERY_SIMILAR, "Very similar")
        .when(similarity > MODERATELY_SIMILAR, "Moderately similar")
        .otherwise("Different")
    )
