"""Rule-based page types: an ordered list of (label, condition), first hit wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.features import count_of, tags

# The text and class patterns of the rules, matched anywhere, in any case.
ADD_TO_BAG = "add to bag"
CART_HEADINGS = "your bag|shopping bag|cart summary|bag summary"
CART_CLASSES = "cart-content|bag-item|cart-item"
CHECKOUT_CLASSES = "checkout|payment|billing|shipping|delivery-address"
CHECKOUT_HEADINGS = "checkout|payment|shipping"
GRID_CLASSES = "product-grid|product-list|plp-grid"
CARD_CLASSES = "product-card|product-tile"
CONTACT_CLASSES = "contact|get-in-touch|customer-service"
CONTACT_HEADINGS = "contact|help|customer service"
ACCOUNT_CLASSES = "account|profile|my-account"
ACCOUNT_HEADINGS = "my account|profile|account"

Rules = list[tuple[str, Column]]


def _matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))


def any_class(pattern: str) -> Column:
    return F.exists("elements", lambda e: F.exists(e["classes"], lambda c: _matches(c, pattern)))


def any_heading(pattern: str) -> Column:
    """Only h1 and h2 elements carry `own_string`."""
    return F.exists("elements", lambda e: _matches(e["own_string"], pattern))


def standard_rules() -> Rules:
    tag_array = tags()
    adds_to_bag = F.exists(
        "elements",
        lambda e: (F.coalesce(e["attrs"]["data-auto-id"], F.lit("")) == "add-to-bag")
        | ((e["tag"] == "button") & _matches(e["attrs"]["title"], ADD_TO_BAG)),
    )
    cards = F.filter(
        "elements", lambda e: F.exists(e["classes"], lambda c: _matches(c, CARD_CLASSES))
    )
    return [
        ("product", adds_to_bag),
        ("cart", any_heading(CART_HEADINGS) | any_class(CART_CLASSES)),
        ("checkout", any_class(CHECKOUT_CLASSES) | any_heading(CHECKOUT_HEADINGS)),
        (
            "homepage",
            (count_of(tag_array, "nav") >= 1)
            & (count_of(tag_array, "a") > 50)
            & (count_of(tag_array, "section", "article") > 3),
        ),
        ("category", any_class(GRID_CLASSES) | (F.size(cards) > 3)),
        ("contact", any_class(CONTACT_CLASSES) | any_heading(CONTACT_HEADINGS)),
        ("account", any_class(ACCOUNT_CLASSES) | any_heading(ACCOUNT_HEADINGS)),
    ]


def page_type(rules: Rules | None = None, default: str = "other") -> Column:
    """Label of the first rule that holds. Pass other rules to change the typing."""
    label = F.lit(default)
    for name, condition in reversed(rules or standard_rules()):
        label = F.when(condition, name).otherwise(label)
    return label


def classify(parsed: DataFrame, rules: Rules | None = None) -> DataFrame:
    return parsed.select("page_id", page_type(rules).alias("page_type"))


def type_distribution(typed: DataFrame) -> DataFrame:
    return typed.groupBy("page_type").agg(F.count("*").alias("pages"))
