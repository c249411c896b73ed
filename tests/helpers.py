"""Small builders used by several tests."""

from pagelens.operators.dom import parse_pages


def pages(spark, *markup, start=1):
    rows = list(enumerate(markup, start=start))
    return spark.createDataFrame(rows, "page_id bigint, html string")


def parsed(spark, *markup):
    return parse_pages(pages(spark, *markup))


def by_page(df):
    return {row.page_id: row for row in df.collect()}
