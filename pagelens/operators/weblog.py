"""Request, response, asset and console logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import short_hash
from pagelens.functions.urls import (
    cookie_map,
    is_api_url,
    is_network_log,
    is_script_asset,
    script_score,
    tagged_payload,
    url_path,
    url_query,
)


def api_requests(requests: DataFrame) -> DataFrame:
    """Calls to API URLs, with cookies, path, query and short id."""
    called = requests.where(is_api_url(F.col("url")))
    return called.select(
        "url",
        "method",
        "headers",
        cookie_map(F.col("cookie")).alias("cookies"),
        url_path(F.col("url")).alias("path"),
        url_query(F.col("url")).alias("query"),
        short_hash(F.col("url")).alias("request_id"),
        "ts",
    )


def last_per_key(rows: DataFrame, key: str, at: Column, *values: str) -> DataFrame:
    """The latest row of each key; partial aggregation, so a hot key costs one row a task."""
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*values), at).alias("last"))
    return latest.select(key, "last.*")


def last_request_per_url(requests: DataFrame) -> DataFrame:
    return last_per_key(requests, "url", F.col("ts"), "method", "headers", "cookies", "ts")


def last_cookies(responses: DataFrame, domain: str) -> DataFrame:
    """Last value of each cookie set by a successful response of the domain itself."""
    own = responses.where((F.col("status") == 200) & F.contains("url", F.lit(domain)))
    return last_per_key(own, "name", F.col("ts"), "value", "ts")


def seen_urls(requests: DataFrame) -> DataFrame:
    return requests.select("url").dropDuplicates(["url"])


def script_assets(assets: DataFrame) -> DataFrame:
    """Scripts to keep: the first non-empty body of each URL hash."""
    wanted = assets.where(is_script_asset(F.col("url"), F.col("content_type"), F.col("body")))
    hashed = wanted.withColumn("asset_id", short_hash(F.col("url")))
    first = F.min_by(F.struct("url", "body"), F.struct("ts", "url"))
    return hashed.groupBy("asset_id").agg(first.alias("first")).select("asset_id", "first.*")


def console_payloads(console: DataFrame) -> DataFrame:
    """Distinct payloads after the marker, under their short hash, which different ones may share."""
    found = console.select(tagged_payload(F.col("message")).alias("payload"))
    kept = found.where("payload is not null").dropDuplicates(["payload"])
    return kept.select(short_hash(F.col("payload")).alias("payload_id"), "payload")


def console_network_calls(console: DataFrame) -> DataFrame:
    """Distinct network logs under their short hash, which different ones may share."""
    calls = console.where(is_network_log(F.col("message"))).dropDuplicates(["message"])
    return calls.select(short_hash(F.col("message")).alias("log_id"), "message")


def api_scripts(scripts: DataFrame, key: str, body: str) -> DataFrame:
    """Scripts with API code, by falling number of patterns found, ties by key."""
    scored = scripts.select(key, script_score(F.col(body)).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), key)
