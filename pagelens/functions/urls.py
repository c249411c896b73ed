"""URL, cookie and request-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import strip

# The substrings and patterns that mark a URL as an API call.
API_URL_PATTERNS = [
    r"/api/",
    r"/graphql",
    r"/rest/",
    r"/v\d+/",
    r"/service/",
    r"\.json",
]

# The patterns that mark a script as containing API code.
SCRIPT_PATTERNS = [
    r"fetch\s*\(",
    r"XMLHttpRequest",
    r"new\s+WebSocket",
    r"\.ajax\s*\(",
    r"\.post\s*\(",
    r"\.get\s*\(",
    r"headers\s*:",
    r"Authorization\s*:",
    r"Bearer\s+",
    r"api_key",
    r"apiKey",
    r"token",
    r"signature",
]

# Fixed value: text in front of a payload written to the console.
PAYLOAD_MARKER = "DECRYPT_LOG:"

# Scheme, then host, path and query, each up to the next delimiter. A plain pattern
# rather than parse_url, which gives null for a URL holding a raw space.
_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
_HOST = _SCHEME + r"//([^/?#]*)"
_PATH = _SCHEME + r"(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, _HOST, 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def url_from_page_id(page_id: Column) -> Column:
    """Undo the file-name form of a URL; the triple underscore goes first."""
    scheme = F.replace(page_id, F.lit("___"), F.lit("://"))
    return F.replace(scheme, F.lit("__"), F.lit("/"))


def is_api_url(url: Column) -> Column:
    return url.rlike("|".join(API_URL_PATTERNS))


def script_score(body: Column) -> Column:
    """How many of the script patterns occur in the text."""
    score = F.lit(0).cast("bigint")
    for pattern in SCRIPT_PATTERNS:
        score = score + body.rlike(pattern).cast("bigint")
    return score


def cookie_items(cookies: Column) -> Column:
    """`a=1; b=2` as an array of (name, value), in order, items without `=` left out; empty
    for a null string. White space of any kind around an item is cut off."""
    given = F.coalesce(cookies, F.lit(""))
    items = F.filter(F.split(given, ";", -1), lambda item: F.contains(item, F.lit("=")))
    trimmed = F.transform(items, strip)
    return F.transform(
        trimmed,
        lambda item: F.struct(
            F.substring_index(item, "=", 1).alias("name"),
            F.regexp_extract(item, "(?s)^[^=]*=(.*)$", 1).alias("value"),
        ),
    )


def cookie_map(cookies: Column) -> Column:
    """Cookie string as a map; a repeated name keeps its last value."""
    items = cookie_items(cookies)
    last = F.filter(
        items,
        lambda item, i: ~F.exists(
            F.slice(items, i + 2, F.greatest(F.size(items), F.lit(1))),
            lambda later: later["name"] == item["name"],
        ),
    )
    return F.map_from_entries(last)


def tagged_payload(message: Column) -> Column:
    """Text after the first payload marker, null where the marker is absent."""
    at = F.instr(message, PAYLOAD_MARKER)
    rest = F.substr(message, at + len(PAYLOAD_MARKER))
    return F.when(at > 0, rest)


def is_network_log(message: Column) -> Column:
    return F.contains(message, F.lit("fetch(")) | F.contains(message, F.lit("XMLHttpRequest"))


def is_script_asset(url: Column, content_type: Column, body: Column) -> Column:
    is_script_url = F.endswith(url, F.lit(".js")) | F.contains(url, F.lit("/js/"))
    is_text = F.contains(content_type, F.lit("javascript")) | F.contains(
        content_type, F.lit("application/json")
    )
    return is_script_url & is_text & (F.length(body) > 0)
