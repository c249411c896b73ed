"""The SQL each query is compared with, over the same tables.

Pages are taken apart with regular expressions here, which the given and derived
markup allows: comments and script bodies go first, then every tag is one token.
"""

from __future__ import annotations

from pagelens.functions.text import PROMPT_CHARS, PROMPT_HEAD, PROMPT_TAIL
from pagelens.functions.urls import API_URL_PATTERNS, SCRIPT_PATTERNS
from pagelens.operators.features import (
    FORM_TAGS,
    HEADING_TAGS,
    INDICATOR_TAGS,
    RATIO_TAGS,
    SEMANTIC_TAGS,
    VECTOR_FEATURES,
)
from pagelens.registry.inputs import (
    CONSOLE_MESSAGE,
    COOKIES,
    DRESSED_HTML,
    HAS_CRAWLED,
    HAS_FINAL,
    HAS_PAGE,
    REQUEST_URL,
    STATUS,
)
from pagelens.registry.queries import (
    DRESSED_SCORE_LIMIT,
    SCORE_LIMIT,
    STRUCTURAL_LIMIT,
    TAG_LIMIT,
    VISUAL_LIMIT,
)

GIVEN = "SELECT page_id, html FROM pages"
DRESSED = f"""SELECT doc_id AS page_id, {DRESSED_HTML} AS html
  FROM documents LEFT JOIN labels USING (doc_id)"""

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def source(pages: str) -> str:
    """CTEs: `clean(page_id, h)` and `words(page_id, h)`, the latter without script bodies."""
    return rf"""
src AS ({pages}),
clean AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
    '<!--.*?-->', '', 'gs'),
    '<script([^>]*)>.*?</script>', '<script\1></script>', 'gs'),
    '<style([^>]*)>.*?</style>', '<style\1></style>', 'gs') AS h FROM src),
texts AS (SELECT page_id, replace(replace(replace(replace(replace(
    regexp_replace(replace(h, '&amp<', '&amp;<'), '<[^>]*>', '', 'gs'), '&copy;', chr(169)), '&middot;', chr(183)),
    '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM clean)"""


def tokens(pages: str) -> str:
    """CTEs up to `el(page_id, pos, tok, tag, classes, id)`: one row per element."""
    return rf"""{source(pages)},
lists AS (SELECT page_id, regexp_extract_all(h, '<[a-zA-Z][^>]*>') AS l FROM clean),
flat AS (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS tok FROM lists),
el AS (SELECT page_id, pos, tok,
    lower(regexp_extract(tok, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag,
    list_filter(string_split(regexp_extract(tok, ' class="([^"]*)"', 1), ' '),
      lambda c: c <> '') AS classes,
    nullif(regexp_extract(tok, ' id="([^"]*)"', 1), '') AS id
  FROM flat)"""


def tree(pages: str) -> str:
    """CTEs up to `nodes(page_id, pos, tag, depth, parent_pos, tok)` by a stack per page."""
    return rf"""{source(pages)},
lists AS (SELECT page_id, regexp_extract_all(h, '</?[a-zA-Z][^>]*>') AS l FROM clean),
flat AS (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS tok FROM lists),
named AS (SELECT page_id, i, tok, tok LIKE '</%' AS is_end,
    lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM flat),
steps AS (
  SELECT page_id, CAST(-1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS names,
    CAST([] AS BIGINT[]) AS places, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS depth,
    CAST(-1 AS BIGINT) AS parent_pos, true AS is_end, '' AS tag, '' AS tok FROM clean
  UNION ALL
  SELECT s.page_id, n.i,
    CASE WHEN NOT n.is_end AND n.tag NOT IN ('br', 'meta', 'img', 'input')
        THEN list_append(s.names, n.tag)
      WHEN n.is_end AND list_contains(s.names, n.tag)
        THEN s.names[1:len(s.names) - list_position(list_reverse(s.names), n.tag)]
      ELSE s.names END,
    CASE WHEN NOT n.is_end AND n.tag NOT IN ('br', 'meta', 'img', 'input')
        THEN list_append(s.places, s.pos + 1)
      WHEN n.is_end AND list_contains(s.names, n.tag)
        THEN s.places[1:len(s.names) - list_position(list_reverse(s.names), n.tag)]
      ELSE s.places END,
    CASE WHEN n.is_end THEN s.pos ELSE s.pos + 1 END,
    len(s.names) + 1, coalesce(s.places[-1], -1), n.is_end, n.tag, n.tok
  FROM steps s JOIN named n ON n.page_id = s.page_id AND n.i = s.i + 1),
nodes AS (SELECT page_id, pos, tag, depth, parent_pos, tok FROM steps WHERE NOT is_end)"""


def clean_text(value: str) -> str:
    pieces = f"regexp_split_to_array({value}, '{LINE_END}|  ')"
    stripped = strip("x")
    kept = f"list_filter(list_transform({pieces}, lambda x: {stripped}), lambda x: x <> '')"
    return f"array_to_string({kept}, ' ')"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def tag_count(*tags: str) -> str:
    names = ", ".join(f"'{t}'" for t in tags)
    return big(f"count(*) FILTER (WHERE tag IN ({names}))")


HREF = r"""regexp_extract(tok, ' href="([^"]*)"', 1)"""
IS_LINK = "tag = 'a' AND regexp_matches(tok, ' href=')"


def feature_sql(pages: str) -> str:
    """CTEs up to `feats`: the 28 numbers of each page."""
    total = "count(*)"
    cells = {
        "total_tags": big(total),
        "unique_tags": big("count(DISTINCT tag)"),
        "tag_diversity": f"count(DISTINCT tag) / {total}",
        "total_classes": big("coalesce(sum(len(classes)), 0)"),
        "unique_classes": big("len(list_distinct(flatten(list(classes))))"),
        "total_ids": big("count(id)"),
        "unique_ids": big("count(DISTINCT id)"),
        "internal_links": big(f"count(*) FILTER (WHERE {IS_LINK} AND NOT {HREF} LIKE 'http%')"),
        "external_links": big(f"count(*) FILTER (WHERE {IS_LINK} AND {HREF} LIKE 'http%')"),
        "nav_elements": tag_count("nav"),
        "text_length": big("any_value(length(t))"),
        "word_count": big(
            f"any_value(len(list_filter(regexp_split_to_array(t, '{SPACE}+'),"
            " lambda w: w <> '')))"
        ),
        "heading_count": tag_count(*HEADING_TAGS),
    }
    cells |= {f"{t}_ratio": f"count(*) FILTER (WHERE tag = '{t}') / {total}" for t in RATIO_TAGS}
    cells |= {f"{t}_count": tag_count(t) for t in FORM_TAGS}
    cells |= {f"semantic_{t}": tag_count(t) for t in SEMANTIC_TAGS}
    listed = ",\n    ".join(f"{cells[name]} AS {name}" for name in VECTOR_FEATURES)
    flags = ", ".join(f"bool_or(tag = '{t}') AS has_{t}" for t in INDICATOR_TAGS)
    return f"""{tokens(pages)},
feats AS (SELECT page_id, {listed}, {flags}
  FROM el JOIN texts USING (page_id) GROUP BY page_id)"""


def scaled_sql(columns: list[str], table: str = "feats") -> str:
    """CTE `scaled(id, dim, value)`: standard-scaled columns in long form."""
    parts = []
    for dim, name in enumerate(columns):
        value = f"CAST({name} AS DOUBLE)"
        parts.append(
            f"SELECT page_id AS id, {big(dim)} AS dim, "
            f"CASE WHEN stddev_pop({value}) OVER () <= 1e-12 * greatest(1, avg({value}) OVER ())"
            f" THEN 0 ELSE ({value} - avg({value}) OVER ()) / stddev_pop({value}) OVER () END"
            f" AS value FROM {table}"
        )
    return f"scaled AS ({' UNION ALL '.join(parts)})"


STRUCTURAL_LONG = f"{feature_sql(GIVEN)},\n{scaled_sql(VECTOR_FEATURES)}"
STRUCTURAL_VECTORS = f"""{STRUCTURAL_LONG},
structural AS (SELECT id, list(value ORDER BY dim) AS vector FROM scaled GROUP BY id)"""
VISUAL_VECTORS = """
visual AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""
COMBINED_VECTORS = """
shared AS (SELECT s.id, s.vector AS sv, v.vector AS vv FROM structural s JOIN visual v USING (id)),
shared_long AS (
  SELECT id, unnest(range(28)) AS dim, unnest(sv) AS x FROM shared UNION ALL
  SELECT id, unnest(range(64)) + 28 AS dim, unnest(vv) AS x FROM shared),
combined_long AS (SELECT id, dim,
    CASE WHEN stddev_pop(x) OVER w <= 1e-12 * greatest(1, abs(avg(x) OVER w)) THEN 0
      ELSE (x - avg(x) OVER w) / stddev_pop(x) OVER w END AS value
  FROM shared_long WINDOW w AS (PARTITION BY dim)),
combined AS (SELECT id, list(value ORDER BY dim) AS vector FROM combined_long GROUP BY id)"""


def cosine(x: str, y: str) -> str:
    return (
        f"list_dot_product({x}, {y}) / "
        f"(sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({y}, {y})))"
    )


def folded_pairs(table: str, limit: float) -> str:
    """CTE `alike`: distinct vectors above the limit, and copies under a = b."""
    return f"""
kept AS (SELECT min(id) AS id, count(*) AS copies, vector FROM {table}
  WHERE list_dot_product(vector, vector) > 0 GROUP BY vector),
alike AS (
  SELECT x.id AS a, y.id AS b, {cosine('x.vector', 'y.vector')} AS similarity,
    x.copies AS copies_a, y.copies AS copies_b, x.copies * y.copies AS page_pairs
  FROM kept x JOIN kept y ON x.id < y.id
  WHERE {cosine('x.vector', 'y.vector')} >= {limit}
  UNION ALL
  SELECT id, id, 1.0, copies, copies, copies * (copies - 1) // 2 FROM kept WHERE copies > 1)"""


def every_pair(table: str, limit: float, name: str = "alike") -> str:
    """CTE `alike`, or of another name: pairs of ids above the limit, those of copies among them,
    and rows that come again under their id as a = b."""
    return f"""
{name} AS (
  SELECT x.id AS a, y.id AS b, {cosine('x.vector', 'y.vector')} AS similarity
  FROM (SELECT DISTINCT id, vector FROM {table} WHERE list_dot_product(vector, vector) > 0) x
  JOIN (SELECT DISTINCT id, vector FROM {table} WHERE list_dot_product(vector, vector) > 0) y ON x.id < y.id
  WHERE {cosine('x.vector', 'y.vector')} >= {limit}
  UNION ALL SELECT id, id, 1.0 FROM {table} WHERE list_dot_product(vector, vector) > 0
  GROUP BY id, vector HAVING count(*) > 1)"""


VISUAL_ALIKE = f"{VISUAL_VECTORS},{folded_pairs('visual', VISUAL_LIMIT)}"
BOTH_ORDERS = """
both_orders AS (SELECT a, b, similarity FROM alike WHERE a <> b
  UNION ALL SELECT b, a, similarity FROM alike WHERE a <> b)"""
VISUAL_BOTH = f"{VISUAL_ALIKE},{BOTH_ORDERS}"
VISUAL_EVERY = f"{VISUAL_VECTORS},{every_pair('visual', VISUAL_LIMIT)},{BOTH_ORDERS}"


def column_ranges_sql(table: str) -> str:
    """CTE `ranges(b, lo, hi)`: ends of each column of the full matrix, diagonal included."""
    score = f"""CASE WHEN list_dot_product(x.vector, x.vector) * list_dot_product(y.vector, y.vector) > 0
    THEN {cosine('x.vector', 'y.vector')} ELSE 0 END"""
    return f"""
ranges AS (SELECT y.id AS b, min({score}) AS lo, max({score}) AS hi
  FROM {table} x CROSS JOIN {table} y GROUP BY y.id)"""


def two_lenses(visual_pairs: str) -> str:
    """CTEs of the pairs the visual lens finds, under both lenses."""
    return f"""{STRUCTURAL_VECTORS},{visual_pairs},
first_lens AS (SELECT p.a, p.b, CASE WHEN list_dot_product(x.vector, x.vector)
      * list_dot_product(y.vector, y.vector) > 0
      THEN {cosine('x.vector', 'y.vector')} ELSE 0 END AS similarity
  FROM both_orders p JOIN structural x ON x.id = p.a JOIN structural y ON y.id = p.b),
{column_ranges_sql('structural')},
minmax AS (SELECT p.a, p.b, CASE WHEN hi > lo THEN (similarity - lo) / (hi - lo) ELSE 0 END AS scaled
  FROM (SELECT * FROM first_lens UNION ALL SELECT id, id, 1.0 FROM structural) p
  JOIN ranges r ON r.b = p.b),
side AS (SELECT m.a, m.b, m.scaled, v.similarity AS other
  FROM minmax m JOIN (SELECT * FROM both_orders UNION ALL SELECT id, id, 1.0 FROM visual) v USING (a, b))"""

EVERY_TWO = two_lenses(VISUAL_EVERY)

FITTED = f"""{EVERY_TWO},
labelled AS (SELECT f.a, f.b, f.similarity AS x, v.similarity AS y,
    CAST(la.label = lb.label AS INTEGER) AS t
  FROM first_lens f JOIN both_orders v USING (a, b)
  JOIN embeddings la ON la.vec_id = f.a JOIN embeddings lb ON lb.vec_id = f.b),
moments AS (SELECT var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, t) AS xt,
    covar_pop(y, t) AS yt, avg(x) AS mx, avg(y) AS my, avg(t) AS mt FROM labelled WHERE t IS NOT NULL),
solved AS (SELECT (xt * yy - yt * xy) / (xx * yy - xy * xy) AS w1,
    (yt * xx - xt * xy) / (xx * yy - xy * xy) AS w2, mx, my, mt FROM moments)"""

BAND = """CASE WHEN {s} > 0.8 THEN 'Very similar' WHEN {s} > 0.6 THEN 'Moderately similar'
  ELSE 'Different' END"""


# -- logs and listings -------------------------------------------------------------

REQUESTS = f"""
reqs AS (SELECT {REQUEST_URL} AS url, event_type AS method, {COOKIES} AS cookie,
    {STATUS} AS status, ts
  FROM events JOIN pages ON page_id = user_id)"""
IS_API = " OR ".join(f"regexp_matches(url, '{p}')" for p in API_URL_PATTERNS)
SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
HOST = rf"regexp_extract(url, '{SCHEME}//([^/?#]*)', 1)"
PATH = rf"regexp_extract(url, '{SCHEME}(?://[^/?#]*)?([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
# The cookie string always reads sid=<id>; u=a=b ;bare; sid=<type>;e=
COOKIE_ROWS = """
items AS (SELECT {key}, unnest(range(len(l))) AS i, trim(unnest(l)) AS item
  FROM (SELECT {key}, string_split({cookie}, ';') AS l FROM {table})),
pairs AS (SELECT {key}, i, substr(item, 1, instr(item, '=') - 1) AS name,
    substr(item, instr(item, '=') + 1) AS value FROM items WHERE contains(item, '=')),
crumbs AS (SELECT {key}, name, arg_max(value, i) AS value FROM pairs GROUP BY ALL)"""

LISTING = f"""
files AS (SELECT page_id, 'crawl/' || page_id || '/' || name AS path, name,
    regexp_extract(name, '[^.]*$') AS ext
  FROM (SELECT page_id, 'page.html' AS name FROM pages WHERE {HAS_PAGE}
    UNION ALL SELECT page_id, 'crawled.html' FROM pages WHERE {HAS_CRAWLED}
    UNION ALL SELECT page_id, 'final_page.html' FROM pages WHERE {HAS_FINAL}
    UNION ALL SELECT page_id, 'zz_other.html' FROM pages
    UNION ALL SELECT vec_id, 'shot' || label || '.png' FROM embeddings))"""
MESSAGES = f"""
msgs AS (SELECT {CONSOLE_MESSAGE} AS message FROM documents LEFT JOIN labels USING (doc_id))"""


def script_score(body: str) -> str:
    return " + ".join(f"CAST(regexp_matches({body}, '{p}') AS BIGINT)" for p in SCRIPT_PATTERNS)


# -- cache state -------------------------------------------------------------------

STATE = """
cur AS (SELECT doc_id AS page_id, 'offline' AS model, md5(text) AS content_hash, n_chars
  FROM documents),
cache AS (SELECT doc_id AS page_id, 'offline' AS model,
    CASE WHEN toxic = 1 THEN md5(text || 'old') ELSE md5(text) END AS content_hash,
    CAST(quality AS DOUBLE) AS v1, CAST(1 AS DOUBLE) AS v2 FROM documents JOIN labels USING (doc_id)),
fresh AS (SELECT page_id, model, content_hash, CAST(n_chars AS DOUBLE) AS v1,
    CAST(2 AS DOUBLE) AS v2
  FROM cur WHERE n_chars >= 200),
merged AS (SELECT coalesce(c.page_id, f.page_id) AS page_id, coalesce(c.model, f.model) AS model,
    CASE WHEN f.page_id IS NULL THEN c.content_hash ELSE f.content_hash END AS content_hash,
    CASE WHEN f.page_id IS NULL THEN c.v1 ELSE f.v1 END AS v1,
    CASE WHEN f.page_id IS NULL THEN c.v2 ELSE f.v2 END AS v2
  FROM cache c FULL JOIN fresh f ON c.page_id = f.page_id AND c.model = f.model)"""

# -- page types --------------------------------------------------------------------


def page_types_sql(pages: str) -> str:
    """CTEs up to `typed(page_id, page_type)`, from the markup's own regularities."""

    def class_like(pattern: str) -> str:
        return f"""coalesce(bool_or(len(list_filter(classes,
          lambda c: regexp_matches(c, '{pattern}', 'i'))) > 0), false)"""

    def heading_like(pattern: str) -> str:
        return f"""regexp_matches(any_value(coalesce(nullif(regexp_extract(h,
          '<h[12]>(?:<span>)?([^<]*)(?:</span>)?</h[12]>', 1), ''), '')), '{pattern}', 'i')"""

    return f"""{tokens(pages)},
rules AS (SELECT page_id,
    bool_or(tok LIKE '% data-auto-id="add-to-bag"%' OR (tag = 'button'
      AND regexp_matches(regexp_extract(tok, ' title="([^"]*)"', 1), 'add to bag', 'i'))) AS r1,
    {heading_like('your bag|shopping bag|cart summary|bag summary')}
      OR {class_like('cart-content|bag-item|cart-item')} AS r2,
    {class_like('checkout|payment|billing|shipping|delivery-address')}
      OR {heading_like('checkout|payment|shipping')} AS r3,
    {tag_count('nav')} >= 1 AND {tag_count('a')} > 50
      AND {tag_count('section', 'article')} > 3 AS r4,
    {class_like('product-grid|product-list|plp-grid')} OR count(*) FILTER (WHERE
      len(list_filter(classes, lambda c: regexp_matches(c, 'product-card|product-tile', 'i'))) > 0
      ) > 3 AS r5,
    {class_like('contact|get-in-touch|customer-service')}
      OR {heading_like('contact|help|customer service')} AS r6,
    {class_like('account|profile|my-account')}
      OR {heading_like('my account|profile|account')} AS r7
  FROM el JOIN clean USING (page_id) GROUP BY page_id),
typed AS (SELECT page_id, CASE WHEN r1 THEN 'product' WHEN r2 THEN 'cart' WHEN r3 THEN 'checkout'
    WHEN r4 THEN 'homepage' WHEN r5 THEN 'category' WHEN r6 THEN 'contact' WHEN r7 THEN 'account'
    ELSE 'other' END AS page_type FROM rules)"""


# -- structures --------------------------------------------------------------------


def structures_sql(pages: str, base: str | None = None) -> str:
    """CTEs up to `struct` (one row per page) and `sigs` (one per distinct structure)."""
    forms = ", ".join(f"{tag_count(t)} AS {t}_count" for t in FORM_TAGS)
    keys = ", ".join(
        ["seq", "counts", "unique_classes", "unique_ids", *[f"{t}_count" for t in FORM_TAGS], "pats"]
    )
    return rf"""{base or tokens(pages)},
counted AS (SELECT page_id, list(struct_pack(tag := tag, n := n) ORDER BY tag) AS counts
  FROM (SELECT page_id, tag, count(*) AS n FROM el GROUP BY ALL) GROUP BY page_id),
shape AS (SELECT page_id, list(tag ORDER BY pos) FILTER (WHERE pos < 100) AS seq,
    {big('len(list_distinct(flatten(list(classes))))')} AS unique_classes,
    {big('count(DISTINCT id)')} AS unique_ids, {forms}
  FROM el GROUP BY page_id),
patrows AS (SELECT page_id, pos * 2 AS o,
    'id:' || regexp_replace(id, '\d+', 'N', 'g') AS p FROM el WHERE pos < 100 AND id IS NOT NULL
  UNION ALL SELECT page_id, pos * 2 + 1, 'class:' || array_to_string(list_sort(classes), '.')
  FROM el WHERE pos < 100 AND len(classes) > 0),
patlists AS (SELECT page_id, list(p ORDER BY o)[1:50] AS pl FROM patrows GROUP BY page_id),
struct AS (SELECT page_id, seq, counts, unique_classes, unique_ids,
    {', '.join(f'{t}_count' for t in FORM_TAGS)},
    list_sort(list_distinct(coalesce(pl, CAST([] AS VARCHAR[])))) AS pats
  FROM shape JOIN counted USING (page_id) LEFT JOIN patlists USING (page_id)),
sigs AS (SELECT min(page_id) AS sig, count(*) AS pages, {keys} FROM struct GROUP BY {keys})"""


def relative(x: str, y: str) -> str:
    return f"abs({x} - {y}) / greatest({x}, {y}, 1)"


TAG_SIM = """(SELECT sum(u.n * v.n) FROM (SELECT unnest(x.counts, recursive := true)) u
  JOIN (SELECT unnest(y.counts, recursive := true)) v USING (tag))"""


def pair_terms(x: str, y: str) -> str:
    css = f"1 - ({relative(f'{x}.unique_classes', f'{y}.unique_classes')} + " + (
        f"{relative(f'{x}.unique_ids', f'{y}.unique_ids')}) / 2"
    )
    forms = " + ".join(relative(f"{x}.{t}_count", f"{y}.{t}_count") for t in FORM_TAGS)
    union = f"len(list_distinct(list_concat({x}.pats, {y}.pats)))"
    pattern = (
        f"CASE WHEN {union} > 0 THEN len(list_intersect({x}.pats, {y}.pats)) / {union} END"
    )
    return f"""{css} AS css_sim, 1 - ({forms}) / 4 AS form_sim, {pattern} AS pattern_sim"""


TAG_DOTS = """
long_counts AS (SELECT {key} AS k, unnest(counts, recursive := true) FROM {table}),
lengths AS (SELECT k, sqrt(sum(n * n)) AS len FROM long_counts GROUP BY k)"""


def tag_pairs(pages: str, base: str | None = None, limit: float = TAG_LIMIT) -> str:
    """CTEs up to `tagalike`: distinct tag counts with cosine above the limit."""
    return f"""{base or tokens(pages)},
counted AS (SELECT page_id, list(struct_pack(tag := tag, n := n) ORDER BY tag) AS counts
  FROM (SELECT page_id, tag, count(*) AS n FROM el GROUP BY ALL) GROUP BY page_id),
groups AS (SELECT min(page_id) AS sig, count(*) AS pages, counts FROM counted GROUP BY counts),
{TAG_DOTS.format(key='sig', table='groups')},
dots AS (SELECT x.k AS a, y.k AS b, sum(x.n * y.n) AS dot
  FROM long_counts x JOIN long_counts y ON x.tag = y.tag AND x.k < y.k GROUP BY ALL),
tagalike AS (
  SELECT d.a, d.b, {big('x.pages * y.pages')} AS page_pairs, d.dot / (p.len * q.len) AS tag_sim
  FROM dots d JOIN lengths p ON p.k = d.a JOIN lengths q ON q.k = d.b
  JOIN groups x ON x.sig = d.a JOIN groups y ON y.sig = d.b
  WHERE d.dot / (p.len * q.len) >= {limit}
  UNION ALL
  SELECT sig, sig, {big('pages * (pages - 1) // 2')}, 1.0 FROM groups WHERE pages > 1)"""


NEXT_PAIRS = f"""{structures_sql(DRESSED)},
{TAG_DOTS.format(key='page_id', table='struct')},
dots AS (SELECT x.k AS a, y.k AS b, sum(x.n * y.n) AS dot
  FROM long_counts x JOIN long_counts y ON x.tag = y.tag AND y.k = x.k + 1 GROUP BY ALL)"""


def ratio_sql(pairs: str, table: str, key: str) -> str:
    """CTEs up to `ratios(a, b, ratio)`: matching blocks of the two sequences of each pair.

    The longest common run of a segment (the earliest in the first, then in the second
    sequence) cuts it into the parts before and after, which are treated alike.
    """
    return f"""
places AS (SELECT {key} AS k, unnest(range(len(seq))) AS i, unnest(seq) AS tag FROM {table}),
same AS (SELECT p.a, p.b, x.i, y.i AS j FROM {pairs} p JOIN places x ON x.k = p.a
  JOIN places y ON y.k = p.b AND y.tag = x.tag),
runs AS (SELECT a, b, i, j, row_number() OVER (PARTITION BY a, b, i - j, part ORDER BY i) AS run
  FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS part FROM same)),
segs AS (
  SELECT p.a, p.b, {big('0')} AS alo, {big('len(x.seq)')} AS ahi, {big('0')} AS blo,
    {big('len(y.seq)')} AS bhi, {big('0')} AS m
  FROM {pairs} p JOIN {table} x ON x.{key} = p.a JOIN {table} y ON y.{key} = p.b
  UNION ALL
  SELECT a, b, CASE WHEN side = 0 THEN alo ELSE best.si + best.n END,
    CASE WHEN side = 0 THEN best.si ELSE ahi END,
    CASE WHEN side = 0 THEN blo ELSE best.sj + best.n END,
    CASE WHEN side = 0 THEN best.sj ELSE bhi END,
    CASE WHEN side = 0 THEN best.n ELSE 0 END
  FROM (SELECT a, b, alo, ahi, blo, bhi, arg_min(
      struct_pack(n := n, si := i - n + 1, sj := j - n + 1), (-n, i - n + 1, j - n + 1)) AS best
    FROM (SELECT s.*, r.i, r.j, least(r.run, r.i - s.alo + 1, r.j - s.blo + 1) AS n
      FROM segs s JOIN runs r ON r.a = s.a AND r.b = s.b AND r.i >= s.alo AND r.i < s.ahi
        AND r.j >= s.blo AND r.j < s.bhi)
    GROUP BY a, b, alo, ahi, blo, bhi), (VALUES (0), (1)) AS sides(side)),
ratios AS (SELECT a, b,
    CASE WHEN max(ahi + bhi) = 0 THEN 1 ELSE 2 * sum(m) / max(ahi + bhi) END AS ratio
  FROM segs GROUP BY a, b)"""


def composite_sql(ratio: str) -> str:
    """Raw score; every page here has tags."""
    return (
        f"((2 * {ratio} + tag_sim + css_sim + form_sim + 1.5 * coalesce(pattern_sim, 0))"
        " / (4 + CAST(pattern_sim IS NOT NULL AS INT)))"
    )


SCORES = f"""round(f.ratio, 9) AS seq_ab, round(g.ratio, 9) AS seq_ba,
  round({composite_sql('f.ratio')}, 9) AS score_ab,
  round({composite_sql('g.ratio')}, 9) AS score_ba,
  round({composite_sql('f.ratio')} * (4 + CAST(pattern_sim IS NOT NULL AS INT))
    / (5 + 1.5 * CAST(pattern_sim IS NOT NULL AS INT)), 9) AS score_norm"""
BOTH_RATIOS = """JOIN ratios f ON f.a = c.a AND f.b = c.b
  JOIN ratios g ON g.a = c.b AND g.b = c.a"""


def similar_structures_sql(pages: str, limit: float) -> str:
    """All pairs of signatures; those that could not reach the limit are left out before
    the matching, by the Dice overlap of their tags, which the ratio cannot exceed."""
    reach = f"greatest({composite_sql('f.ratio')}, {composite_sql('g.ratio')})"
    return f"""WITH RECURSIVE {structures_sql(pages)},
{TAG_DOTS.format(key='sig', table='sigs')},
dots AS (SELECT x.k AS a, y.k AS b, sum(x.n * y.n) AS dot
  FROM long_counts x JOIN long_counts y ON x.tag = y.tag AND x.k <= y.k GROUP BY ALL),
terms AS (SELECT d.a, d.b, x.pages AS pages_a, y.pages AS pages_b,
    CASE WHEN d.a = d.b THEN {big('x.pages * (x.pages - 1) // 2')}
      ELSE {big('x.pages * y.pages')} END AS page_pairs,
    d.dot / (p.len * q.len) AS tag_sim, {pair_terms('x', 'y')}
  FROM dots d JOIN lengths p ON p.k = d.a JOIN lengths q ON q.k = d.b
  JOIN sigs x ON x.sig = d.a JOIN sigs y ON y.sig = d.b WHERE d.a < d.b OR x.pages > 1),
first_tags AS (SELECT sig AS k, len(seq) AS l, unnest(seq) AS tag FROM sigs),
tallies AS (SELECT k, l, tag, count(*) AS n FROM first_tags GROUP BY ALL),
dices AS (SELECT x.k AS a, y.k AS b, 2 * sum(least(x.n, y.n)) / any_value(x.l + y.l) AS dice
  FROM tallies x JOIN tallies y ON x.tag = y.tag AND x.k <= y.k GROUP BY x.k, y.k),
cand AS (SELECT t.* FROM terms t JOIN dices o USING (a, b)
  WHERE {composite_sql('dice')} >= {limit} - 1e-9),
pairs AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM cand UNION ALL SELECT b, a FROM cand)),
{ratio_sql('pairs', 'sigs', 'sig')}
SELECT c.a, c.b, pages_a, pages_b, page_pairs, round(tag_sim, 9) AS tag_sim,
  round(css_sim, 9) AS css_sim, round(form_sim, 9) AS form_sim,
  round(pattern_sim, 9) AS pattern_sim, {SCORES}
FROM cand c {BOTH_RATIOS} WHERE {reach} >= {limit}"""


WORDS = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def hashed_words_sql(table: str, size: int) -> str:
    """CTEs up to `hashed(id, dim, value)` from `table(id, text)`."""
    return f"""
words AS (SELECT id, unnest({WORDS.format(text='text')}) AS w FROM {table}),
filled AS (SELECT id, {big(f"CAST('0x' || substr(md5(w), 1, 8) AS UBIGINT) % {size}")} AS dim,
    count(*) AS n FROM words GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(n * n)) AS len FROM filled GROUP BY id),
grid AS (SELECT id, unnest(range({size})) AS dim FROM {table}),
hashed AS (SELECT id, dim, coalesce(n / len, 0) AS value
  FROM grid LEFT JOIN filled USING (id, dim) LEFT JOIN norms USING (id))"""


# Composite scores of the dressed structures, by the types of their pages.
TYPED_SCORES = f"""WITH scored AS ({similar_structures_sql(DRESSED, DRESSED_SCORE_LIMIT)}),
by_type AS (WITH {structures_sql(DRESSED, page_types_sql(DRESSED))}
  SELECT sig, page_type, count(*) AS n FROM struct JOIN sigs USING (seq, counts, unique_classes,
    unique_ids, {', '.join(f'{t}_count' for t in FORM_TAGS)}, pats)
  JOIN typed USING (page_id) GROUP BY sig, page_type),
within AS (SELECT x.page_type AS page_type, a, b,
    {big('CASE WHEN a = b THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END')} AS page_pairs,
    score_ab, score_ba
  FROM scored JOIN by_type x ON x.sig = a JOIN by_type y ON y.sig = b AND y.page_type = x.page_type
  WHERE a <> b OR x.n > 1)"""


def top_pairs_sql(table: str) -> str:
    return f"""SELECT '{table}' AS lens, x.id AS a, y.id AS b,
    round({cosine('x.vector', 'y.vector')}, 9) AS s
  FROM {table} x JOIN {table} y ON x.id < y.id
  WHERE list_dot_product(x.vector, x.vector) > 0 AND list_dot_product(y.vector, y.vector) > 0"""


def power_sql(name: str, matrix: str) -> str:
    """CTE `name(v, size, sign)`: the leading eigenvector of a 28 x 28 matrix, its
    eigenvalue, and the sign that makes its largest entry positive."""
    turned = "list_transform(m, lambda r: list_dot_product(r, v))"
    return f"""{name}_steps AS (
  SELECT 0 AS n, list_transform(range(28), lambda k: CAST(1 + k / 100 AS DOUBLE)) AS v
  UNION ALL
  SELECT n + 1, list_transform({turned}, lambda x: x / sqrt(list_dot_product({turned}, {turned})))
  FROM {name}_steps, {matrix} WHERE n < 1000),
{name} AS (SELECT v, list_dot_product(v, {turned}) AS size,
    CASE WHEN abs(list_max(v)) >= abs(list_min(v)) THEN 1 ELSE -1 END AS sign
  FROM {name}_steps, {matrix} WHERE n = 1000)"""


def mean_sql(table: str) -> str:
    unit = "list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector)))"
    return f"""(SELECT count(*) AS n FROM {table}) c,
  (SELECT sum(s * s) AS total FROM (SELECT sum(v) AS s FROM (
      SELECT unnest(range(len(vector))) AS dim, unnest({unit}) AS v FROM {table}
      WHERE list_dot_product(vector, vector) > 0) GROUP BY dim)) t,
  (SELECT count(*) AS nz FROM {table} WHERE list_dot_product(vector, vector) > 0) z"""


# -- interactive elements ----------------------------------------------------------

INTAKE = f"""WITH {source(GIVEN)},
shown AS (SELECT * FROM (SELECT page_id AS id, {clean_text('t')} AS text FROM texts) WHERE text <> ''),
{hashed_words_sql('shown', 16)}
SELECT id AS page_id, 'offline' AS model, md5(text) AS content_hash, dim, round(value, 6) AS value
FROM shown JOIN hashed USING (id)"""

INTERACTIVE = rf"""{source(DRESSED)},
cut AS (SELECT page_id, regexp_extract_all(h, '<[^>]*>') AS l,
    regexp_split_to_array(h, '<[^>]*>') AS seg FROM clean),
every AS (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS tok FROM cut),
kinds AS (SELECT page_id, i, tok, tok LIKE '</%' AS is_end,
    lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM every),
starts AS (SELECT page_id, i, tok, tag,
    row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos
  FROM kinds WHERE NOT is_end AND tag <> ''),
chosen AS (SELECT * FROM starts WHERE tag IN ('button', 'input', 'select', 'textarea', 'a', 'label',
    'details', 'summary') OR regexp_matches(tok, ' on[a-z]+="') OR regexp_matches(tok, ' tabindex=')
    OR regexp_matches(tok, ' role="button"')),
ends AS (SELECT c.page_id, c.i, min(k.i) AS j FROM chosen c JOIN kinds k
  ON k.page_id = c.page_id AND k.is_end AND k.tag = c.tag AND k.i > c.i GROUP BY ALL),
shown AS (SELECT c.page_id, CAST(c.pos AS BIGINT) AS pos, c.tag,
    array_to_string(list_transform(list_filter(
      regexp_extract_all(c.tok, ' [a-z]+="[^"]*"'), lambda x: regexp_matches(x,
        '^ (on[a-z]+|tabindex|id)=') OR x = ' role="button"' OR (c.tag = 'a' AND x LIKE ' href=%')),
      lambda x: replace(trim(x), '"', '')), '|') AS attributes,
    trim(regexp_extract(c.tok, ' class="([^"]*)"', 1)) AS classes,
    CASE WHEN c.tag = 'input' THEN '' ELSE array_to_string(list_transform(
      t.seg[c.i + 2:e.j + 1], lambda x: {strip('x')}), '') END AS text
  FROM chosen c JOIN cut t USING (page_id) LEFT JOIN ends e ON e.page_id = c.page_id AND e.i = c.i)"""


# -- all of them -------------------------------------------------------------------

RATIOS = ["tag_diversity", *[f"{t}_ratio" for t in RATIO_TAGS]]
ROUNDED_FEATURES = ", ".join(
    f"round({n}, 9) AS {n}" if n in RATIOS else n for n in VECTOR_FEATURES
)
FLAGS = ", ".join(f"has_{t}" for t in INDICATOR_TAGS)
LABELS = "FROM documents LEFT JOIN labels USING (doc_id)"

ORACLES: dict[str, str] = {
    "lenient_page_texts": f"""WITH {source(GIVEN)}
SELECT page_id, text, md5(text) AS content_hash
FROM (SELECT page_id, {clean_text('t')} AS text FROM texts) WHERE text <> ''""",
    "crawl_pages": f"""WITH {LISTING}
SELECT page_id,
  coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE ext = 'html'), '') AS html_files,
  coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE ext = 'png'), '') AS screenshots
FROM files GROUP BY page_id""",
    "primary_html": f"""WITH {LISTING}
SELECT page_id, arg_min(path, list_position(['page.html', 'crawled.html', 'final_page.html'], name))
  AS path FROM files WHERE name IN ('page.html', 'crawled.html', 'final_page.html')
GROUP BY page_id""",
    "primary_html_or_first": f"""WITH {LISTING}
SELECT page_id, first(path ORDER BY name <> 'page.html', path) AS path
FROM files WHERE ext = 'html' GROUP BY page_id""",
    "primary_screenshot": f"""WITH {LISTING}
SELECT page_id, min(path) AS path FROM files WHERE ext = 'png' GROUP BY page_id""",
    "embedding_cache": f"WITH {STATE} SELECT page_id, model, content_hash, v1 AS first, v2 AS second FROM merged",
    "result_documents": f"""WITH {page_types_sql(DRESSED)}
SELECT page_type, count(*) AS pages, count(*) AS listed, false AS has_visual,
  (SELECT count(*) FROM typed) AS total_files
FROM typed GROUP BY page_type""",
    "visual_document": f"""WITH {VISUAL_VECTORS},
line AS (SELECT n AS total_files, round(total / (n * n), 6) AS average_similarity FROM {mean_sql('visual')})
SELECT id, unnest(range(64)) AS dim, round(unnest(vector), 6) AS value, total_files, average_similarity,
  {big(64)} AS embedding_dimension FROM visual, line""",
    "feature_document": f"""WITH {feature_sql(GIVEN)},
long AS ({' UNION ALL '.join(
        f"SELECT page_id, '{name}' AS feature, {big(place)} AS place, CAST({name} AS DOUBLE) AS value FROM feats"
        for place, name in enumerate(VECTOR_FEATURES, start=1))})
SELECT page_id, feature, place, value, round(avg(value) OVER (PARTITION BY feature), 6) AS mean FROM long""",
    "interactables_json": f"""WITH {INTERACTIVE}
SELECT page_id, count(*) AS interactables, string_agg(tag, ',' ORDER BY pos) AS tags
FROM shown GROUP BY page_id""",
    "request_log": f"""WITH {REQUESTS},
latest AS (SELECT url, max(ts) AS ts FROM reqs WHERE {IS_API} GROUP BY url),
won AS (SELECT r.* FROM reqs r JOIN latest l ON l.url = r.url AND l.ts = r.ts),
{COOKIE_ROWS.format(key='url', cookie='cookie', table='won')}
SELECT url, method, {PATH} AS path, {QUERY} AS query, substr(md5(url), 1, 8) AS request_id, cookies
FROM won JOIN (SELECT url, string_agg(name || '=' || value, '&' ORDER BY name) AS cookies
  FROM crumbs GROUP BY url) USING (url)""",
    "visible_text": f"""WITH {source(GIVEN)}
SELECT page_id, {clean_text('t')} AS text FROM texts""",
    "content_hashes": "SELECT doc_id, md5(text) AS content_hash FROM documents",
    "short_hash_ids": "SELECT page_id, substr(md5(url), 1, 8) AS url_id FROM pages",
    "urls_from_page_ids": """SELECT page_id, replace(replace(replace(replace(url, '://', '___'),
  '/', '__'), '___', '://'), '__', '/') AS url FROM pages""",
    "url_parts": f"SELECT page_id, {HOST} AS host, {PATH} AS path, {QUERY} AS query FROM pages",
    "cookie_maps": f"""WITH src AS (SELECT event_id, {COOKIES} AS cookie FROM events),
{COOKIE_ROWS.format(key='event_id', cookie='cookie', table='src')}
SELECT event_id, name, value FROM crumbs""",
    "api_requests": f"""WITH {REQUESTS}
SELECT url, method, {PATH} AS path, {QUERY} AS query, substr(md5(url), 1, 8) AS request_id, ts
FROM reqs WHERE {IS_API}""",
    "script_assets": """WITH assets AS (
  SELECT 'https://' || split_part(url, '/', 3) || '/js/' || lower(substr(html, 39, 2)) AS url,
    CASE WHEN url LIKE 'https%' THEN 'text/javascript' WHEN url LIKE '%.html'
      THEN 'application/json' ELSE 'text/html' END AS content_type,
    CASE WHEN url LIKE '%#top' THEN '' ELSE html END AS body, page_id AS ts FROM pages),
kept AS (SELECT substr(md5(url), 1, 8) AS asset_id, * FROM assets
  WHERE (url LIKE '%.js' OR url LIKE '%/js/%') AND body <> ''
  AND (content_type LIKE '%javascript%' OR content_type LIKE '%application/json%'))
SELECT asset_id, arg_min(url, ts) AS url, md5(arg_min(body, ts)) AS body_hash
FROM kept GROUP BY asset_id""",
    "console_payloads": f"""WITH {MESSAGES},
found AS (SELECT DISTINCT substr(message, instr(message, 'DECRYPT_LOG:') + 12) AS payload
  FROM msgs WHERE contains(message, 'DECRYPT_LOG:'))
SELECT substr(md5(payload), 1, 8) AS payload_id, payload FROM found""",
    "console_network_calls": f"""WITH {MESSAGES}
SELECT DISTINCT substr(md5(message), 1, 8) AS log_id, message FROM msgs
WHERE contains(message, 'fetch(') OR contains(message, 'XMLHttpRequest')""",
    "api_scripts": f"""WITH {MESSAGES},
scored AS (SELECT md5(message) AS script, {script_score('message')} AS score FROM msgs)
SELECT script, score FROM scored WHERE score > 0 ORDER BY score DESC, script""",
    "script_scores": f"""WITH {MESSAGES}
SELECT md5(message) AS message_hash, {script_score('message')} AS score FROM msgs""",
    "description_prompts": f"""WITH src AS ({DRESSED}),
made AS (SELECT page_id, '{PROMPT_HEAD}' || substr(html, 1, {PROMPT_CHARS}) || '{PROMPT_TAIL}' AS p
  FROM src)
SELECT page_id, md5(p) AS prompt_hash, length(p) AS chars FROM made""",
    "short_labels": """SELECT page_id,
  CASE WHEN length(url) > 20 THEN left(url, 20) || '...' ELSE url END AS label20,
  CASE WHEN length(url) > 15 THEN left(url, 15) || '...' ELSE url END AS label15,
  replace(url, '.html', '') AS file_label FROM pages""",
    "name_categories": """WITH named AS (SELECT doc_id, CASE
  WHEN contains(lower(text), 'stan') AND NOT contains(lower(text), 'pdp') THEN 'stan'
  WHEN contains(lower(text), 'pdp') THEN 'pdp' WHEN contains(lower(text), 'cart') THEN 'cart'
  WHEN contains(lower(text), 'checkout') THEN 'checkout' ELSE 'other' END AS category
  FROM documents)
SELECT doc_id, category, CASE category WHEN 'stan' THEN '#FF6B6B' WHEN 'pdp' THEN '#4ECDC4'
  WHEN 'cart' THEN '#45B7D1' WHEN 'checkout' THEN '#96CEB4' ELSE '#FFD93D' END AS colour
FROM named""",
    "type_colours": f"""WITH {page_types_sql(DRESSED)}
SELECT page_id, page_type, CASE page_type WHEN 'product' THEN '#FF6B6B' WHEN 'cart' THEN '#4ECDC4'
  WHEN 'checkout' THEN '#45B7D1' WHEN 'homepage' THEN '#96CEB4' WHEN 'contact' THEN '#DDA0DD'
  ELSE '#95A5A6' END AS colour FROM typed""",
    "unit_vectors": f"""WITH {VISUAL_VECTORS}
SELECT id, unnest(range(len(vector))) AS dim, round(unnest(list_transform(vector,
  lambda x: x / sqrt(list_dot_product(vector, vector)))), 6) AS value FROM visual""",
    "concatenated_vectors": f"""WITH {VISUAL_VECTORS}
SELECT id, unnest(range(2 * len(vector))) AS dim,
  round(unnest(list_concat(vector, list_reverse(vector))), 6) AS value FROM visual""",
    "averaged_vectors": f"""WITH {VISUAL_VECTORS}
SELECT id, unnest(range(64)) AS dim, round(unnest(list_transform(range(64),
  lambda i: vector[i + 1] * 0.6 + vector[64 - i] * 0.4)), 6) AS value FROM visual""",
    "page_elements": f"""WITH RECURSIVE {tree(GIVEN)}
SELECT page_id, pos, tag, depth, parent_pos, {HREF} AS href,
  regexp_extract(tok, ' class="([^"]*)"', 1) AS classes FROM nodes""",
    "tag_sequences": f"""WITH {tokens(DRESSED)}
SELECT page_id, string_agg(tag, ',' ORDER BY pos) AS tags FROM el WHERE pos < 200
GROUP BY page_id""",
    "tag_counts": f"""WITH {tokens(GIVEN)}
SELECT page_id, tag, count(*) AS n, min(pos) AS first_pos FROM el GROUP BY page_id, tag""",
    "css_fingerprints": f"""WITH {feature_sql(DRESSED)}
SELECT page_id, unique_classes, total_classes, unique_ids FROM feats""",
    "form_structures": f"""WITH {feature_sql(DRESSED)}
SELECT page_id, form_count, input_count, button_count, select_count FROM feats""",
    "link_structures": f"""WITH {tokens(DRESSED)}
SELECT page_id, count(*) FILTER (WHERE {IS_LINK}) AS total_links,
  count(*) FILTER (WHERE {IS_LINK} AND NOT regexp_matches({HREF}, '^https?://')) AS internal_links,
  count(*) FILTER (WHERE {IS_LINK} AND regexp_matches({HREF}, '^https?://')) AS external_links,
  {tag_count('nav')} AS nav_links FROM el GROUP BY page_id""",
    "link_prefix_counts": f"""WITH {feature_sql(DRESSED)}
SELECT page_id, internal_links, external_links FROM feats""",
    "depth_statistics": f"""WITH RECURSIVE {tree(GIVEN)}
SELECT page_id, max(depth) AS max_depth, round(avg(depth), 9) AS avg_depth,
  round((count(*) * sum(depth * depth) - sum(depth) * sum(depth)) / (count(*) * count(*)), 9)
    AS depth_variance
FROM nodes WHERE pos < 100 GROUP BY page_id""",
    "id_class_patterns": f"""WITH {structures_sql(DRESSED)}
SELECT page_id, array_to_string(pl, '|') AS patterns FROM patlists""",
    "page_type_labels": f"WITH {page_types_sql(DRESSED)} SELECT page_id, page_type FROM typed",
    "page_types_by_own_rules": f"""WITH {tokens(GIVEN)}
SELECT page_id, CASE WHEN {tag_count('p')} > 10 THEN 'long' WHEN {tag_count('b')} > 1 THEN 'broken'
  ELSE 'other' END AS page_type FROM el GROUP BY page_id""",
    "page_feature_vectors": f"""WITH {feature_sql(GIVEN)}
SELECT page_id, {ROUNDED_FEATURES}, {FLAGS} FROM feats""",
    "dressed_feature_vectors": f"""WITH {feature_sql(DRESSED)}
SELECT page_id, {ROUNDED_FEATURES} FROM feats""",
    "boolean_indicators": f"WITH {feature_sql(DRESSED)} SELECT page_id, {FLAGS} FROM feats",
    "meta_info": f"""WITH {tokens(DRESSED)},
metas AS (SELECT page_id, pos, coalesce(nullif(regexp_extract(tok, ' name="([^"]*)"', 1), ''),
    nullif(regexp_extract(tok, ' property="([^"]*)"', 1), '')) AS name,
    nullif(regexp_extract(tok, ' content="([^"]*)"', 1), '') AS content FROM el WHERE tag = 'meta')
SELECT page_id, name, arg_max(content, pos) AS content FROM metas
WHERE name IS NOT NULL AND content IS NOT NULL GROUP BY page_id, name""",
    "input_types": f"""WITH {tokens(DRESSED)}
SELECT page_id, CASE WHEN regexp_matches(tok, ' type=') THEN regexp_extract(tok, ' type="([^"]*)"', 1)
  ELSE 'text' END AS input_type, count(*) AS n FROM el WHERE tag = 'input' GROUP BY ALL""",
    "id_counts": f"""WITH {tokens(DRESSED)}
SELECT page_id, id, count(*) AS n FROM el WHERE id IS NOT NULL GROUP BY page_id, id""",
    "top_tags": f"""WITH {tokens(GIVEN)},
counted AS (SELECT page_id, tag, count(*) AS n, min(pos) AS f FROM el GROUP BY page_id, tag),
ranked AS (SELECT page_id, tag, n,
    row_number() OVER (PARTITION BY page_id ORDER BY n DESC, f) AS rank FROM counted)
SELECT * FROM ranked WHERE rank <= 20""",
    "top_classes": f"""WITH {tokens(DRESSED)},
named AS (SELECT page_id, pos * 100 + unnest(range(len(classes))) AS o, unnest(classes) AS class
  FROM el),
counted AS (SELECT page_id, class, count(*) AS n, min(o) AS f FROM named GROUP BY page_id, class),
ranked AS (SELECT page_id, class, n,
    row_number() OVER (PARTITION BY page_id ORDER BY n DESC, f) AS rank FROM counted)
SELECT * FROM ranked WHERE rank <= 10""",
    "interactive_elements": f"WITH {INTERACTIVE} SELECT * FROM shown",
    "page_link_texts": rf"""WITH {tokens(GIVEN)},
linked AS (SELECT page_id, unnest(regexp_extract_all(h, '<a [^>]*>[^<]*')) AS part,
    unnest(range(len(regexp_extract_all(h, '<a [^>]*>[^<]*')))) AS nth FROM clean),
anchors AS (SELECT page_id, pos, tok, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1
    AS nth FROM el WHERE tag = 'a')
SELECT page_id, pos, 'a' AS tag, {HREF} AS href,
  {strip("replace(regexp_extract(part, '>([^<]*)', 1), '&amp;', '&')")} AS text
FROM anchors JOIN linked USING (page_id, nth)""",
    "interactable_counts": f"""WITH {INTERACTIVE}
SELECT page_id, count(*) AS interactables FROM shown GROUP BY page_id""",
    "site_interactables": f"""WITH {INTERACTIVE}
SELECT tag, count(*) AS elements, count(DISTINCT page_id) AS pages FROM shown GROUP BY tag""",
    "standard_vectors": f"WITH {STRUCTURAL_LONG} SELECT id, dim, round(value, 6) AS value FROM scaled",
    "feature_profile": f"""WITH {feature_sql(GIVEN)}, long AS ({' UNION ALL '.join(
        f"SELECT '{n}' AS feature, CAST({n} AS DOUBLE) AS v FROM feats" for n in VECTOR_FEATURES)})
SELECT feature, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25,
  round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75,
  round(max(v), 6) AS max FROM long GROUP BY feature""",
    "combined_vectors": f"""WITH {STRUCTURAL_VECTORS},{VISUAL_VECTORS},{COMBINED_VECTORS}
SELECT id, dim, round(value, 6) AS value FROM combined_long""",
    "vectors_with_signals": f"""WITH {feature_sql(GIVEN)},
more AS (SELECT f.*, coalesce(v.visits, 0) AS visits FROM feats f LEFT JOIN
  (SELECT user_id, count(*) AS visits FROM events GROUP BY user_id) v ON v.user_id = f.page_id),
{scaled_sql([*VECTOR_FEATURES, 'visits'], 'more')}
SELECT id, dim, round(value, 6) AS value FROM scaled""",
    "changed_pages": f"""WITH {STATE}
SELECT page_id, model, content_hash FROM cur c WHERE NOT EXISTS (SELECT 1 FROM cache k
  WHERE k.page_id = c.page_id AND k.model = c.model AND k.content_hash = c.content_hash)""",
    "cache_upsert": f"""WITH {STATE}
SELECT page_id, model, content_hash, v1 AS first, v2 AS second FROM merged""",
    "resolved_vectors": f"""WITH {STATE}
SELECT c.page_id, CASE WHEN f.page_id IS NOT NULL THEN 'new' WHEN k.page_id IS NOT NULL THEN 'cached'
  ELSE 'missing' END AS origin, coalesce(f.v1, k.v1) AS first, coalesce(f.v2, k.v2) AS second
FROM cur c LEFT JOIN fresh f ON f.page_id = c.page_id LEFT JOIN cache k ON k.page_id = c.page_id""",
    "embedding_cost": f"""WITH {STATE}
SELECT count(*) AS texts, round(count(*) * 25 / 60, 6) AS minutes FROM cur c
WHERE NOT EXISTS (SELECT 1 FROM cache k
  WHERE k.page_id = c.page_id AND k.content_hash = c.content_hash)""",
    "structure_signatures": f"""WITH {structures_sql(GIVEN)}
SELECT sig, pages, array_to_string(seq, ',') AS seq, unique_classes, unique_ids FROM sigs""",
    "similar_tag_counts": f"""WITH {tag_pairs(DRESSED)}
SELECT a, b, page_pairs, round(tag_sim, 9) AS tag_sim FROM tagalike""",
    "fairly_similar_tag_counts": f"""WITH {tag_pairs(DRESSED, limit=0.9)}
SELECT a, b, page_pairs, round(tag_sim, 9) AS tag_sim FROM tagalike""",
    "similar_patterns": f"""WITH {structures_sql(DRESSED)},
held AS (SELECT min(page_id) AS id, count(*) AS pages, pats FROM struct WHERE len(pats) > 0 GROUP BY pats),
alike AS (SELECT x.id AS a, y.id AS b, x.pages * y.pages AS page_pairs,
    len(list_intersect(x.pats, y.pats)) / len(list_distinct(list_concat(x.pats, y.pats))) AS jaccard
  FROM held x JOIN held y ON x.id < y.id
  UNION ALL SELECT id, id, pages * (pages - 1) // 2, 1.0 FROM held WHERE pages > 1)
SELECT a, b, {big('page_pairs')} AS page_pairs, round(jaccard, 9) AS jaccard FROM alike WHERE jaccard >= 0.8""",
    "listed_pair_terms": f"""WITH {NEXT_PAIRS}
SELECT d.a, d.b, round(d.dot / (p.len * q.len), 9) AS tag_sim, round(css_sim, 9) AS css_sim,
  round(form_sim, 9) AS form_sim, round(pattern_sim, 9) AS pattern_sim
FROM (SELECT d.*, {pair_terms('x', 'y')} FROM dots d JOIN struct x ON x.page_id = d.a
  JOIN struct y ON y.page_id = d.b) d
JOIN lengths p ON p.k = d.a JOIN lengths q ON q.k = d.b""",
    "similar_structures": similar_structures_sql(GIVEN, SCORE_LIMIT),
    "similar_dressed_structures": similar_structures_sql(DRESSED, DRESSED_SCORE_LIMIT),
    "listed_pair_scores": f"""WITH RECURSIVE {NEXT_PAIRS},
cand AS (SELECT d.a, d.b, d.dot / (p.len * q.len) AS tag_sim, {pair_terms('x', 'y')}
  FROM dots d JOIN lengths p ON p.k = d.a JOIN lengths q ON q.k = d.b
  JOIN struct x ON x.page_id = d.a JOIN struct y ON y.page_id = d.b),
pairs AS (SELECT a, b FROM cand UNION ALL SELECT b, a FROM cand),
{ratio_sql('pairs', 'struct', 'page_id')}
SELECT c.a, c.b, {SCORES} FROM cand c {BOTH_RATIOS}""",
    "text_embeddings": f"""WITH src AS (SELECT doc_id AS id, text FROM documents),
{hashed_words_sql('src', 32)}
SELECT id, dim, round(value, 6) AS value FROM hashed""",
    "tfidf_embeddings": f"""WITH src AS (SELECT doc_id AS id, text FROM documents),
{hashed_words_sql('src', 32)},
weight AS (SELECT dim, ln((SELECT count(*) + 1 FROM src) / (count(n) + 1)) AS w
  FROM grid LEFT JOIN filled USING (id, dim) GROUP BY dim),
weighed AS (SELECT id, dim, coalesce(n, 0) * w AS x
  FROM grid JOIN weight USING (dim) LEFT JOIN filled USING (id, dim)),
length AS (SELECT id, sqrt(sum(x * x)) AS len FROM weighed GROUP BY id)
SELECT id, dim, round(CASE WHEN len > 0 THEN x / len ELSE 0 END, 6) AS value
FROM weighed JOIN length USING (id)""",
    "described_embeddings": f"""WITH prompts AS (SELECT page_id AS id,
  '{PROMPT_HEAD}' || substr(html, 1, {PROMPT_CHARS}) || '{PROMPT_TAIL}' AS p FROM pages),
src AS (SELECT id, length(p) || ' characters, '
  || {big("(length(p) - length(replace(p, '<p', ''))) // 2")} || ' paragraphs' AS text FROM prompts),
{hashed_words_sql('src', 16)}
SELECT id, dim, round(value, 6) AS value FROM hashed""",
    "similar_vectors": f"""WITH {VISUAL_ALIKE}
SELECT a, b, round(similarity, 9) AS similarity, copies_a, copies_b, {big('page_pairs')}
  AS page_pairs, {BAND.format(s='similarity')} AS band, round(1 - similarity, 9) AS distance
FROM alike""",
    "very_similar_vectors": f"""WITH {VISUAL_VECTORS},{folded_pairs('visual', 0.8)}
SELECT a, b, round(similarity, 9) AS similarity, copies_a, copies_b, {big('page_pairs')}
  AS page_pairs FROM alike""",
    "similar_structural_vectors": f"""WITH {STRUCTURAL_VECTORS},
{folded_pairs('structural', STRUCTURAL_LIMIT)}
SELECT a, b, round(similarity, 6) AS similarity, copies_a, copies_b, {big('page_pairs')}
  AS page_pairs FROM alike""",
    "named_pairs": f"""WITH {VISUAL_VECTORS},
scored AS (SELECT x.id AS a, y.id AS b, {cosine('x.vector', 'y.vector')} AS s
  FROM visual x JOIN visual y ON y.id = x.id + 1)
SELECT a, b, round(s, 9) AS similarity, {BAND.format(s='s')} AS band FROM scored""",
    "column_min_max": f"""WITH {VISUAL_EVERY},{column_ranges_sql('visual')}
SELECT p.a, p.b, round(CASE WHEN hi > lo THEN (similarity - lo) / (hi - lo) ELSE 0 END, 6) AS similarity
FROM (SELECT a, b, similarity FROM both_orders UNION ALL SELECT id, id, 1.0 FROM visual) p
JOIN ranges r ON r.b = p.b""",
    "column_ranges": f"""WITH {STRUCTURAL_VECTORS},{column_ranges_sql('structural')}
SELECT b, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ranges""",
    "weighted_blend": f"""WITH {EVERY_TWO}
SELECT a, b, round(0.7 * scaled + 0.3 * other, 6) AS similarity FROM side""",
    "weight_sweep": f"""WITH {EVERY_TWO}
SELECT a, b, CAST(w1 AS DOUBLE) AS first_weight, CAST(w2 AS DOUBLE) AS second_weight,
  round(w1 * scaled + w2 * other, 6) AS similarity
FROM side, (VALUES (0.5::DOUBLE, 0.5::DOUBLE), (0.7, 0.3), (0.3, 0.7), (1.0, 0.0), (0.0, 1.0))
  AS w(w1, w2)""",
    "lens_comparison": f"""WITH {STRUCTURAL_VECTORS},
{every_pair('structural', STRUCTURAL_LIMIT, 'alike_s')},
{VISUAL_VECTORS},{every_pair('visual', VISUAL_LIMIT)}
SELECT coalesce(s.a, v.a) AS a, coalesce(s.b, v.b) AS b, round(s.similarity, 6) AS structural,
  round(v.similarity, 6) AS visual
FROM alike_s s FULL JOIN alike v ON s.a = v.a AND s.b = v.b""",
    "lens_correlation": f"""WITH {EVERY_TWO}
SELECT round(corr(f.similarity, v.similarity), 6) AS correlation, count(*) AS pairs
FROM first_lens f JOIN both_orders v USING (a, b)""",
    "fitted_lens_weights": f"""WITH {FITTED}
SELECT 'structural' AS lens, round(w1, 6) AS weight FROM solved
UNION ALL SELECT 'visual', round(w2, 6) FROM solved
UNION ALL SELECT 'intercept', round(mt - w1 * mx - w2 * my, 6) FROM solved""",
    "fused_lenses": f"""WITH {FITTED}
SELECT a, b, round(mt - w1 * mx - w2 * my + w1 * x + w2 * y, 6) AS similarity
FROM labelled, solved""",
    "matrix_blocks": f"""WITH {VISUAL_BOTH}
SELECT a, b // 1000 AS block, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS columns,
  string_agg(printf('%.6f', similarity), ';' ORDER BY b) AS similarities
FROM both_orders GROUP BY a, b // 1000""",
    "mean_similarity": f"""WITH {VISUAL_VECTORS},
every AS (SELECT x.id AS a, y.id AS b, {cosine('x.vector', 'y.vector')} AS s
  FROM visual x CROSS JOIN visual y)
SELECT (SELECT count(*) FROM visual) AS vectors, round(avg(s), 9) AS mean_full,
  round(avg(s) FILTER (WHERE a < b), 9) AS mean_upper FROM every""",
    "type_distribution": f"""WITH {page_types_sql(DRESSED)}
SELECT page_type, count(*) AS pages FROM typed GROUP BY page_type""",
    "within_type_pairs": f"{TYPED_SCORES} SELECT * FROM within",
    "within_type_spread": f"""{TYPED_SCORES},
orders AS (SELECT page_type, page_pairs, score_ab AS raw FROM within
  UNION ALL SELECT page_type, page_pairs, score_ba FROM within),
expanded AS (SELECT page_type, round(raw, 6) AS score, unnest(range(page_pairs)) AS one FROM orders),
quarters AS (SELECT page_type, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
    quantile_cont(score, 0.75) AS q3, count(*) AS scores FROM expanded GROUP BY page_type),
possible AS (SELECT page_type, {big('sum(n) * (sum(n) - 1) // 2')} AS pairs_possible
  FROM by_type GROUP BY page_type)
SELECT page_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(score) FILTER (WHERE score >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(score) FILTER (WHERE score <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, scores,
  pairs_possible
FROM expanded JOIN quarters USING (page_type) JOIN possible USING (page_type)
GROUP BY page_type, q1, median, q3, scores, pairs_possible""",
    "product_pairs": f"""{TYPED_SCORES}
SELECT a, b, page_pairs, score_ab, score_ba FROM within WHERE page_type = 'product'""",
    "product_against_cart": f"""WITH RECURSIVE {structures_sql(DRESSED, page_types_sql(DRESSED))},
pair AS (SELECT min(page_id) FILTER (WHERE page_type = 'product') AS a,
    min(page_id) FILTER (WHERE page_type = 'cart') AS b FROM typed),
{TAG_DOTS.format(key='page_id', table='struct')},
cand AS (SELECT pair.a, pair.b, (SELECT sum(u.n * v.n) FROM long_counts u JOIN long_counts v
    ON u.tag = v.tag WHERE u.k = pair.a AND v.k = pair.b) / (p.len * q.len) AS tag_sim,
    css_sim, form_sim, pattern_sim
  FROM pair JOIN (SELECT x.page_id AS xa, y.page_id AS yb, {pair_terms('x', 'y')}
    FROM pair JOIN struct x ON x.page_id = pair.a JOIN struct y ON y.page_id = pair.b) t
    ON t.xa = pair.a AND t.yb = pair.b
  JOIN lengths p ON p.k = pair.a JOIN lengths q ON q.k = pair.b),
pairs AS (SELECT a, b FROM cand UNION ALL SELECT b, a FROM cand),
{ratio_sql('pairs', 'struct', 'page_id')}
SELECT c.a, c.b, round(tag_sim, 9) AS tag_sim, round(css_sim, 9) AS css_sim,
  round(form_sim, 9) AS form_sim, round(pattern_sim, 9) AS pattern_sim, {SCORES}
FROM cand c {BOTH_RATIOS}""",
    "site_coverage": f"""WITH {STRUCTURAL_VECTORS},{VISUAL_VECTORS},{COMBINED_VECTORS},
rows AS ({' UNION ALL '.join(
        f"SELECT '{lens}' AS lens, n AS vectors, {big(dim)} AS dimension, "
        f"round(total / (n * n), 6) AS mean_full, "
        f"round((total - nz) / (n * (n - 1)), 6) AS mean_upper FROM {mean_sql(lens)}"
        for lens, dim in (('structural', 28), ('visual', 64), ('combined', 92)))})
SELECT *, (SELECT count(*) FROM pages) AS total_pages FROM rows""",
    "feature_sample": f"""WITH RECURSIVE {tree(GIVEN)},
sized AS (SELECT page_id, count(DISTINCT tag) AS unique_tags,
    {big("count(DISTINCT nullif(regexp_extract(tok, ' class=.([^ ]*).>', 1), ''))")}
      AS unique_classes, {tag_count('form')} AS form_count,
    max(depth) FILTER (WHERE pos < 100) AS max_depth FROM nodes GROUP BY page_id)
SELECT * FROM sized ORDER BY page_id LIMIT 3""",
    "similar_pair_summary": f"""WITH {STRUCTURAL_VECTORS},
{folded_pairs('structural', STRUCTURAL_LIMIT)}
SELECT {big('sum(page_pairs)')} AS pairs_above_limit,
  round(sum(similarity * page_pairs) / sum(page_pairs), 6) AS mean_above_limit,
  (SELECT count(*) * (count(*) - 1) // 2 FROM structural) AS pairs_possible FROM alike""",
    "top_similar_pairs": f"""WITH {STRUCTURAL_VECTORS},
visual AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings
  JOIN pages ON page_id = vec_id),{COMBINED_VECTORS},
scored AS ({top_pairs_sql('structural')} UNION ALL {top_pairs_sql('visual')}
  UNION ALL {top_pairs_sql('combined')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lens ORDER BY s DESC, a, b) AS rank
  FROM scored)
SELECT lens, rank, a, b, round(s, 6) AS similarity, p.url AS url1, q.url AS url2
FROM ranked JOIN pages p ON p.page_id = a JOIN pages q ON q.page_id = b WHERE rank <= 10""",
    "principal_components": f"""WITH RECURSIVE {STRUCTURAL_VECTORS},
products AS (SELECT x.dim AS i, y.dim AS j, sum(x.value * y.value) AS c
  FROM scaled x JOIN scaled y USING (id) GROUP BY ALL),
rows AS (SELECT i, list(c ORDER BY j) AS row FROM products GROUP BY i),
mat AS (SELECT list(row ORDER BY i) AS m FROM rows),
{power_sql('first', 'mat')},
rest AS (SELECT list_transform(range(28), lambda i: list_transform(range(28), lambda j:
    m[i + 1][j + 1] - size * v[i + 1] * v[j + 1])) AS m FROM mat, first),
{power_sql('second', 'rest')}
SELECT id, round(list_dot_product(vector, f.v) * f.sign, 6) AS x,
  round(list_dot_product(vector, s.v) * s.sign, 6) AS y
FROM structural, first f, second s""",
    "metric_layout": f"""WITH RECURSIVE {VISUAL_VECTORS},
scored AS (SELECT x.id AS a, y.id AS b, round({cosine('x.vector', 'y.vector')}, 9) AS s
  FROM visual x JOIN visual y ON x.id <> y.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM scored),
edges AS (SELECT a, b, greatest(1 - s, 0) AS wanted FROM ranked WHERE rank <= 5),
ends AS (SELECT a AS id, b AS other, wanted FROM edges
  UNION ALL SELECT b, a, wanted FROM edges),
layout AS (
  SELECT 0 AS step, id, CAST('0x' || substr(md5('x' || id), 1, 6) AS UBIGINT) / 16777216 AS x,
    CAST('0x' || substr(md5('y' || id), 1, 6) AS UBIGINT) / 16777216 AS y
  FROM (SELECT DISTINCT id FROM ends)
  UNION ALL
  SELECT step + 1, id, x + sum((x - ox) * pull) / (2 * count(*)),
    y + sum((y - oy) * pull) / (2 * count(*))
  FROM (SELECT l.step, l.id, l.x, l.y, o.x AS ox, o.y AS oy,
      coalesce(e.wanted / nullif(sqrt((l.x - o.x) ** 2 + (l.y - o.y) ** 2), 0), 0) - 1 AS pull
    FROM layout l JOIN ends e ON e.id = l.id JOIN layout o ON o.id = e.other WHERE l.step < 10)
  GROUP BY step, id, x, y)
SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM layout WHERE step = 10""",
    "nearest_neighbours": f"""WITH {VISUAL_VECTORS},
scored AS (SELECT x.id, y.id AS neighbour, round({cosine('x.vector', 'y.vector')}, 9) AS s
  FROM visual x JOIN visual y ON x.id <> y.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS rank
  FROM scored)
SELECT id, neighbour, round(s, 6) AS similarity, rank FROM ranked WHERE rank <= 15""",
    "neighbour_index_recall": """SELECT count(*) AS queries,
  CAST(count(*) * least(15, (SELECT count(*) - 1 FROM embeddings)) AS BIGINT) AS neighbours,
  true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0""",
    "seen_urls": f"WITH {REQUESTS} SELECT DISTINCT url FROM reqs",
    "last_request_per_url": f"""WITH {REQUESTS}
SELECT url, arg_max(method, ts) AS method, arg_max(cookie, ts) AS cookie, max(ts) AS ts
FROM reqs GROUP BY url""",
    "last_cookies": f"""WITH {REQUESTS},
src AS (SELECT row_number() OVER () AS rid, * FROM reqs
  WHERE status = 200 AND contains(url, 'example.net')),
{COOKIE_ROWS.format(key='rid', cookie='cookie', table='src')},
timed AS (SELECT name, value, ts FROM crumbs JOIN src USING (rid))
SELECT name, arg_max(value, ts) AS value, max(ts) AS ts FROM timed GROUP BY name""",
    "streamed_last_values": """SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type,
  arg_max(value, ts) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id""",
    "streamed_seen_urls": f"SELECT DISTINCT {HOST} AS host FROM pages",
    "streamed_page_intake": INTAKE,
    "streamed_html_folder": INTAKE,
    "throttled_page_intake": f"""WITH {source(GIVEN)}
SELECT count(*) AS pages, true AS pauses_kept FROM texts WHERE {clean_text('t')} <> ''""",
    "html_folder_pages": """SELECT page_id, length(h) AS chars, md5(h) AS digest
FROM (SELECT page_id, regexp_replace(html, '\r\n?', chr(10), 'g') AS h FROM pages)""",
}
