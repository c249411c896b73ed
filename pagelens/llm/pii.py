"""Personal data by weak supervision.

Candidate spans of each kind come from wide patterns. Labelers (strict pattern, checksum
and shape, gazetteer, cue words before the span) vote on each candidate or abstain.
Expectation-maximisation over the counted vote patterns estimates how reliable each
labeler is and how probable each pattern is to be personal data; a logistic classifier on
features of the span itself is then trained on these probabilities and decides. Spans of
the base patterns always stay; the classifier adds others.

Only built-in functions are used on the data. What reaches the driver are counts by kind,
vote pattern and feature pattern: at most len(KINDS) * 3**4 * 2**5 rows, whatever the input.

Null text counts as empty. Repeated rows are treated alike. An empty table gives an empty
result. Within one text the work is linear, but for the copying of span lists, which is a
copy of references per span.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.barrier import settled

# Base kinds, in the order of the contract, then the kinds the method adds.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret", "id"]
LEFT = 32  # characters of context before a span

# The patterns as defined, written so that no text makes them run in quadratic time or
# deep recursion: possessive repeats, and starts only where a run of the class starts.
BASE_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A cheap test that must hold for a base match to exist.
BASE_GUARD = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
# Wider candidates: written-out addresses, national phone numbers, keys and passwords,
# identity numbers.
WIDE_PATTERN = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?"
    r"[A-Za-z0-9-]++(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?:(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))"
    r"|(?:(?i)(?:password|passwd|token|secret|api[_-]?key)[ ]?[=:][ ]?\"?[A-Za-z0-9+/_-]{6,}+\"?)",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
WIDE_GUARD = {
    "email": r"[\[(](?:at|AT)[\])]",
    "phone": r"[0-9][ .-][0-9]{4}",
    "secret": r"AKIA|ASIA|[=:] ?\"?[A-Za-z0-9+/_-]{6}",
    "id": r"[0-9]-[0-9]{2}-[0-9]",
}
# Gazetteers: known endings, calling codes, issuer digits, key words.
GAZETTEER = {
    "email": r"(?i)[. ](?:com|org|net|edu|gov|info|io|de|fr|es|uk)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])",
    "phone": r"^(?:\+(?:1|33|34|44|49)|\(?[2-9])",
    "secret": r"^(?:AKIA|ASIA|(?i:password|passwd|token|secret|api))",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)",
}
AGAINST = {
    "email": r"(?i)\.(?:png|jpg|gif|css|js)$",
    "ip": r"^(?:0|127|255)\.",
    "card": r"^0",
    "phone": r"^\(?[01]",
    "secret": r"(?i)(?:example|changeme|xxxx)",
    "id": r"^(?:000|666|9)|-00-",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write to|correo|courriel)\W*$",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr)\W*$",
    "card": r"(?i)(?:card|visa|credit|karte|tarjeta|carte)\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon)\W*$",
    "secret": r"(?i)(?:key|login|aws|auth|credential|user)\W*$",
    "id": r"(?i)(?:ssn|social|id|passport|tax)\W*$",
}
WRONG_CUES = r"(?i)(?:version|\bv|isbn|order|invoice|section|figure|no\.)\W*$"

EMPTY = "array<struct<kind:int,start:int,stop:int,base:boolean,match:string,before:string>>"


def _found(text: Column, kind: str, pattern: str, guard: str, base: bool) -> Column:
    """Matches with their places in code points. The pieces between the matches and the
    matches themselves, in turn, add up to the text."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))
    number = KINDS.index(kind)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["match"])
        span = F.struct(
            F.lit(number).alias("kind"),
            start.alias("start"),
            stop.alias("stop"),
            F.lit(base).alias("base"),
            pair["match"].alias("match"),
            F.right(pair["gap"], F.lit(LEFT)).alias("before"),
        )
        return F.when(
            pair["match"].isNotNull(),
            F.struct(stop.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans")),
        ).otherwise(state)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("spans"))
    spans = F.aggregate(pairs, zero, step, lambda state: state["spans"])
    return F.when(text.rlike(guard), spans).otherwise(F.array().cast(EMPTY))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits (at most a card's 19) pass the Luhn check."""
    each = F.split(F.reverse(_digits(match)), "")
    worth = F.transform(
        each,
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(worth, F.lit(0), lambda total, x: total + x) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `spans`: base spans that pass their checks, and wider candidates that touch no
    base span, as an array of structs."""
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("__body", body)
    step = step.withColumns(
        {f"__{k}": _found(F.col("__body"), k, BASE_PATTERN[k], BASE_GUARD[k], True) for k in BASE_KINDS}
    )
    step = step.withColumns(
        {
            f"__w_{k}": _found(F.col("__body"), k, p, WIDE_GUARD[k], False)
            for k, p in WIDE_PATTERN.items()
        }
    )

    def checked(kind: str) -> Column:
        return F.filter(f"__{kind}", lambda s: _passes(kind, s["match"]))

    passed = [checked(kind) for kind in BASE_KINDS]
    step = step.withColumn("__base", F.concat(*passed))
    wide = F.filter(
        F.concat(*[F.col(f"__w_{k}") for k in WIDE_PATTERN]),
        lambda s: ~F.exists("__base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )
    return step.select(*docs.columns, settled(F.concat("__base", wide)).alias("spans"))


# -- votes, features ---------------------------------------------------------------


def _by_kind(span: Column, table: dict[str, str], value: Column) -> Column:
    result = F.lit(False)
    for kind, pattern in table.items():
        result = F.when(span["kind"] == KINDS.index(kind), value.rlike(pattern)).otherwise(result)
    return result


def votes(span: Column) -> Column:
    """Votes of the four labelers as one number in base 3 (0 abstains, 1 for, 2 against)."""
    match, before, kind = span["match"], span["before"], span["kind"]
    count = F.length(_digits(match))
    strict = F.when(span["base"], 1).when(kind >= len(BASE_KINDS), 1).otherwise(0)
    shape = (
        F.when(kind == KINDS.index("card"), F.when(count == 16, 1).otherwise(0))
        .when(kind == KINDS.index("phone"), F.when(count.between(10, 12), 1).otherwise(2))
        .when(kind == KINDS.index("secret"), F.when(match.rlike("[0-9]"), 1).otherwise(2))
        .when(kind == KINDS.index("id"), F.when(match.rlike(r"-0000$"), 2).otherwise(0))
        .otherwise(0)
    )
    listed = F.when(_by_kind(span, AGAINST, match), 2).when(
        _by_kind(span, GAZETTEER, match), 1
    ).otherwise(0)
    context = F.when(before.rlike(WRONG_CUES), 2).when(
        _by_kind(span, CUES, before), 1
    ).otherwise(0)
    return strict + 3 * shape + 9 * listed + 27 * context


def features(span: Column) -> Column:
    """Five features of the span itself as one number in base 2."""
    match = span["match"]
    size = F.length(match)
    flags = [
        match.rlike("[0-9]"),
        match.rlike("[A-Za-z]"),
        match.rlike(r"[ ().\[\]-]"),
        size >= 16,
        F.length(_digits(match)) * 2 >= size,
    ]
    return reduce(lambda a, b: a + b, [f.cast("int") * (1 << i) for i, f in enumerate(flags)])


N_VOTES, N_FEATURES = 4, 5


def estimate(patterns: list[tuple[int, int, int]], rounds: int = 50) -> dict[tuple[int, int], float]:
    """(kind, votes) -> probability of personal data, from (kind, votes, count).

    Two classes; each labeler votes by itself given the class, with a table of its own per
    kind. The start favours labelers that are better than chance; counts are smoothed."""
    result = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = sorted((v, n) for k, v, n in patterns if k == kind)
        total = sum(n for _, n in own)
        split = {v: [(v // 3**j) % 3 for j in range(N_VOTES)] for v, _ in own}
        rate = 0.5
        table = [[[0.5, 0.3, 0.2], [0.5, 0.2, 0.3]] for _ in range(N_VOTES)]
        chance: dict[int, float] = {}
        for _ in range(rounds):
            for v, _n in own:
                yes, no = math.log(rate), math.log(1 - rate)
                for j, vote in enumerate(split[v]):
                    if vote:
                        yes += math.log(table[j][0][vote])
                        no += math.log(table[j][1][vote])
                chance[v] = 1 / (1 + math.exp(min(700, no - yes)))
            rate = min(0.999, max(0.001, (1 + sum(n * chance[v] for v, n in own)) / (2 + total)))
            for j in range(N_VOTES):
                for side in (0, 1):
                    weight = [2 * x for x in ((0.5, 0.3, 0.2), (0.5, 0.2, 0.3))[side]]
                    for v, n in own:
                        weight[split[v][j]] += n * (chance[v] if side == 0 else 1 - chance[v])
                    table[j][side] = [w / sum(weight) for w in weight]
        result |= {(kind, v): chance[v] for v, _ in own}
    return result


def train(counts: list[tuple[int, int, int, int]], chance: dict[tuple[int, int], float],
          rounds: int = 200, step: float = 0.5) -> dict[tuple[int, int], float]:
    """(kind, features) -> probability, by logistic regression per kind on the estimated
    probabilities, with an L2 penalty, from (kind, votes, features, count)."""
    result = {}
    for kind in sorted({c[0] for c in counts}):
        soft: dict[int, list[float]] = {}
        for k, v, f, n in sorted(counts):
            if k == kind:
                cell = soft.setdefault(f, [0.0, 0.0])
                cell[0] += n * chance[(k, v)]
                cell[1] += n
        total = sum(n for _, n in soft.values())
        rows = {f: [1.0, *[float(f >> i & 1) for i in range(N_FEATURES)]] for f in soft}
        w = [0.0] * (N_FEATURES + 1)
        for _ in range(rounds):
            slope = [1e-3 * x for x in w]
            for f, (hits, n) in soft.items():
                p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, rows[f], strict=True))))
                for i, x in enumerate(rows[f]):
                    slope[i] += (n * p - hits) * x / total
            w = [a - step * b for a, b in zip(w, slope, strict=True)]
        for f, row in rows.items():
            z = sum(a * b for a, b in zip(w, row, strict=True))
            result[(kind, f)] = 1 / (1 + math.exp(-z))
    return result


def fit(found: DataFrame) -> list[int]:
    """Codes kind * 2**5 + features the trained classifier takes for personal data."""
    span = F.col("span")
    counted = (
        found.select(F.explode("spans").alias("span"))
        .select(span["kind"].alias("kind"), votes(span).alias("votes"), features(span).alias("features"))
        .groupBy("kind", "votes", "features")
        .count()
    )
    rows = [tuple(r) for r in counted.collect()]  # at most 6 * 81 * 32
    tally: dict[tuple[int, int], int] = {}
    for kind, vote, _, n in rows:
        tally[(kind, vote)] = tally.get((kind, vote), 0) + n
    chance = estimate([(k, v, n) for (k, v), n in tally.items()])
    trained = train(rows, chance)
    return sorted(k * 2**N_FEATURES + f for (k, f), p in trained.items() if p >= 0.5)


def decide(found: DataFrame, codes: list[int]) -> DataFrame:
    """Keep base spans and those the classifier takes, in the order of kind and place."""
    kept = F.filter(
        "spans",
        lambda s: s["base"] | (s["kind"] * 2**N_FEATURES + features(s)).isin(codes or [-1]),
    )
    return found.withColumn("spans", F.array_sort(kept))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the
    first by place, then the longest, is replaced and the others up to its end with it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"], (-s["stop"]).alias("back"), s["kind"]))
    )

    def step(state: Column, s: Column) -> Column:
        piece = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return (
            F.when(
                s["start"] >= state["at"],
                F.struct(
                    (-s["back"]).alias("at"),
                    F.concat(state["out"], piece, F.get(names, s["kind"])).alias("out"),
                ),
            )
            .when(
                -s["back"] > state["at"],
                F.struct((-s["back"]).alias("at"), state["out"].alias("out")),
            )
            .otherwise(state)
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        ordered,
        zero,
        step,
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `docs` with every span replaced by its kind; n_chars, where it is a column,
    follows the new text. Texts without spans, null ones too, stay as they are."""
    renamed = docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns])
    body = f"in_{text}"
    decided = decide(find(renamed, body), fit(find(renamed.select(body), body)))
    touched = F.size("spans") > 0
    fresh = F.when(touched, redacted(F.coalesce(F.col(body), F.lit("")), F.col("spans")))
    columns = decided.withColumn("__new", fresh.otherwise(F.col(body)))
    out = {c: F.col(f"in_{c}") for c in docs.columns} | {text: F.col("__new")}
    if "n_chars" in out:
        out["n_chars"] = F.when(touched, F.length("__new").cast("long")).otherwise(F.col("in_n_chars"))
    return columns.select(*[column.alias(c) for c, column in out.items()])
