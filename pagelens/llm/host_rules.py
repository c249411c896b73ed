"""Host-level quality rules.

Every text is held against rules of its own (too short, repeated word windows, symbols,
repeated lines, odd word lengths). Failures are added up by host, the rates are shrunk
towards the corpus with a beta prior fitted to the hosts themselves, and the verdict on a
host comes back to its documents: on a host that fails too often a text must pass every
rule, elsewhere only the base ones.

Only built-in functions are used. Null text counts as empty, null host is a host of its
own, repeated rows count each time, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.barrier import settled
from pagelens.llm.common import words
from pagelens.session import small_side

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
WORD_LENGTH = (2, 12)
HOST_LIMIT = 0.5
RULES = ["short", "repeats", "symbols", "lines", "lengths"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _window_hashes(count: str, tokens: str) -> Column:
    """Hash of each window of words. Elements are taken one by one: a slice would copy the
    whole array for every window."""
    return F.when(
        F.col(count) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.col(count) - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col(tokens), i + j) for j in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<long>"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add a struct column `measured` with the measures and n_lines to the rows of `docs`.

    Words of repeated windows: hashes with their places are sorted (only in texts where a
    hash occurs twice), neighbours of equal hash mark places, and the places in order give
    the length of the union of their windows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumns(
        {
            "__words": words(F.col(text)),
            "__lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "__symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    step = step.withColumn("__n", F.size("__words"))
    step = step.withColumn("__hashes", _window_hashes("__n", "__words"))
    step = step.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__hashes")) < F.size("__hashes"),
            F.sort_array(
                F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
            ),
        ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")),
    )
    step = step.withColumn(
        "__places",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        "__sorted",
                        lambda x, i: F.struct(
                            x["at"].alias("at"),
                            (
                                F.coalesce(F.get("__sorted", i - 1)["h"] == x["h"], F.lit(False))
                                | F.coalesce(F.get("__sorted", i + 1)["h"] == x["h"], F.lit(False))
                            ).alias("twice"),
                        ),
                    ),
                    lambda x: x["twice"],
                ),
                lambda x: x["at"],
            )
        ),
    )
    repeated = F.aggregate(
        F.transform(
            "__places",
            lambda at, i: F.least(
                F.lit(WINDOW), F.coalesce(F.get("__places", i + 1) - at, F.lit(WINDOW))
            ),
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    measured = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )
    return step.select(*docs.columns, settled(measured).alias("measured"))


def failures(m: Column) -> dict[str, Column]:
    """Which rules a text fails, by the name of the rule. Integer arithmetic only."""
    n = m["n_words"]
    low, high = WORD_LENGTH
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * n,
        "symbols": 100 * m["n_symbols"] > MAX_SYMBOL_PERCENT * n,
        "lines": 100 * m["n_dup_lines"] > MAX_DUP_LINE_PERCENT * m["n_lines"],
        "lengths": (m["word_chars"] < low * n) | (m["word_chars"] > high * n),
    }


def base_failed(m: Column) -> Column:
    failed = failures(m)
    return failed["short"] | failed["repeats"]


def any_failed(m: Column) -> Column:
    result = F.lit(False)
    for rule in failures(m).values():
        result = result | rule
    return result


def host_table(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, failures by rule, raw and shrunken rate, and verdict.

    The prior's mean and strength come from the mean and variance of the hosts' rates
    (method of moments). Where they vary less than chance alone makes them, or there is
    one host, the strength is that of the average host.
    """
    m = F.col("measured")
    counts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(any_failed(m).cast("long")).alias("n_failed"),
        *[F.sum(rule.cast("long")).alias(f"n_{name}") for name, rule in failures(m).items()],
    )
    rate = F.col("n_failed") / F.col("n_docs")
    moments = counts.agg(
        F.avg(rate).alias("mean"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("var"),
        F.avg(F.col("n_docs").cast("double")).alias("size"),
    )
    spread = F.col("mean") * (1 - F.col("mean"))
    strength = F.when(
        (F.col("var") > 0) & (spread / F.col("var") - 1 > 0), spread / F.col("var") - 1
    ).otherwise(F.col("size"))
    prior = moments.select("mean", F.least(strength, F.col("size")).alias("strength"))
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (
        F.col("n_docs") + F.col("strength")
    )
    return (
        counts.crossJoin(F.broadcast(prior))  # one row
        .withColumn("rate", rate)
        .withColumn("shrunk_rate", shrunk)
        .withColumn("host_failed", F.col("shrunk_rate") > HOST_LIMIT)
        .drop("mean", "strength")
    )


def judge(measured: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Add `base_failed` and `kept` to measured rows."""
    failing = small_side(
        hosts.filter("host_failed").select(F.col("host").alias("__host")), "failing-hosts"
    )
    m = F.col("measured")
    joined = measured.join(
        failing.withColumn("__bad", F.lit(True)), F.col(host).eqNullSafe(F.col("__host")), "left"
    )
    failed = base_failed(m)
    bad = F.coalesce(F.col("__bad"), F.lit(False))
    return joined.withColumns(
        {
            "base_failed": failed,
            "kept": settled(~failed & ~(bad & any_failed(m))),
        }
    ).drop("__host", "__bad")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Rows of `docs` the rules keep, with the columns of `docs`.

    The host table needs a pass over the texts of its own; measures are computed again in
    the pass that filters, so that no copy of the texts is written or shuffled.
    """
    renamed = docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns])
    narrow = measure(
        renamed.select(F.col(f"in_{host}").alias("source"), F.col(f"in_{text}").alias("text"))
    )
    hosts = host_table(narrow)
    judged = judge(measure(renamed, f"in_{text}"), hosts, f"in_{host}")
    return judged.filter("kept").select(
        *[F.col(f"in_{c}").alias(c) for c in docs.columns]
    )
