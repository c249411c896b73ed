"""One-permutation MinHash fingerprints.

The shingles of a text are hashed once. The top bits of a hash name its bin, each bin keeps
its least hash. Bins no shingle falls into are filled by optimal densification: each empty
bin takes the bins in a random order of its own, the same for all texts, and borrows the
value of the first that is not empty. The low-order bits of the values are packed into a
hexadecimal string; likeness is the share of equal places, corrected for places that agree
by chance.

Only built-in functions are used. Texts are compared in lower case. Null, empty and blank
texts have no shingles and the empty fingerprint: likeness 1 to each other, 0 to others.
Texts of fewer words than a shingle are one shingle. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.barrier import settled
from pagelens.llm.common import words

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8


def _bin(value: Column) -> Column:
    """Top bits of a hash, rising with it."""
    return F.shiftright(value, 64 - BIN_BITS) + (BINS // 2)


def add_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the array of low-order values by bin (empty for texts without words).

    In sorted order the hashes of a bin stand together, so the least of each bin is where
    the bin number changes."""
    keep = df.columns
    step = df.withColumn("__w", words(F.lower(F.col(text)))).withColumn("__n", F.size("__w"))
    hashes = (
        F.when(
            F.col("__n") >= SHINGLE,
            F.transform(
                F.sequence(F.lit(0), F.col("__n") - SHINGLE),
                lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(SHINGLE)]),
            ),
        )
        .when(F.col("__n") > 0, F.array(F.xxhash64("__w")))
        .otherwise(F.array().cast("array<long>"))
    )
    step = step.withColumn("__sorted", F.sort_array(hashes)).drop("__w", "__n")
    step = step.withColumn(
        "__least",
        F.filter(
            "__sorted",
            lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("__sorted", i - 1))),
        ),
    ).drop("__sorted")
    step = step.withColumn("__bins", F.transform("__least", lambda x: _bin(x).cast("int")))
    step = step.withColumn(
        "__values", F.transform("__least", lambda x: x.bitwiseAND((1 << LOW_BITS) - 1).cast("int"))
    ).drop("__least")

    def borrowed(j: Column) -> Column:
        order = F.transform(
            "__bins",
            lambda b, i: F.struct(F.xxhash64(j, b).alias("h"), F.get("__values", i).alias("v")),
        )
        return F.array_min(order)["v"]

    def place(j: Column) -> Column:
        at = F.array_position("__bins", j).cast("int")
        return F.coalesce(F.get("__values", at - 1), borrowed(j))

    dense = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), place)
    signature = (
        F.when(F.size("__bins") == 0, F.array().cast("array<int>"))
        .when(F.size("__bins") == BINS, F.col("__values"))
        .otherwise(dense)
    )
    return step.withColumn(out, settled(signature)).select(*keep, out)


def packed(signature: Column) -> Column:
    """The low-order bits as lowercase hexadecimal digits."""
    digits = F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), LOW_BITS // 4, "0"))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1: equal places beyond those that agree by chance."""
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)),
        F.lit(0),
        lambda total, x: total + x,
    )
    chance = 1 / (1 << LOW_BITS)
    corrected = (same / BINS - chance) / (1 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.greatest(F.lit(0.0), corrected))
    )


def with_next(df: DataFrame, key: str, carried: list[str], tie: str) -> DataFrame:
    """Add next_<column> for each carried column: its value in the row that follows in
    ascending order of `key` (null first, then by `tie`), after the last row the first.

    Rows go to ranges of keys whose first keys are keys of the table, so that the row that
    follows the last of a range is a first row of the next; a copy of these first rows goes
    to the range before. One shuffle, and no task has more than its ranges."""
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__key", F.coalesce(F.col(key), F.lit(-(1 << 63)).cast("long")))
    found = keyed.agg(
        F.min("__key").alias("least"),
        F.percentile_approx(
            "__key", [i / parts for i in range(1, parts)], max(10_000, 10 * parts)
        ).alias("inner"),
    ).first()
    if found["least"] is None:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    bounds = sorted({found["least"], *found["inner"]})
    table = F.array(*[F.lit(b) for b in bounds])
    halvings = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        at_or_before = F.get(table, middle) <= F.col("__key")
        return F.struct(
            F.when(at_or_before, middle).otherwise(state["low"]).alias("low"),
            F.when(at_or_before, state["high"]).otherwise(middle).alias("high"),
        )

    zero = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    keyed = keyed.withColumn("__range", F.aggregate(halvings, zero, halve, lambda s: s["low"]))
    own = F.struct(F.col("__range").alias("range"), F.lit(False).alias("copy"))
    before = F.struct(
        F.pmod(F.col("__range") - 1, F.lit(len(bounds))).cast("int").alias("range"),
        F.lit(True).alias("copy"),
    )
    places = F.when(F.get(table, F.col("__range")) == F.col("__key"), F.array(own, before))
    dealt = keyed.withColumn("__place", F.explode(places.otherwise(F.array(own))))
    order = Window.partitionBy("__place.range").orderBy("__place.copy", "__key", tie)
    nexts = {f"next_{c}": F.lead(c).over(order) for c in carried}
    return (
        dealt.withColumns(nexts)
        .filter(~F.col("__place.copy"))
        .drop("__key", "__range", "__place")
    )
