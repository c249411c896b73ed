"""The registered queries of the operators, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import (
    archives,
    bin_completion,
    fill_in_middle,
    golay,
    host_rules,
    mixing,
    nbsvm,
    oph,
    packing,
    paragraphs,
    periodic,
    pii,
    toxicity,
)
from pagelens.llm.common import is_training_row, table, words
from pagelens.session import ship_package, written

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    LLM_QUERIES[function.__name__] = run
    return run


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii")
    decided = pii.decide(found, pii.fit(found))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])

    def count(number: int, kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    counts = [count(number, kind) for number, kind in enumerate(pii.BASE_KINDS)]
    return decided.select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
    )


@query
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = written(host_rules.measure(docs).drop("text"), "measured")
    judged = host_rules.judge(measured, host_rules.host_table(measured))
    return judged.select(
        "doc_id", *[f"measured.{m}" for m in host_rules.MEASURES], "base_failed", "kept"
    )


@query
def op2_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).drop("ids")


@query
def op3_golay_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = golay.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_links",
    )


@query
def op4_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"), "quality")
    return nbsvm.scored(docs, model).select(
        "doc_id",
        (~is_training_row()).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op6_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    signed = oph.add_signature(docs, "text", "own")
    paired = oph.with_next(signed, "doc_id", ["text", "own"], "text")
    n = F.length("text")
    paired = paired.withColumn("n_chars", n.cast("long")).withColumn(
        "edited",
        F.concat(
            F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")),
            F.substring(F.col("next_text"), F.lit(1), F.floor(n / 4).cast("int")),
        ),
    )
    compared = oph.add_signature(paired, "edited", "changed")
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        oph.packed(F.col("own")).alias("fingerprint"),
        oph.packed(F.col("changed")).alias("edited_fingerprint"),
        oph.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        oph.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


@query
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        (~is_training_row()).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_terms",
    )


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find(docs.select("doc_id", _with_periodic_end().alias("text")))
    best = F.array_sort(
        "runs",
        lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], -1)
        .when(x["length"] * y["period"] < y["length"] * x["period"], 1)
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .otherwise(F.when(x["period"] < y["period"], -1).otherwise(1)),
    )
    line = F.transform(
        "runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    )
    listed = F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n"))))
    return found.withColumn("best", F.try_element_at(best, F.lit(1))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _with_periodic_end() -> Column:
    """One text in ten made periodic from one of its words on, as the crc32 of its id says;
    a null id has none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    listed = words(F.col("text"))
    n = F.size(listed)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    end = F.slice(F.flatten(F.array_repeat(F.slice(listed, a + 1, p), times)), 1, n - a)
    changed = F.array_join(F.concat(F.slice(listed, 1, a), end), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col("text"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


@query
def op13_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.packed(table(spark, sf_dir, "documents")).drop("ids")


LLM_ORACLES["op5_host_rules"] = r"""
WITH body AS (SELECT doc_id, source, coalesce(text, '') AS b FROM documents),
split AS (SELECT doc_id, source, b,
    list_filter(string_split_regex(b, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM body),
windows AS (SELECT doc_id, i, ws[i + 1:i + 8] AS k
  FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 7, 0))) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c
  FROM windows) WHERE c > 1),
gaps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g
  FROM twice),
covered AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS r FROM gaps GROUP BY doc_id),
m AS (SELECT s.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(b) - length(regexp_replace(b, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(r, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words
      OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words
      AS any_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE any_failed) AS k FROM f GROUP BY source),
prior AS (SELECT avg(k / n) AS mean, coalesce(var_pop(k / n), 0) AS v, avg(n) AS size FROM h),
strength AS (SELECT mean, least(size, CASE WHEN v > 0 AND mean * (1 - mean) / v - 1 > 0
  THEN mean * (1 - mean) / v - 1 ELSE size END) AS w FROM prior),
bad AS (SELECT source FROM h, strength WHERE (k + mean * w) / (n + w) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (any_failed AND EXISTS (
    SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source)) AS kept
FROM f"""


LLM_ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us,
    list_transform([1, 9, 17, 25], lambda i: list_reduce(list_transform(range(8), lambda j:
      CAST(strpos('0123456789abcdef', substr(x, CAST(i + j AS BIGINT), 1)) - 1 AS BIGINT)),
      lambda a, b: 16 * a + b)) AS hs FROM d),
f AS (SELECT doc_id, t, us, len(us) AS n,
    least(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS a,
    greatest(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
      OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS pre,
    coalesce(array_to_string(us[a + 1:b], ''), '') AS mid,
    coalesce(array_to_string(us[b + 1:n], ''), '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
