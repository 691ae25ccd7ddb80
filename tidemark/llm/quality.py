"""Quality rules: rule failures of documents, shrunken failure rates of hosts, and verdicts of both.

RULES are conditions on a document's measures. A host (here: the source of documents) fails each rule at
the rate of its documents, shrunk towards the corpus by that rule's own beta prior, whose mean and
strength come from the hosts' rates by the method of moments. A host of which one rule's shrunken rate is
over MAX_RATE is rejected with all its documents. Only built-in functions are used, and texts are never
shuffled.

Null and empty texts have no words and so fail. A null host is a host of its own. Rows are never merged,
and a null id changes nothing. An empty table gives an empty one. Further columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._tables import written

#: Rejects a host of whose documents more than this share would fail a rule.
MAX_RATE = 0.5
MIN_WORDS = 50
#: Rules by name: SQL conditions on the measures. The first two are the base rules, which reject a document by themselves.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "n_dup_lines > 0 AND 10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
}
BASE_RULES = ("few_words", "repeats")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BLANK = " \t\n\x0b\f\r"
_BLANK_CLASS = r"[ \t\n\x0B\f\r]"
_NO_PLACES = "array<int>"


def _words(text: Column) -> Column:
    trimmed = F.call_function("btrim", text, F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK_CLASS + "+"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and MEASURES, with n_lines, of docs (doc_id, host, text).

    Words in repeated windows are found by sorting (hash of the window, position) within each text, for
    the few texts whose windows are not all different. Windows are compared by 64-bit hashes within one text.
    """
    keep = ["doc_id", "host"]
    raw = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
    out = docs.select(*keep, raw.alias("raw"), _words(raw).alias("words"), lines.alias("lines"))
    out = out.select(
        *keep, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("raw", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "words",
    )
    # The hash of three neighbouring words by index; texts of fewer words have none.
    out = out.withColumn("hash", F.transform("words", lambda w: F.xxhash64(w)))
    at = F.when(F.size("hash") > 2, F.sequence(F.lit(1), F.size("hash") - 2)).otherwise(F.array().cast(_NO_PLACES))
    out = out.withColumn("window", F.transform(at, lambda i: F.xxhash64(F.element_at("hash", i), F.element_at("hash", i + 1), F.element_at("hash", i + 2))))
    all_new = F.size(F.array_distinct("window")) == F.size("window")
    out = out.withColumn("window", F.when(all_new, F.array().cast("array<bigint>")).otherwise(F.col("window")))
    out = out.withColumn("sorted", F.array_sort(F.transform("window", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def neighbours(column: str, make) -> Column:
        more = F.greatest(F.size(column) - 1, F.lit(0))
        return F.zip_with(F.slice(column, F.lit(1), more), F.slice(column, F.lit(2), more), make)

    near = neighbours("sorted", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast(_NO_PLACES)))
    out = out.withColumn("places", F.array_sort(F.array_distinct(F.flatten(near))))
    gaps = neighbours("places", lambda a, b: F.least(b - a, F.lit(3)))
    repeat = F.aggregate(gaps, F.when(F.size("places") > 0, F.lit(3)).otherwise(F.lit(0)), lambda total, gap: total + gap).cast("long")
    return out.select(*keep, *MEASURES[:4], repeat.alias("n_repeat_words"), "n_lines")


def host_rates(judged: DataFrame, rules: Sequence[str]) -> DataFrame:
    """(host, n, and for each rule its shrunken failure rate) from rows with host and a boolean column for each rule."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(F.col(r)).alias(r) for r in rules))
    hosts = written(hosts, "hosts")  # one small row for each host
    out = hosts
    for r in rules:
        share = F.col(r) / F.col("n")
        prior = hosts.agg((F.sum(r) / F.sum("n")).alias("mean"), F.var_pop(share).alias("var"), F.avg(1 / F.col("n")).alias("noise"))
        # The variance between hosts is what chance within hosts does not explain; strength = mean (1 - mean) / between - 1.
        spread = F.col("mean") * (1 - F.col("mean"))
        between = F.greatest(F.col("var") - spread * F.col("noise"), F.lit(1e-6))
        prior = prior.select("mean", F.greatest(spread / between - 1, F.lit(1.0)).alias("strength"))
        mean, strength = prior.select("mean").scalar(), prior.select("strength").scalar()
        out = out.withColumn(r, (F.col(r) + mean * strength) / (F.col("n") + strength))
    return out


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Of every row of docs (doc_id, source, text): doc_id, host, measures, a column for each rule (true: failed), base_failed, and kept.

    kept: neither its own base rules nor its host rejects it.
    """
    judged = measures(docs.select("doc_id", F.col("source").alias("host"), "text"))
    judged = written(judged.withColumns({r: F.expr(rule) for r, rule in RULES.items()}), "quality")
    rates = host_rates(judged, tuple(RULES))
    bad = rates.where(F.greatest(*RULES) > MAX_RATE).select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    out = judged.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    failed = F.greatest(*BASE_RULES)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("bad").isNull()).drop("bad_host", "bad")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its measures and verdict."""
    out = quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *MEASURES, "base_failed", "kept")


_RATES = ", ".join(
    f"(sum({r}) OVER () / sum(n) OVER ()) AS mean_{r}, var_pop({r} / n) OVER () AS var_{r}" for r in RULES
)
_STRENGTHS = ", ".join(f"greatest(mean_{r} * (1 - mean_{r}) / greatest(var_{r} - mean_{r} * (1 - mean_{r}) * noise, 1e-6) - 1, 1.0) AS strength_{r}" for r in RULES)
_BAD = " OR ".join(f"({r} + mean_{r} * strength_{r}) / (n + strength_{r}) > {MAX_RATE}" for r in RULES)
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK_CLASS}+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines, 0) AS n_lines, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, {", ".join(f"({rule}) AS {r}" for r, rule in RULES.items())} FROM m),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"(count(*) FILTER ({r}))::DOUBLE AS {r}" for r in RULES)} FROM j GROUP BY source),
moments AS (SELECT *, avg(1 / n) OVER () AS noise, {_RATES} FROM hosts),
prior AS (SELECT *, {_STRENGTHS} FROM moments),
bad AS (SELECT source FROM prior WHERE {_BAD})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
    NOT (few_words OR repeats) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM j.source) AS kept FROM j"""
