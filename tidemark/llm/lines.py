"""Line deduplication: lines that many sites share, by the spread of distinct sites.

For each line, named by its hash, a HyperLogLog sketch of the sites that have it is merged by
aggregation. Lines whose estimate is near the threshold get exact distinct counts, and those on
`min_spread` sites or more are boilerplate and go from every text, whatever their length.

With `spare`, texts of which boilerplate lines hold more than that share of the characters stay as
they are: such a text is a copy of a page that circulates as a whole, which is for near-duplicate
removal to judge. Without it every boilerplate line goes.

A line ends at a line feed; blanks around it don't count, and lines without a word are left alone. A
null text stays null and has no lines; a null site is a site of its own. Repeated rows are rows like
any other. A text may be left empty; its row stays. An empty table gives an empty one. Further columns
stay as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._tables import free_name, row_key, written

MIN_SPREAD = 5
#: Used where near-duplicate removal follows.
SPARE = 0.5
LG_K = 10
#: Estimates within this share of the threshold are counted exactly: three standard errors of a sketch.
MARGIN = 3 * 1.04 / math.sqrt(1 << LG_K)
_BLANK = " \t\n\x0b\f\r"


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(k1, k2, pos, line, size, site): the row's key, the line's place, hash and characters, a row for each line with a word."""
    split = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.call_function("btrim", line, F.lit(_BLANK)))
    rows = docs.select(*row_key("doc_id", "text"), F.xxhash64(F.col(site)).alias("site"), F.posexplode(split).alias("pos", "text"))
    return rows.where("text <> ''").select("k1", "k2", "pos", F.xxhash64("text").alias("line"), F.length("text").alias("size"), "site")


def boilerplate(lines: DataFrame, min_spread: int = MIN_SPREAD) -> DataFrame:
    """The hashes of lines (line, site) on min_spread sites at least."""
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = written(spread.where(F.col("sites") >= math.floor(min_spread * (1 - MARGIN))), "line-spread")
    near = written(spread.where(F.col("sites") <= math.ceil(min_spread * (1 + MARGIN))).select("line"), "near-threshold")
    pairs = lines.select("line", "site").join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_spread)
    return exact.select("line").unionByName(spread.join(near, "line", "left_anti").select("line"))


def drop_boilerplate(docs: DataFrame, site: str = "source", min_spread: int = MIN_SPREAD, spare: float | None = None, marks: tuple[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text, site) with boilerplate lines taken out of the text; marks: names of columns for the counts of lines before and taken."""
    lines = written(_lines(docs, site), "lines")
    bad = written(boilerplate(lines, min_spread), "boilerplate")
    # Equal rows share a key and have the same lines, so sets of places are those of one text.
    gone = lines.join(bad, "line", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "size")).alias("gone"))
    k1, k2, taken, own = (free_name(docs, n) for n in ("k1_", "k2_", "gone_", "taken_"))
    out = docs.withColumns(dict(zip((k1, k2), row_key("doc_id", "text"), strict=True)))
    out = out.join(gone.select(*(F.col(a).alias(b) for a, b in (("k1", k1), ("k2", k2), ("gone", taken)))), [k1, k2], "left")
    split, none = F.split("text", "\n"), F.array().cast("array<int>")
    remove = F.coalesce(F.col(taken)["pos"], none)
    if spare is not None:
        whole = F.aggregate(split, F.lit(0), lambda total, line: total + F.length(F.call_function("btrim", line, F.lit(_BLANK))))
        common = F.aggregate(F.col(taken)["size"], F.lit(0), lambda total, size: total + size)
        remove = F.when(common > spare * whole, none).otherwise(remove)
    out = out.withColumn(own, remove)
    kept = F.filter(split, lambda line, i: ~F.array_contains(own, i))
    if marks:
        out = out.withColumns({marks[0]: F.coalesce(F.size(split), F.lit(0)).cast("long"), marks[1]: F.size(own).cast("long")})
    out = out.withColumn("text", F.when(F.size(own) == 0, F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.select(*docs.columns, *(marks or ()))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: lines, lines removed, and the SHA-256 of what is left (of nothing for a null text)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = drop_boilerplate(docs, marks=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lines that many sites share; every row stays, and copies of whole pages are left for the next stage."""
    return drop_boilerplate(docs, spare=SPARE)
