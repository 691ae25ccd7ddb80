"""URL filters: exact membership by a cascade of Bloom filters, under host and path rules.

The cascade's first level encodes the listed keys; the second the false positives of the first among
all other keys of the corpus; the third the listed keys that the second takes in; and so on until a
level lets nothing wrong through. A key's first level that lacks it decides: exact for every key of
the universe, with no join at all. Only built-in functions are used.

A level is one array of 64-bit words that each task reads from a scalar subquery. How much a cascade
takes is known from the counts of listed and other keys before it is built; beyond MAX_BYTES keys are
dealt into shards by hash, stored by shard, each shard has arrays of its own, and what is looked up in
them is that shard's part alone. All shards of a level are built in one job.

A null url, or one without "://", has empty host and path. Repeated rows are judged alike. Listed keys
that no page has don't matter; null ones are left out. Empty tables give empty results. Columns of pages
other than page_id and url are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._tables import written

#: (rule, verdict); a rule is a host, which stands for its subdomains too, and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Names whose pages are listed, wherever they stand in the host.
LISTED_SITES = ("spam-farm", "cheap-pills", "free-bets", "adult-x", "ads-track", "casino-win")
#: Hash functions of each level; a level takes in 1 in 2**HASHES of the keys that it should not.
HASHES = 5
MAX_BYTES = 32 << 20
MAX_RULES = 200
SEGMENT = 1024
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _ASCII_UPPER, _ASCII_LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; of equal length the first in the alphabet."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        site, _, start = text.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    """One level: its bits in each shard, and a row (shard, words) for each shard."""

    bits: int
    seed: int
    arrays: DataFrame | None = None

    def positions(self, key: Column) -> list[Column]:
        first = F.pmod(F.xxhash64(key, F.lit(2 * self.seed)), F.lit(self.bits))
        step = F.pmod(F.xxhash64(key, F.lit(2 * self.seed + 1)), F.lit(self.bits - 1)) + 1
        return [F.pmod(first + step * i, F.lit(self.bits)) for i in range(HASHES)]

    def has(self, key: Column, shard: int) -> Column:
        words, out = self.arrays.where(F.col("shard") == shard).select("words").scalar(), F.lit(True)
        for at in self.positions(key):
            out &= F.getbit(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), (at % 64).cast("int")) == 1
        return out


@dataclass
class Cascade:
    shards: int
    levels: list[Level]

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.shards)).cast("int")

    def listed(self, key: Column, shard: int) -> Column:
        """Whether a key of the universe that lies in the shard is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.has(key, shard), F.lit(n % 2 == 1)).otherwise(out)
        return out


def bit_arrays(keys: DataFrame, level: Level, shards: int) -> DataFrame:
    """(shard, words): the level's bits in order; rows are merged before they are shuffled, and every word is there."""
    at = keys.select("shard", F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    bits = at.select("shard", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    size = math.ceil(level.bits / 64)
    blank = keys.sparkSession.range(size * shards).select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = bits.unionByName(blank).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    parts = words.groupBy("shard", F.expr(f"word div {SEGMENT}").alias("segment")).agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("part"))
    return parts.groupBy("shard").agg(F.flatten(F.array_sort(F.collect_list(F.struct("segment", "part")))["part"]).alias("words"))


def build_cascade(keys: DataFrame, listed: DataFrame) -> Cascade:
    """A cascade for the keys (column key, with repeats) of which some are in `listed` (column key)."""
    flags = keys.select("key", F.lit(True).alias("used"), F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(False).alias("used"), F.lit(True).alias("listed")))
    flags = flags.where("key is not null").groupBy("key").agg(F.max("used").alias("used"), F.max("listed").alias("listed")).where("used").drop("used")
    universe = written(flags, "cascade-keys")
    total = universe.agg(F.count("*").alias("n"), F.count_if("listed").alias("yes")).first()
    # Every second level lets through one in 2**HASHES of what the one before encodes.
    need = (total["yes"] + (total["n"] - total["yes"]) / 2**HASHES) / (1 - 2.0**-HASHES) * HASHES / math.log(2) / 8
    cascade = Cascade(max(1, math.ceil(1.1 * need / MAX_BYTES)), [])
    universe = universe.withColumn("shard", cascade.shard(F.col("key")))
    if cascade.shards > 1:
        universe = written(universe, "cascade-shards", by="shard")
    yes, other = universe.where("listed").select("shard", "key"), universe.where("not listed").select("shard", "key")
    while (n := yes.groupBy("shard").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]) > 0:
        level = Level(max(64, math.ceil(n * HASHES / math.log(2) / 64) * 64), len(cascade.levels))
        level.arrays = written(bit_arrays(yes, level, cascade.shards), "cascade-level")
        cascade.levels.append(level)
        wrong = [other.where(F.col("shard") == s).where(level.has(F.col("key"), s)) for s in range(cascade.shards)]
        yes, other = written(reduce(DataFrame.unionByName, wrong), "cascade-wrong", by="shard" if cascade.shards > 1 else None), yes
    return cascade


def flag_listed(rows: DataFrame, listed: DataFrame, column: str = "listed") -> DataFrame:
    """`rows` (with a column key, with repeats) with a flag for keys that are in `listed`."""
    cascade = build_cascade(rows, listed)
    if cascade.shards == 1:
        return rows.withColumn(column, cascade.listed(F.col("key"), 0))
    dealt = written(rows.withColumn("shard", cascade.shard(F.col("key"))), "cascade-rows", by="shard")
    parts = [dealt.where(F.col("shard") == s).withColumn(column, cascade.listed(F.col("key"), s)) for s in range(cascade.shards)]
    return reduce(DataFrame.unionByName, parts).drop("shard")


def page_keys(pages: DataFrame) -> DataFrame:
    """page_id, host, path and key (host and path) of pages (page_id, url)."""
    host, path = url_parts(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))


def site_list(keys: DataFrame, sites: Sequence[str] = LISTED_SITES) -> DataFrame:
    """A list of keys: all of those sites, wherever their name stands in the host."""
    return keys.where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, sites)))).select("key").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed for every row of pages (page_id, url); listed: a table of keys, by default of LISTED_SITES."""
    keys = page_keys(pages)
    judged = flag_listed(keys, site_list(keys) if listed is None else listed)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "listed")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages with its verdict."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    def cases(pick: int) -> str:
        out = ""
        for rule in sorted(RULES, key=lambda r: -len(r[0])):
            site, _, start = rule[0].partition("/")
            out += f" WHEN (host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '/{start}') THEN '{rule[pick]}'"
        return out

    names = ", ".join(f"'{s}'" for s in LISTED_SITES)
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH parts AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '{pattern}', 1), '{_ASCII_UPPER}', '{_ASCII_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{pattern}', 2) AS path FROM pages),
flagged AS (SELECT *, list_has_any(string_split(host, '.'), [{names}]) AS listed FROM parts)
SELECT page_id, host, path, CASE{cases(0)} END AS rule,
    coalesce(CASE{cases(1)} END, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM flagged"""


ORACLE = _oracle()
