"""Secret scans with an incremental ledger of blobs.

A blob is a text named by its SHA-256. The ledger is a table with one row for each pair of blob and
rule version that has been scanned; a scan reads only the texts of pairs that it lacks, one text for
each blob however many paths and repeated rows hold it, appends what it finds, and joins findings back to all paths.
Where few blobs are new, a Bloom filter of those keeps the texts of all others from being shuffled.

A null text counts as empty. Rows are never merged: repeated rows and rows without an id each get
their own result row. An empty table gives an empty one. Columns other than path and text are not read, so
their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._tables import shared_path, written
from tidemark.llm.urls import Level, bit_arrays

RULE_VERSION = "2024-01"
#: Kinds in the order in which spans that start together are listed; the first three are the base.
BASE_KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "cloud": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
}
#: Texts are filtered before they are shuffled if fewer than one row in so many is new; the filter's size is bounded.
FEW_NEW = 4
MAX_BITS = 1 << 26
_WORDS = ("passw", "secret", "token", "api")
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, order of the kind, kind:start:end) of every finding, in the order in which they are listed."""
    found = []
    low = text.lower()
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        if kind == "assign" and not any(w in low for w in _WORDS):
            continue
        for m in pattern.finditer(text):
            if kind == "assign" and len(m[2]) < 8 or kind == "access" and len(m[0]) < 16:
                continue
            found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(found)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for blob, version, text in zip(pdf["blob"], pdf["rule_version"], pdf["text"], strict=True):
            spans = find_spans(text or "")
            counts = [sum(rank == k for _, rank, _ in spans) for k in range(len(BASE_KINDS))]
            base = ",".join(s for _, rank, s in spans if rank < len(BASE_KINDS))
            rows.append((blob, version, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, _, s in spans)))
        yield pd.DataFrame(rows, columns=["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def update_ledger(versions: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans the texts of `versions` (path, text) that the ledger lacks under this rule version; returns (path, blob).

    The ledger only grows. If a job dies before its append commits, the next call scans those blobs again.
    """
    spark = versions.sparkSession
    named = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = named.select("path", "blob")
    todo = paths.groupBy("blob").agg(F.count("*").alias("n"))
    known = read_ledger(spark, ledger_path).where(F.col("rule_version") == rule_version).select("blob")
    todo = written(todo.join(known, "blob", "left_anti"), "unseen-blobs")
    texts = named.select("blob", "text")
    count = todo.agg(F.count("*").alias("new"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if count["new"] and FEW_NEW * count["rows"] < paths.count():
        bits = min(MAX_BITS, max(64, 10 * count["new"]))
        level = Level(bits, 0)
        level.arrays = written(bit_arrays(todo.select(F.lit(0).alias("shard"), F.col("blob").alias("key")), level, 1), "unseen-filter")
        texts = texts.where(level.has(F.col("blob"), 0))
    # Equal texts shrink to one in each task before the shuffle, so a blob in a third of all rows is no hot key.
    texts = texts.dropDuplicates(["blob"]).join(todo.select("blob").hint("shuffle_hash"), "blob", "left_semi")
    work = texts.select("blob", F.lit(rule_version).alias("rule_version"), "text")
    work.mapInPandas(_scan, LEDGER).write.mode("append").parquet(ledger_path)
    return paths


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """The ledger; empty where none has been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger_path)


def scan_secrets(versions: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, findings...) for every row of `versions` (path, text)."""
    paths = update_ledger(versions, ledger_path, rule_version)
    # A task that is run twice, or a call that failed, may leave a blob in the ledger twice: its findings are equal.
    found = read_ledger(versions.sparkSession, ledger_path).where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])
    found = written(found, "findings")  # so that the join below can split a blob with many paths
    return paths.join(found, "blob")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its secrets, through a ledger of this run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    out = scan_secrets(docs, shared_path(spark, "blob-ledger"))
    return out.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")
