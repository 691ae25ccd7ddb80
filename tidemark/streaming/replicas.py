"""A stored replica that takes in what other replicas send, by tables or by streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.crdt import key_prefix, latest, prefix_digests
from tidemark.sources.shared import shared_folder

COLUMNS = ["key", "wall", "counter", "node", "value"]


def _folder_of(size: int) -> Column:
    # A letter in front, or folders such as 10 and 1e would be read as numbers.
    return F.concat(F.lit("p"), key_prefix(size)).alias("prefix")


def create_replica(items: DataFrame, folder: str, size: int = 2) -> None:
    """The latest rows (key, wall, counter, node, value) in folders by the first `size` hexadecimal digits of their keys' hashes. Rows without a key are left out."""
    latest(items.where("key is not null")).select(*COLUMNS, _folder_of(size)).hint("rebalance", "prefix").write.partitionBy("prefix").parquet(folder)


def read_replica(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select(*COLUMNS)


def sync_replica(remote: DataFrame, folder: str, size: int = 2) -> list[str]:
    """Merges rows of another replica into the stored one, and returns the prefixes that this changed.

    Only folders under which remote has keys are read, and only those are rewritten whose digest is another after the merge.
    So older rows and rows that are sent again write nothing, in any order, and a batch that is repeated after a failure does
    no harm. A null key has no prefix and is an error of the sender: such rows are left out. At most 16 ** size prefixes reach the driver.
    """
    spark = remote.sparkSession
    sent = latest(remote.where("key is not null"))
    asked = sorted(r[0] for r in sent.select(_folder_of(size)).distinct().collect())
    if not asked:
        return []
    held = spark.read.parquet(folder).where(F.col("prefix").isin(asked)).select(*COLUMNS)
    staged = f"{shared_folder(spark)}/replica-{uuid.uuid4().hex}"
    latest(held.unionByName(sent.select(*COLUMNS))).select(*COLUMNS).write.parquet(staged)
    merged = spark.read.schema(held.schema).parquet(staged)
    before, after = (prefix_digests(rows, size).toDF("prefix", name) for rows, name in ((held, "before"), (merged, "after")))
    changed = sorted(r[0] for r in after.join(before, "prefix", "left").where(~F.col("after").eqNullSafe(F.col("before"))).select("prefix").collect())
    if changed:
        rows = merged.select(*COLUMNS, _folder_of(size)).where(F.col("prefix").isin([f"p{c}" for c in changed]))
        rows.hint("rebalance", "prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(folder)
    return changed


def stream_anti_entropy(remote: DataFrame, folder: str, state: str, size: int = 2) -> dict[int, list[str]]:
    """sync_replica for each batch of a stream, over all files that are there; the prefixes that each batch changed. `state` is the stream's checkpoint folder."""
    changed: dict[int, list[str]] = {}

    def merge(batch: DataFrame, epoch: int) -> None:
        changed[epoch] = sync_replica(batch, folder, size)

    remote.writeStream.option("checkpointLocation", state).foreachBatch(merge).trigger(availableNow=True).start().awaitTermination()
    return changed
