"""Upserts by key into versioned folders, and evidence of a subject as one JSON text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_folder


def merge_upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """target with the rows of batch put in place of those of the same keys; of a key's rows in batch the one last in `order` counts.

    Merging a batch again changes nothing. Null keys are a key like any other.
    """
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("last")).select("last.*")
    same = [target[k].eqNullSafe(last[k]) for k in keys]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return target.join(last, on, "left_anti").unionByName(last.select(*target.columns))


def upsert_files(target: DataFrame, batch: DataFrame, keys: list[str], order: str, folder: str, version: int) -> DataFrame:
    """merge_upsert as a version of its own in folder: fit for foreachBatch, since a repeated batch overwrites its version only."""
    path = f"{folder.rstrip('/')}/version={version}"
    merge_upsert(target, batch, keys, order).write.mode("overwrite").parquet(path)
    return target.sparkSession.read.schema(target.schema).parquet(path)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def create_buckets(target: DataFrame, keys: list[str], folder: str, buckets: int = 64) -> None:
    """target as a table in folders by the hash of its keys, for upsert_buckets."""
    target.select("*", _bucket(keys, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)


def read_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("bucket")


def upsert_buckets(batch: DataFrame, keys: list[str], order: str, folder: str, buckets: int = 64) -> list[int]:
    """merge_upsert into the table in folder, of which only the folders that batch touches are read and written; returns those.

    What they will hold is written beside the table first, then put in place by an overwrite of just these partitions. A batch that is
    repeated, as foreachBatch may, changes nothing. Null keys are a key like any other.
    """
    spark = batch.sparkSession
    table = spark.read.parquet(folder)
    batch = batch.select(*[c for c in table.columns if c != "bucket"], *([] if order in table.columns else [order]))
    touched = sorted(r[0] for r in batch.select(_bucket(keys, buckets)).distinct().collect())
    if not touched:
        return touched
    held = table.where(F.col("bucket").isin(touched)).drop("bucket")
    staged = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    merge_upsert(held, batch, keys, order).write.parquet(staged)
    merged = spark.read.schema(held.schema).parquet(staged).select("*", _bucket(keys, buckets)).hint("rebalance", "bucket")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return touched


def _section(name: str) -> Column:
    mine = F.filter("rows", lambda r: r["section"] == name)
    return F.transform(mine, lambda r: F.struct(r["id"].alias("id"), r["detail"].alias("detail"))).alias(name)


def evidence_bundle(subject: str, **sections: DataFrame) -> DataFrame:
    """(subject, bundle): a JSON text of each subject with its rows (id, detail) of each section, in order of id.

    All sections are grouped in one shuffle. A subject's own evidence must fit into a row.
    """
    parts = [df.select(F.col(subject).alias("subject"), F.lit(name).alias("section"), F.col("id").cast("long").alias("id"), F.col("detail").cast("string").alias("detail")) for name, df in sections.items()]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    grouped = rows.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("id", "detail", "section"))).alias("rows"))
    own = [_section(name) for name in sections]
    return grouped.select("subject", F.to_json(F.struct("subject", *own)).alias("bundle"))
