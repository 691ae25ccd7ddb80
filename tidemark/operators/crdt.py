"""Merging of replicated state. A delta is (resource, field, node, wall, counter, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_counters(deltas: DataFrame) -> DataFrame:
    """Each node's largest count, summed over nodes; merging again changes nothing."""
    by_node = deltas.groupBy("resource", "field", "node").agg(F.max("value").alias("value"))
    return by_node.groupBy("resource", "field").agg(F.sum("value").alias("total"))


def merge_registers(deltas: DataFrame) -> DataFrame:
    """The value of the latest (wall, counter, node); of equal stamps the largest value."""
    last = F.max(F.struct("wall", "counter", "node", "value"))
    return deltas.groupBy("resource", "field").agg(last.alias("last")).select("resource", "field", F.col("last.value").alias("value"), F.col("last.node").alias("node"))


def merge_clocks(deltas: DataFrame) -> DataFrame:
    """The vector clock of each resource: the largest counter of each node."""
    return deltas.groupBy("resource", "node").agg(F.max("counter").alias("counter"))


def compare_clocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """How two vector clocks (resource, node, counter) of each resource stand: equal, before, after or concurrent. A node that one lacks counts 0."""
    a, b = left.select("resource", "node", F.col("counter").alias("l")), right.select("resource", "node", F.col("counter").alias("r"))
    both = a.join(b, ["resource", "node"], "full").na.fill(0, ["l", "r"]).groupBy("resource")
    out = both.agg(F.bool_or(F.col("l") > F.col("r")).alias("ahead"), F.bool_or(F.col("l") < F.col("r")).alias("behind"))
    order = F.when(F.col("ahead") & F.col("behind"), "concurrent").when(F.col("ahead"), "after").when(F.col("behind"), "before").otherwise("equal")
    return out.select("resource", order.alias("order"))


def merge_sets(changes: DataFrame) -> DataFrame:
    """(resource, element) of observed-remove sets: an element is in if one of its add tags has not been removed. changes: resource, element, tag, op (add or remove)."""
    tags = changes.groupBy("resource", "element", "tag").agg(F.bool_or(F.col("op") == "remove").alias("removed"), F.bool_or(F.col("op") == "add").alias("added"))
    return tags.where("added and not removed").select("resource", "element").distinct()


def merge_maps(deltas: DataFrame) -> DataFrame:
    """(resource, field, value) of maps whose fields are registers with tombstones: the latest (wall, counter, node) wins, and if that is a deletion the field is gone."""
    last = F.max(F.struct("wall", "counter", "node", "deleted", "value"))
    out = deltas.groupBy("resource", "field").agg(last.alias("last"))
    return out.where(~F.col("last.deleted")).select("resource", "field", F.col("last.value").alias("value"))


def latest(items: DataFrame) -> DataFrame:
    """The row of each key with the latest (wall, counter, node); of equal stamps the largest value."""
    last = F.max(F.struct("wall", "counter", "node", "value"))
    return items.groupBy("key").agg(last.alias("last")).select("key", "last.*")


def key_prefix(size: int) -> Column:
    return F.substring(F.sha2("key", 256), 1, size)


def prefix_digests(items: DataFrame, size: int = 2) -> DataFrame:
    """(prefix, digest): for each beginning of the keys' hashes a sum of row hashes, which any order of merging leaves the same."""
    prefix = key_prefix(size)
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", "key", "wall", "counter", "node", "value"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return items.groupBy(prefix.alias("prefix")).agg(F.sum(row).alias("digest"))


def anti_entropy(local: DataFrame, remote: DataFrame, size: int = 2) -> DataFrame:
    """The merged state (key, wall, counter, node, value) of two replicas. Only remote rows under prefixes whose digests differ are fetched."""
    mine, theirs = latest(local), latest(remote)
    differ = prefix_digests(mine, size).toDF("prefix", "d1").join(prefix_digests(theirs, size).toDF("prefix", "d2"), "prefix", "full").where(~F.col("d1").eqNullSafe(F.col("d2"))).select("prefix")
    fetched = theirs.withColumn("prefix", key_prefix(size)).join(differ, "prefix", "left_semi").drop("prefix")
    return latest(mine.unionByName(fetched))
