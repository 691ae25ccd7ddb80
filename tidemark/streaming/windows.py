"""Windowed counts over streams, and running a stream over all files that are there."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import episode_backoff_ms
from tidemark.sources.shared import shared_folder


def stream_files(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of a table of a folder, a parquet file or a folder of such files, with the schema that it has; all files are one batch unless a batch has fewer."""
    path = f"{folder.rstrip('/')}/{name}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    # As a pattern, since a stream takes no path of one file.
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(f"{path[:-1]}[{path[-1]}]")


def in_any_order(df: DataFrame, key: str, turns: int = 3) -> DataFrame:
    """A stream of a table's rows that come in so many batches at most, each row in a turn that its key's hash names: late rows abound."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/turns-{uuid.uuid4().hex}"
    for turn in range(turns):
        df.where(F.pmod(F.xxhash64(key), F.lit(turns)) == turn).write.mode("append").parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // turns))).parquet(path)


def in_turns(df: DataFrame, ts: str, turns: int = 3) -> tuple[DataFrame, list[Callable[[], None]]]:
    """A stream of a table's rows in the order of time, and what writes its later turns, for `run_to_end`.

    A turn may be many files, in no order, so it has to be one batch: the next one is written when the stream has read all that is there.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/turns-{uuid.uuid4().hex}"
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    first, last = df.agg(F.min(stamp), F.max(stamp)).first()
    first, width = first or 0, max(1, -(-((last or 0) - (first or 0) + 1) // turns))

    def write(turn: int) -> None:
        df.where(F.floor((stamp - first) / width) == turn).write.mode("append").parquet(path)

    write(0)
    return spark.readStream.schema(df.schema).parquet(path), [partial(write, turn) for turn in range(1, turns)]


def window_counts(events: DataFrame, ts: str, kind: str, width: str, lateness: str) -> DataFrame:
    """Events of each kind in tumbling windows. Rows later than the watermark allows are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    counted = timed.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), kind, "n")


def tumbling_rate(deliveries: DataFrame, ts: str, width: str, most: int, lateness: str = "10 minutes") -> DataFrame:
    """Deliveries of each webhook by window, and whether they exceed what is allowed."""
    return window_counts(deliveries, ts, "webhook_id", width, lateness).withColumn("throttled", F.col("n") > most)


def sliding_failure_rate(deliveries: DataFrame, ts: str, width: str, step: str, lateness: str = "10 minutes") -> DataFrame:
    """The share of failures of each webhook in overlapping windows."""
    timed = deliveries.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    out = timed.groupBy(F.window(ts, width, step).alias("w"), "webhook_id").agg(F.count("*").alias("n"), F.count_if(~F.col("delivered")).alias("failed"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "webhook_id", "n", F.round(F.col("failed") / F.col("n"), 6).alias("failure_rate"))


def activity_sessions(events: DataFrame, ts: str, owner: str, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Stretches of activity of each owner that end after a gap without events."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    out = timed.groupBy(F.session_window(ts, gap).alias("w"), owner).agg(F.count("*").alias("n"))
    return out.select(owner, F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("closes"), "n")


def stream_heads(episodes: DataFrame) -> DataFrame:
    """Head and version of each session; of equal times the larger id."""
    head = F.max(F.struct("created_at", "episode_id")).alias("head")
    return episodes.groupBy("session_id").agg(head, F.count("*").alias("version")).select("session_id", F.col("head.episode_id").alias("head_episode_id"), F.col("head.created_at").alias("head_at"), "version")


def stream_dedupe(imports: DataFrame, ts: str, keys: list[str], lateness: str) -> DataFrame:
    """The first import of each key; repeats inside the watermark are dropped."""
    return imports.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def stream_retry(attempts: DataFrame, most: int) -> DataFrame:
    """Where each delivery stands after its attempts (delivery_id, success, at): delivered, pending with the time of the next try, or dead letter."""
    seen = attempts.groupBy("delivery_id").agg(F.count("*").alias("attempts"), F.max("success").alias("delivered"), F.max("at").alias("last"))
    status = F.when(F.col("delivered"), "delivered").when(F.col("attempts") >= most, "dead_letter").otherwise("pending")
    due = F.when(~F.col("delivered"), F.unix_millis("last") + episode_backoff_ms(F.col("attempts"), most))
    return seen.select("delivery_id", "attempts", status.alias("status"), due.alias("due_ms"))


def event_fanout(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event with the enabled subscriptions of its user that want its type: a stream joined with a table."""
    live = subscriptions.where("enabled").select("user_id", "subscription_id", "types")
    return events.join(live, "user_id").where(F.array_contains("types", F.col("event_type"))).select("event_id", "subscription_id")


def run_to_end(stream: DataFrame, mode: str = "complete", later: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """The full result after all present files. Each batch writes a version of its own, so that a repeated batch overwrites itself.

    In complete mode the last version is the result, in append mode all of them are. Each of `later` brings further files once those before are read;
    the stream goes on from its checkpoint.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch}")
        last.append(epoch)

    # State in RocksDB may outgrow memory, and state with timers needs it; a query that has started keeps what it was started with.
    store, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(store)
    spark.conf.set(store, provider)
    try:
        for bring in (None, *later):
            if bring:
                bring()
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    if not last:
        return spark.createDataFrame([], stream.schema)
    versions = [max(last)] if mode == "complete" else sorted(set(last))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/version={v}" for v in versions])
