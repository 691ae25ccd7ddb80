"""Streams over tables of many files, and turns of many files each."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tidemark.plans.catalog import QUERIES
from tidemark.streaming import ordered as O
from tidemark.streaming import stateful as V
from tidemark.streaming import windows as Z

DATA = "/root/testdata/sf0.001"


def test_a_stream_reads_a_table_of_many_files(spark, tmp_path):
    """A table may be one file or a folder of files."""
    spark.read.parquet(f"{DATA}/conversations.parquet").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = [sorted(map(tuple, QUERIES["str3_stream_heads"](spark, d).collect())) for d in (DATA, str(tmp_path))]
    assert found[0] and found[0] == found[1]


def test_turns_of_many_files_come_in_order(spark):
    """Each turn is one batch, however many files it has, so that a breaker sees deliveries in their order."""
    table = spark.range(3000).select((F.col("id") % 7).alias("webhook_id"), F.col("id").alias("delivery_id"), (F.col("id") % 11 > 5).alias("delivered"), F.timestamp_seconds(F.col("id") * 60).alias("created_at"))
    stream, later = Z.in_turns(table.repartition(5), "created_at")
    got = Z.run_to_end(V.circuit_breaker(stream, 2, 7200), "append", later)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, V.circuit_breaker(table, 2, 7200).collect())) and got.count() == 3000


def test_changes_of_many_slots_at_once():
    """A bucket's slots are told apart: the changes are those of each slot alone."""
    rng = random.Random(5)
    rows = pd.DataFrame([(rng.randrange(9), i, rng.choice("aAbB"), rng.randrange(20)) for i in range(120)], columns=["slot", "edge_id", "target", "micros"])
    known, new = rows[:60], rows[60:]
    one = lambda f, slot: f[f["slot"] == slot].drop(columns="slot")
    alone = [O.changes_of(one(known, s), one(new, s)).assign(slot=s) for s in range(9)]
    listed = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None)[["slot", "change", "edge_id", "other_id", "old_target", "new_target", "micros"]].itertuples(index=False)))
    assert listed(O.changes_of(known, new)) == listed(pd.concat(alone)) and len(new)
    assert sorted(O.compact(rows, 10)["edge_id"]) == sorted(e for s in range(9) for e in O.compact(one(rows, s), 10)["edge_id"])


def test_adapters_of_many_keys_fold_as_one_by_one(spark, monkeypatch):
    """Keys that share a bucket, batches that end inside a key, and a stream's turns: all give what a plain fold of each key does."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(5)), "ab"[rng.integers(2)], i, i // 2, rng.standard_normal(6).tolist(), rng.standard_normal(6).tolist(), float(rng.integers(-400, 401)) / 2) for i in range(300)]
    rows.append((9, "c", 300, 0, [1.0] * 6, [1.0] * 6, 0.0))
    want = {}
    for user, agent, _, _, query, item, rating in sorted(rows, key=lambda r: (r[3], r[2])):
        a = np.random.default_rng([user, *agent.encode()]).standard_normal((V.RANK, 6)) / np.sqrt(6)
        n, b = want.get((user, agent), (0, np.zeros((6, V.RANK))))
        q, x = np.array(query), np.array(item)
        if rating:
            n, b = n + 1, b + abs(rating) * V.STEP * np.outer(np.sign(rating) * (q - (x + b @ (a @ x) / V.RANK)), a @ x)
            b = b * min(1.0, V.LIMIT / np.linalg.norm(b))
        want[user, agent] = n, b
    monkeypatch.setattr(V, "BUCKETS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        table = spark.createDataFrame(rows, "user_id long, agent string, event_id long, second long, query array<float>, item array<float>, rating double").withColumn("at", F.timestamp_seconds("second")).drop("second")
        of_table = V.train_adapters(table).collect()
        stream, later = Z.in_turns(table.repartition(3), "at")
        of_stream = Z.run_to_end(V.train_adapters(stream), "append", later).collect()
        short = V.train_adapters(table, matrices=False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {(r["user_id"], r["agent"]): r for r in sorted(of_stream, key=lambda r: r["updates"])}
    assert len(of_table) == len(want) == len(last) and {r.asDict().keys() == {"user_id", "agent", "updates", "norm"} for r in short} == {True}
    for r in of_table:
        n, b = want[r["user_id"], r["agent"]]
        for found in (r, last[r["user_id"], r["agent"]]):
            assert found["updates"] == n and np.allclose(np.array(found["b"]).reshape(6, V.RANK), b, atol=1e-4)
    assert any(np.linalg.norm(b) > V.LIMIT - 1e-6 for _, b in want.values())
