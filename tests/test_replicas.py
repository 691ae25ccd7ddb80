"""A stored replica under rows that are late, repeated or old; change lists; and feedback against a plain fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import crdt, facts
from tidemark.streaming import replicas
from tidemark.streaming import stateful as V

ROWS = "key string, wall long, counter long, node string, value long"


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_only_what_differs_is_rewritten(spark, tmp_path):
    folder = tmp_path / "replica"
    start = [(f"k{i}", 10, 0, "a", i) for i in range(200)]
    replicas.create_replica(spark.createDataFrame(start + [("k1", 9, 9, "z", -1)], ROWS), str(folder), 1)
    first = files(folder)
    old = [("k5", 9, 0, "b", 77), ("k6", 10, 0, "a", 6), (None, 99, 0, "a", 1)]
    assert replicas.sync_replica(spark.createDataFrame(old, ROWS), str(folder), 1) == [] and files(folder) == first
    assert replicas.sync_replica(spark.createDataFrame([], ROWS), str(folder), 1) == []
    news = spark.createDataFrame([("k7", 11, 0, "b", 70), ("k7", 10, 5, "b", 71), ("k8", 10, 0, "b", 80)], ROWS)
    changed = replicas.sync_replica(news, str(folder), 1)
    want = sorted({r[0] for r in news.select(crdt.key_prefix(1)).collect()})
    assert changed == want
    kept = {path for path in first if path.split("prefix=p")[1][0] not in want}
    assert kept and all(files(folder)[path] == first[path] for path in kept)
    assert replicas.sync_replica(news, str(folder), 1) == []
    held = {r["key"]: r["value"] for r in replicas.read_replica(spark, str(folder)).collect()}
    assert held == {f"k{i}": i for i in range(200)} | {"k7": 70, "k8": 80}


def test_streams_in_any_order_agree(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"k{rng.integers(40)}", int(rng.integers(6)), int(rng.integers(3)), "ab"[rng.integers(2)], i) for i in range(300)]
    want = {}
    for key, *stamp in rows:
        want[key] = max(want.get(key, stamp), stamp)
    for turn, order in enumerate((rows, rows[::-1])):
        sent, folder = tmp_path / f"sent{turn}", tmp_path / f"replica{turn}"
        for part in range(3):
            spark.createDataFrame(order[100 * part : 100 * part + 100], ROWS).coalesce(1).write.mode("append").parquet(str(sent))
        replicas.create_replica(spark.createDataFrame(order[:20], ROWS), str(folder))
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(sent))
        assert len(replicas.stream_anti_entropy(stream, str(folder), str(tmp_path / f"state{turn}"))) == 3
        assert {r[0]: list(r[1:]) for r in replicas.read_replica(spark, str(folder)).collect()} == want


def test_summary_lines(spark):
    from tidemark.plans import catalog

    f, e = catalog.X.facts(spark, "/root/testdata/sf0.001"), catalog.X.episodes(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        facts.change_report(f, e, "2024-01-02 00:00:00", "2024-01-02 00:00:00")
    assert facts.change_report(f.where("false"), e.where("false"), "2024-01-02 00:00:00", "2024-01-03 00:00:00").count() == 0
    told = spark.createDataFrame([(1, 5, 1, "2024-01-02 10:00:00")], "session_id long, episode_id long, user_id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    row = facts.change_report(f.where("false"), told, "2024-01-02 00:00:00", "2024-01-03 00:00:00").where("change = 'summary'").first()
    assert row["summary"] == "0 added facts, 0 superseded facts, 0 confidence deltas, 1 head changes, 1 added episodes" and row["id"] is None


def test_feedback_by_entries(spark):
    """Adapters entry by entry with plain loops, without matrix products."""
    rng = np.random.default_rng(5)
    said = [(u, "ag"[u % 2], i, i // 2, rng.normal(size=4).tolist(), (rng.normal(size=4) * 30).tolist(), float(rng.integers(-2, 3)) / 2) for u in range(3) for i in range(40)]
    feedback = spark.createDataFrame(said, "user_id long, agent string, event_id long, at long, query array<double>, item array<double>, rating double")
    got = {r["user_id"]: r for r in V.train_adapters(feedback.orderBy(F.rand(1))).collect()}
    for user in range(3):
        agent, rank, dims = "ag"[user % 2], V.RANK, 4
        a = (np.random.default_rng([user, *agent.encode()]).standard_normal((rank, dims)) / np.sqrt(dims)).tolist()
        b, updates = [[0.0] * rank for _ in range(dims)], 0
        for _, _, _, _, q, item, rating in (r for r in said if r[0] == user):
            if not rating:
                continue
            updates += 1
            low = [sum(a[k][j] * item[j] for j in range(dims)) for k in range(rank)]
            gap = [q[j] - item[j] - sum(b[j][k] * low[k] for k in range(rank)) / rank for j in range(dims)]
            b = [[b[j][k] + 0.005 * rating * gap[j] * low[k] for k in range(rank)] for j in range(dims)]
            size = sum(x * x for line in b for x in line) ** 0.5
            b = [[x * min(1.0, 10.0 / size) for x in line] for line in b] if size else b
        assert got[user]["updates"] == updates and np.allclose(got[user]["b"], [x for line in b for x in line]) and 0 < got[user]["norm"] <= 10.000001
