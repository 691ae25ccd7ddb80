"""Hits by vector of the hybrid read path against a plain comparison of every query with every item of its user."""

import math
import random

import pyarrow as pa
import pytest

from tidemark.operators import hybrid


def rounded(x):
    return math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


def score(q, v):
    """(class, score) in the order of SQL: not a number first, null last."""
    if q is None or v is None:
        return (0, 0.0)
    lengths = math.sqrt(sum(x * x for x in q)) * math.sqrt(sum(x * x for x in v))
    return (1, rounded(sum(x * y for x, y in zip(q, v)) / lengths)) if lengths else (2, 0.0)


def wanted(queries, items):
    out = set()
    for query, user, q in queries:
        for kind, most in hybrid.HITS.items():
            mine = sorted((tuple(-x for x in score(q, v)), i) for owner, k, i, v in items if owner == user and k == kind)
            out |= {(query, kind, i, n + 1) for n, (_, i) in enumerate(mine[:most])}
    return out


def made(rng):
    """Few different vectors, so that there are ties; some without length, some missing; users of many and of no items or queries."""
    vectors = [[float(rng.randrange(-2, 3)) for _ in range(4)] for _ in range(30)] + [[0.0] * 4, None]
    items = [(user, kind, f"{kind[0]}{n}", rng.choice(vectors)) for user, size in ((1, 400), (2, 30), (3, 3), (5, 12)) for n in range(size) for kind in (*hybrid.HITS, "other")]
    queries = [(n, rng.choice([1, 1, 1, 2, 3, 4]), rng.choice(vectors)) for n in range(150)]
    return queries, items


@pytest.mark.parametrize("rows", [20, 1 << 15])
def test_by_vector(spark, monkeypatch, rows):
    monkeypatch.setattr(hybrid, "ROWS", rows)
    monkeypatch.setattr(hybrid, "ASKED", rows)
    queries, items = made(random.Random(rows))
    asked = spark.createDataFrame(queries, "query_id long, user_id long, vector array<float>")
    found = hybrid.by_vector(asked, spark.createDataFrame(items, "user_id long, kind string, id string, vector array<float>"))
    assert {tuple(r) for r in found.select("query_id", "kind", "id", "rank").collect()} == wanted(queries, items)


def test_pairs_are_not_rows():
    """A part gives back no more than the hits of its queries, however many items tie, and its own scores in blocks."""
    queries = pa.table({"query_id": list(range(40)), "user_id": [7] * 40, "q": pa.array([[1.0, 0.0]] * 40, pa.list_(pa.float32()))})
    items = pa.table({"user_id": [7] * 60_000, "kind": ["fact"] * 60_000, "id": [f"{n}" for n in range(60_000)], "vector": pa.array([[1.0, 1.0]] * 60_000, pa.list_(pa.float32()))})
    found = hybrid._nearest(queries, items)
    names = sorted(f"{n}" for n in range(60_000))[: hybrid.HITS["fact"]]
    assert found.num_rows == 40 * len(names) and found.column("id").to_pylist()[: len(names)] == names
    assert set(found.column("score").to_pylist()) == {rounded(1 / math.sqrt(2))}


def test_nothing_asked(spark):
    queries, items = made(random.Random(1))
    items = spark.createDataFrame(items, "user_id long, kind string, id string, vector array<float>")
    asked = spark.createDataFrame(queries, "query_id long, user_id long, vector array<float>")
    assert hybrid.by_vector(asked.limit(0), items).isEmpty() and hybrid.by_vector(asked, items.limit(0)).isEmpty()
