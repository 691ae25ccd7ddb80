"""Contradictions against all pairs, whole and in parts; the sweep's steps are in proportion to what comes out."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts as K


def overlaps(rows):
    out = set()
    for i, (slot, obj, start, end) in enumerate(rows):
        for j, (other, name, begun, stop) in enumerate(rows[:i]):
            if slot == other and obj and name and obj.lower() != name.lower() and (end is None or begun < end) and (stop is None or start < stop):
                out.add((j, i))
    return out


@pytest.mark.parametrize("part", [1 << 13, 5])
def test_pairs(spark, part, monkeypatch):
    monkeypatch.setattr(K, "FACTS_OF_A_PART", part)
    rng = random.Random(15)
    rows = [(rng.randrange(3), rng.choice(["a", "A", "b", "c"]), s := rng.randrange(60), rng.choice([None, s + 1 + rng.randrange(25)])) for _ in range(150)] + [(0, None, 3, None), (0, "x", 10, 11)]
    at = lambda c: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval({c})")
    table = spark.createDataFrame([(i, 1, f"s{x[0]}", "l", *x[1:]) for i, x in enumerate(rows)], "edge_id long, user_id long, source string, label string, target string, start int, end int")
    table = table.withColumns({"valid_at": at("start"), "invalid_at": at("end"), "part": F.lit(1), "turn": F.lit("x")})
    found = [(r["id1"], r["id2"]) for r in K.contradictions(table, F.expr("timestamp_ntz'2024-04-01 00:00:00'")).collect()]
    assert len(found) == len(set(found)) and set(found) == overlaps(rows)
    assert K.contradictions(table.where("false"), F.expr("timestamp_ntz'2024-04-01 00:00:00'")).count() == 0


def test_equal_objects_cost_nothing():
    """Fifty thousand open facts of one object and one of another: as many pairs as facts, not the square."""
    n = 50_000
    low, high = K.sweep(list(range(n + 1)), list(range(n + 1)), [None] * (n + 1), ["same"] * n + ["other"], set(range(n + 1)))
    assert len(low) == n and set(high) == {n}
    assert K.sweep([1, 2, 3], [0, 5, 5], [5, None, 9], ["a", "b", "c"], {1, 2, 3}) == ([2], [3])
