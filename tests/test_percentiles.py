"""Percentiles against numpy: ties, few values, far outliers, nulls and one group that holds most rows."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import percentiles
from tidemark.operators.percentiles import exact_percentiles


@pytest.mark.parametrize("bins, few", [(1024, 1 << 15), (64, 40)])
def test_percentiles(spark, bins, few):
    rng = random.Random(8)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(1500)], "ties": [rng.choice([1.0, 2.0, 2.0]) for _ in range(400)], "one": [7.5], "two": [1.0, 2.0], "same": [3.0] * 100,
        "far": [10.0 ** rng.randrange(-200, 200) * rng.choice([-1, 1]) for _ in range(200)] + [1.7e308, -1.7e308], None: [float(i) for i in range(30)],
    }
    rows = [(k, x) for k, values in groups.items() for x in values] + [("normal", None), ("none", None), ("nan", math.nan), ("two", math.nan)]
    rng.shuffle(rows)
    shares = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    table = spark.createDataFrame(rows, "size string, v double")
    found = {r["size"]: [r[n] for n in shares] for r in exact_percentiles(table, ["size"], "v", shares, bins, few).collect()}
    assert found.pop("none") == [None] * 5 and found.pop("nan") == [None] * 5
    assert found.keys() == groups.keys()
    for key, values in groups.items():
        ordered, want = sorted(values), []
        for p in shares.values():
            r = p * (len(values) - 1)
            a, b = ordered[math.floor(r)], ordered[math.ceil(r)]
            want.append(a + (b - a) * (r - math.floor(r)))
        assert np.allclose(found[key], want, rtol=1e-12, atol=0), key
    assert exact_percentiles(table.where("false"), ["size"], "v", shares).count() == 0


def test_small_groups_beside_a_large_one(spark, monkeypatch):
    """Only the large group's values are stored and counted; 500 small groups, and one of nulls, are sorted or known at once."""
    sizes, cut = [], percentiles.cut

    def counted(df):
        sizes.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(percentiles, "cut", counted)
    rng = random.Random(3)
    groups = {i: [rng.gauss(0, 9) for _ in range(20)] for i in range(500)} | {500: [rng.gauss(0, 9) for _ in range(3000)], 501: []}
    rows = [(k, x) for k, values in groups.items() for x in values] + [(i % 502, None) for i in range(4000)]
    found = exact_percentiles(spark.createDataFrame(rows, "size long, v double"), ["size"], "v", {"p50": 0.5, "p95": 0.95}, 16, 100).collect()
    assert len(found) == 502 and max(sizes) <= 3000
    for r in found:
        assert [r["p50"], r["p95"]] == ([None, None] if r["size"] == 501 else pytest.approx(list(np.quantile(groups[r["size"]], [0.5, 0.95]))))
