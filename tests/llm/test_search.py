"""Ranked search against scores of every pair, summed by hand."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import search

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, length = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scores = []
        for doc_id, c, n in counts:
            m = 75 + 25 * n * total // length
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(400)] + ["the", "The", "ÉT", "été", "été", "𝕏y", "a_b", "x-y", "don't"]
    weights = [1 / (1 + i % 200) for i in range(len(words))]
    make = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(n, make(rng.randrange(1, 120))) for n in range(400)]
    docs += [(500, None), (501, ""), (502, "--- !"), (None, "w1 w2 w399"), (None, "w1 w2 w399"), (7, docs[7][1]), (7, "w3 w399"), (503, "rare " * 30_000), (504, "w0"), (505, "w0"), (506, "w0")]
    items = [(n, make(rng.randrange(1, 30))) for n in range(25)] + [(100, None), (101, " "), (102, "nowhere"), (103, "rare rare"), (104, "w0 W0"), (None, "w1 w399"), (104, "w399")]
    return docs, items


@pytest.mark.parametrize("block", [search.BLOCK, 300])
def test_search(spark, rows, block, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", block)
    docs, items = rows
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS term", "2 AS rank").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n", "3 AS score")
    key = lambda r: tuple(str(x) for x in r)
    for k in (3, 20, 1000):
        found = search.search(d, q, k).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, found), key=key) == sorted(brute(docs, items, k), key=key)


def test_empty_tables(spark, rows):
    docs, items = (spark.createDataFrame(r, f"{n} long, text string") for r, n in zip(rows, ("doc_id", "item_id"), strict=True))
    assert search.search(docs.where("false"), items).count() == 0 and search.search(docs, items.where("false")).count() == 0
    assert search.search(docs.where("doc_id = 502"), items).count() == 0


def test_accumulators_that_cannot_win_go(spark, rows, monkeypatch):
    """After the first owners only documents near the best are carried on."""
    monkeypatch.setattr(search, "BLOCK", 2000)
    sizes = {}
    whole = search.written

    def kept(df, name, by=None):
        out = whole(df, name, by)
        if name.startswith("bundles"):
            sizes[name] = out.selectExpr("sum(size(rows))").first()[0]
        return out

    monkeypatch.setattr(search, "written", kept)
    docs, items = (spark.createDataFrame(r, f"{n} long, text string") for r, n in zip(rows, ("doc_id", "item_id"), strict=True))
    search.search(docs, items, 2).count()
    touched = len(brute(*rows, 10**6))
    assert 0 < sizes["bundles-2"] < touched / 4
