"""Exact search in parts against numpy, and the index: recall, pairs compared, bounds and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import retrieval
from tidemark.operators import vector_index as I
from tidemark.sources import fixtures as X


def best(rows, asked, k, min_score=-2.0, same=True):
    out = set()
    for a, t, x in asked:
        scored = sorted(((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6), b) for b, u, y in rows if b != a and (u == t or not same)), key=lambda s: s)
        out |= {(a, b, -s, n) for n, (s, b) in enumerate([s for s in scored if -s[0] >= min_score][:k], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 10)) * 3
    return [(n, int(n % 9 == 0), (centres[n % 12] + rng.standard_normal(10)).tolist()) for n in range(900)]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, tenant int, vector array<double>").withColumn("part", F.lit(1))


@pytest.mark.parametrize("sizes", [(1 << 15, 1 << 11), (40, 7)])
def test_exact_in_parts(rows, vectors, sizes, monkeypatch):
    monkeypatch.setattr(I.dealt, "__defaults__", sizes)
    asked = [r for r in rows if r[0] % 20 == 0]
    for options in ({}, {"min_score": 0.9}, {"same_tenant": False, "min_score": 0.5}):
        found = retrieval.cosine_topk(vectors.where("vec_id % 20 = 0"), vectors, 6, **options).collect()
        assert {(r["query_id"], r["id"], r["score"], r["rank"]) for r in found} == best(rows, asked, 6, options.get("min_score", -2.0), options.get("same_tenant", True))


def test_cells_prune_what_has_structure(spark, vectors, tmp_path):
    """Clustered vectors: few cells are looked into, short lists are compared, and nearly all neighbours are found."""
    I.build_index(vectors, str(tmp_path), 5, 40)
    book = I.read_codebook(spark, str(tmp_path))
    asked = vectors.where("vec_id % 20 = 0")
    exact = {(r["query_id"], r["id"]) for r in retrieval.cosine_topk(asked, vectors, 5).collect()}
    found = {(r["query_id"], r["id"]) for r in I.search_index(asked, vectors, str(tmp_path), 5).collect()}
    assert book.probes < len(book.centres) / 2 and book.short < 60 and len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_pairs(spark, sf, tmp_path):
    """These vectors have no clusters at all, so that codes alone must prune."""
    v = X.vectors(spark, f"/root/testdata/{sf}")
    I.build_index(v, str(tmp_path))
    asked = v.where("vec_id % 20 = 0")
    exact = {(r["query_id"], r["id"]) for r in retrieval.cosine_topk(asked, v, 5).collect()}
    found = {(r["query_id"], r["id"]) for r in I.search_index(asked, v, str(tmp_path), 5).collect()}
    compared = I.candidates(asked, str(tmp_path))[0].count()
    pairs = asked.alias("q").join(v.alias("v"), F.expr("q.tenant = v.tenant and q.vec_id <> v.vec_id")).count()
    print(sf, len(exact & found) / len(exact), compared / pairs, I.read_codebook(spark, str(tmp_path)).probes)
    assert len(exact & found) >= 0.9 * len(exact) and (sf == "sf0.01" or compared <= 0.1 * pairs)


def test_odd_vectors(spark, tmp_path):
    odd = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 1, [0.0, 0.0]), (4, 1, None), (5, None, [1.0, 1.0]), (6, 2, [1.0, 1.0])], "vec_id long, tenant int, vector array<double>")
    I.build_index(odd, str(tmp_path / "a"))
    assert [(r["query_id"], r["id"]) for r in I.search_index(odd, odd, str(tmp_path / "a"), 5).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    I.build_index(odd.where("false"), str(tmp_path / "b"))
    assert I.search_index(odd, odd, str(tmp_path / "b"), 5).count() == 0
    assert retrieval.cosine_topk(odd.where("false"), odd, 3).count() == 0


def test_a_part_holds_few_scores_at_once(rows, monkeypatch):
    """However many queries and items a part has, no more than BLOCK scores are in memory; the results are those of all at once."""
    import pyarrow as pa

    monkeypatch.setattr(I, "BLOCK", 2000)
    seen = []
    score = lambda q, v: seen.append(len(q) * len(v)) or I.cosines(q, v)
    vector = lambda name, some: pa.table({name: [r[0] for r in some], "q" if name == "query_id" else "vector": [r[2] for r in some]})
    found = I._exact(6, score, 0.5)(vector("query_id", rows[::20]), vector("id", rows)).to_pylist()
    want = {w[:3] for w in best(rows, rows[::20], 6, 0.5, False)}
    assert {(r["query_id"], r["id"], r["score"]) for r in found} == want and max(seen) <= 2000 and sum(seen) == 45 * 900


def test_contradictions_by_parts(spark, rows, vectors, monkeypatch):
    """Alike in the first four dimensions and unlike in the rest, whatever parts the vectors are dealt into; nothing is compared pair by pair."""
    from tidemark.operators import fusion

    monkeypatch.setattr(I.dealt, "__defaults__", (40, 7))
    cos = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    want = set()
    for a, t, x in rows[::20]:
        scored = sorted((-round(cos(x[:4], y[:4]) - cos(x[4:], y[4:]), 6), b) for b, u, y in rows if b != a and u == t)
        want |= {(a, b, -s, n) for n, (s, b) in enumerate(scored[:3], 1)}
    found = fusion.contradiction_rank(vectors.where("vec_id % 20 = 0"), vectors, 4, 3)
    assert {(r["query_id"], r["id"], r["score"], r["rank"]) for r in found.collect()} == want
    assert "CoGroup" in found._jdf.queryExecution().toString()


def test_contradictions_without_vectors_come_last(spark):
    from tidemark.operators import fusion

    some = spark.createDataFrame([(1, 1, [1.0, 0.0, 1.0]), (2, 1, None), (3, 1, [1.0, 0.0, -1.0]), (4, 1, None), (5, 2, [1.0, 1.0, 1.0])], "vec_id long, tenant int, vector array<double>")
    found = fusion.contradiction_rank(some.where("vec_id < 3"), some, 1, 2).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found) == [(1, 1, 3, 2.0), (1, 2, 2, None), (2, 1, 1, None), (2, 2, 3, None)]
