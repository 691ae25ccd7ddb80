"""Periodic runs against all lags compared word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every maximal stretch of every lag; those with a smaller period go."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                stretch = words[i : j + q]
                if not any(all(stretch[k] == stretch[k + p] for k in range(len(stretch) - p)) for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda x: (x[0], x[2]))


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode()) & 0xFFFFFFFF
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *numbers, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    out = [None, "", " \n", "a", "a " * 5, "a " * 6, "a " * 7, "a b " * 3, "a b " * 4, "a b a b a b a b a", "x " * 3000, "a a b " * 400, "é 𝕏 " * 9, "p\x1cq r " * 8]
    for size in (1, 2, 3, 5, 9):  # few different words make many short runs
        out += [" ".join(rng.choice("abcdefghi"[:size]) for _ in range(rng.randrange(5, 120))) for _ in range(30)]
    for q in (3, 4, 5, 7, 8, 9, 16, 17, 40, 65):
        period = [rng.choice("abcd") for _ in range(q)]
        times = 4 * q + rng.randrange(-1, 2 * q)
        out.append(" ".join(["z"] * rng.randrange(3) + [period[i % q] for i in range(times)] + ["y"] + [period[i % q] for i in range(times)]))
    # Every pair of letters occurs twice within the period, so that short grams recur at other lags than it.
    cycle = list("aabbccacbaabbcbaccab")
    out += [" ".join(cycle * 5), " ".join(cycle[:11] * 4 + cycle * 6)]
    return out


def test_runs_of_words(texts):
    for text in texts:
        words = WORD.findall(text or "")
        codes = {w: np.uint64(n * 0x9E3779B97F4A7C15 % 2**64) for n, w in enumerate(dict.fromkeys(words), 1)}
        hashes = np.array([codes[w] for w in words], dtype=np.uint64)
        assert runs.find_runs(hashes, np.array([0, len(words)])) == plain_runs(words), text
    # Texts that lie one after another don't run into each other.
    both = np.concatenate([np.full(5, 7, np.uint64), np.full(6, 7, np.uint64), np.full(3, 7, np.uint64)])
    assert runs.find_runs(both, np.array([0, 5, 5, 11, 14])) == [(5, 6, 1)]


def test_query(spark, texts, tmp_path):
    rows = [(n, t) for n, t in enumerate(texts * 3)] + [(None, "a b c " * 9), (7, texts[-1]), (7, texts[-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS runs", "2 AS best")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(str(x) for x in r)
    found = sorted((tuple(r) for r in runs.op12_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert found == sorted((expected(*r) for r in rows), key=key)
    assert any(runs.planted(r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_what_is_left_of_texts(spark):
    docs = spark.createDataFrame([("k", "so it goes on and on and on and on and on it goes")], "doc_id string, text string")
    row = runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(3, 9, 2)] and row["collapsed"] == "so it goes on and it goes" and row["n_words"] == 14


def test_equal_words_take_few_steps():
    """A text of one word has n places of one gram: one seed is extended, and no pairs of places are listed."""
    words = np.full(400_000, 5, dtype=np.uint64)
    assert runs.find_runs(words, np.array([0, len(words)])) == [(0, 400_000, 1)]
    rng = np.random.default_rng(1)
    period = rng.integers(1, 2**60, 1000).astype(np.uint64)
    assert runs.find_runs(np.tile(period, 300), np.array([0, 300_000])) == [(0, 300_000, 1000)]
