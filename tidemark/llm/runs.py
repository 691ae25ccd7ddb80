"""Periodic runs of words within texts: seeds of equal k-grams, extended along diagonals.

A run is a stretch of words with smallest period q, at least max(LEAST_WORDS, REPEATS * q) long, that no
neighbouring word extends with that period. Its words equal those q before them over its length less q, so
every run of period q has a k-gram that occurs again q words on, if k is not over that overlap. Periods are
searched in levels (half, whole] of a power of two. A level's k is the least overlap that its runs
have, and not below the level's longest period: then the grams of a run occur in it at multiples of the
period only, so the next occurrence of a gram gives the pair to be looked at, and all pairs of a gram's
occurrences needn't be listed. Only places where grams of the shortest k recur go into an index at all.

Seeds (place, lag) are taken by lag, then place. A table of how far each lag's diagonal has been covered
skips seeds that an earlier one has reached; the others are extended both ways, word by word in doubling
steps. Each text is worked on where it was read: nothing is shuffled, and work grows with a text's words times the
levels that it has, by arrays of one slice of texts at a time. Words are compared by 64-bit hashes within one text.

Texts may be read with their ends made periodic (`planted`, a fixed rule on the id). A null text has no words, as
has an empty one; a null id plants nothing. Rows are never merged. An empty table gives an empty one. Columns other than doc_id and
text are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text

LEAST_WORDS, REPEATS = 6, 4
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def levels(longest: int) -> Iterator[tuple[int, int, int]]:
    """(first period, last period, k) of each level that a text of so many words may need."""
    whole = 1
    while True:
        first = whole // 2 + 1
        if max(LEAST_WORDS, REPEATS * first) > longest:
            return
        yield first, whole, max(LEAST_WORDS - first, (REPEATS - 1) * first)
        whole *= 2


def planted(doc_id: object, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on, a text of n words repeats its words a to a + p; None for most ids."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _grams(total: np.ndarray, inverse: np.ndarray, at: np.ndarray, k: int, salt: np.ndarray) -> np.ndarray:
    """Hashes of the k words from each place on, different for each text."""
    with np.errstate(over="ignore"):
        return _text.mix((total[at + k] - total[at]) * inverse[at] + salt)


def _next_equal(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs again, and the next place of it; `at` ascends."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return at[order[:-1][same]], at[order[1:][same]]


def _reach(words: np.ndarray, i: int, j: int, limit: int, step: int) -> int:
    """How many words from i and j on, in the direction of step and at most `limit`, are equal."""
    done, size = 0, 16
    while done < limit:
        size = min(size * 2, limit - done)
        a, b = (words[i + done : i + done + size], words[j + done : j + done + size]) if step > 0 else (words[i - done - size + 1 : i - done + 1][::-1], words[j - done - size + 1 : j - done + 1][::-1])
        differ = np.flatnonzero(a != b)
        if len(differ):
            return done + int(differ[0])
        done += size
    return limit


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; words: hashes, bounds: of the texts that lie one after another."""
    counts = np.diff(bounds)
    longest = int(counts.max(initial=0))
    if longest < LEAST_WORDS:
        return []
    doc = np.repeat(np.arange(len(counts)), counts)
    left = bounds[1:][doc] - np.arange(len(words))  # words from here to the text's end
    power, inverse = _text._power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words * power[: len(words)], out=total[1:])
        salt = _text.mix(doc.astype(np.uint64) + np.uint64(1))
    shortest = LEAST_WORDS - 1
    at = np.flatnonzero(left >= shortest)
    first, second = _next_equal(_grams(total, inverse, at, shortest, salt[at]), at)
    recurs = np.zeros(len(words) + 1, dtype=bool)
    recurs[first] = recurs[second] = True
    # From each place on: how many places in a row recur.
    stops = np.flatnonzero(~recurs)
    row = stops[np.searchsorted(stops, np.arange(len(words)))] - np.arange(len(words))
    found: list[tuple[int, int, int]] = []
    for low, high, k in levels(longest):
        at = np.flatnonzero((row > k - shortest) & (left >= k))
        if not len(at):
            continue
        here, there = _next_equal(_grams(total, inverse, at, k, salt[at]), at)
        lag = there - here
        near = (lag >= low) & (lag <= high) & (doc[here] == doc[there])
        here, lag = here[near], lag[near]
        order = np.lexsort((here, lag))
        here, lag = here[order], lag[order]
        new = np.ones(len(here), dtype=bool)
        new[1:] = (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1)  # the next place on a diagonal is covered by the one before
        covered: dict[int, int] = {}
        for i, q in zip(here[new].tolist(), lag[new].tolist(), strict=True):
            if i < covered.get(q, -1):
                continue
            start, end = int(bounds[doc[i]]), int(bounds[doc[i] + 1])
            begin = i - _reach(words, i - 1, i + q - 1, i - start, -1)
            stop = i + _reach(words, i, i + q, end - q - i, 1)
            covered[q] = stop
            length = stop - begin + q
            if length >= max(LEAST_WORDS, REPEATS * q):
                found.append((begin, length, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _read(ids: list, words: _text.Words) -> _text.Words:
    """The words of texts as the rule of `planted` has them."""
    source = np.arange(len(words.start))
    for n, (doc_id, count) in enumerate(zip(ids, words.counts.tolist(), strict=True)):
        if rule := planted(doc_id, count):
            a, p = rule
            first, last = int(words.bounds[n]) + a, int(words.bounds[n + 1])
            source[first:last] = first + np.arange(last - first) % p
    return _text.Words(words.data, words.start[source], words.end[source], words.bounds, words.hash[source])


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, n_words, runs (start, length, period), by start and period, and collapsed.

    collapsed: the words joined by one space, without those that some run holds after its first period.
    plant: read texts by the rule of `planted`.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _text.slices(batch, "text"):
                words = _text.words(data, offsets)
                if plant:
                    words = _read(part.column(0).to_pylist(), words)
                bounds = words.bounds
                found = find_runs(words.hash, bounds)
                dropped = np.zeros(len(words.hash) + 1, dtype=np.int64)
                for start, length, period in found:
                    dropped[start + period] += 1
                    dropped[start + length] -= 1
                text = _text.joined(words, np.cumsum(dropped[:-1]) == 0)
                start, length, period = np.array(found, dtype=np.int64).reshape(-1, 3).T
                of = np.searchsorted(bounds, start, side="right") - 1
                edges = np.searchsorted(of, np.arange(part.num_rows + 1))
                runs = pa.StructArray.from_arrays([pa.array(start - bounds[of]), pa.array(length), pa.array(period)], fields=list(_RUNS.value_type))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words.counts), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), runs), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its runs, texts read by the rule of `planted`."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
    # Longest first, then by start and period; null where there is no run.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.withColumns({"best": best, "listed": listed})
    length, period = -F.col("best.shorter"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: All lags up to a quarter of each text's words: equal words at that lag, put together to stretches. 3988292384 is the polynomial of crc32.
ORACLE = r"""WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
  xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::HUGEINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS HUGEINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CAST(CASE WHEN x >= 0 THEN xor(CAST(r AS UBIGINT), CAST(x AS UBIGINT)) ELSE xor(CAST(r AS UBIGINT) >> 1, 3988292384::UBIGINT * (CAST(r AS UBIGINT) & 1::UBIGINT)) END AS HUGEINT))::UBIGINT) AS h FROM documents),
g AS (SELECT doc_id, words, CAST(len(words) AS BIGINT) AS n, h % 10 = 0 AND len(words) > 0 AS planted, CAST(h // 10 AS BIGINT) AS g FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, i, n, words[CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed, first({'s': start, 'l': length, 'q': q} ORDER BY length DESC, start, q) AS best FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256 FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN kept USING (doc_id)"""
