"""Benchmark decontamination: rare word sequences as seeds, then local alignment.

Words are lower-cased in A-Z, and punctuation counts as blank. A copy is a passage whose local
alignment with the item by Smith-Waterman over words (match 2, mismatch and gap -1) has MIN_SCORE of
the item's full score, edited or not.

Seeds are pairs of words of an item, one or two apart, and hit pairs of a text that are one or two
apart. An alignment of m matches and e edits scores 2m - e, so if that is s or more, at most m - s/2
of its m - 1 steps from match to match can hold two edits; the others, s/2 - 1 at least, are hits from
as many positions of the item and of the text, all within 3n - s words of an item of n. Of these
`need`, an item leaves out less than half for its most frequent positions, so its rarer pairs are its
seeds, and need falls by as many. Where a text has that many hits so close together, the passage around
them is aligned: no pair that would reach MIN_SCORE is missed, whatever the counts.

Items are taken in blocks of at most BLOCK words, each against all texts, so what is broadcast has a
fixed bound however many items there are; each block passes through the driver and costs two scans of the
texts, so the work grows with texts times blocks. Items of fewer than MIN_WORDS words are not looked for.
Null and empty texts match nothing. Items without an id are reported with a null id; repeated items and
repeated rows are reported each. Empty tables match nothing. Further columns are left as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm import _text
from tidemark.llm._tables import free_name

MIN_WORDS = 3
MIN_SCORE = 0.5
#: Words of a block of items: 8 bytes for each word and each pair.
BLOCK = 1 << 20
_BLANK = np.frombuffer(b".,;:!?\"'()[]{}-", dtype=np.uint8)


def _plain(data: np.ndarray) -> np.ndarray:
    out = _text.LOWER[data]
    out[np.isin(data, _BLANK)] = 32
    return out


def _pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """The hash of each word with the one so far behind it."""
    with np.errstate(over="ignore"):
        return _text.mix(_text.mix(words[:-apart]) + words[apart:])


@dataclass
class Items:
    """A block of test items: word hashes, and the pairs with their items."""

    ids: list
    words: list[np.ndarray] = field(default_factory=list)
    pairs: np.ndarray | None = None  # distinct, sorted
    owner: np.ndarray | None = None  # items of seeds, by seed
    first: np.ndarray | None = None  # where each pair's owners begin
    need: np.ndarray | None = None  # hits that a copy has at least, by item
    reach: np.ndarray | None = None  # words that a copy spans at most, by item

    @staticmethod
    def of(ids: list, texts: list[str | None]) -> Items:
        data, offsets = _text.utf8(pa.array(texts, type=pa.string()))
        parts = _text.words(_plain(data), offsets)
        out = Items(ids, [parts.hash[a:b] for a, b in zip(parts.bounds[:-1], parts.bounds[1:], strict=True)])
        found = [_pairs(w, apart) for w in out.words if len(w) >= MIN_WORDS for apart in (1, 2)]
        out.pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
        return out

    def choose(self, frequency: np.ndarray) -> None:
        """The pairs of each item become its seeds, but for its most frequent positions."""
        size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.need = np.maximum(1, np.ceil(size * MIN_SCORE - 1).astype(np.int64))
        self.reach = np.ceil(size * (3 - 2 * MIN_SCORE)).astype(np.int64)
        seeds = []
        for n, words in enumerate(self.words):
            if len(words) >= MIN_WORDS:
                near, far = (np.searchsorted(self.pairs, _pairs(words, apart)) for apart in (1, 2))
                count = frequency[near] + np.append(frequency[far], 0)
                common = (int(self.need[n]) - 1) // 2
                self.need[n] -= common
                rare = np.argsort(count, kind="stable")[: len(near) - common]
                own = np.unique(np.append(near[rare], far[rare[rare < len(far)]]))
                seeds.append(np.stack([own, np.full(len(own), n)]))
        both = np.concatenate(seeds, axis=1) if seeds else np.zeros((2, 0), dtype=np.int64)
        order = np.argsort(both[0], kind="stable")
        self.owner = both[1][order]
        self.first = np.searchsorted(both[0][order], np.arange(len(self.pairs) + 1))

    def hits(self, parts: _text.Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of pairs of the block, and which they are."""
        doc, out = parts.doc(), []
        for apart in (1, 2):
            pairs = _pairs(parts.hash, apart)
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            found = np.flatnonzero((self.pairs[at] == pairs) & (doc[:-apart] == doc[apart:]))
            out.append((found, at[found]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Share of the full score of the best local alignment, and the words of the passage that it spans."""
    n = len(passage)
    row, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(passage == word, 2, -1)
        new, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
        diagonal, down = row[:-1] + step, row[1:] - 1
        new[1:] = np.maximum(0, np.maximum(diagonal, down))
        start[1:] = np.where(new[1:] == 0, ramp[1:], np.where(diagonal >= down, begin[:-1], begin[1:]))
        reach = np.maximum.accumulate(new + ramp)  # a gap along the passage costs one for each word
        along = reach - ramp
        source = np.maximum.accumulate(np.where(new + ramp == reach, ramp, 0))
        start = np.where(along > new, start[source], start)
        row, begin = np.maximum(new, along), start
        at = int(row.argmax())
        if row[at] > best[0]:
            best = int(row[at]), int(begin[at]), at
    return best[0] / (2 * len(item)), best[1], best[2]


def find_items(items: Items, parts: _text.Words) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end) of the best alignment of each pair with MIN_SCORE."""
    at, pair = items.hits(parts)
    count = items.first[pair + 1] - items.first[pair]
    if not count.sum():
        return []
    place = np.repeat(items.first[pair] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
    at, item = np.repeat(at, count), items.owner[place]
    order = np.lexsort((at, item))
    at, item = at[order], item[order]
    once = np.append(True, (np.diff(item) != 0) | (np.diff(at) != 0))  # both pairs of a position are one hit
    at, item = at[once], item[once]
    doc = np.searchsorted(parts.bounds, at, side="right") - 1
    # Windows of the hits that a copy needs, within its reach; those of one text and item whose margins meet are one passage.
    head = np.arange(len(at))
    tail = head + items.need[item] - 1
    head, tail = head[tail < len(at)], tail[tail < len(at)]
    close = (item[tail] == item[head]) & (doc[tail] == doc[head]) & (at[tail] - at[head] <= items.reach[item[head]])
    head, tail = head[close], tail[close]
    if not len(head):
        return []
    low, high, reach = at[head], at[tail], items.reach[item[head]]
    new = np.append(True, (np.diff(item[head]) != 0) | (np.diff(doc[head]) != 0) | (low[1:] - high[:-1] > 2 * reach[1:]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(head)) - 1
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        d, i, margin = int(doc[head[a]]), int(item[head[a]]), int(reach[a])
        begin, end = max(int(parts.bounds[d]), int(low[a]) - margin), min(int(parts.bounds[d + 1]), int(high[b]) + margin + 1)
        score, start, stop = align(items.words[i], parts.hash[begin:end])
        if score >= MIN_SCORE and score > best.get((d, i), (0,))[0]:
            base = begin - int(parts.bounds[d])
            best[d, i] = score, base + start, base + stop
    return [(d, i, *rest) for (d, i), rest in best.items()]


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks, streamed through the driver one block at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len((row["text"] or "").split())
        if size >= BLOCK:
            yield Items.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts)


def _with_seeds(docs: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of items whose seeds are chosen by the count of their pairs in docs."""
    for items in _blocks(benchmark):
        if not len(items.pairs):
            continue
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def counted(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value.pairs), dtype=np.int64)
            for batch in batches:
                for _, data, offsets in _text.slices(batch, "text"):
                    total += np.bincount(sent.value.hits(_text.words(_plain(data), offsets))[1], minlength=len(total))
            pair = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(total[pair])})

        rows = docs.select("text").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        frequency = np.zeros(len(items.pairs), dtype=np.int64)
        frequency[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
        items.choose(frequency)
        yield items


def find_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every text of docs (doc_id, text) that holds an item, for its best alignment."""
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, score double, first_word long, end_word long"
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for items in _with_seeds(docs, benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def located(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in _text.slices(batch, "text"):
                    found = find_items(sent.value, _text.words(_plain(data), offsets))
                    if found:
                        doc, item, score, start, stop = zip(*found, strict=True)
                        ids = pa.array([sent.value.ids[i] for i in item], type=id_type)
                        yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(doc)), "item_id": ids, "score": score, "first_word": start, "end_word": stop})

        part = docs.select("doc_id", "text").mapInArrow(located, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _contaminated(docs: DataFrame, items: Items, column: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf("boolean")
    def holds(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out = []
            batch = pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string())], ["text"])
            for part, data, offsets in _text.slices(batch, "text"):
                flag = np.zeros(part.num_rows, dtype=bool)
                flag[[f[0] for f in find_items(sent.value, _text.words(_plain(data), offsets))]] = True
                out.append(flag)
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, dtype=bool))

    return docs.withColumn(column, holds("text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a benchmark item in documents, one row for each text and item."""
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that hold no copy of a benchmark item, unchanged."""
    column = free_name(docs, "copy_")
    out = docs
    for items in _with_seeds(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        out = _contaminated(out, items, column).where(~F.col(column)).drop(column)
    return out
