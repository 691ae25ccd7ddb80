"""Removal of word sequences that occur more than once, by automata over recurring passages.

1. Candidates. In each window of `width` words the `GRAM`-word sequence with the least hash is its
   anchor. Equal windows have equal anchors, so a window whose anchor occurs once is unique. Neighbouring
   windows with one anchor make a segment, the text from the first's start to the last's end.
2. Confirmation. Segments of all documents whose anchors recur are dealt by anchor into shards of about
   SHARD_BYTES, so equal windows meet in one. As a shard streams by, windows that have been seen before
   confirm passages, the longest stretches of such windows. No hash decides here, texts are compared.
3. Location. The passages of each shard are compiled into an Aho-Corasick automaton over words, and all
   segments of the shard are streamed through it. Its patterns are the passages cut into blocks of
   (width + 1) / 2 words; every window holds one of them whole, and around a block that is found the
   windows are compared word for word. Words under windows found so go; without the automaton none would.

A shard that turns out too large is cut within its task by the anchors of another hash, and so on, so what
automata and sets of windows hold is bounded whatever one anchor brings along.

Segments of an anchor with more than FEW of them and more than one in HOT of all could overfill a shard.
Their windows are counted by 128-bit hashes instead; those that occur once are located by the
aggregate itself, all others go. So a passage that a third of the documents hold collapses before the
shuffle, and nothing is joined back on a hash.

Null and empty texts have no words. Repeated rows are occurrences of their own. Rows with a null id are
kept and judged like any other. An empty table gives an empty one. Columns other than doc_id and text are
not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._tables import written

WIDTH = 35
GRAM = 8
#: Text of the segments of one shard, about; what is built from it takes some twenty times as much memory.
SHARD_BYTES = 4 << 20
#: A shard may turn out larger, by chance or by one frequent anchor; beyond so many times SHARD_BYTES it is cut by further anchors, CUTS deep at most.
LARGE, CUTS = 8, 4
#: Bytes of a segment, about.
SEGMENT_BYTES = 280
HOT = 1 << 20
FEW = 64


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` neighbouring values is, the first of equal ones (short at the end)."""
    least, where, span = values.copy(), np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        later = np.flatnonzero(least[step:] < least[:-step])
        value, place = least[later + step], where[later + step]
        least[later], where[later] = value, place
        span += step
    return where


class Windows:
    """The windows of the texts of a slice: word positions, runs of neighbours with one anchor, and the runs' texts and anchors."""

    def __init__(self, parts: _text.Words, width: int, cut: int = 0) -> None:
        """cut: which of several independent hashes names the anchor."""
        self.at = self.run = self.first = np.zeros(0, dtype=np.int64)
        self.anchor = np.zeros(0, dtype=np.uint64)
        if len(parts.hash) >= width:
            self.at, grams = np.flatnonzero(parts.whole(width)), parts.grams(GRAM)
            grams = _text.mix(grams ^ np.uint64(cut)) if cut else grams
            if len(self.at):
                place = sliding_argmin(grams, width - GRAM + 1)[self.at]
                new = np.append(True, (np.diff(place) != 0) | (np.diff(self.at) != 1))
                self.first, self.run = np.flatnonzero(new), np.cumsum(new) - 1
                self.anchor = grams[place[self.first]]
        self.doc = np.searchsorted(parts.bounds, self.at[self.first], side="right") - 1


def _batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _in_lists(lists: pa.Array, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which of the values are in their texts' lists."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
    listed = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.isin(_text.mix(value ^ _text.mix(doc.astype(np.uint64))), _text.mix(listed ^ _text.mix(owner)))


def _window_keys(parts: _text.Words, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows at those words."""
    return _text.ranges(parts.hash, at, at + width), _text.ranges(_text.mix(parts.hash ^ np.uint64(0x5851F42D4C957F2D)), at, at + width)


def _emit_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _text.slices(batch, "text"):
                windows = Windows(_text.words(data, offsets), width)
                yield _batch(hash=_signed(windows.anchor), key=part.column("key").to_numpy()[windows.doc])

    return run


def _candidates(part: pa.RecordBatch, parts: _text.Words, width: int, hot: np.ndarray) -> tuple[Windows, np.ndarray, np.ndarray]:
    """The windows of a slice, which runs have an anchor that recurs, and which of those a hot one."""
    windows = Windows(parts, width)
    again = ~_in_lists(part.column("lone"), windows.doc, windows.anchor)
    at = np.minimum(np.searchsorted(hot, windows.anchor), max(0, len(hot) - 1))
    return windows, again, again & (hot[at] == windows.anchor) if len(hot) else np.zeros(len(again), dtype=bool)


def _emit_windows(width: int, sent):
    """(h1, h2, key) of the windows with hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _text.slices(batch, "text"):
                parts = _text.words(data, offsets)
                windows, _, some = _candidates(part, parts, width, sent.value)
                if some.any():
                    use = some[windows.run]
                    h1, h2 = _window_keys(parts, windows.at[use], width)
                    yield _batch(h1=_signed(h1), h2=_signed(h2), key=part.column("key").to_numpy()[windows.doc[windows.run[use]]])

    return run


def _emit_segments(width: int, shards: int, sent):
    """(shard, key, check, pos, text) of the runs whose anchor recurs and isn't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _text.slices(batch, "text"):
                parts = _text.words(data, offsets)
                windows, again, hot = _candidates(part, parts, width, sent.value)
                runs = np.flatnonzero(again & ~hot)
                if not len(runs):
                    continue
                text = b" ".join(_text.joined(parts, np.ones(len(parts.hash), dtype=bool)))
                # Texts without words leave a blank each.
                size = parts.end - parts.start + 1
                ends = np.cumsum(size) + np.repeat(np.cumsum(parts.counts == 0), parts.counts)
                a, b = windows.at[windows.first[runs]], windows.at[np.append(windows.first[1:], len(windows.at))[runs] - 1] + width - 1
                cuts = [text[low:high] for low, high in zip((ends[a] - size[a]).tolist(), (ends[b] - 1).tolist(), strict=True)]
                doc = windows.doc[runs]
                yield _batch(
                    shard=(windows.anchor[runs] % np.uint64(shards)).astype(np.int32), key=part.column("key").to_numpy()[doc], check=part.column("check").to_numpy()[doc],
                    pos=(a - parts.bounds[doc]).astype(np.int32), text=pa.array(cuts, pa.binary()),
                )

    return run


class Passages:
    """Passages of a shard, confirmed as texts come by, and their automaton. A text is a string with a character for each word."""

    def __init__(self, width: int) -> None:
        self.width, self.block = width, (width + 1) // 2
        self.letters: dict[bytes, str] = {}
        self.seen: set[str] = set()
        self.windows: set[str] = set()
        self.passages: set[str] = set()
        self.automaton: ahocorasick.Automaton | None = None

    def spelled(self, text: bytes) -> str:
        letters = self.letters
        try:
            return "".join([letters[word] for word in text.split(b" ")])
        except KeyError:
            for word in text.split(b" "):
                if word not in letters:
                    n = len(letters) + 1
                    letters[word] = chr(n if n < 0xD800 else n + 0x800)
            return self.spelled(text)

    def confirm(self, line: str) -> None:
        """Stretches of windows of a text that have come by before are passages."""
        width, begin = self.width, None
        for i in range(len(line) - width + 1):
            window = line[i : i + width]
            if window in self.seen:
                self.windows.add(window)
                begin = i if begin is None else begin
            else:
                self.seen.add(window)
                if begin is not None:
                    self.passages.add(line[begin : i - 1 + width])
                    begin = None
        if begin is not None:
            self.passages.add(line[begin:])

    def compile(self) -> None:
        self.seen.clear()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for line in self.passages:
            for i in range(0, len(line) - self.block + 1, self.block):
                self.automaton.add_word(line[i : i + self.block])
        self.automaton.make_automaton()

    def covered(self, line: str) -> list[tuple[int, int]]:
        """Ranges of words of a text that windows of the passages cover."""
        out: list[tuple[int, int]] = []
        if not self.passages:
            return out
        width, done, most = self.width, 0, len(line) - self.width
        for end, _ in self.automaton.iter(line):
            start = end - self.block + 1  # of the block; the windows around it begin up to width - block earlier
            for i in range(max(done, start - width + self.block), min(start, most) + 1):
                if line[i : i + width] in self.windows:
                    if out and i <= out[-1][1]:
                        out[-1] = out[-1][0], i + width
                    else:
                        out.append((i, i + width))
            done = max(done, start + 1)
        return out


def _cuts(rows: list[tuple], width: int, cut: int, n: int) -> Iterator[list[tuple]]:
    """The segments of a shard in n parts, one after another, by the anchor of another hash; equal windows fall to one part."""
    for which in range(n):
        out = []
        for some in range(0, len(rows), 4096):
            batch = rows[some : some + 4096]
            data = np.frombuffer(b"".join(text for *_, text in batch), dtype=np.uint8)
            parts = _text.words(data, np.cumsum([0, *(len(text) for *_, text in batch)]))
            windows = Windows(parts, width, cut)
            runs = np.flatnonzero(windows.anchor % np.uint64(n) == which)
            a, b = windows.at[windows.first[runs]], windows.at[np.append(windows.first[1:], len(windows.at))[runs] - 1] + width - 1
            low, high, doc = parts.start[a].tolist(), parts.end[b].tolist(), windows.doc[runs].tolist()
            text, before = data.tobytes(), parts.bounds[windows.doc[runs]]
            for d, skip, x, y in zip(doc, (a - before).tolist(), low, high, strict=True):
                key, check, pos, _ = batch[d]
                out.append((key, check, pos + skip, text[x:y]))
        if out:
            yield out


def _located(rows: list[tuple], width: int, most: int, cut: int = 1) -> Iterator[pa.RecordBatch]:
    """(key, check, first, last) of the words under recurring windows, from the segments (key, check, pos, text) of a shard."""
    size = sum(len(text) for *_, text in rows)
    if size > most and cut <= CUTS:
        for part in _cuts(rows, width, cut, -(-2 * size // most)):
            yield from _located(part, width, most, cut + 1)
        return
    passages = Passages(width)
    lines = [passages.spelled(text) for *_, text in rows]
    for line in lines:
        passages.confirm(line)
    passages.compile()
    found = [(key, check, pos + a, pos + b) for (key, check, pos, _), line in zip(rows, lines, strict=True) for a, b in passages.covered(line)]
    key, check, first, last = zip(*found, strict=True) if found else ((), (), (), ())
    yield _batch(key=pa.array(key, pa.int64()), check=pa.array(check, pa.int64()), first=pa.array(first, pa.int32()), last=pa.array(last, pa.int32()))


def _locate(width: int, most: int):
    """What _located finds, shard by shard; rows come in order of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if rows:
                        yield from _located(rows, width, most)
                    shard, rows = s, []
                rows.append(row)
        if rows:
            yield from _located(rows, width, most)

    return run


def _emit_kept(width: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _text.slices(batch, "text"):
                parts = _text.words(data, offsets)
                lists = part.column("gone")
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ranges, doc = lists.flatten(), np.repeat(np.arange(part.num_rows), sizes)
                own = ranges.field("check").to_numpy() == part.column("check").to_numpy()[doc]  # not of another row with the same key
                first, last = (parts.bounds[doc] + ranges.field(n).to_numpy() for n in ("first", "last"))
                depth = np.zeros(len(parts.hash) + 1, dtype=np.int64)
                np.add.at(depth, first[own], 1)
                np.add.at(depth, last[own], -1)
                windows, _, hot = _candidates(part, parts, width, sent.value)
                use = np.flatnonzero(hot[windows.run]) if len(windows.at) else windows.at
                if len(use):
                    h1, h2 = _window_keys(parts, windows.at[use], width)
                    again = windows.at[use[~_in_lists(part.column("single"), windows.doc[windows.run[use]], h1 ^ h2)]]
                    np.add.at(depth, again, 1)
                    np.add.at(depth, again + width, -1)
                gone = np.cumsum(depth)[:-1] > 0
                kept = _text.joined(parts, ~gone)
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), parts.bounds[:-1]) * (parts.counts > 0)
                yield _batch(
                    doc_id=part.column("doc_id"), n_words=parts.counts.astype(np.int64), n_removed=removed,
                    kept_sha256=pa.array([hashlib.sha256(t).hexdigest() for t in kept]), kept=pa.array([t.decode() for t in kept]),
                )

    return run


def drop_repeated_phrases(docs: DataFrame, width: int = WIDTH, with_text: bool = True, shard_bytes: int = SHARD_BYTES, few: int = FEW) -> DataFrame:
    """For each row of docs (doc_id, text): n_words, n_removed, kept_sha256 and, if asked for, the kept text.

    Texts are shuffled once, by a key of their own, and that shuffle serves all three passes. Rows that
    share a key share lists of hashes, which name words, not places, and the places found carry 64 bits
    more, so two different texts would have to agree in 128 bits to do each other harm.
    """
    key = F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("check")
    docs = docs.select("doc_id", "text").select("doc_id", "text", *key)
    kind = dict(docs.dtypes)["doc_id"]
    anchors = docs.select("key", "text").mapInArrow(_emit_anchors(width), "hash long, key long")
    anchors = written(anchors.groupBy("hash").agg(F.count("*").alias("n"), F.min("key").alias("key")), "anchors")
    total = anchors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("again")).first()
    hot = anchors.where((F.col("n") > few) & (F.col("n") * HOT > total["all"])).select("hash").toArrow().column("hash")  # fewer than HOT
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(hot.to_numpy().view(np.uint64)))
    shards = max(1, -(-total["again"] * SEGMENT_BYTES // shard_bytes))
    tasks = min(shards, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    every = ("doc_id", "text", "key", "check")
    lone = anchors.where("n = 1").groupBy("key").agg(F.collect_list("hash").alias("lone"))
    marked = docs.join(lone.hint("shuffle_hash"), "key", "left").select(*every, "lone")
    windows = marked.mapInArrow(_emit_windows(width, sent), "h1 long, h2 long, key long")
    single = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    single = single.groupBy("key").agg(F.collect_list(F.col("h1").bitwiseXOR(F.col("h2"))).alias("single"))
    parts = marked.mapInArrow(_emit_segments(width, shards, sent), "shard int, key long, check long, pos int, text binary")
    found = parts.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_locate(width, LARGE * shard_bytes), "key long, check long, first int, last int")
    gone = found.groupBy("key").agg(F.collect_list(F.struct("check", "first", "last")).alias("gone"))
    out = marked.join(single.hint("shuffle_hash"), "key", "left").join(gone.hint("shuffle_hash"), "key", "left").select(*every, "lone", "single", "gone")
    out = out.mapInArrow(_emit_kept(width, sent), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")


def op3_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents without its 35-word sequences that occur elsewhere."""
    return drop_repeated_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
