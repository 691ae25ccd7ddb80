"""Language-model scores: prediction by partial matching over bytes, beside a smoothed unigram base.

The model is a trie of byte contexts, counted over every training text; byte 0xFF, which UTF-8 never
holds, stands before each text and ends it. Escapes are estimated by method C (as many as a context has
symbols), and symbols that a longer context offers are excluded from shorter ones. It has two parts.

Short contexts, of up to three bytes, give a distribution for each byte. Orders 0 to 2 are a table of
fixed size, each order excluding just what the next longer one offers. A context of three bytes keeps its
own symbols; its escape goes to the order below, whose other symbols are scaled up to take its place.

Deep contexts are the DEEP bytes before an anchor, and what follows up to the next anchor is the branch
below it, stored as one (a path-compressed trie). Anchors lie where a hash of the last four bytes says so,
about one byte in SPACING, and at the beginning of each text. A branch that occurs c times below a
context with n occurrences of k branches has c / (n + k), and each byte further along it c / (c + 1); if it
has not been seen the model escapes, with k / (n + k), to short contexts. The deep part grows with
the corpus; texts of which another copy was learnt score much higher than their like.

Where things lie: orders 0 to 2 and frequent three-byte contexts are broadcast, as rows of 256 (those with
1/ROWS of all symbols, so ROWS at most) or as entries (a context of k symbols if it has k/ENTRIES of all,
so ENTRIES at most). All other three-byte contexts, the deep part, and the counts of words with less than
1/HEAD of all tokens are tables in Spark, joined by shuffles. Nothing that was counted is left out.

Null texts count as empty: one end token. Rows are never merged; a row with a null id is held out. An
empty training set gives N = 0 and uniform bytes; an empty table an empty one. Columns other than doc_id,
text and those of `train` are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._tables import written

FOLDS, HELD_OUT = 7, 2
ROWS = 1 << 16
ENTRIES = 1 << 22
HEAD = 1 << 20
DEEP, SPACING = 12, 128
EDGE = 0xFF
#: Stands for the end token among the hashes of words.
END = np.uint64(0x5E17_0FF1_7E97_0EED)
#: Stands for the context at the beginning of a text.
BEGIN = np.uint64(0xBE61_0000_0000_0001)
_COUNTS = "kind int, key long, branch long, n long"
_WORD, _GRAM, _BRANCH = range(3)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte and each text's end: its three bytes of context and itself; and where texts begin among them."""
    size = np.diff(offsets)
    starts = np.append(0, np.cumsum(size + 1))
    padded = np.full(len(data) + 4 * len(size), EDGE, dtype=np.uint8)
    doc = np.repeat(np.arange(len(size)), size)
    padded[np.arange(len(data)) + 4 * doc + 3] = data
    first = np.arange(starts[-1]) + 3 * np.repeat(np.arange(len(size)), size + 1)
    wide = padded.astype(np.uint32)
    context = (wide[first] << 16) | (wide[first + 1] << 8) | wide[first + 2]
    return context, padded[first + 3], starts


def branches(symbol: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each branch begins among the symbols (and their end), and the hashes of its context and of itself."""
    wide = symbol.astype(np.uint32)
    last = (wide[:-4] << 24) | (wide[1:-3] << 16) | (wide[2:-2] << 8) | wide[3:-1]
    with np.errstate(over="ignore"):
        anchor = np.flatnonzero(((last * np.uint32(2654435761)) >> np.uint32(16)) % SPACING == 0) + 4
    own = starts[np.searchsorted(starts, anchor, side="right") - 1]
    begin = np.union1d(starts[:-1], anchor[anchor - own >= DEEP])
    end = np.append(begin[1:], len(symbol))
    values = _text.BYTE[symbol]
    context = _text.ranges(values, np.maximum(begin - DEEP, 0), begin)
    context[np.isin(begin, starts[:-1])] = BEGIN
    return np.append(begin, len(symbol)), context, _text.ranges(values, begin, end)


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).astype(np.uint64).view(np.int64)


class _Counts:
    """Counts of keys of this task, given out whenever many have come, so that memory is bounded."""

    def __init__(self, kind: int) -> None:
        self.kind, self.keys, self.counts, self.size = kind, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 1 << 22:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
            counts = np.bincount(place, np.concatenate(self.counts), minlength=len(keys)).astype(np.int64)
            self.keys, self.counts, self.size = [], [], 0
            for at in range(0, len(keys), 1 << 16):
                k = keys[at : at + (1 << 16)]
                yield _counted(self.kind, _signed(k), np.zeros(len(k), dtype=np.int64), counts[at : at + (1 << 16)])


def _counted(kind: int, key: np.ndarray, branch: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(key), kind, dtype=np.int32)), "key": key, "branch": branch, "n": n})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, of three bytes with a fourth, and of branches."""
    words, grams = _Counts(_WORD), _Counts(_GRAM)
    for batch in batches:
        for part, data, offsets in _text.slices(batch, "text"):
            yield from words.add(_text.words(data, offsets, lower=True).hash)
            yield from words.add(np.array([END]), np.array([part.num_rows]))
            context, symbol, starts = contexts(data, offsets)
            yield from grams.add((context << np.uint32(8)) | symbol)
            _, key, branch = branches(symbol, starts)
            yield _counted(_BRANCH, _signed(key), _signed(branch), np.ones(len(key), dtype=np.int64))
    yield from words.flush()
    yield from grams.flush()


class Low:
    """Orders 0 to 2: a row of log10 probabilities for each context of two bytes, or of one where the two were never seen."""

    def __init__(self, key: np.ndarray, n: np.ndarray) -> None:
        """key: two bytes and a symbol; n: counts."""
        with np.errstate(divide="ignore", invalid="ignore"):
            c2 = np.zeros((1 << 16, 256), dtype=np.float32)
            c2.reshape(-1)[key] = n
            c1 = np.zeros((256, 256))
            for first in range(256):
                c1 += c2[first << 8 : (first + 1) << 8]
            c0 = c1.sum(axis=0)
            n0, t0 = np.count_nonzero(c0), c0.sum()
            rest = np.full(256, -np.log10(max(1, 256 - n0)))  # below order 0: unseen symbols, alike
            s1 = c1 > 0
            low0 = self._order(c0, t0 - s1 @ c0, n0 - s1.sum(axis=1), rest)  # order 0 without the symbols of a byte's context
            row0 = self._order(c0, np.array([t0]), np.array([n0]), rest)[0]
            t1, n1 = c1.sum(axis=1), s1.sum(axis=1)
            rows = [np.where((t1 > 0)[:, None], self._order(c1, t1, n1, low0), row0).astype(np.float32)]
            seen = np.unique(key >> 8)
            for at in range(0, len(seen), 4096):
                pair = seen[at : at + 4096]
                b, k2 = pair & 255, c2[pair].astype(float)
                s2, k1 = k2 > 0, c1[b]
                low1 = self._order(k1, t1[b] - (k1 * s2).sum(axis=1), n1[b] - s2.sum(axis=1), low0[b])
                rows.append(self._order(k2, k2.sum(axis=1), s2.sum(axis=1), low1).astype(np.float32))
            self.table = np.concatenate(rows)
            self.row = np.tile(np.arange(256, dtype=np.int32), 256)
            self.row[seen] = 256 + np.arange(len(seen), dtype=np.int32)

    @staticmethod
    def _order(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, below: np.ndarray) -> np.ndarray:
        """log10 probabilities of one order: of its symbols by count, of others by an escape and the order below."""
        total, kinds = np.asarray(total, dtype=float)[:, None], np.asarray(kinds, dtype=float)[:, None]
        escape = np.where(kinds > 0, np.log10(kinds / (total + kinds)), 0.0)
        return np.where(count > 0, np.log10(count / (total + kinds)), escape + below)


def _third(sent):
    """(context, n, symbols, logs, escape): order 3 of each context; what its escape adds to the log of the order below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = sent.value
        for batch in batches:
            lists = batch.column("each")
            if not batch.num_rows:
                continue
            bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            symbol, n = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("symbol", "n"))
            context = batch.column("context").to_numpy()
            row = np.repeat(np.arange(len(context)), np.diff(bounds))
            total, kinds = np.add.reduceat(n, bounds[:-1]), np.diff(bounds)
            taken = np.add.reduceat(10.0 ** low.table[low.row[context & 0xFFFF][row], symbol].astype(float), bounds[:-1])
            escape = np.log10(kinds / (total + kinds)) - np.log10(np.maximum(1 - taken, 1e-9))
            logs = np.log10(n / (total + kinds)[row])
            offsets = pa.array(bounds.astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "context": context, "n": total, "symbols": pa.ListArray.from_arrays(offsets, pa.array(symbol.astype(np.int32))),
                "logs": pa.ListArray.from_arrays(offsets, pa.array(logs)), "escape": escape,
            })

    return run


@dataclass
class Short:
    """What is broadcast of the short contexts."""

    low: Low
    dense: np.ndarray  # contexts of three bytes with rows
    rows: np.ndarray
    some: np.ndarray  # contexts with entries, sorted
    escape: np.ndarray
    entry: np.ndarray  # context and symbol, sorted
    logs: np.ndarray

    @staticmethod
    def of(low: Low, frequent: pa.Table, total: int, rows: int) -> Short:
        n, context = frequent.column("n").to_numpy(), frequent.column("context").to_numpy()
        escape = frequent.column("escape").to_numpy()
        size = frequent.column("symbols").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(n) else np.zeros(0, dtype=np.int64)
        symbol = frequent.column("symbols").combine_chunks().flatten().to_numpy() if len(n) else np.zeros(0, dtype=np.int64)
        logs = frequent.column("logs").combine_chunks().flatten().to_numpy() if len(n) else np.zeros(0)
        owner = np.repeat(np.arange(len(n)), size)
        full = n * rows >= total
        dense = context[full]
        table = low.table[low.row[dense & 0xFFFF]] + escape[full][:, None].astype(np.float32)
        place = np.cumsum(full) - 1
        mine = full[owner]
        table[place[owner[mine]], symbol[mine]] = logs[mine]
        entry = (context[owner[~mine]].astype(np.int64) << 8) | symbol[~mine]
        order, by = np.argsort(entry), np.argsort(context[~full])
        return Short(low, dense, table, context[~full][by], escape[~full][by], entry[order], logs[~mine][order])

    def index(self) -> np.ndarray:
        """The row of each context of three bytes; -1 - row of the order below for those without one."""
        out = np.tile(-1 - self.low.row, 256)
        out[self.dense] = np.arange(len(self.dense), dtype=np.int32)
        return out

    def score(self, index: np.ndarray, context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities, and where the order below stands in for a context that isn't here."""
        at = index[context]
        out = np.empty(len(at))
        here = at >= 0
        out[here] = self.rows[at[here], symbol[here]]
        rest = np.flatnonzero(~here)
        out[rest] = self.low.table[-1 - at[rest], symbol[rest]]
        if not len(self.some):
            return out, rest
        place = np.minimum(np.searchsorted(self.some, context[rest]), len(self.some) - 1)
        known = self.some[place] == context[rest]
        entry = (context[rest].astype(np.int64) << 8) | symbol[rest]
        own = np.minimum(np.searchsorted(self.entry, entry), len(self.entry) - 1)
        seen = known & (self.entry[own] == entry)
        out[rest[known]] += self.escape[place[known]]
        out[rest[seen]] = self.logs[own[seen]]
        return out, rest[~known]


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table.column(c).to_numpy() for c in names]


def fit_short(spark: SparkSession, grams: DataFrame, rows: int = ROWS, entries: int = ENTRIES) -> tuple[Short, DataFrame]:
    """The part that is broadcast, of bounded size, and the table of all three-byte contexts, from counts (key, n) of four bytes."""
    low = Low(*_columns(grams.groupBy((F.col("key") % (1 << 24)).alias("key")).agg(F.sum("n").alias("n")), "key", "n"))  # 2**24 keys at most
    each = F.collect_list(F.struct((F.col("key") % 256).cast("int").alias("symbol"), "n")).alias("each")  # 256 symbols at most
    grouped = grams.groupBy(F.expr("cast(key div 256 as int)").alias("context")).agg(each)
    third = grouped.mapInArrow(_third(spark.sparkContext.broadcast(low)), "context int, n long, symbols array<int>, logs array<double>, escape double")
    third = written(third, "third-order")
    total = third.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = (F.col("n") * rows >= total) | (F.col("n") * entries >= F.size("symbols").cast("long") * F.lit(total))
    return Short.of(low, third.where(frequent).toArrow(), total, rows), third.where(~frequent)


def _score(sent):
    """A row for each text, with lists of what is looked up in tables: tail words, and branches with their rare contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, head_keys, head_logs = sent.value
        index = short.index()
        for batch in batches:
            for part, data, offsets in _text.slices(batch, "text"):
                parts = _text.words(data, offsets, lower=True)
                context, symbol, starts = contexts(data, offsets)
                logs, rare = short.score(index, context, symbol)
                begin, key, branch = branches(symbol, starts)
                low = np.add.reduceat(logs, begin[:-1])
                offset = pa.array(np.searchsorted(rare, begin).astype(np.int32))
                each = pa.StructArray.from_arrays(
                    [
                        pa.array(_signed(key)), pa.array(_signed(branch)), pa.array(np.diff(begin).astype(np.int32)), pa.array(low),
                        pa.ListArray.from_arrays(offset, pa.StructArray.from_arrays([pa.array(context[rare].astype(np.int32)), pa.array(symbol[rare].astype(np.int32)), pa.array(logs[rare])], ["context", "symbol", "low"])),
                    ],
                    ["key", "branch", "m", "low", "rare"],
                )
                word = np.insert(parts.hash, parts.bounds[1:], END)  # each text ends with the end token
                bounds = parts.bounds + np.arange(len(parts.bounds))
                at = np.minimum(np.searchsorted(head_keys, word), max(0, len(head_keys) - 1))
                known = head_keys[at] == word if len(head_keys) else np.zeros(len(word), dtype=bool)
                base = np.where(known, head_logs[at], 0.0) if len(head_keys) else np.zeros(len(word))
                tail = np.append(0, np.cumsum(~known))[bounds].astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_tokens": np.diff(bounds), "n_head": np.add.reduceat(known.astype(np.int64), bounds[:-1]),
                    "head": np.add.reduceat(base, bounds[:-1]), "low": np.add.reduceat(logs, starts[:-1]),
                    "tail": pa.ListArray.from_arrays(pa.array(tail), pa.array(_signed(word[~known]))),
                    "each": pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, starts).astype(np.int32)), each),
                })

    return run


def _deep_changes(scored: DataFrame, counts: DataFrame, rare: DataFrame) -> DataFrame:
    """(row, change): what deep and rare contexts change of the texts' scores by frequent short contexts."""
    branch = counts.where(F.col("kind") == _BRANCH).select("key", "branch", F.col("n").alias("c"))
    # A context of one branch needs no totals.
    forks = branch.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    forks = written(forks.where("k > 1"), "forks")
    deep = branch.join(forks, "key", "left").select("key", "branch", "c", F.coalesce("n", "c").alias("n"), F.coalesce("k", F.lit(1)).alias("k"))
    each = scored.select("row", F.inline("each"))
    found = each.join(written(deep, "deep"), ["key", "branch"], "left")
    cost = F.log10(F.col("c") / (F.col("n") + F.col("k"))) + (F.col("m") - 1) * F.log10(F.col("c") / (F.col("c") + 1))
    found = written(found.select("row", "key", (cost - F.col("low")).alias("change"), F.when(F.col("c").isNull(), F.col("rare")).alias("rare")), "branch-scores")
    new = found.where("change is null")
    single = branch.join(forks, "key", "left_anti").select("key", F.col("c").alias("n"), F.lit(1).cast("long").alias("k"))
    known = new.select("row", "key").join(forks.unionByName(single), "key").select("row", F.log10(F.col("k") / (F.col("n") + F.col("k"))).alias("change"))
    looked = new.select("row", F.inline("rare")).join(rare.drop("n"), "context")
    own = F.element_at("logs", F.array_position("symbols", F.col("symbol")).cast("int"))
    looked = looked.select("row", F.when(F.array_contains("symbols", F.col("symbol")), own - F.col("low")).otherwise(F.col("escape")).alias("change"))
    return found.where("change is not null").select("row", "change").unionByName(known).unionByName(looked)


def score_texts(docs: DataFrame, train: Column, rows: int = ROWS, entries: int = ENTRIES) -> DataFrame:
    """For each row of docs (doc_id, text): n_tokens, n_known, train_tokens, base_score and score. train marks the rows to learn from."""
    spark = docs.sparkSession
    counts = docs.where(train).select("text").mapInArrow(_count, _COUNTS).groupBy("kind", "key", "branch").agg(F.sum("n").alias("n"))
    counts = written(counts, "lm-counts", by="kind")
    tokens = counts.where(F.col("kind") == _WORD).select("key", "n")
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head_keys, head_counts = _columns(tokens.where(F.col("n") * HEAD >= n), "key", "n")
    order = np.argsort(head_keys.view(np.uint64))
    head = head_keys.view(np.uint64)[order], np.log10(head_counts[order] + 1.0)
    short, rare = fit_short(spark, counts.where(F.col("kind") == _GRAM).select("key", "n"), rows, entries)
    sent = spark.sparkContext.broadcast((short, *head))
    kind = dict(docs.dtypes)["doc_id"]
    branch = "array<struct<key:long,branch:long,m:int,low:double,rare:array<struct<context:int,symbol:int,low:double>>>>"
    scored = docs.select("doc_id", "text").mapInArrow(_score(sent), f"doc_id {kind}, n_tokens long, n_head long, head double, low double, tail array<long>, each {branch}")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")  # numbers are fixed by being written
    words = scored.select("row", F.explode("tail").alias("key")).join(tokens.where(F.col("n") * HEAD < n), "key")
    words = words.groupBy("row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare"))
    changes = _deep_changes(scored, counts, rare).groupBy("row").agg(F.sum("change").alias("change"))
    out = scored.drop("tail", "each").join(words, "row", "left").join(changes, "row", "left")
    base = F.col("head") + F.coalesce("rare", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("low") + F.coalesce("change", F.lit(0.0))).alias("score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its base score and the model's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_texts(docs, ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
