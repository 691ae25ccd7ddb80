"""Ranked lexical search for a table of items: bundles of each item travel through the owners of its terms.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z lower-cased. Only
postings of terms that some item holds are kept: texts are cut into terms where they are read, and the terms
joined with those of the items (Spark chooses how, by size). A posting has the integer part of its term's
contribution, so that sums are the same in any order.

Each term has one owner by how many documents hold it: OWNERS are bounds of that share, rare terms first. A stage
is one owner's turn. Documents are dealt into blocks of about BLOCK postings; for each block a stage brings together, by cogroup,
the owner's postings and the bundles: an item's terms of that owner with their weights, and its sparse accumulators (document, score)
from the stages before. The contributions are added and the bundle goes on; after the last stage each block selects its best,
then all blocks' are ranked together. A block's postings, its documents and its accumulators are bounded by its
size whatever a term's share of the corpus, so that a common term is no hot key.

Between stages accumulators go that can no longer be among an item's first k: those whose score and all that the
remaining owners can add (the sum over their terms of weight times the largest part) stay below a score that k
documents of one block have reached. What is dropped is below k others, so results are exact.

Each row of documents is a document and each row of items an item of its own, also where they are repeated or their ids are null; rows of
one item id are ranked apart. Equal scores are ranked by ascending document id, null ids last. Null and empty texts have no
terms: such a document is never found, such an item finds nothing. Empty tables give an empty result. Other columns
aren't read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._tables import written

#: Owners of terms: the share of documents up to which a term belongs to each.
OWNERS = (1 / 1024, 1 / 64, 1 / 8, 1.0)
#: Postings of a block, about.
BLOCK = 1 << 18
#: What a term occurrence saturates at and how lengths count, in hundredths; UNIT is the integer scale of a term's part.
K, LENGTH, UNIT, WEIGHT = 12, 25, 1_000_000_000, 1000

_TERM = np.zeros(256, dtype=bool)
_TERM[128:] = True
for _first, _last in ("09", "AZ", "az"):
    _TERM[ord(_first) : ord(_last) + 1] = True
#: Stands for a document as such: every document with a term has one posting of it.
MARK = 0


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another: number of terms of each, and (text, term's hash, occurrences) of their different terms."""
    data = _text.LOWER[data]
    solid = _TERM[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1 : len(data)]
    ends[:-1] &= ~solid[1:] | cut[1 : len(data)]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    n = np.diff(np.searchsorted(start, offsets))
    # The highest bit is set, so that no term's hash is MARK.
    term = (_text.ranges(_text.BYTE[data], start, end) | np.uint64(1 << 63)).view(np.int64)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(term)), dtype=bool), (text[1:] != text[:-1]) | (term[1:] != term[:-1])]))
    return n, text[first], term[first], np.diff(np.append(first, len(term)))


def _terms(table: DataFrame, key: str) -> DataFrame:
    """(row, key, n, term, tf): the terms of every row, and MARK once for each row with terms. row: a number of its own for each row.

    Rows are numbered within tasks, so the result is to be written before it is used twice.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() << 36) - 1
        for batch in batches:
            for part, data, offsets in _text.slices(batch, "text"):
                n, text, term, tf = _counted(data, offsets)
                edges = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                rows = np.arange(row + 1, row + 1 + part.num_rows)
                row += part.num_rows
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int64))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([pa.array(rows), part.column(0), pa.array(n.astype(np.int64)), *lists], ["row", key, "n", "terms", "tfs"])

    kind = table.schema[key].dataType.simpleString()
    lists = table.select(key, "text").mapInArrow(cut, f"row long, {key} {kind}, n long, terms array<long>, tfs array<long>").where("n > 0")
    mark = F.array(F.struct(F.lit(MARK).cast("long").alias("terms"), F.lit(1).cast("long").alias("tfs")))
    each = F.explode(F.concat(mark, F.arrays_zip("terms", "tfs"))).alias("t")
    return lists.select("row", key, "n", each).select("row", key, "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))


def _owner(df: Column, n: Column) -> Column:
    out = F.lit(len(OWNERS) - 1)
    for k in reversed(range(len(OWNERS) - 1)):
        out = F.when(df <= n * OWNERS[k], k).otherwise(out)
    return out


def _stage(k: int, last: bool):
    """What a stage does with one block: bundles and postings to bundles, or after the last stage to each item's best."""

    def add(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        term, row, part = (postings.column(c).to_numpy() for c in ("term", "row", "part"))
        order = np.lexsort((row, term))
        term, row, part = term[order], row[order], part[order]
        ids = postings.column("doc_id").take(pa.array(order))
        own = bundles.column("owned").to_pylist()
        held = bundles.column("rows").combine_chunks()
        held_ids, held_scores = bundles.column("ids").combine_chunks(), bundles.column("scores").combine_chunks()
        # The documents of this block that occur here at all, by row.
        every = np.concatenate([row, held.flatten().to_numpy()])
        rows, at = np.unique(every, return_index=True)
        names = pa.concat_arrays([*ids.chunks, held_ids.flatten()]).take(pa.array(at)) if len(at) else held_ids.flatten()
        place = np.searchsorted(rows, row)
        by_id = np.empty(len(rows), dtype=np.int64)
        if last:
            by_id[pc.array_sort_indices(names, null_placement="at_end").to_numpy()] = np.arange(len(rows))  # a stable order: equal ids by row
        items: dict[int, list[int]] = {}
        for i, q in enumerate(bundles.column("item").to_pylist()):
            items.setdefault(q, []).append(i)
        out_item, out_rows, out_at, out_scores, out_kth = [], [], [], [], []
        offsets = held.offsets.to_numpy() - held.offsets[0].as_py()
        flat_rows, flat_scores = held.flatten().to_numpy(), held_scores.flatten().to_numpy()
        rest, floor = bundles.column("rest").to_pylist(), bundles.column("least").to_pylist()
        score = np.zeros(len(rows), dtype=np.int64)
        for q, parts in items.items():
            score[:] = 0
            best = more = 0
            for i in parts:
                a, b = offsets[i], offsets[i + 1]
                score[np.searchsorted(rows, flat_rows[a:b])] += flat_scores[a:b]
                best, more = max(best, floor[i] or 0), max(more, rest[i] or 0)
                for t in own[i] or ():
                    a, b = np.searchsorted(term, t["term"]), np.searchsorted(term, t["term"], side="right")
                    score[place[a:b]] += t["weight"] * part[a:b]
            found = np.flatnonzero((score > 0) & (score + more >= best))
            kth = 0
            if len(found) >= k:
                kth = int(np.partition(score[found], len(found) - k)[len(found) - k])
                found = found[score[found] + more >= kth]
            if last:
                found = found[np.lexsort((by_id[found], -score[found]))[:k]]
            out_item.append(q)
            out_rows.append(len(found))
            out_at.append(found)
            out_scores.append(score[found])
            out_kth.append(kth)
        at = np.concatenate(out_at) if out_at else np.zeros(0, dtype=np.int64)
        edges = pa.array(np.append(0, np.cumsum(out_rows)).astype(np.int32))
        columns = [pa.array(rows[at]), names.take(pa.array(at)), pa.array(np.concatenate(out_scores) if out_scores else at)]
        block = bundles.column("block")[0] if bundles.num_rows else postings.column("block")[0]
        return pa.table(
            [pa.array([block.as_py()] * len(out_item), pa.int32()), pa.array(out_item, pa.int64()), *(pa.ListArray.from_arrays(edges, c) for c in columns), pa.array(out_kth, pa.int64())],
            names=["block", "item", "rows", "ids", "scores", "kth"],
        )

    return add


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of docs (doc_id, text) for every row of items (item_id, text), and item, a number of each row of items."""
    asked = written(_terms(items, "item_id"), "item-terms")
    vocabulary = asked.select("term").distinct()
    kept = written(_terms(docs, "doc_id").join(vocabulary, "term"), "postings")
    size = kept.where(F.col("term") == MARK).agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    total, length = F.lit(size["n"]).cast("long"), F.lit(size["l"]).cast("long")
    if not size["n"]:  # no document has a term
        total, length = F.lit(1).cast("long"), F.lit(1).cast("long")
    blocks = max(1, -(-kept.count() // BLOCK))
    m = F.lit(100 - LENGTH) + F.call_function("div", LENGTH * F.col("n") * total, length)
    part = F.call_function("div", F.lit(UNIT) * F.col("tf"), 1000 * F.col("tf") + K * m)
    postings = kept.where(F.col("term") != MARK).select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "term", "row", "doc_id", part.alias("part"))
    weight = F.floor(WEIGHT * F.log((2 * total + 2) / (2 * F.col("df") + 1))).cast("long")
    held = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    owned = written(held.select("term", "most", weight.alias("weight"), _owner(F.col("df"), total).alias("owner")), "owned-terms")
    # Each item's terms by owner, with weights times repeats; rest: the most that the owners after it can add.
    mine = asked.join(owned, "term").withColumn("weight", F.col("weight") * F.col("tf"))
    mine = mine.groupBy("row", "owner").agg(F.collect_list(F.struct("term", "weight")).alias("owned"), F.sum(F.col("weight") * F.col("most")).alias("adds"))
    mine = written(mine.withColumnRenamed("row", "item"), "item-owners")
    sums = mine.groupBy("item").agg(*(F.coalesce(F.sum(F.when(F.col("owner") > s, F.col("adds"))), F.lit(0)).alias(f"rest_{s}") for s in range(len(OWNERS))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"block int, item long, rows array<long>, ids array<{kind}>, scores array<long>, kth long"
    bundles, least = None, None
    for s in range(len(OWNERS)):
        terms = mine.where(F.col("owner") == s).select("item", "owned")
        start = sums.select("item", F.col(f"rest_{s}").alias("rest")).join(terms, "item", "left")
        start = start.join(least, "item", "left") if s else start.withColumn("least", F.lit(0).cast("long"))
        start = start.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "item", "owned", "rest", "least")
        start = start.select("*", *(F.array().cast(f"array<{t}>").alias(c) for c, t in (("rows", "long"), ("ids", kind), ("scores", "long"))))
        if s:
            carried = bundles.where(F.size("rows") > 0).select("block", "item", F.lit(None).cast(start.schema["owned"].dataType).alias("owned"), F.lit(0).cast("long").alias("rest"), F.lit(0).cast("long").alias("least"), "rows", "ids", "scores")
            start = start.unionByName(carried)
        turn = postings.join(owned.where(F.col("owner") == s).select("term"), "term").select("block", "term", "row", "doc_id", "part")
        bundles = start.groupBy("block").cogroup(turn.groupBy("block")).applyInArrow(_stage(k, s == len(OWNERS) - 1), shape)
        bundles = written(bundles, f"bundles-{s}")
        least = bundles.groupBy("item").agg(F.max("kth").alias("least"))
    best = bundles.select("item", F.explode(F.arrays_zip("rows", "ids", "scores")).alias("d")).select("item", F.col("d.rows").alias("row"), F.col("d.ids").alias("doc_id"), F.col("d.scores").alias("score"))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.where(F.col("term") == MARK).select(F.col("row").alias("item"), "item_id")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score", "item")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for every item of benchmark."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items).select("item_id", "rank", "doc_id", "score")


_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH t AS (SELECT doc_id, unnest({_CUT}) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_CUT}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS len FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, total),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // len)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""
