"""Best-fit packing into sequences of several permitted lengths.

A text has ceil(UTF-8 bytes / 4) tokens and one end token. Texts beyond the largest capacity are cut
into full pieces and a rest. Pieces are dealt by hash of their row numbers into shards of about SHARD
rows, each packed on its own: best fit in order of falling size. Where nothing open fits, a bin is
opened. Which length it gets is decided for each bin, over all permitted ones together: each is filled
on paper with the largest pieces still to come, cut down to the least length that holds them, and the
one that costs least for each token packed is opened. At the end each bin is cut down to the least
length that holds its contents. A bin costs its capacity and BIN_COST tokens.

Null and empty texts are one token. Rows are never merged, and repeated rows are dealt apart; ties go by
row, then piece. A null id stays null, and ids of any type come back unchanged. An empty table packs
into nothing. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITIES = (1024, 2048, 4096)
BIN_COST = 16
SHARD = 20_000


def _paper_fill(left: Counter, mask: int, room: int) -> int:
    """Tokens that the largest pieces still to come put into an open bin's room; mask has a bit for each size of left."""
    filled, used = 0, Counter()
    while room:
        fits = mask & ((1 << (room + 1)) - 1)
        while fits and used[size := fits.bit_length() - 1] == left[size]:
            fits ^= 1 << size
        if not fits:
            break
        used[size] += 1
        filled += size
        room -= size
    return filled


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin of each size, fill and capacity of each bin; sizes fall, none is over the largest capacity."""
    capacities = sorted(capacities)
    free: dict[int, list[int]] = {}  # open bins by free room
    rooms = 0  # bit r is set where a bin with free room r is open
    left = Counter(sizes)
    mask = sum(1 << s for s in left)
    place, fill = [], []
    for size in sizes:
        left[size] -= 1
        if not left[size]:
            mask &= ~(1 << size)
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            best = None
            for capacity in (c for c in capacities if c >= size):
                full = size + _paper_fill(left, mask, capacity - size)
                cost = (next(c for c in capacities if c >= full) + BIN_COST) / full
                if best is None or cost < best[0]:
                    best = cost, capacity
            room, at = best[1], len(fill)
            fill.append(0)
        place.append(at)
        fill[at] += size
        if room > size:
            free.setdefault(room - size, []).append(at)
            rooms |= 1 << (room - size)
    return place, fill, [next(c for c in capacities if c >= f) for f in fill]


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text): its bin (shard, bin), the bin's capacity, and where it lies.

    token_start is the piece's place in its text, offset its place in the bin.
    """
    capacities = sorted(capacities)
    top = capacities[-1]
    kind = dict(docs.dtypes)["doc_id"]
    tokens = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long") + 1
    # Rows are numbered where they are read, so that repeated rows go to different shards.
    pieces = docs.select("doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("row"), tokens.alias("tokens"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("tokens") / top) - 1)))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(top), F.col("tokens") - F.col("piece") * top))
    count = docs.select(tokens.alias("tokens")).agg(F.coalesce(F.sum(F.ceil(F.col("tokens") / top)), F.lit(0))).first()[0]
    shards = max(1, -(-int(count) // SHARD))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards))).drop("tokens")

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("row", "ascending"), ("piece", "ascending")])
        size = table.column("n_tokens").to_numpy()
        place, fill, caps = pack(size.tolist(), capacities)
        bins = np.array(place)
        order = np.argsort(bins, kind="stable")
        before = np.empty(len(size), dtype=np.int64)
        before[order] = np.cumsum(size[order]) - size[order]
        offset = before - np.append(0, np.cumsum(fill))[bins]
        columns = {"shard": table.column("shard"), "bin": bins, "capacity": np.array(caps)[bins], "doc_id": table.column("doc_id"), "piece": table.column("piece")}
        return pa.table(columns | {"token_start": table.column("piece").to_numpy() * top, "n_tokens": size, "offset": offset})

    return pieces.groupBy("shard").applyInArrow(packed, f"shard long, bin long, capacity long, doc_id {kind}, piece long, token_start long, n_tokens long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every row of documents with its bin."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the pieces of docs with their bins."""
    return pack_documents(docs.select("doc_id", "text"))
