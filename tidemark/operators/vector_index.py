"""Nearest vectors for tables of queries: exact in blocks, and through an index of coarse cells and product codes.

Exact search deals a tenant's vectors into parts by their number, and its queries too; a part of both is one task's
matrix product, so neither a large tenant nor its many queries are gathered in one task.

The index. On a bounded sample (SAMPLE rows, about) one task learns coarse centroids by k-means, and codes of what
is left of each SUB dimensions after its centroid is taken off. Every vector is stored under its cell with a byte for each SUB dimensions.
A query looks into its nearest cells, adds up table values by code, and the best of a short list are compared on whole vectors.
How many cells and how long a list are learned too: on the sample, as what finds REACH of its exact neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_folder

#: Vectors of one part, queries of one part, and scores that a part's task holds at once.
ROWS, ASKED, BLOCK = 1 << 15, 1 << 13, 1 << 20
#: Rows to learn from, about; vectors of a cell, about; cells at most; dimensions of a code; rounds of k-means.
SAMPLE, CELL, MOST_CELLS, SUB, ROUNDS = 40_000, 1 << 10, 1 << 12, 4, 12
#: Queries of the sample by which the search is set, and the share of their neighbours that each step keeps.
TRIED, REACH = 256, 0.98


def parts_of(items: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """(keys, parts): into how many parts of about `rows` rows each key's items go."""
    return items.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))


def dealt(queries: DataFrame, items: DataFrame, keys: list[str], query_id: str, ident: str, rows: int = ROWS, asked: int = ASKED) -> tuple[DataFrame, DataFrame]:
    """Both tables with columns part and turn: a query and an item of one key meet in exactly one (part, turn)."""
    parts, turns = parts_of(items, keys, rows), parts_of(queries, keys, asked).withColumnRenamed("parts", "turns")
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(parts, keys).join(turns, keys).withColumn("turn", place(query_id, "turns")).withColumn("part", every("parts"))
    right = items.join(parts, keys).join(turns, keys).withColumn("part", place(ident, "parts")).withColumn("turn", every("turns"))
    right = right.drop("parts", "turns")
    return left.drop("parts", "turns"), right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of their own, where both tables come from one


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k best; equal scores by id. What is not to be found is -inf."""
    row, column = [], []
    for i, line in enumerate(score):
        at = np.flatnonzero(line > -np.inf)
        if len(at) > k:
            at = at[line[at] >= np.partition(line[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((ids[at], -line[at]))[:k]]
        row.append(np.full(len(at), i))
        column.append(at)
    return np.concatenate(row or [np.zeros(0, int)]), np.concatenate(column or [np.zeros(0, int)])


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.maximum(np.linalg.norm(rows, axis=1), 1e-300)


def _exact(k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], min_score: float | None):
    """The k best of a part's items for each of its queries; BLOCK scores are held at once, whatever the part's size."""

    def meet(queries: pa.Table, items: pa.Table) -> pa.Table:
        asked, ids = queries.column("query_id").to_numpy(), items.column("id").to_numpy()
        found = [(asked[:0], ids[:0], np.zeros(0))]
        if len(asked) and len(ids):
            vectors, q = matrix(items.column("vector")), matrix(queries.column("q"))
            step = max(1, BLOCK // len(ids))
            for at in range(0, len(asked), step):
                some = asked[at : at + step]
                near = np.round(score(q[at : at + step], vectors), 6)
                near[some[:, None] == ids[None, :]] = -np.inf
                if min_score is not None:
                    near[near < min_score] = -np.inf
                row, column = _best(near, ids, k)
                found.append((some[row], ids[column], near[row, column] + 0.0))
        return pa.table(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return meet


def cosines(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The cosine of each query with each vector; 0 for what has no length."""
    return (q @ vectors.T) / lengths(q)[:, None] / lengths(vectors)


def top_k_per_query(scored: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """The k best of each query (query_id, id, score); equal scores go by id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    scored = scored if min_score is None else scored.where(F.col("score") >= min_score)
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None, same_tenant: bool = True, score: Callable[[np.ndarray, np.ndarray], np.ndarray] = cosines) -> DataFrame:
    """(query_id, id, score, rank): the k most similar vectors other than the query's own (vec_id, tenant, vector), of its tenant or of all.

    score: of all queries and vectors of two matrices.
    """
    tenant = F.col("tenant") if same_tenant else F.lit(0)
    q = queries.select(F.col("vec_id").alias("query_id"), tenant.alias("tenant"), F.col("vector").alias("q")).where("tenant is not null and q is not null")
    v = vectors.select(F.col("vec_id").alias("id"), tenant.alias("tenant"), "vector").where("tenant is not null and vector is not null")
    left, right = dealt(q, v, ["tenant"], "query_id", "id")
    keys = ["tenant", "part", "turn"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_exact(k, score, min_score), "query_id long, id long, score double")
    return top_k_per_query(scored, k)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Up to k centroids of x; a centroid that nothing is nearest to stays where it was."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(1)
    return np.concatenate([np.argmin(square - 2 * (part @ centres.T), axis=1) for part in np.array_split(x, max(1, len(x) * len(centres) // (1 << 24)))])


@dataclass
class Codebook:
    """centres: of cells; books: of the codes of each SUB dimensions; probes, short: cells looked into, candidates compared."""

    centres: np.ndarray
    books: np.ndarray
    probes: int = 1
    short: int = 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centres)
        rest = self._split(x - self.centres[cell])
        return cell, np.stack([nearest(rest[:, m], book) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def cells(self, q: np.ndarray) -> np.ndarray:
        """The cells of each query, the most similar first."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : self.probes]

    def scores(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """About the similarity of each query with each vector of these cells and codes."""
        parts = self._split(q)
        out = (q @ self.centres.T)[:, cell]
        for m, book in enumerate(self.books):
            out += (parts[:, m] @ book.T)[:, codes[:, m]]
        return out

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = len(self.books) * SUB
        return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), -1, SUB)


def learn(x: np.ndarray, tenant: np.ndarray, total: int, k: int, size: int = CELL, reach: float = REACH) -> Codebook:
    """A codebook from unit vectors of a sample; total: vectors in all, size: of a cell, about."""
    rng = np.random.default_rng(7)
    centres = kmeans(x, max(1, min(MOST_CELLS, total // size, len(x) // 8)), rng)
    book = Codebook(centres, np.zeros((-(-x.shape[1] // SUB), 1, SUB)))
    rest = book._split(x - centres[nearest(x, centres)])
    book.books = np.stack([kmeans(rest[:, m], 256, rng) for m in range(rest.shape[1])])
    cell, codes = book.encode(x)
    ranks, places = [], []
    book.probes = len(centres)
    for i in rng.choice(len(x), min(TRIED, len(x)), replace=False):
        own = np.flatnonzero((tenant == tenant[i]) & (np.arange(len(x)) != i))
        best = np.argsort(-(x[own] @ x[i]), kind="stable")[:k]
        order = np.argsort(book.cells(x[i : i + 1])[0])  # the place of each cell in the query's order
        about = book.scores(x[i : i + 1], cell[own], codes[own])[0]
        ranks += order[cell[own[best]]].tolist()
        places += [int((about > a).sum()) for a in about[best]]
    quantile = lambda values: int(np.quantile(values, reach, method="higher")) + 1 if values else 1
    book.probes = quantile(ranks)
    book.short = max(k, -(-quantile(places) * max(total, len(x)) // max(len(x), 1)))
    return book


def _learn(total: int, k: int, size: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found)
            book = learn(unit(matrix(table.column("vector"))), np.array(table.column("tenant").to_pylist(), dtype=object), total, k, size)
            shapes = [pa.array([list(a.shape)], pa.list_(pa.int64())) for a in (book.centres, book.books)]
            blobs = [pa.array([a.astype(np.float32).tobytes()], pa.binary()) for a in (book.centres, book.books)]
            yield pa.RecordBatch.from_arrays([blobs[0], shapes[0], blobs[1], shapes[1], pa.array([book.probes]), pa.array([book.short])], ["centres", "cs", "books", "bs", "probes", "short"])

    return train


def build_index(vectors: DataFrame, folder: str, k: int = 5, size: int = CELL) -> None:
    """Writes the codebook and (id, tenant, cell, code) of every vector (vec_id, tenant, vector) to folder. Null and zero vectors are in no cell."""
    clean = vectors.where("vector is not null and tenant is not null").select(F.col("vec_id").alias("id"), "tenant", "vector").where(F.exists("vector", lambda x: x != 0))
    total = clean.count()
    picked = clean.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(total, 1))))).repartition(1)
    shape = "centres binary, cs array<long>, books binary, bs array<long>, probes long, short long"
    picked.mapInArrow(_learn(total, k, size), shape).write.mode("overwrite").parquet(f"{folder}/codebook")
    book = read_codebook(vectors.sparkSession, folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, codes = book.encode(unit(matrix(pa.chunked_array([b.column("vector")]))))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tenant"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "tenant", "cell", "code"])

    kind = clean.schema["tenant"].dataType.simpleString()
    coded = clean.mapInArrow(encode, f"id long, tenant {kind}, cell int, code binary") if book else clean.select("id", "tenant", F.lit(0).alias("cell"), F.lit(b"").alias("code"))
    coded.write.mode("overwrite").parquet(f"{folder}/codes")


def read_codebook(spark: SparkSession, folder: str) -> Codebook | None:
    """The codebook, whose size is bounded by MOST_CELLS; None where nothing was indexed."""
    row = spark.read.parquet(f"{folder}/codebook").first()
    if row is None:
        return None
    centres, books = (np.frombuffer(row[a], np.float32).reshape(row[s]).astype(np.float64) for a, s in (("centres", "cs"), ("books", "bs")))
    return Codebook(centres, books, row["probes"], row["short"])


def candidates(queries: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """(query_id, id): each query's short list by codes, and how long the lists are at most."""
    spark = queries.sparkSession
    codes, book = spark.read.parquet(f"{folder}/codes"), read_codebook(spark, folder)
    q = queries.select(F.col("vec_id").alias("query_id"), "tenant", F.col("vector").alias("q")).where(F.exists("q", lambda x: x != 0) & F.col("tenant").isNotNull())
    if book is None:
        return q.join(codes, "tenant").select("query_id", "id"), 0
    kind = codes.schema["tenant"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = book.cells(unit(matrix(pa.chunked_array([b.column("q")]))))
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("tenant"), b.column("q"), pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["query_id", "tenant", "q", "cells"])

    asked = q.mapInArrow(probe, f"query_id long, tenant {kind}, q {q.schema['q'].dataType.simpleString()}, cells array<int>")
    asked = asked.select("query_id", "tenant", "q", F.explode("cells").alias("cell"))

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        who, ids = left.column("query_id").to_numpy(), right.column("id").to_numpy()
        if not len(who) or not len(ids):
            return pa.table({"query_id": who[:0], "id": ids[:0], "score": np.zeros(0)})
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        cell, q, step, found = right.column("cell").to_numpy(), unit(matrix(left.column("q"))), max(1, BLOCK // len(ids)), []
        for at in range(0, len(who), step):
            some = who[at : at + step]
            score = book.scores(q[at : at + step], cell, code)
            score[some[:, None] == ids[None, :]] = -np.inf
            row, column = _best(score, ids, book.short)
            found.append((some[row], ids[column], score[row, column]))
        return pa.table(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    left, right = dealt(asked, codes, ["tenant", "cell"], "query_id", "id")
    keys = ["tenant", "cell", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, "query_id long, id long, score double")
    return top_k_per_query(found, book.short).select("query_id", "id"), book.short


def search_index(queries: DataFrame, vectors: DataFrame, folder: str, k: int, min_score: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best of each query's short list, compared on whole vectors."""
    found, _ = candidates(queries, folder)
    near = found.join(vectors.select(F.col("vec_id").alias("id"), "vector"), "id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("q", "vector", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    near = near.select("query_id", "id", F.round(dot / (length("q") * length("vector")), 6).alias("score"))
    return top_k_per_query(near, k, min_score)


def index_folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}"
