"""Chunks of fixed size, and embeddings by a function that the caller supplies."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Characters of pieces that are given back at once, about.
GIVEN = 1 << 20


def pieces_of(docs: DataFrame, pieces: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """doc_id and what pieces gives for each text of docs (doc_id, text), as columns of schema of which the last is a piece's text; null texts are empty ones.

    Texts become Python's one at a time, and pieces go back after GIVEN characters, so a task holds no batch's texts and pieces together.
    """
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([("doc_id", batch.schema.field("doc_id").type), *fields])
            rows, held = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ident = doc_id.as_py()
                for piece in pieces(text.as_py() or ""):
                    rows.append((ident, *piece))
                    held += len(piece[-1])
                    if held >= GIVEN:
                        yield _batch(rows, out)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, out)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _cuts(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            end = max(text.rfind(c, end - size // 5, end) for c in ".!?\n") + 1 or end
        yield at, end
        at = n if end == n else end - overlap


def chunk_fixed(docs: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, char_offset, char_count, text): pieces of at most `size` characters, cut after the last sentence end
    of their final fifth, each starting `overlap` characters before the last one's end; char_count is in bytes of the trimmed
    text. Blank pieces and null or empty texts give no rows."""
    if not 0 <= overlap < 0.8 * size:
        raise ValueError("overlap must be less than 0.8 * size")

    def pieces(text: str) -> Iterator[tuple]:
        bodies = ((at, text[at:end].strip()) for at, end in _cuts(text, size, overlap))
        for n, (at, body) in enumerate((at, body) for at, body in bodies if body):
            yield n, at, len(body.encode()), body

    return pieces_of(docs, pieces, "chunk_index int, char_offset long, char_count long, text string")


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed counts of hashed words at unit length; a text without words is all zeros."""

    def embed_texts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                row[(code >> 1) % dims] += 1 if code & 1 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    return embed_texts


def embed(df: DataFrame, column: str, load: Callable[[], Callable[[list[str]], np.ndarray]], into: str = "vector") -> DataFrame:
    """df with a vector of each text of column; load is called once a task and returns the batch embedder. Null texts are empty ones."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = load()
        for texts in batches:
            yield pd.Series(list(embedder(texts.fillna("").tolist())), dtype=object)

    return df.withColumn(into, run(column))
