"""Chunks along headings, and facts by an extractor that the caller supplies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.models import pieces_of

_FEW = 50


def is_heading(line: str) -> bool:
    """Numbered, all capitals, or a few words that begin with capitals. Lengths are in UTF-8 bytes."""
    size = len(line.encode())
    if not 3 <= size <= 100:
        return False
    if "0" <= line[0] <= "9" and ("." in line or "chapter" in line.lower()):
        return True
    if all(c.isupper() for c in line if c.isalpha()):
        return 3 < size < 60
    words = line.split()
    capital = sum(len(w.encode()) > 1 and w[0].isupper() for w in words)
    return 2 <= len(words) <= 6 and capital >= len(words) - 1


def structural_pieces(text: str, size: int) -> Iterator[tuple[str, int, str | None, int]]:
    """(text, page, section, offset in bytes) of the pieces of a text whose pages are parted by form feeds."""
    piece: list[str] = []
    held, section, page, begin, at = 0, None, 1, 0, 0

    def flush(least: int) -> Iterator[tuple[str, int, str | None, int]]:
        body = "".join(piece).strip()
        if len(body.encode()) > least:
            yield body, page, section, begin

    for number, part in enumerate(text.split("\f"), 1):
        for line in map(str.strip, part.split("\n")):
            if not line:
                piece.append("\n")
                held += 1
                continue
            length = len(line.encode())
            if is_heading(line):
                yield from flush(_FEW)
                piece, held, section, page, begin = [], 0, line, number, at
            piece.append(line + "\n")
            held += length + 1
            if held > size:
                yield from flush(0)
                piece, held, page, begin = [], 0, number, at + length
            at += length + 1
        at += 1
    yield from flush(0)


def chunk_structural(docs: DataFrame, size: int = 1500) -> DataFrame:
    """(doc_id, chunk_index, page, section, char_offset, char_count, text): pieces that end at headings or beyond `size` bytes. Null and blank texts give no rows."""

    def pieces(text: str) -> Iterator[tuple]:
        for n, (body, page, section, at) in enumerate(structural_pieces(text, size)):
            yield n, page, section, at, len(body.encode()), body

    return pieces_of(docs, pieces, "chunk_index int, page int, section string, char_offset long, char_count long, text string")


Extractor = Callable[[str], list[tuple[str, str, str]]]


def extract_facts(episodes: DataFrame, load: Callable[[], Extractor]) -> tuple[DataFrame, DataFrame]:
    """Facts (episode_id, source, label, target) and dead letters (episode_id, error) of episodes (episode_id, content).

    load is called once a task and returns the extractor; what it raises for a text makes that episode a dead letter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = load()
        for batch in batches:
            rows = []
            for ident, text in zip(batch["episode_id"], batch["content"], strict=True):
                try:
                    rows += [(ident, *fact, None) for fact in extract(text or "")]
                except Exception as problem:  # noqa: BLE001 - the caller's function may raise anything
                    rows.append((ident, None, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["episode_id", "source", "label", "target", "error"], dtype=object)

    kind = dict(episodes.dtypes)["episode_id"]
    found = episodes.select("episode_id", "content").mapInPandas(run, f"episode_id {kind}, source string, label string, target string, error string")
    return found.where("error is null").drop("error"), found.where("error is not null").select("episode_id", "error")


def neighbours_extractor() -> Extractor:
    """A rule for tests: each capitalised word mentions the next one. A text without a letter is an error."""

    def extract(text: str) -> list[tuple[str, str, str]]:
        if not re.search(r"[A-Za-z]", text):
            raise ValueError("no words")
        names = re.findall(r"\b[A-Z][a-z]+", text)
        return [(a, "mentions", b) for a, b in zip(names, names[1:], strict=False)]

    return extract


def extraction_report(facts: DataFrame, dead: DataFrame) -> DataFrame:
    """(episode_id, facts, error) of each episode that gave facts or failed."""
    good = facts.groupBy("episode_id").agg(F.count("*").alias("facts")).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(dead.select("episode_id", F.lit(0).cast("long").alias("facts"), "error"))
