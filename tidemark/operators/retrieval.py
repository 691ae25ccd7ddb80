"""Similarity search, full-text ranking and rank fusion for tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fulltext import STOP_WORDS, all_words, fulltext_topk, keywords  # noqa: F401
from tidemark.operators.vector_index import dealt, exact_topk, top_k_per_query  # noqa: F401


def by_tenant(queries: DataFrame, items: DataFrame, ident: str) -> DataFrame:
    """Every query (query_id, tenant) with every item of its tenant: an exact search of a stated set of queries, in parts by the tenant's size."""
    left, right = dealt(queries, items, ["tenant"], "query_id", ident)
    return left.join(right, ["tenant", "part", "turn"]).drop("part", "turn")


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None, same_tenant: bool = True) -> DataFrame:
    """Exact top k by cosine among vectors of the query's tenant, or of all tenants; with min_score only those that reach it."""
    return exact_topk(queries, vectors, k, min_score, same_tenant)


def rrf(ranked: DataFrame, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list, id, rank)."""
    return ranked.groupBy("query_id", "id").agg(F.round(F.sum(1 / (c + F.col("rank"))), 6).alias("score"))
