"""Approximate search, reranking, adapters, retrieval policies and token budgets for tables of queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import cosine, dot, estimate_tokens
from tidemark.functions.texts import ball_factor, hierarchy_depth, poincare_distance
from tidemark.operators.vector_index import cosines, exact_topk, top_k_per_query


def upsert_vectors(log: DataFrame) -> DataFrame:
    """The vectors left after a log of upserts and deletes (op): the last entry of each id counts."""
    last = log.groupBy("vec_id").agg(F.max(F.struct("seq", "op", "vector")).alias("last"))
    return last.where("last.op = 'upsert'").select("vec_id", "last.vector", F.col("last.seq").alias("seq"))


def namespace_report(vectors: DataFrame, dims: int) -> DataFrame:
    """(tenant, vectors, wrong): how many vectors each namespace holds, and how many have not the namespace's dimensions."""
    return vectors.groupBy("tenant").agg(F.count("*").alias("vectors"), F.count_if(F.coalesce(F.size("vector") != dims, F.lit(True))).alias("wrong"))


def vectors_exist(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """asked (vec_id) with whether there is such a vector."""
    known = vectors.select("vec_id").distinct().withColumn("found", F.lit(True))
    return asked.join(known, "vec_id", "left").select("vec_id", F.coalesce("found", F.lit(False)).alias("found"))


def hyperbolic_rerank(candidates: DataFrame, c: float = 1.0, alpha: float = 0.3) -> DataFrame:
    """Candidates (query_id, id, q, vector) by cosine blended with closeness in the ball."""
    candidates = candidates.withColumns({"fq": ball_factor(F.col("q"), c), "fv": ball_factor(F.col("vector"), c)})
    inside = {"ball_q": F.transform("q", lambda x: x.cast("double") * F.col("fq")), "ball_vector": F.transform("vector", lambda x: x.cast("double") * F.col("fv"))}
    candidates = candidates.withColumns(inside).withColumn("gap", poincare_distance(F.col("ball_q"), F.col("ball_vector"), c))
    gap = F.col("gap")
    score = (1 - alpha) * cosine(F.col("q"), F.col("vector")) + alpha / (1 + gap)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return candidates.select("query_id", "id", F.round(score, 6).alias("score"), F.round(hierarchy_depth(F.col("ball_vector")), 6).alias("depth")).withColumn("rank", rank)


def contradiction_rank(queries: DataFrame, vectors: DataFrame, head: int, k: int) -> DataFrame:
    """Likeliest contradictions: alike in the first head dimensions (subject, predicate), unlike in the rest (object)."""
    score = lambda q, v: cosines(q[:, :head], v[:, :head]) - cosines(q[:, head:], v[:, head:])
    best = exact_topk(queries, vectors, k, score=score).drop("rank")
    # What lacks a vector has no score and comes last, by id: of a tenant k + 1 such rows suffice, one of which may be the query itself.
    first = F.row_number().over(W.partitionBy("tenant").orderBy("vec_id"))
    least = lambda rows: rows.select("tenant", "vec_id", first.alias("n")).where(F.col("n") <= k + 1).select("tenant", F.col("vec_id").alias("id"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "tenant", F.col("vector").isNull().alias("bare"))
    bare = asked.where("not bare").join(least(vectors.where("vector is null")), "tenant").unionByName(asked.where("bare").join(least(vectors), "tenant"))
    none = bare.where("id <> query_id").select("query_id", "id", F.lit(None).cast("double").alias("score"))
    return top_k_per_query(best.unionByName(none), k)


def mmr(ranked: DataFrame, keep: int, weight: float = 0.7) -> DataFrame:
    """Relevant and different: picks the best of weight * relevance - (1 - weight) * likeness to a pick, time after time.

    ranked (query_id, id, score) must hold few rows a query, as top k does; likeness is 1 - the gap of relevances.
    """
    def pick(found: pd.DataFrame) -> pd.DataFrame:
        best = found.groupby("id", as_index=False)["score"].max().sort_values("id")
        top = best["score"].max()
        left = {i: (s / top if top > 0 else 0.0) for i, s in zip(best["id"], best["score"], strict=True)}
        chosen: list[tuple[int, float]] = []
        while left and len(chosen) < keep:
            value = {i: weight * r - (1 - weight) * max((1 - abs(r - c) for _, c in chosen), default=0.0) for i, r in left.items()}
            first = max(value, key=lambda i: (round(value[i], 9), -i))
            chosen.append((first, left.pop(first)))
        return pd.DataFrame({"query_id": found["query_id"].iloc[0], "id": [i for i, _ in chosen], "pick": range(1, len(chosen) + 1)})

    return ranked.select("query_id", "id", "score").groupBy("query_id").applyInPandas(pick, "query_id long, id long, pick int")


def adapt(vectors: DataFrame, adapters: DataFrame, scale: float = 0.125) -> DataFrame:
    """v + scale * B(A v) for vectors with an adapter of their (user_id, agent); a is rank rows, b is rows of rank values."""
    inner = F.transform("a", lambda row: dot(row, F.col("vector")))
    joined = vectors.join(adapters, ["user_id", "agent"], "left").withColumn("inner", inner)
    moved = F.zip_with("vector", F.transform("b", lambda row: dot(row, F.col("inner"))), lambda v, m: v.cast("double") + m * scale)
    return joined.withColumn("vector", F.coalesce(moved, F.col("vector").cast("array<double>"))).drop("a", "b", "inner")


def adapter_stats(adapters: DataFrame) -> DataFrame:
    """Size (Frobenius norm) of both matrices of each adapter."""
    norm = lambda c: F.sqrt(F.aggregate(F.flatten(c), F.lit(0.0), lambda t, x: t + x * x))
    return adapters.select("user_id", "agent", F.round(norm("a"), 6).alias("norm_a"), F.round(norm("b"), 6).alias("norm_b"))


def token_budget(lines: DataFrame, headers: dict[str, str], budget: int) -> DataFrame:
    """lines (query_id, section, rank, line, and more) that fit each query's budget, with used_tokens after each: sections in order, each up to the first line that doesn't fit.

    A section starts with its header, which counts only if a line follows. Running sums decide, so all is windows by query.
    """
    query = W.partitionBy("query_id")
    running = F.sum(estimate_tokens(F.concat("line", F.lit("\n")))).over(W.partitionBy("query_id", "section").orderBy("rank"))
    out = lines.withColumn("running_", running).withColumn("used_", F.lit(0).cast("long")).withColumn("used_tokens", F.lit(None).cast("long"))
    for section, header in headers.items():
        cost = -(-len((header + "\n").encode()) // 4)
        after = F.col("used_") + cost + F.col("running_")
        out = out.withColumn("after_", F.when((F.col("section") == section) & (after <= budget), after))
        out = out.withColumns({"used_": F.coalesce(F.max("after_").over(query), "used_"), "used_tokens": F.coalesce("used_tokens", "after_")})
    return out.where("used_tokens is not null").drop("running_", "used_", "after_")


def retrieval_policy(queries: DataFrame, users: DataFrame) -> DataFrame:
    """Budget, least score and weight of time of each query: its own policy, else its user's, else the default."""
    # Tokens, least relevance and weight of time of each policy.
    table = {"precision": (400, 0.55, 0.35), "recall": (700, 0.15, 0.2), "stability": (500, 0.4, 0.8)}
    out = queries.join(users, "user_id", "left").withColumn("policy", F.coalesce("policy", "user_policy", F.lit("default")))

    def pick(i: int, other) -> Column:
        chain = F.lit(other)
        for name, row in table.items():
            chain = F.when(F.col("policy") == name, F.lit(row[i])).otherwise(chain)
        return chain

    tokens = F.greatest(F.lit(100), F.least(F.coalesce("max_tokens", pick(0, 500)), F.lit(10_000)))
    return out.select("query_id", "policy", tokens.alias("max_tokens"), pick(1, 0.3).alias("min_score"), pick(2, None).cast("double").alias("time_weight"))


def goal_adjust(facts: DataFrame, goals: DataFrame) -> DataFrame:
    """Relevance of each user's facts under the user's goal: label boost, key words, suppressed words; within 0.01 and 10."""
    out = facts.join(goals, "user_id", "left")
    boost = F.coalesce(F.try_element_at("label_boost", F.col("label")), F.lit(1.0))
    has = lambda c: F.coalesce(F.exists(c, lambda w: F.contains(F.lower("fact"), F.lower(w))), F.lit(False))
    factor = boost * F.when(has("keywords"), 1.5).otherwise(1.0) * F.when(has("suppress"), 0.5).otherwise(1.0)
    return out.withColumn("relevance", F.round(F.greatest(F.lit(0.01), F.least(F.col("relevance") * factor, F.lit(10.0))), 6))


def explain(parts: dict[str, DataFrame]) -> DataFrame:
    """One reason for each hit of a query: the first source that found it."""
    out = None
    for i, (name, part) in enumerate(parts.items()):
        tagged = part.select("query_id", "id", F.struct(F.lit(i).alias("order"), F.lit(name).alias("reason")).alias("found"))
        out = tagged if out is None else out.unionByName(tagged)
    return out.groupBy("query_id", "id").agg(F.min("found").alias("found")).select("query_id", "id", "found.reason")


def structured_context(facts: DataFrame, now: Column, key_facts: int = 10, changes: int = 5, days: int = 30, relations: int = 8, conflicts: int = 5) -> DataFrame:
    """Of each user the most certain active facts, the latest changes, the best supported relationships and open questions, as numbered rows of four sections.

    A question is open where a slot has several active facts; its newest fact stands for it.
    """
    def section(df: DataFrame, name: str, order: list[Column], most: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("user_id").orderBy(*order))
        return df.withColumn("rank", rank).where(F.col("rank") <= most).select("user_id", F.lit(name).alias("section"), "rank", "edge_id")

    recent = facts.where(F.col("invalid_at") > now - F.make_dt_interval(F.lit(days)))
    active = facts.where("invalid_at is null")
    out = section(active, "key_facts", [F.desc("confidence"), F.col("edge_id")], key_facts).unionByName(section(recent, "changes", [F.desc("invalid_at"), F.col("edge_id")], changes))
    out = out.unionByName(section(active, "relationships", [F.desc("corroboration_count"), F.desc("valid_at"), F.col("edge_id")], relations))
    slot = W.partitionBy("user_id", "source", "label")
    newest = F.row_number().over(slot.orderBy(F.desc("valid_at"), F.desc("edge_id")))
    open_ = active.withColumns({"newest": newest, "several": F.count("*").over(slot)}).where("newest = 1 and several > 1")
    return out.unionByName(section(open_, "open_questions", [F.desc("several"), F.col("edge_id")], conflicts))


def recall_eval(cases: DataFrame) -> DataFrame:
    """Whether a context holds all that it should, and whether its first bullet holds what it shouldn't."""
    first = F.regexp_extract("context", r"(?m)^- (.*)$", 1)
    low = F.lower("context")
    right = F.forall("contains", lambda w: F.contains(low, F.lower(w)))
    stale = F.exists("not_contains", lambda w: F.contains(F.lower(first), F.lower(w)))
    return cases.select("case_id", right.alias("right"), stale.alias("stale"))


def recent_fallback(queries: DataFrame, hits: DataFrame, episodes: DataFrame, most: int = 3) -> DataFrame:
    """The newest episodes of the user for each query that found nothing."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("episode_id")))
    newest = episodes.withColumn("rank", rank).where(F.col("rank") <= most).select("user_id", "episode_id", "rank")
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").join(newest, "user_id").select("query_id", "episode_id", "rank")
