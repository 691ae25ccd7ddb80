"""The whole read path for a table of queries, as one plan.

Classify, search by vector and by text among the user's entities, facts and episodes, fuse the ranks, keep
facts that are valid for what the query asks, add facts one hop from the best entities, weigh by time, and
fill a token budget. No query is handled on its own: all steps are joins, groupings and windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import texts as T
from tidemark.functions.scalars import age_days, blend, fact_temporal_score
from tidemark.operators.facts import valid_at
from tidemark.operators.fusion import token_budget
from tidemark.operators.graph import cut
from tidemark.operators.retrieval import all_words, keywords
from tidemark.operators.vector_index import ASKED, BLOCK, ROWS, matrix

#: Hits of each search by kind of item.
HITS = {"entity": 10, "fact": 15, "episode": 5}
HEADERS = {"entity": "Known entities:", "fact": "Current facts:", "episode": "Relevant conversations:"}
# Weight of time by intent, and what the kind of a query makes of it.
WEIGHTS = {"current": 0.35, "recent": 0.45, "historical": 0.55}
RANK_CONSTANT = 60


def time_weight(intent: Column, kind: Column) -> Column:
    """Questions about time weigh it 0.55 at least, questions for a fact 0.2 at most."""
    base = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[intent]
    return F.when(kind == "temporal", F.greatest(base, F.lit(0.55))).when(kind == "factual", F.least(base, F.lit(0.2))).otherwise(base)


def _ranked(scored: DataFrame) -> DataFrame:
    """(query_id, kind, id, rank): the best of each query and kind; equal scores go by id."""
    rank = F.row_number().over(W.partitionBy("query_id", "kind").orderBy(F.desc("score"), "id"))
    most = F.create_map(*[F.lit(x) for pair in HITS.items() for x in pair])[F.col("kind")]
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "kind", "id", "rank")


def _dealt(queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with bucket, part and turn: many users share a bucket; the items of one of more than ROWS go to several parts, queries beyond ASKED to several turns.

    The few such users are broadcast, so that vectors are shuffled once, to where they are compared.
    """
    count = lambda rows, name: rows.groupBy("user_id").agg(F.count("*").alias(name))
    sizes = cut(count(items, "items").join(count(queries, "asked"), "user_id"))
    rows = sizes.agg(F.sum(F.col("items") + F.col("asked"))).first()[0] or 0
    large = F.broadcast(sizes.where((F.col("items") > ROWS) | (F.col("asked") > ASKED)).select("user_id", F.ceil(F.col("items") / ROWS).cast("int").alias("parts"), F.ceil(F.col("asked") / ASKED).cast("int").alias("turns")))
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(max(1, -(-rows // ROWS)))).cast("int").alias("bucket")
    one = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    left = queries.join(large, "user_id", "left").select("*", bucket, one("query_id", "turns").alias("turn"), every("parts").alias("part"))
    right = items.join(large, "user_id", "left").select("*", bucket, one("id", "parts").alias("part"), every("turns").alias("turn"))
    return left.drop("parts", "turns"), right.drop("parts", "turns")


def _filled(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, zeros where there is none, and where there is one."""
    there = pc.is_valid(column).to_numpy()
    some = matrix(column.filter(pa.array(there))) if there.any() else np.zeros((0, 1))
    out = np.zeros((len(there), some.shape[1]))
    out[there] = some
    return out, there


def _first(query: np.ndarray, item: np.ndarray, score: np.ndarray, kind: np.ndarray, name: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hits that are among the `most` of their query and kind; equal scores by name."""
    order = np.lexsort((name[item], -score, kind[item], query))
    query, item, score = query[order], item[order], score[order]
    at = np.arange(len(query))
    new = np.append(True, (query[1:] != query[:-1]) | (kind[item[1:]] != kind[item[:-1]]))[: len(at)]
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < most[kind[item]]
    return query[keep], item[keep], score[keep]


def _nearest(queries: pa.Table, items: pa.Table) -> pa.Table:
    """(query_id, kind, id, score): the best items of each query and kind among its user's of this part, by a product of matrices for each user; BLOCK scores are held at once."""
    kinds = pc.unique(items.column("kind")).to_pylist()
    most = np.array([HITS.get(k, 0) for k in kinds] or [0])
    kind = pc.index_in(items.column("kind"), value_set=pa.array(kinds, type=items.schema.field("kind").type)).to_numpy().astype(np.int64)
    name = pc.rank(items.column("id").combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
    user = np.unique(np.concatenate([t.column("user_id").to_numpy() for t in (queries, items)]), return_inverse=True)[1]
    asking, owner = user[: len(queries)], user[len(queries) :]
    by_user, by_owner = np.argsort(asking, kind="stable"), np.lexsort((kind, owner))
    here = np.unique(asking)
    edges = [np.searchsorted(x[order], here, side=side).tolist() for x, order in ((asking, by_user), (owner, by_owner)) for side in ("left", "right")]
    (q, q_there), (v, v_there) = _filled(queries.column("q")), _filled(items.column("vector"))
    q_norm, v_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    found, held, done = [], 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a, b, c, d in zip(*edges, strict=True):
        mine = by_owner[c:d]
        step = max(1, BLOCK // max(1, len(mine)))
        ends = np.searchsorted(kind[mine], np.arange(len(kinds) + 1)).tolist()
        for at in range(a, b if len(mine) else a, step):
            asked = by_user[at : min(b, at + step)]
            with np.errstate(divide="ignore", invalid="ignore"):
                near = q[asked] @ v[mine].T if q.shape[1] == v.shape[1] else np.zeros((len(asked), len(mine)))
                near = near / (q_norm[asked][:, None] * v_norm[mine])
                near = np.sign(near) * np.floor(np.abs(near) * 1e6 + 0.5) / 1e6 + 0.0  # halves go away from zero
            near[np.isnan(near)] = np.inf  # without length: not a number, which comes first
            near[~(q_there[asked][:, None] & v_there[mine])] = -np.inf  # without a vector: no score, which comes last
            for k, (first, last) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if first < last and most[k]:
                    some = near[:, first:last]
                    place = last - first - most[k]
                    row, column = np.nonzero(some >= np.partition(some, place, axis=1)[:, place, None] if place > 0 else np.ones_like(some, dtype=bool))
                    found.append((asked[row], mine[first + column], some[row, column]))
                    held += len(row)
            if held > BLOCK:
                done.append(_first(*map(np.concatenate, zip(*found, strict=True)), kind, name, most))
                found, held = [], 0
    if found:
        done.append(_first(*map(np.concatenate, zip(*found, strict=True)), kind, name, most))
    query, item, score = map(np.concatenate, zip(*done, strict=True))
    out = [queries.column("query_id").take(pa.array(query)), *(items.column(c).take(pa.array(item)) for c in ("kind", "id"))]
    return pa.table([*out, pa.array(np.where(score == np.inf, np.nan, score), mask=score == -np.inf)], ["query_id", "kind", "id", "score"])


def by_vector(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of queries and items are never rows: each task scores those of its users and gives back the best. Items that lack a vector come last."""
    kinds = dict(queries.dtypes) | {c: t for c, t in items.dtypes if c in ("kind", "id")}
    left, right = _dealt(queries.select("query_id", "user_id", F.col("vector").alias("q")).where("user_id is not null"), items.select("user_id", "kind", "id", "vector").where("user_id is not null"))
    keys = ["bucket", "part", "turn"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest, f"query_id {kinds['query_id']}, kind {kinds['kind']}, id {kinds['id']}, score double")
    return _ranked(best)


def by_text(queries: DataFrame, items: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 among the user's items of each kind; how rare a word is counts over all items of the kind."""
    asked = queries.select("query_id", "user_id", F.explode(F.array_distinct(keywords("text"))).alias("term"))
    words = items.select("user_id", "kind", "id", all_words("text").alias("words"))
    total = words.groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    # Terms and their weights are tables of known size, so that where they are few neither words nor matches are dealt by term, of which some are very common.
    terms = cut(asked.select("term").distinct())
    each = words.select("user_id", "kind", "id", F.size("words").alias("len"), F.explode("words").alias("term")).join(terms, "term", "left_semi")
    tf = cut(each.groupBy("user_id", "kind", "id", "len", "term").agg(F.count("*").alias("tf")))  # read twice: texts are taken apart once
    df = tf.groupBy("kind", "term").agg(F.count("*").alias("df")).join(total, "kind")
    weighted = cut(df.select("kind", "term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = asked.join(tf, ["user_id", "term"]).join(weighted, ["kind", "term"]).groupBy("query_id", "kind", "id").agg(F.sum(part).alias("s"))
    return _ranked(scored.select("query_id", "kind", "id", F.round(F.col("s") / (F.col("s") + 1), 6).alias("score")))


def _fitting(now: Column) -> Column:
    """Whether a fact is one that the query may tell: valid at its as_of or any for historical queries, else current and not expired."""
    current = F.col("invalid_at").isNull() & ((F.col("scope") != "time_bounded") | F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return F.when(F.col("intent") == "historical", F.col("as_of").isNull() | valid_at(F.col("as_of"))).otherwise(current)


def hybrid_retrieve(queries: DataFrame, items: DataFrame, facts: DataFrame, episodes: DataFrame, now: Column, budget: int = 500) -> DataFrame:
    """(query_id, section, rank, id, relevance, used_tokens): the lines of each query's context.

    queries: query_id, user_id, text, vector, as_of. items: user_id, kind (entity, fact, episode), id, text, vector. Facts and episodes
    give times; their ids as strings are the items' ids, entities' ids are their names.
    """
    asked = queries.withColumns({"intent": T.temporal_intent(F.col("text")), "query_kind": T.query_type(F.col("text"))["kind"]})
    asked = asked.withColumn("weight", time_weight(F.col("intent"), F.col("query_kind")))
    lists = by_vector(asked, items).unionByName(by_text(asked, items))
    fused = lists.groupBy("query_id", "kind", "id").agg(F.sum(1 / (RANK_CONSTANT + F.col("rank"))).alias("score"))
    # Hits, a few for each query, are cut off here: four parts of the plan go on from them.
    fused = cut(fused.join(asked.select("query_id", "user_id", "intent", "weight", "as_of"), "query_id"))

    entities = fused.where("kind = 'entity'")
    told = facts.select(F.col("edge_id").cast("string").alias("id"), "user_id", "source", "fact", "valid_at", "invalid_at", "scope", "expires_at")
    hits = fused.where("kind = 'fact'").drop("kind").join(told, ["user_id", "id"])
    best = entities.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))).where("rank <= 3")
    hops = best.select("query_id", "user_id", "intent", "weight", "as_of", F.col("id").alias("source"), (F.col("score") * 0.8).alias("score")).join(told, ["user_id", "source"])
    hops = hops.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = hits.select(*hops.columns).unionByName(hops).where(_fitting(now))

    age, closed = age_days(now, F.col("valid_at")), F.col("invalid_at").isNotNull()
    fits = F.when(F.col("as_of").isNull(), 0.6).otherwise(fact_temporal_score("historical", age, closed, valid_at(F.col("as_of"))))
    fits = F.when(F.col("intent") == "historical", fits).when(F.col("intent") == "recent", fact_temporal_score("recent", age, closed)).otherwise(fact_temporal_score("current", age, closed))
    relevance = F.when(F.col("scope") == "stable", F.col("score")).otherwise(blend(F.col("score"), F.col("weight"), fits))  # time does not wear stable facts
    facts_out = both.select("query_id", F.lit("fact").alias("section"), "id", F.col("fact").alias("text"), relevance.alias("relevance"))
    entities_out = entities.select("query_id", F.lit("entity").alias("section"), "id", F.col("id").alias("text"), blend(F.col("score"), F.col("weight") * 0.4, F.lit(0.6)).alias("relevance"))
    said = episodes.select("user_id", F.col("episode_id").cast("string").alias("id"), "content", "created_at")
    age = age_days(now, F.col("created_at"))
    fits = F.when(F.col("intent") == "historical", T.episode_temporal_score("historical", age)).otherwise(T.episode_temporal_score("current", age))
    said = fused.where("kind = 'episode'").drop("kind").join(said, ["user_id", "id"]).withColumn("fits", fits).where((F.col("intent") == "historical") | (F.col("fits") >= 0.01))
    said_out = said.select("query_id", F.lit("episode").alias("section"), "id", F.col("content").alias("text"), blend(F.col("score"), F.col("weight"), F.col("fits")).alias("relevance"))

    every = entities_out.unionByName(facts_out).unionByName(said_out).withColumn("relevance", F.round("relevance", 6))
    every = every.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "section").orderBy(F.desc("relevance"), "id")))
    return token_budget(every.withColumn("line", F.concat(F.lit("- "), "text")).drop("text"), HEADERS, budget).drop("line")
