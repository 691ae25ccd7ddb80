"""Queries over proposals, edge relevance, routes, proofs, upserts, evidence, chunks and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import models as M
from tidemark.operators import agents as A
from tidemark.plans.registry import NOW, query
from tidemark.sources import exports
from tidemark.sources import fixtures as X
from tidemark.sources.shared import shared_folder


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _has(text: str, phrases: list[str]) -> str:
    return f"len(list_filter({_list(phrases)}, lambda said: contains({text}, said)))"


@query("agg29_conflict_analysis", rf"""WITH c AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations),
p AS (SELECT a.conv_id AS proposal_id, a.t AS p, a.t || ' ' || coalesce(b.t, '') AS about FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = 1 WHERE a.turn = 0),
s AS (SELECT proposal_id, ({_has("t", A.SIGNAL_NEGATIONS)} > 0) <> ({_has("p", A.PROPOSAL_NEGATIONS)} > 0) AS bad FROM p JOIN c ON conv_id = proposal_id AND turn > 1
  WHERE len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: strlen(w) > 3 AND contains(about, w))) > 0),
n AS (SELECT proposal_id, count(s.bad) FILTER (NOT bad) AS supporting, count(s.bad) FILTER (bad) AS conflicting FROM p LEFT JOIN s USING (proposal_id) GROUP BY proposal_id),
r AS (SELECT *, CASE WHEN supporting + conflicting = 0 THEN 0.0::DOUBLE ELSE conflicting::DOUBLE / (supporting + conflicting) END AS score FROM n)
SELECT proposal_id, supporting, conflicting, round(score, 6) AS conflict_score, CASE WHEN score < 0.3 THEN 'proceed' WHEN score < 0.7 THEN 'review_conflicts' ELSE 'reject' END AS recommendation FROM r""")
def _(spark, d):
    said = X.table(spark, d, "conversations")
    core = said.where("turn = 1").select(F.col("conv_id").alias("agent_id"), F.col("text").alias("candidate_core"))
    asked = said.where("turn = 0").select(F.col("conv_id").alias("agent_id"), F.col("conv_id").alias("proposal_id"), F.col("text").alias("proposal")).join(core, "agent_id", "left")
    return A.conflict_analysis(asked, said.where("turn > 1").select(F.col("conv_id").alias("agent_id"), F.col("turn").alias("event_id"), F.col("text").alias("signal")))


@query("agg10_edge_rerank", f"""WITH {X.ASSERTIONS_SQL} SELECT edge_id, round(greatest(0.0, least(1.0, 0.35::DOUBLE * confidence + 0.35::DOUBLE * exp(-greatest(0, trunc((epoch_us({NOW}) - epoch_us(ingested_at)) / 1e6)) / 86400.0::DOUBLE / 120.0::DOUBLE)
  + 0.3::DOUBLE * ln(1 + corroboration_count) / 4)), 6) AS relevance FROM assertions""")
def _(spark, d):
    return A.edge_rerank(X.assertions(spark, d), X.at(X.NOW))


_SCORES = ", ".join(f"{{'n': {_has('t', phrases)}, 'place': {i}, 'strategy': '{name}'}}" for i, (name, phrases) in enumerate(A.ROUTES.items()))


@query("scl8_route", f"""WITH c AS (SELECT CAST(conv_id AS BIGINT) * 1000 + turn AS episode_id, lower(coalesce(text, '')) AS t FROM conversations),
s AS (SELECT episode_id, CASE WHEN x.n = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.35::DOUBLE + 0.15::DOUBLE * x.n) END AS score, x.place, x.strategy FROM (SELECT episode_id, unnest([{_SCORES}]) AS x FROM c)
  UNION ALL SELECT episode_id, 0.3::DOUBLE, 4, 'hybrid' FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, place) AS k FROM s)
SELECT episode_id, max(strategy) FILTER (k = 1) AS strategy, round(least(1.0::DOUBLE, 2 * (max(score) FILTER (k = 1) - max(score) FILTER (k = 2))), 6) AS confidence FROM r GROUP BY episode_id""")
def _(spark, d):
    return X.episodes(spark, d).select("episode_id", A.route(F.col("content")).alias("r")).select("episode_id", "r.strategy", "r.confidence")


@query("scl19_allowlist_proof", f"""WITH {X.ASSERTIONS_SQL}, h AS (SELECT edge_id, unhex(sha256('leaf:' || label)) AS leaf, unhex(sha256(source)) AS a, unhex(sha256(target)) AS b FROM assertions),
n AS (SELECT edge_id, b, unhex(sha256('node:'::BLOB || CASE WHEN edge_id % 2 = 0 THEN a || leaf ELSE leaf || a END)) AS low FROM h) SELECT edge_id, sha256('node:'::BLOB || low || b) AS root, edge_id % 3 > 0 AS ok FROM n""")
def _(spark, d):
    sibling = lambda c, left: F.struct(F.sha2(F.col(c), 256).alias("hash"), left.alias("left"))
    a = X.assertions(spark, d).withColumn("siblings", F.array(sibling("source", F.col("edge_id") % 2 == 0), sibling("target", F.lit(False))))
    a = a.withColumn("root", A.proof_root(F.col("label"), F.col("siblings")))
    told = F.when(F.col("edge_id") % 3 == 0, F.reverse("root")).otherwise(F.upper("root"))
    return a.select("edge_id", "root", A.allowlist_proof_ok(F.col("label"), F.col("siblings"), told).alias("ok"))


_UPSERT = f"""WITH {X.ASSERTIONS_SQL}, b AS (SELECT user_id, label, edge_id % 3 AS turn, arg_max(confidence, edge_id) AS confidence FROM assertions WHERE edge_id % 3 < 2 GROUP BY ALL),
t AS (SELECT user_id, label, max(confidence) + 1 AS confidence, -1 AS turn FROM assertions GROUP BY user_id, label)
SELECT user_id, label, round(arg_max(confidence, turn), 6) AS confidence FROM (SELECT user_id, label, turn, confidence FROM b UNION ALL SELECT user_id, label, turn, confidence FROM t) GROUP BY user_id, label"""


def _turns(spark, d):
    """What all assertions say by user and label, and two batches of them."""
    a = X.assertions(spark, d).select("edge_id", "user_id", "label", "confidence")
    return a.groupBy("user_id", "label").agg((F.max("confidence") + 1).alias("confidence")), a.where("edge_id % 3 = 0"), a.where("edge_id % 3 = 1")


@query("snk1_merge_upsert", _UPSERT)
def _(spark, d):
    target, *batches = _turns(spark, d)
    for batch in batches:
        target = exports.merge_upsert(target, batch, ["user_id", "label"], "edge_id")
    return target.withColumn("confidence", F.round("confidence", 6))


@query("snk1_bucket_upsert", _UPSERT)
def _(spark, d):
    """The same into files, of which each batch rewrites only the folders that it touches."""
    folder = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    target, *batches = _turns(spark, d)
    exports.create_buckets(target, ["user_id", "label"], folder, 16)
    for batch in batches:
        exports.upsert_buckets(batch, ["user_id", "label"], "edge_id", folder, 16)
    return exports.read_buckets(spark, folder).withColumn("confidence", F.round("confidence", 6))


@query("snk3_evidence_bundle", f"""WITH {X.ASSERTIONS_SQL} SELECT user_id AS subject, CAST(to_json(struct_pack(subject := user_id, facts := coalesce(list(struct_pack(id := edge_id, detail := fact) ORDER BY edge_id) FILTER (scope <> 'stable'), []),
  deliveries := list(struct_pack(id := edge_id, detail := CAST(1 + edge_id % 4 AS VARCHAR)) ORDER BY edge_id))) AS VARCHAR) AS bundle FROM assertions GROUP BY user_id""")
def _(spark, d):
    known = X.assertions(spark, d).where("scope <> 'stable'").select("user_id", F.col("edge_id").alias("id"), F.col("fact").alias("detail"))
    sent = X.deliveries(spark, d).select(F.col("webhook_id").alias("user_id"), F.col("delivery_id").alias("id"), F.col("attempts").alias("detail"))
    return exports.evidence_bundle("user_id", facts=known, deliveries=sent)


def _cut(a: str) -> str:
    w = f"substr(text, {a} + 1201, 300)"
    return f"CASE WHEN {a} + 1500 >= n THEN n WHEN regexp_matches({w}, '[.!?\\n]') THEN {a} + 1200 + length(regexp_extract({w}, '(?s)^.*[.!?\\n]')) ELSE {a} + 1500 END"


@query("gen1_chunk_fixed", f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, 0::BIGINT AS a, CAST({_cut("0")} AS BIGINT) AS b FROM d UNION ALL SELECT doc_id, b - 200, CAST({_cut("(b - 200)")} AS BIGINT) FROM c JOIN d USING (doc_id) WHERE b < n),
t AS (SELECT doc_id, a, trim(substr(text, a + 1, b - a), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS piece FROM c JOIN d USING (doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_index, a AS char_offset, strlen(piece) AS char_count, sha256(piece) AS text_sha256 FROM t WHERE piece <> ''""")
def _(spark, d):
    return M.chunk_fixed(X.table(spark, d, "documents").select("doc_id", "text")).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query("gen5_embed")
def _(spark, d):
    return M.embed(X.episodes(spark, d).select("episode_id", "content"), "content", M.hashing_embedder).select("episode_id", "vector")
