"""All queries over the memory tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import analytics as A
from tidemark.operators import crdt
from tidemark.operators import episodes as E
from tidemark.operators import facts as K
from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.plans import agents, attention, audits, core, fulltext, fusion, gaps, hybrid, imports, policies, resolution, similarity, stateful  # noqa: F401
from tidemark.plans.registry import AS_OF as _AS_OF
from tidemark.plans.registry import NOW as _NOW
from tidemark.plans.registry import ORACLES, QUERIES, query
from tidemark.plans.registry import T1 as _T1
from tidemark.plans.registry import T2 as _T2
from tidemark.plans.registry import age as _age
from tidemark.plans.registry import valid as _valid
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import at
from tidemark.streaming import windows as Z

_DAYS = {"message": 28, "text": 26, "json": 30}


# Temporal core


@query("facts_as_of_named", f"""WITH {X.FACTS_SQL}{X.ENTITIES_SQL} SELECT edge_id, f.user_id, label, source_episode_id, coalesce(s.name, 'Unknown') AS source_name, coalesce(t.name, 'Unknown') AS target_name
FROM facts f LEFT JOIN entities s ON s.user_id = f.user_id AND s.name = f.source LEFT JOIN entities t ON t.user_id = f.user_id AND t.name = f.target WHERE {_valid(_AS_OF)}""")
def _(spark, d):
    named = K.resolve_fact_names(K.facts_as_of(X.facts(spark, d), at(X.AS_OF)), X.entities(spark, d))
    return named.select("edge_id", "user_id", "label", "source_episode_id", "source_name", "target_name")


@query("win1_supersede", f"WITH {X.FACTS_SQL} SELECT edge_id, user_id, label, target, valid_at, invalid_at, invalidated_by FROM facts")
def _(spark, d):
    return X.facts(spark, d).select("edge_id", "user_id", "label", "target", "valid_at", "invalid_at", "invalidated_by")


@query("win2_belief_changes", f"""WITH {X.ASSERTIONS_SQL}, b AS (SELECT *, lag(target) OVER w AS old_target, lag(edge_id) OVER w AS old_edge_id FROM assertions
WINDOW w AS (PARTITION BY user_id, source, label ORDER BY ingested_at, edge_id)), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ingested_at DESC, edge_id DESC) AS rn FROM b WHERE lower(old_target) <> lower(target))
SELECT user_id, source, label, old_edge_id, edge_id AS new_edge_id, old_target, target AS new_target, ingested_at AS changed_at FROM c WHERE rn <= 1000""")
def _(spark, d):
    return K.belief_changes(X.assertions(spark, d))


@query("flt1_facts_current", f"WITH {X.FACTS_SQL} SELECT edge_id, user_id, fact FROM facts WHERE invalid_at IS NULL")
def _(spark, d):
    return K.facts_current(X.facts(spark, d)).select("edge_id", "user_id", "fact")


@query("flt2_facts_as_of", f"WITH {X.FACTS_SQL} SELECT edge_id, user_id, fact FROM facts WHERE {_valid(_AS_OF)}")
def _(spark, d):
    return K.facts_as_of(X.facts(spark, d), at(X.AS_OF)).select("edge_id", "user_id", "fact")


@query("flt3_edge_filter", f"WITH {X.FACTS_SQL} SELECT edge_id, fact, valid_at FROM facts WHERE label = 'purchase' AND classification <= 2 AND {_valid(_T2)} ORDER BY valid_at DESC, edge_id LIMIT 50")
def _(spark, d):
    return K.edge_filter(X.facts(spark, d), 50, label="purchase", at=at(X.T2), include_invalidated=True, max_class=2).select("edge_id", "fact", "valid_at")


@query("flt14_drop_expired", f"WITH {X.FACTS_SQL} SELECT edge_id, scope, expires_at FROM facts WHERE scope <> 'time_bounded' OR expires_at IS NULL OR expires_at > {_T2}")
def _(spark, d):
    return K.drop_expired(X.facts(spark, d), at(X.T2)).select("edge_id", "scope", "expires_at")


@query("flt17_agent_filter", f"WITH {X.FACTS_SQL} SELECT edge_id, fact FROM facts WHERE source_agent_id = 'a1'")
def _(spark, d):
    return K.agent_filter(X.facts(spark, d), "a1").select("edge_id", "fact")


@query("jn5_find_conflicting", f"""WITH {X.FACTS_OPEN_SQL} SELECT n.edge_id AS new_edge_id, f.edge_id FROM assertions n JOIN facts_open f USING (user_id, source, target, label)
WHERE n.valid_at >= {_T2} AND f.invalid_at IS NULL AND n.edge_id <> f.edge_id""")
def _(spark, d):
    return K.find_conflicting(X.assertions(spark, d).where(F.col("valid_at") >= at(X.T2)), X.facts_open(spark, d))


@query("jn6_fact_as_of_join", f"""WITH {X.FACTS_SQL} SELECT e.event_id, f.edge_id, f.target FROM events e JOIN facts f ON f.user_id = e.user_id AND f.label = e.event_type AND f.valid_at <= e.ts AND (f.invalid_at IS NULL OR e.ts < f.invalid_at)""")
def _(spark, d):
    rows = X.table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("label"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return K.fact_as_of_join(rows, X.facts(spark, d), "ts", horizon=at(X.NOW)).select("event_id", "edge_id", "target")


@query("jn7_snapshot_diff", f"""WITH {X.FACTS_SQL} SELECT edge_id, user_id, fact, CASE WHEN {_valid(_T2)} THEN 'gained' ELSE 'lost' END AS change FROM facts WHERE {_valid(_T2)} <> {_valid(_T1)}""")
def _(spark, d):
    return K.snapshot_diff(X.facts(spark, d), at(X.T1), at(X.T2))


@query("set3_time_travel_summary", f"""WITH {X.FACTS_SQL} SELECT user_id, count(*) FILTER ({_valid(_T2)}) AS gained, count(*) FILTER ({_valid(_T1)}) AS lost FROM facts WHERE {_valid(_T2)} <> {_valid(_T1)} GROUP BY user_id""")
def _(spark, d):
    return K.time_travel_summary(X.facts(spark, d), at(X.T1), at(X.T2))


@query("set1_timeline", f"""WITH {X.FACTS_SQL}, {X.EPISODES_SQL}, u AS (SELECT 'fact_added' AS event, CAST(user_id AS BIGINT) AS user_id, edge_id AS id, ingested_at AS happened_at FROM facts UNION ALL SELECT 'fact_superseded', user_id, edge_id, invalid_at FROM facts
UNION ALL SELECT 'episode_added', user_id, episode_id, created_at FROM episodes UNION ALL SELECT 'head_advanced', user_id, episode_id, created_at FROM episodes) SELECT * FROM u WHERE happened_at >= {_T1} AND happened_at < {_T2}""")
def _(spark, d):
    return K.timeline(X.facts(spark, d), X.episodes(spark, d), at(X.T1), at(X.T2))


@query("set2_changes_since", f"""WITH {X.FACTS_SQL}, c AS (SELECT user_id, count(*) FILTER (ingested_at > {_T1} AND ingested_at <= {_T2}) AS added, count(*) FILTER (invalid_at > {_T1} AND invalid_at <= {_T2}) AS superseded FROM facts GROUP BY user_id)
SELECT *, added || ' added, ' || superseded || ' superseded' AS summary FROM c WHERE added + superseded > 0""")
def _(spark, d):
    return K.changes_since(X.facts(spark, d), X.T1, X.T2)


@query("jn15_contradictions", f"""WITH {X.FACTS_OPEN_SQL} SELECT a.user_id, a.label, a.edge_id AS id1, b.edge_id AS id2 FROM facts_open a JOIN facts_open b USING (user_id, source, label)
WHERE a.edge_id < b.edge_id AND lower(a.target) <> lower(b.target) AND (a.invalid_at IS NULL OR b.valid_at < a.invalid_at) AND (b.invalid_at IS NULL OR a.valid_at < b.invalid_at)""")
def _(spark, d):
    return K.contradictions(X.facts_open(spark, d), at(X.NOW))


# Reports


@query("agg1_conflict_radar", f"""WITH {X.FACTS_OPEN_SQL}, g AS (SELECT user_id, source, label, count(*) FILTER (invalid_at IS NULL) AS active, count(*) FILTER (invalid_at IS NOT NULL AND {_age('invalid_at')} <= 7) AS recent FROM facts_open GROUP BY ALL)
SELECT *, active >= 2 AS needs_resolution, round(CASE WHEN active >= 2 THEN least(1.0, 0.5 + 0.15 * active::DOUBLE + 0.05 * recent::DOUBLE) ELSE least(0.5, 0.1 * recent::DOUBLE) END::DOUBLE, 6) AS severity FROM g WHERE active > 1 OR recent > 0""")
def _(spark, d):
    return A.conflict_radar(X.facts_open(spark, d), at(X.NOW))


@query("agg2_entity_coherence", f"""WITH {X.FACTS_OPEN_SQL}{X.ENTITIES_SQL} SELECT f.user_id, round(avg(CASE WHEN s.type IS NOT NULL AND t.type IS NOT NULL AND ((s.type <> t.type AND confidence >= 0.5) OR corroboration_count >= 2 OR confidence >= 0.7) THEN 1.0 ELSE 0.0 END), 6) AS entity_coherence, count(*) AS active
FROM facts_open f LEFT JOIN entities s ON s.user_id = f.user_id AND s.name = f.source LEFT JOIN entities t ON t.user_id = f.user_id AND t.name = f.target WHERE invalid_at IS NULL GROUP BY f.user_id""")
def _(spark, d):
    return A.entity_coherence(X.entities(spark, d), X.facts_open(spark, d))


@query("agg3_fact_coherence", f"""WITH {X.FACTS_OPEN_SQL}, g AS (SELECT user_id, source, label, count(DISTINCT lower(target)) > 1 AS c FROM facts_open WHERE invalid_at IS NULL GROUP BY ALL)
SELECT user_id, round(1 - count(*) FILTER (c)::DOUBLE / count(*), 6) AS fact_coherence FROM g GROUP BY user_id""")
def _(spark, d):
    return A.fact_coherence(X.facts_open(spark, d))


@query("agg4_temporal_coherence", f"""WITH {X.FACTS_SQL}, g AS (SELECT user_id, count(*) FILTER ({_age('ingested_at')} <= 14 AND invalid_at IS NULL AND corroboration_count >= 2) AS corroborated, count(*) FILTER (invalid_at IS NOT NULL AND {_age('invalid_at')} <= 14) AS superseded FROM facts GROUP BY user_id)
SELECT *, round(CASE WHEN corroborated + superseded = 0 THEN 0.9 ELSE 0.2 + 0.8 * corroborated::DOUBLE / (corroborated + superseded) END::DOUBLE, 6) AS temporal_coherence FROM g""")
def _(spark, d):
    return A.temporal_coherence(X.facts(spark, d), at(X.NOW), 14)


_IMPORTANCE = f"""{X.FACTS_OPEN_SQL}, act AS (SELECT * FROM facts_open WHERE invalid_at IS NULL), imp AS (SELECT *, 0.4::DOUBLE * ln(1 + corroboration_count::DOUBLE) / ln(11.0::DOUBLE)
+ 0.3::DOUBLE / (1 + count(*) OVER (PARTITION BY user_id, label)) + 0.3::DOUBLE * least(1.0, sqrt((count(*) OVER (PARTITION BY user_id, source) + count(*) OVER (PARTITION BY user_id, target))::DOUBLE) / 10) AS importance FROM act)"""


@query("agg7_edge_importance", f"WITH {_IMPORTANCE} SELECT edge_id, round(importance, 6) AS importance FROM imp")
def _(spark, d):
    return A.edge_importance(X.facts_open(spark, d)).select("edge_id", F.round("importance", 6).alias("importance"))


@query("agg8_stale_facts", f"""WITH {_IMPORTANCE}, e AS (SELECT *, greatest(0.0, least(1.0, confidence * least(1 + 0.1::DOUBLE * (corroboration_count - 1), 2.0) * pow(2.0::DOUBLE, -{_age('valid_at')} / 5.0::DOUBLE) * (1 + 2 * importance))) AS effective FROM imp)
SELECT edge_id, user_id, fact, round(importance, 6) AS importance, round(effective, 6) AS effective FROM e WHERE effective < 0.9""")
def _(spark, d):
    return A.stale_facts(X.facts_open(spark, d), at(X.NOW), 0.9, 5.0)


@query("agg9_node_degree", f"""WITH {X.GRAPH_SQL}, e AS (SELECT src AS node, 1 AS o FROM graph_edges UNION ALL SELECT dst, 0 FROM graph_edges)
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(1 - o) AS BIGINT) AS in_degree, count(*) AS degree FROM e GROUP BY node""")
def _(spark, d):
    return A.node_degree(X.graph_edges(spark, d))


@query("agg12_session_rollup", f"WITH {X.EPISODES_SQL} SELECT session_id, user_id, count(*) AS episodes, arg_max(episode_id, (created_at, episode_id)) AS head_episode_id, max(created_at) AS last_activity FROM episodes GROUP BY session_id, user_id")
def _(spark, d):
    return A.session_rollup(X.episodes(spark, d))


_RETAIN = "CASE type WHEN 'message' THEN 28 WHEN 'text' THEN 26 ELSE 30 END"


@query("agg13_policy_preview", f"WITH {X.EPISODES_SQL} SELECT user_id, type, count(*) AS affected FROM episodes WHERE {_age('created_at')} >= {_RETAIN} GROUP BY ROLLUP (user_id, type)")
def _(spark, d):
    return A.policy_preview(X.episodes(spark, d), at(X.NOW), _DAYS)


@query("agg15_webhook_stats", f"""WITH {X.DELIVERIES_SQL}, g AS (SELECT webhook_id, count(*) FILTER (delivered) AS ok, count(*) FILTER (NOT delivered AND attempts < 3) AS pending, count(*) FILTER (NOT delivered AND attempts >= 3) AS dead_letter,
count(*) FILTER (NOT delivered AND {_age('created_at')} <= 7) AS recent_failures, count(*) FILTER ({_age('created_at')} <= 7) AS recent FROM deliveries GROUP BY webhook_id)
SELECT webhook_id, ok AS delivered, pending, dead_letter, recent_failures, round(CASE WHEN recent > 0 THEN recent_failures::DOUBLE / recent ELSE 0.0 END::DOUBLE, 6) AS failure_rate FROM g""")
def _(spark, d):
    return A.webhook_stats(X.deliveries(spark, d), at(X.NOW))


@query("agg17_span_usage", """WITH s AS (SELECT user_id, 'm' || (user_id % 3) AS model, event_type AS operation, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, value AS latency, event_type <> 'error' AS success FROM events)
SELECT user_id, model, operation, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(count(*) FILTER (NOT success)::DOUBLE / count(*), 6) AS error_rate, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95 FROM s GROUP BY CUBE (user_id, model, operation)""")
def _(spark, d):
    e = X.table(spark, d, "events")
    spans = e.select("user_id", F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("event_type").alias("operation"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("latency"), (F.col("event_type") != "error").alias("success"))
    return A.span_usage(spans)


@query("agg19_compression_report", f"""WITH {X.VECTORS_SQL}, t AS (SELECT CASE WHEN a < 7 THEN 'full' WHEN a < 30 THEN 'half' WHEN a < 90 THEN 'int8' ELSE 'binary' END AS tier, len(vector) AS dims FROM (SELECT *, {_age('created_at')} AS a FROM vectors)),
b AS (SELECT tier, dims, CASE tier WHEN 'full' THEN 4.0 WHEN 'half' THEN 2.0 WHEN 'int8' THEN 1.0 ELSE 0.125 END::DOUBLE AS w FROM t)
SELECT tier, count(*) AS vectors, sum(dims * w) AS bytes, round(100 * (1 - sum(dims * w) / sum(dims * 4.0::DOUBLE)), 6) AS savings FROM b GROUP BY tier""")
def _(spark, d):
    return A.compression_report(X.vectors(spark, d), at(X.NOW))


# Episodes


@query("flt5_episode_filter", f"WITH {X.EPISODES_SQL} SELECT episode_id, role FROM episodes WHERE role IN ('user', 'assistant') AND list_has_any(CAST(json_extract_string(metadata, '$.tags[*]') AS VARCHAR[]), ['t1', 't2'])")
def _(spark, d):
    return E.episode_filter(X.episodes(spark, d), ["user", "assistant"], ["t1", "t2"]).select("episode_id", "role")


@query("flt7_processable", f"WITH {X.EPISODES_SQL} SELECT episode_id, role FROM episodes WHERE trim(content) <> '' AND role <> 'system'")
def _(spark, d):
    return E.processable(X.episodes(spark, d)).select("episode_id", "role")


@query("flt15_retention_split", f"WITH {X.EPISODES_SQL} SELECT episode_id, type, {_age('created_at')} < {_RETAIN} AS retained FROM episodes")
def _(spark, d):
    return E.retention_split(X.episodes(spark, d), at(X.NOW), _DAYS)


@query("flt16_contract_filter", f"WITH {X.EPISODES_SQL} SELECT episode_id, content FROM episodes WHERE role = 'user'")
def _(spark, d):
    return E.contract_filter(X.episodes(spark, d)).select("episode_id", "content")


@query("win3_thread_head", f"WITH {X.EPISODES_SQL} SELECT session_id, arg_max(episode_id, (created_at, episode_id)) AS head_episode_id, max(created_at) AS head_at, count(*) AS version FROM episodes GROUP BY session_id")
def _(spark, d):
    return E.thread_head(X.episodes(spark, d))


@query("win8_messages_page", f"WITH {X.EPISODES_SQL}, r AS (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, episode_id) - 1 AS INTEGER) AS idx, episode_id FROM episodes) SELECT * FROM r WHERE idx >= 2 AND idx < 5")
def _(spark, d):
    return E.messages_page(X.episodes(spark, d), 2, 3)


@query("str11_summary_trigger", f"WITH {X.EPISODES_SQL}, r AS (SELECT session_id, episode_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, episode_id) AS INTEGER) AS n FROM episodes) SELECT * FROM r WHERE n % 3 = 0")
def _(spark, d):
    return E.summary_trigger(X.episodes(spark, d), 3)


# Retrieval


_COSINE = f"""{X.VECTORS_SQL}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.vector, v.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(v.vector, v.vector))), 6) AS score
FROM vectors q JOIN vectors v USING (tenant) WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)"""


@query("vec1_cosine_topk", f"WITH {_COSINE} SELECT * FROM r WHERE rank <= 5")
def _(spark, d):
    v = X.vectors(spark, d)
    return R.cosine_topk(v.where("vec_id % 20 = 0"), v, 5)


@query("fus1_rrf", f"""WITH {_COSINE}, l AS (SELECT query_id, id, rank FROM r WHERE rank <= 10 UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) FROM r WHERE rank <= 10)
SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM l GROUP BY query_id, id""")
def _(spark, d):
    v = X.vectors(spark, d)
    best = R.cosine_topk(v.where("vec_id % 20 = 0"), v, 10)
    from pyspark.sql import Window as W

    by_id = best.select("query_id", "id", F.row_number().over(W.partitionBy("query_id").orderBy("id")).alias("rank"))
    return R.rrf(best.select("query_id", "id", "rank").unionByName(by_id))


# Graph


_REACH = f"""{X.GRAPH_SQL}, both_ways AS (SELECT src, dst FROM graph_edges UNION SELECT dst, src FROM graph_edges)"""


_WALK = f"""{_REACH}, walk AS (SELECT node AS seed, node, 0 AS depth FROM (SELECT DISTINCT src AS node FROM both_ways WHERE src % 20 = 0 AND src < 1000000000) UNION SELECT w.seed, b.dst, w.depth + 1 FROM walk w JOIN both_ways b ON b.src = w.node WHERE w.depth < 3),
near AS (SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY seed, node), reached AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, node) <= 500)"""


def _reached(spark: SparkSession, d: str) -> DataFrame:
    edges = X.graph_edges(spark, d)
    return G.bfs(edges.select(F.col("src").alias("node")).distinct().where("node % 20 = 0"), edges, 3)


@query("grf1_bfs", f"WITH RECURSIVE {_WALK} SELECT * FROM reached")
def _(spark, d):
    return _reached(spark, d)


@query("grf1_induced_edges", f"""WITH RECURSIVE {_WALK} SELECT DISTINCT a.seed, g.src, g.dst FROM graph_edges g JOIN reached a ON a.node = g.src JOIN reached b ON b.node = g.dst AND b.seed = a.seed""")
def _(spark, d):
    return G.induced_edges(_reached(spark, d), X.graph_edges(spark, d))


@query("grf6_connected_components", f"""WITH RECURSIVE {X.GRAPH_SQL}, u AS (SELECT DISTINCT a.src AS x, b.src AS y FROM graph_edges a JOIN graph_edges b USING (dst)),
walk AS (SELECT DISTINCT src AS root, src AS node FROM graph_edges UNION SELECT w.root, u.y FROM walk w JOIN u ON u.x = w.node), c AS (SELECT node, min(root) AS component FROM walk GROUP BY node)
SELECT node, component FROM c UNION SELECT dst, component FROM graph_edges JOIN c ON src = node""")
def _(spark, d):
    return G.connected_components(X.graph_edges(spark, d))


_ROUNDS = 6
_LABELS = f"{_REACH}, l0 AS (SELECT DISTINCT src AS node, src AS label FROM both_ways)" + "".join(
    f""", l{i} AS MATERIALIZED (SELECT node, label FROM (SELECT b.src AS node, label, count(*) AS n FROM both_ways b JOIN l{i - 1} l ON l.node = b.dst GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1)"""
    for i in range(1, _ROUNDS + 1)
)


@query("grf3_label_propagation", f"WITH {_LABELS} SELECT node, label FROM l{_ROUNDS}")
def _(spark, d):
    return G.label_propagation(X.graph_edges(spark, d), _ROUNDS)


@query("agg32_community_sizes", f"WITH {_LABELS} SELECT label, node, count(*) OVER (PARTITION BY label) AS members FROM l{_ROUNDS}")
def _(spark, d):
    return G.community_sizes(G.label_propagation(X.graph_edges(spark, d), _ROUNDS))


# Scalars over facts


@query("scl1_fact_temporal_score", f"""WITH {X.FACTS_SQL} SELECT edge_id, round(CASE WHEN invalid_at IS NOT NULL THEN 0.2 ELSE 0.6 + 0.4 * exp(-{_age('valid_at')} / 120.0::DOUBLE) END::DOUBLE, 6) AS current_score, round(exp(-{_age('valid_at')} / 30.0::DOUBLE), 6) AS recent_score,
CASE WHEN {_valid(_AS_OF)} THEN 0.95 ELSE 0.2 END::DOUBLE AS historical_score FROM facts""")
def _(spark, d):
    age, closed = S.age_days(at(X.NOW), F.col("valid_at")), F.col("invalid_at").isNotNull()
    scores = {k: F.round(S.fact_temporal_score(k, age, closed, K.valid_at(at(X.AS_OF))), 6).alias(f"{k}_score") for k in ("current", "recent", "historical")}
    return X.facts(spark, d).select("edge_id", *scores.values())


@query("scl5_reinforce", f"WITH {X.FACTS_SQL} SELECT edge_id, round(greatest(0.0, least(1.5, confidence / (1 + 0.05 * {_age('valid_at')}::DOUBLE) + 0.1::DOUBLE * log2(1 + access_count::DOUBLE))), 6) AS strength FROM facts")
def _(spark, d):
    return X.facts(spark, d).select("edge_id", F.round(S.reinforce(F.col("confidence"), S.age_days(at(X.NOW), F.col("valid_at")), F.col("access_count").cast("double")), 6).alias("strength"))


@query("scl9_estimate_tokens", f"WITH {X.EPISODES_SQL} SELECT episode_id, CAST(ceil(strlen(content) / 4.0) AS BIGINT) AS tokens FROM episodes")
def _(spark, d):
    return X.episodes(spark, d).select("episode_id", S.estimate_tokens(F.col("content")).alias("tokens"))


@query("jn1_resolve_fact_names", f"""WITH {X.FACTS_OPEN_SQL}{X.ENTITIES_SQL} SELECT edge_id, coalesce(s.name, 'Unknown') AS source_name, coalesce(t.name, 'Unknown') AS target_name
FROM facts_open f LEFT JOIN entities s ON s.user_id = f.user_id AND s.name = f.source LEFT JOIN entities t ON t.user_id = f.user_id AND t.name = f.target""")
def _(spark, d):
    return K.resolve_fact_names(X.facts_open(spark, d), X.entities(spark, d)).select("edge_id", "source_name", "target_name")


@query("win7_edge_reinforcement", "SELECT event_id % 500 AS edge_id, count(*) AS accesses, max(ts) AS last_access FROM events GROUP BY 1")
def _(spark, d):
    log = X.table(spark, d, "events").select((F.col("event_id") % 500).alias("edge_id"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return K.edge_reinforcement(log)


@query("flt20_page_after", "SELECT event_id, user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1) // 10 AS BIGINT) AS page FROM events")
def _(spark, d):
    return E.page_numbers(X.table(spark, d, "events"), "user_id", "ts", "event_id", 10).select("event_id", "user_id", "page")


@query("flt21_expire", f"SELECT event_id, user_id FROM events WHERE {_age('ts')} < 7")
def _(spark, d):
    return E.expire(X.table(spark, d, "events"), at(X.NOW), "ts", 7).select("event_id", "user_id")


_DELTAS = "deltas AS (SELECT user_id AS resource, event_type AS field, 'n' || (event_id % 3) AS node, epoch_ms(ts) AS wall, event_id % 5 AS counter, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events)"


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("resource"), F.col("event_type").alias("field"), F.concat(F.lit("n"), F.col("event_id") % 3).alias("node"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("wall"), (F.col("event_id") % 5).alias("counter"), F.get_json_object("props", "$.k").cast("long").alias("value"),
    )


@query("agg24_merge_counters", f"WITH {_DELTAS}, n AS (SELECT resource, field, node, max(value) AS v FROM deltas GROUP BY ALL) SELECT resource, field, CAST(sum(v) AS BIGINT) AS total FROM n GROUP BY resource, field")
def _(spark, d):
    return crdt.merge_counters(_deltas(spark, d))


@query("agg24_merge_registers", f"WITH {_DELTAS} SELECT resource, field, arg_max(value, (wall, counter, node, value)) AS value, arg_max(node, (wall, counter, node, value)) AS node FROM deltas GROUP BY resource, field")
def _(spark, d):
    return crdt.merge_registers(_deltas(spark, d))


@query("agg25_merge_clocks", f"WITH {_DELTAS} SELECT resource, node, max(counter) AS counter FROM deltas GROUP BY resource, node")
def _(spark, d):
    return crdt.merge_clocks(_deltas(spark, d))


# Streams, run over the files that are there


@query("str13_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    stream = Z.stream_files(spark, d, "events.parquet")
    return Z.run_to_end(Z.window_counts(stream, "ts", "event_type", "1 hour", "10 minutes"))
