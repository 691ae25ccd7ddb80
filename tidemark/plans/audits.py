"""Queries over audits, reports, proposals, experiences and evaluations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.operators import audits as U
from tidemark.operators import retrieval as R
from tidemark.plans.registry import NOW, T1, T2, age, query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import at

_VERSIONS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


def _chain(spark, d):
    """Chains of up to 16 events: two legacy ones, then each with the hash before it. Every 97th event was altered."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = X.table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("action"), F.col("ts").cast("timestamp_ntz").alias("created_at"), n.alias("n"))
    e = e.select(F.concat_ws(":", "user_id", F.floor(F.col("n") / 16)).alias("chain"), (F.col("n") % 16 + 1).alias("to_version"), "event_id", "action", "created_at")
    rows = e.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("to_version", "event_id", "action", "created_at"))).alias("rows"))
    start = F.array().cast("array<struct<to_version:int,event_id:bigint,action:string,created_at:timestamp_ntz,prev_hash:string,own:string>>")

    def add(done, r):
        prev = F.coalesce(F.try_element_at(done, F.lit(-1))["own"], F.lit(""))
        own = F.when(r["to_version"] <= 2, "").otherwise(U.chain_hash(r["action"], r["to_version"] - 1, r["to_version"], prev, r["created_at"]))
        return F.concat(done, F.array(F.struct(r["to_version"].alias("to_version"), r["event_id"].alias("event_id"), r["action"].alias("action"), r["created_at"].alias("created_at"), prev.alias("prev_hash"), own.alias("own"))))

    e = rows.select("chain", F.inline(F.aggregate("rows", start, add)))
    return e.withColumns({"from_version": F.col("to_version") - 1, "event_hash": F.when((F.col("event_id") % 97 == 0) & (F.col("own") != ""), "00").otherwise(F.col("own"))})


@query("win4_audit_chain_verify", f"""WITH v AS ({_VERSIONS}), c AS (SELECT event_id, user_id, (n - 1) // 16 AS c, (n - 1) % 16 + 1 AS v FROM v), l AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id, c ORDER BY v) AS p FROM c)
SELECT event_id, CASE WHEN v <= 2 THEN 'legacy' WHEN event_id % 97 = 0 THEN 'altered' WHEN v > 3 AND p % 97 = 0 THEN 'unlinked' ELSE 'ok' END AS state FROM l""")
def _(spark, d):
    return U.audit_chain_verify(_chain(spark, d), "chain").select("event_id", "state")


_AUDIT = "CASE event_id % 3 WHEN 0 THEN 'policy_violation_' || event_type ELSE event_type END"


@query("agg14_violations", f"SELECT user_id, 'policy_violation_' || event_type AS action, count(*) AS n, max(ts) AS last_at FROM events WHERE event_id % 3 = 0 AND ts > {T1} AND ts <= {T2} GROUP BY ALL")
def _(spark, d):
    audit = X.table(spark, d, "events").selectExpr("user_id", f"{_AUDIT} AS action", "cast(ts AS timestamp_ntz) AS created_at")
    return U.violations(audit, at(X.T1), at(X.T2))


@query("snk2_audit_export", f"""SELECT CASE WHEN event_type = 'signup' THEN 'governance' ELSE 'webhook' END AS kind, event_id AS id, ts AS created_at, CASE WHEN event_type = 'signup' THEN user_id END AS user_id FROM events WHERE event_type IN ('signup', 'error') AND ts > {T1} AND ts <= {T2}""")
def _(spark, d):
    e = X.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), "user_id", "event_type")
    return U.audit_export({"governance": e.where("event_type = 'signup'").drop("event_type"), "webhook": e.where("event_type = 'error'").drop("event_type", "user_id")}, at(X.T1), at(X.T2))


@query("agg16_incidents", f"""WITH {X.DELIVERIES_SQL}, {X.FACTS_OPEN_SQL}, s AS (SELECT webhook_id, count(*) FILTER (NOT delivered AND attempts < 3) AS pending, count(*) FILTER (NOT delivered AND attempts >= 3) AS dead, count(*) FILTER (NOT delivered AND {age('created_at')} <= 7) AS rf, count(*) FILTER ({age('created_at')} <= 7) AS rc FROM deliveries GROUP BY 1),
r AS (SELECT *, round(CASE WHEN rc > 0 THEN rf::DOUBLE / rc ELSE 0.0 END::DOUBLE, 6) AS rate FROM s), g AS (SELECT user_id, source, label, count(*) FILTER (invalid_at IS NULL) AS active, count(*) FILTER (invalid_at IS NOT NULL AND {age('invalid_at')} <= 7) AS recent FROM facts_open GROUP BY ALL),
c AS (SELECT user_id, max(round(least(1.0, 0.5 + 0.15 * active::DOUBLE + 0.05 * recent::DOUBLE), 6)) AS severity, count(*) AS n FROM g WHERE active >= 2 GROUP BY user_id)
SELECT 'dead_letters' AS kind, 'high' AS severity, webhook_id AS subject, dead::DOUBLE AS size FROM r WHERE dead > 0 UNION ALL SELECT 'failure_rate', 'high', webhook_id, rate FROM r WHERE rate >= 0.3 UNION ALL SELECT 'backlog', 'medium', webhook_id, pending FROM r WHERE pending >= 5
UNION ALL SELECT 'conflict', 'high', user_id, severity FROM c WHERE severity >= 0.9 UNION ALL SELECT 'many_conflicts', 'low', user_id, n FROM c WHERE n >= 4""")
def _(spark, d):
    return U.incidents(A.webhook_stats(X.deliveries(spark, d), at(X.NOW)), A.conflict_radar(X.facts_open(spark, d), at(X.NOW)))


@query("agg18_step_metrics", """SELECT event_type AS step, count(*) AS executions, count(*) FILTER (value < 20) AS successes, count(*) FILTER (value >= 20) AS failures, CAST(sum(event_id % 4) AS BIGINT) AS retries, round(count(*) FILTER (value >= 20)::DOUBLE / count(*), 6) AS error_rate, round(avg(value), 6) AS mean_duration FROM events GROUP BY 1""")
def _(spark, d):
    return U.step_metrics(X.table(spark, d, "events").selectExpr("event_type AS step", "value < 20 AS success", "event_id % 4 AS retries", "value AS duration"))


_STRUCT = f"""{X.FACTS_OPEN_SQL}{X.ENTITIES_SQL}, act AS (SELECT * FROM facts_open WHERE invalid_at IS NULL), touched AS (SELECT DISTINCT user_id, source AS name, source AS component FROM act UNION SELECT user_id, target, source FROM act),
sc AS (SELECT e.user_id, count(*) AS entities, count(DISTINCT t.component) + count(*) FILTER (t.component IS NULL) AS communities, count(*) FILTER (t.component IS NULL) AS isolated FROM entities e LEFT JOIN touched t USING (user_id, name) GROUP BY 1)"""


def _components(spark, d):
    """Every fact's source is its user, so each user's touched entities form one component, named after the user."""
    f = X.facts_open(spark, d).where("invalid_at is null")
    return f.select("user_id", F.explode(F.array("source", "target")).alias("name"), F.col("source").alias("component")).distinct()


@query("agg5_structural_coherence", f"WITH {_STRUCT} SELECT *, round(CASE WHEN entities <= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - 0.8 * communities::DOUBLE / entities - 0.4 * isolated::DOUBLE / entities)) END::DOUBLE, 6) AS structural_coherence FROM sc")
def _(spark, d):
    return U.structural_coherence(X.entities(spark, d), X.facts_open(spark, d), _components(spark, d))


@query("agg6_coherence_report", f"""WITH {_STRUCT}, s AS (SELECT user_id, round(CASE WHEN entities <= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - 0.8 * communities::DOUBLE / entities - 0.4 * isolated::DOUBLE / entities)) END::DOUBLE, 6) AS structural_coherence FROM sc),
e AS (SELECT f.user_id, round(avg(CASE WHEN s.type IS NOT NULL AND t.type IS NOT NULL AND ((s.type <> t.type AND confidence >= 0.5) OR corroboration_count >= 2 OR confidence >= 0.7) THEN 1.0 ELSE 0.0 END), 6) AS entity_coherence FROM act f LEFT JOIN entities s ON s.user_id = f.user_id AND s.name = f.source LEFT JOIN entities t ON t.user_id = f.user_id AND t.name = f.target GROUP BY 1),
g AS (SELECT user_id, source, label, count(DISTINCT lower(target)) > 1 AS c FROM act GROUP BY ALL), f AS (SELECT user_id, round(1 - count(*) FILTER (c)::DOUBLE / count(*), 6) AS fact_coherence FROM g GROUP BY 1),
k AS (SELECT user_id, count(*) FILTER ({age('ingested_at')} <= 14 AND invalid_at IS NULL AND corroboration_count >= 2) AS co, count(*) FILTER (invalid_at IS NOT NULL AND {age('invalid_at')} <= 14) AS su FROM facts_open GROUP BY 1), t AS (SELECT user_id, round(CASE WHEN co + su = 0 THEN 0.9 ELSE 0.2 + 0.8 * co::DOUBLE / (co + su) END::DOUBLE, 6) AS temporal_coherence FROM k),
j AS (SELECT user_id, structural_coherence, coalesce(entity_coherence, 1.0) AS entity_coherence, coalesce(fact_coherence, 1.0) AS fact_coherence, coalesce(temporal_coherence, 1.0) AS temporal_coherence FROM s LEFT JOIN e USING (user_id) LEFT JOIN f USING (user_id) LEFT JOIN t USING (user_id))
SELECT *, round(entity_coherence * 0.20::DOUBLE + fact_coherence * 0.35::DOUBLE + temporal_coherence * 0.20::DOUBLE + structural_coherence * 0.25::DOUBLE, 5) AS coherence, concat_ws(',', CASE WHEN entity_coherence < 0.5 THEN 'review entity' END, CASE WHEN fact_coherence < 0.5 THEN 'review fact' END, CASE WHEN temporal_coherence < 0.5 THEN 'review temporal' END, CASE WHEN structural_coherence < 0.5 THEN 'review structural' END) AS advice FROM j""")
def _(spark, d):
    return U.coherence_report(X.entities(spark, d), X.facts_open(spark, d), _components(spark, d), at(X.NOW), 14)


@query("agg10_entity_rerank", f"""WITH {X.FACTS_OPEN_SQL}{X.ENTITIES_SQL}, e AS (SELECT user_id, unnest([source, target]) AS name FROM facts_open WHERE invalid_at IS NULL), g AS (SELECT user_id, name, count(*) AS degree FROM e GROUP BY ALL)
SELECT user_id, name, round(greatest(0.0, least(1.0, 0.3::DOUBLE * ln(1 + mention_count::DOUBLE) / 6 + 0.4::DOUBLE * exp(-((epoch_us({NOW}) - epoch_us(updated_at)) / 86400000000.0::DOUBLE) / 120) + 0.3::DOUBLE * ln(1 + coalesce(degree, 0)::DOUBLE) / 4)), 6) AS relevance FROM entities LEFT JOIN g USING (user_id, name)""")
def _(spark, d):
    return U.relevance_of_entities(X.entities(spark, d), X.facts_open(spark, d), at(X.NOW))


@query("agg11_digest_inputs", f"""WITH {X.FACTS_OPEN_SQL}{X.ENTITIES_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mention_count DESC, name) AS rn FROM entities), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_at DESC, edge_id) AS rn FROM facts_open WHERE invalid_at IS NULL),
a AS (SELECT user_id, count(*) AS entities, string_agg(name || ' (' || type || ')', chr(10) ORDER BY rn) FILTER (rn <= 4) AS entities_lines FROM e GROUP BY 1), b AS (SELECT user_id, count(*) AS facts, string_agg(fact, chr(10) ORDER BY rn) FILTER (rn <= 6) AS facts_lines FROM f GROUP BY 1)
SELECT user_id, entities, entities_lines, coalesce(facts, 0) AS facts, coalesce(facts_lines, '') AS facts_lines FROM a LEFT JOIN b USING (user_id)""")
def _(spark, d):
    return U.digest_inputs(X.entities(spark, d), X.facts_open(spark, d), 4, 6)


_EXP = "x AS (SELECT event_id, 'a' || user_id AS agent, event_type AS category, (event_id % 10)::DOUBLE / 10 AS weight, 0.5::DOUBLE + (event_id % 50)::DOUBLE / 100 AS confidence, ts AS at FROM events)".replace("AS at", 'AS "at"')


def _experiences(spark, d):
    return X.table(spark, d, "events").selectExpr("event_id", "concat('a', user_id) AS agent", "event_type AS category", "cast(event_id % 10 AS double) / 10 AS weight", "0.5D + cast(event_id % 50 AS double) / 100 AS confidence", "cast(ts AS timestamp_ntz) AS at")


@query("agg27_experience_importance", f"""WITH {_EXP}, p AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY "at", event_id) AS rn FROM x), j AS (SELECT a.event_id, count(b.event_id) AS n, any_value(a.confidence) AS c, any_value(a.weight) AS w, avg(b.confidence) AS m FROM p a LEFT JOIN p b ON a.agent = b.agent AND a.category = b.category AND b.rn BETWEEN a.rn - 49 AND a.rn - 1 GROUP BY a.event_id)
SELECT event_id, n, round(CASE WHEN n = 0 THEN 1.0 ELSE 0.4::DOUBLE / (1 + n) + 0.35::DOUBLE * (1 - abs(c - m)) + 0.25::DOUBLE * w END::DOUBLE, 6) AS importance FROM j""")
def _(spark, d):
    return U.experience_importance(_experiences(spark, d)).select("event_id", "n", "importance")


_DECAYED = f"weight * confidence * pow(2.0::DOUBLE, -{age('at')} / 30.0::DOUBLE)".replace("(at)", '("at")')


@query("set4_fork_experiences", f"""WITH {_EXP}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY agent ORDER BY "at" DESC, event_id DESC) AS INTEGER) AS rank FROM x WHERE category IN ('purchase', 'view') AND confidence >= 0.6 AND {_DECAYED} >= 0.2)
SELECT agent || '-fork' AS agent, sha256(agent || ':' || event_id) AS fork_id, event_id, rank FROM r WHERE rank <= 40""")
def _(spark, d):
    return U.fork_experiences(_experiences(spark, d), ["purchase", "view"], 0.6, 0.2, at(X.NOW), 40)


@query("ret8_agent_context", f"""WITH {_EXP}, r AS (SELECT *, {_DECAYED} AS decayed, row_number() OVER (PARTITION BY agent ORDER BY "at" DESC, event_id DESC) AS rank FROM x)
SELECT agent, count(*) AS experiences, string_agg(event_id, ',' ORDER BY rank) FILTER (rank <= 8) AS shown, round(sum(decayed), 5) AS weight FROM r WHERE rank <= 50 GROUP BY agent""")
def _(spark, d):
    return U.agent_context(_experiences(spark, d), at(X.NOW))


@query("win9_identity_versions", f"""WITH {_EXP}, v AS (SELECT agent, category || event_id AS core, row_number() OVER (PARTITION BY agent ORDER BY "at", event_id) AS version FROM x)
SELECT agent, CAST(max(version) FILTER (version <= 5) AS INTEGER) AS restored, arg_max(core, version) FILTER (version <= 5) AS core, CAST(max(version) + 1 AS INTEGER) AS version FROM v GROUP BY agent""")
def _(spark, d):
    return U.identity_at(_experiences(spark, d).withColumn("core", F.concat("category", "event_id")), 5)


@query("win10_replay_events", f"""WITH {X.DELIVERIES_SQL}, c AS (SELECT webhook_id, min(delivery_id) + 500 AS after_id FROM deliveries GROUP BY 1), r AS (SELECT webhook_id, delivery_id, CAST(row_number() OVER (PARTITION BY webhook_id ORDER BY delivery_id) AS INTEGER) AS rank FROM deliveries JOIN c USING (webhook_id) WHERE delivery_id > after_id AND NOT delivered) SELECT * FROM r WHERE rank <= 3""")
def _(spark, d):
    sent = X.deliveries(spark, d)
    return U.replay(sent, sent.groupBy("webhook_id").agg((F.min("delivery_id") + 500).alias("after_id")), 3).select("webhook_id", "delivery_id", "rank")


@query("agg30_proposal_status", f"""WITH p AS (SELECT o_orderkey AS proposal_id, 1 + o_orderkey % 3 AS quorum, 24 * (o_orderkey % 2) AS cooling, 240 AS deadline, {NOW} - to_hours(CAST(o_orderkey % 400 AS INTEGER)) AS created_at FROM orders), v AS (SELECT l_orderkey AS proposal_id, count(DISTINCT l_suppkey) FILTER (l_linenumber <> 6) AS approvers, bool_or(l_linenumber = 6) AS refused FROM lineitem GROUP BY 1)
SELECT proposal_id, coalesce(approvers, 0) AS approvers, CASE WHEN coalesce(refused, false) THEN 'rejected' WHEN coalesce(approvers, 0) >= quorum AND (epoch_us({NOW}) - epoch_us(created_at)) / 3600000000 >= cooling THEN 'approved' WHEN (epoch_us({NOW}) - epoch_us(created_at)) / 3600000000 > deadline THEN 'expired' ELSE 'pending' END AS status FROM p LEFT JOIN v USING (proposal_id)""")
def _(spark, d):
    made = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("proposal_id"), (1 + F.col("o_orderkey") % 3).alias("quorum"), (24 * (F.col("o_orderkey") % 2)).alias("cooling_hours"), F.lit(240).alias("deadline_hours"), (at(X.NOW) - F.expr("make_dt_interval(0, cast(o_orderkey % 400 as int), 0, 0)")).alias("created_at"))
    votes = X.table(spark, d, "lineitem").selectExpr("l_orderkey AS proposal_id", "l_suppkey AS voter", "l_linenumber <> 6 AS approve")
    return U.proposal_status(made, votes, at(X.NOW))


@query("agg31_narrative_inputs", f"""WITH {X.EPISODES_SQL}, s AS (SELECT user_id, session_id, min(created_at) AS f, count(*) AS n FROM episodes GROUP BY ALL), c AS (SELECT user_id, strftime(f, '%Y-%m') AS chapter, string_agg(session_id, ',' ORDER BY f, session_id) AS sessions, CAST(sum(n) AS BIGINT) AS episodes FROM s GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY chapter) AS INTEGER) AS version FROM c""")
def _(spark, d):
    return U.narrative_inputs(X.episodes(spark, d))


_ITEMS = "i AS (SELECT 'a' AS replica, event_type || ':' || event_id AS key, CAST(value AS DECIMAL(18, 2))::VARCHAR AS value FROM events UNION ALL SELECT 'b', event_type || ':' || event_id, CAST(value + CASE WHEN event_type = 'view' AND event_id % 501 = 0 THEN 1 ELSE 0 END AS DECIMAL(18, 2))::VARCHAR FROM events)"
_DIGESTS = f"{_ITEMS}, p AS (SELECT replica, key[1] AS prefix, sha256(concat_ws('|', count(*), bit_xor(('0x' || h[1:15])::BIGINT), bit_xor(('0x' || h[16:30])::BIGINT), bit_xor(('0x' || h[31:45])::BIGINT), bit_xor(('0x' || h[46:60])::BIGINT))) AS digest FROM (SELECT *, sha256(key || '=' || value) AS h FROM i) GROUP BY ALL)"


def _items(spark, d):
    e = X.table(spark, d, "events")
    a = e.selectExpr("'a' AS replica", "concat(event_type, ':', event_id) AS key", "cast(cast(value AS decimal(18, 2)) AS string) AS value")
    return a.unionByName(e.selectExpr("'b' AS replica", "concat(event_type, ':', event_id) AS key", "cast(cast(value + CASE WHEN event_type = 'view' AND event_id % 501 = 0 THEN 1 ELSE 0 END AS decimal(18, 2)) AS string) AS value"))


@query("agg26_state_digest", f"WITH {_DIGESTS} SELECT * FROM p UNION ALL SELECT replica, '', sha256(string_agg(digest, '' ORDER BY prefix)) FROM p GROUP BY replica")
def _(spark, d):
    return U.state_digest(_items(spark, d))


@query("agg26_digest_diff", f"WITH {_DIGESTS} SELECT a.prefix FROM p a JOIN p b ON a.prefix = b.prefix AND a.replica = 'a' AND b.replica = 'b' WHERE a.digest <> b.digest")
def _(spark, d):
    return U.digest_diff(U.state_digest(_items(spark, d)), "a", "b")


@query("agg21_eval_report", """WITH g AS (SELECT event_type AS pack, avg(CASE WHEN event_id % 7 <> 0 THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN event_id % 11 = 0 THEN 1.0 ELSE 0.0 END) AS stale_rate, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1)
SELECT pack, round(accuracy, 6) AS accuracy, round(stale_rate, 6) AS stale_rate, round(p50, 6) AS p50, round(p95, 6) AS p95, accuracy >= 0.86 AS passed FROM g""")
def _(spark, d):
    return U.eval_report(X.table(spark, d, "events").selectExpr("event_type AS pack", "event_id % 7 <> 0 AS right", "event_id % 11 = 0 AS stale", "value AS latency"), 0.86)


_RANKED = f"""{X.VECTORS_SQL}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.vector, v.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(v.vector, v.vector))), 6) AS score FROM vectors q JOIN vectors v USING (tenant) WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, id % 3 = query_id % 3 AS hit, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


@query("agg23_ranking_metrics", f"""WITH {_RANKED}, e AS (SELECT query_id, max(CASE WHEN rank = 1 AND hit THEN 1.0 ELSE 0.0 END)::DOUBLE AS a, sum(CASE WHEN rank <= 3 AND hit THEN 1.0 ELSE 0.0 END)::DOUBLE / 3 AS p, max(CASE WHEN rank <= 5 AND hit THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0.0 END) AS g FROM r WHERE rank <= 5 GROUP BY 1)
SELECT count(*) AS queries, round(avg(a), 6) AS accuracy_1, round(avg(p), 6) AS precision_3, round(avg(g), 6) AS ndcg_5 FROM e""")
def _(spark, d):
    v = X.vectors(spark, d)
    return U.ranking_metrics(R.cosine_topk(v.where("vec_id % 20 = 0"), v, 5).withColumn("hit", F.col("id") % 3 == F.col("query_id") % 3))


@query("agg20_attachment_counts", "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click FROM events GROUP BY user_id")
def _(spark, d):
    return U.attachment_counts(X.table(spark, d, "events").select("user_id", F.col("event_type").alias("kind")), ["view", "click"])


@query("str8_retry_dead_letter", """WITH g AS (SELECT l_orderkey AS delivery_id, count(*) AS attempts, bool_or(l_linenumber = 5) AS delivered FROM lineitem GROUP BY 1)
SELECT delivery_id, attempts, CASE WHEN delivered THEN 'delivered' WHEN attempts >= 3 THEN 'dead_letter' ELSE 'pending' END AS status, CASE WHEN NOT delivered AND attempts < 3 THEN CAST(500 * pow(2, attempts - 1) AS BIGINT) END AS wait_ms FROM g""")
def _(spark, d):
    return U.retry_state(X.table(spark, d, "lineitem").selectExpr("l_orderkey AS delivery_id", "l_linenumber = 5 AS success"))
