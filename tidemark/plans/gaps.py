"""Further forms of operators: more filters, contracts, expiries, change events, merges, vector checks and text helpers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import texts as T
from tidemark.operators import analytics as A
from tidemark.operators import audits as U
from tidemark.operators import crdt
from tidemark.operators import episodes as E
from tidemark.operators import facts as K
from tidemark.operators import fusion as M
from tidemark.operators import policies as P
from tidemark.operators import resolution as R
from tidemark.operators import vectors as V
from tidemark.plans.registry import AS_OF, T1, T2, age, query, valid
from tidemark.sources import fixtures as X
from tidemark.sources import imports as I
from tidemark.sources.fixtures import at


@query("flt3_edge_filter_target", f"WITH {X.FACTS_SQL} SELECT edge_id, fact, valid_at FROM facts WHERE target = 'v3' AND classification <= 2 AND invalid_at IS NULL ORDER BY valid_at DESC, edge_id LIMIT 80")
def _(spark, d):
    return K.edge_filter(X.facts(spark, d), 80, target="v3", max_class=2).select("edge_id", "fact", "valid_at")


@query("flt5_episode_filter_window", f"""WITH {X.EPISODES_SQL} SELECT episode_id FROM episodes WHERE role IN ('user', 'system') AND created_at >= TIMESTAMP '2024-01-02 00:00:00' AND created_at < TIMESTAMP '2024-01-04 00:00:00' AND episode_id % 3 = 0""")
def _(spark, d):
    rows = X.episodes(spark, d).withColumn("status", F.when(F.col("episode_id") % 3 == 0, "completed").otherwise("pending"))
    return E.episode_filter(rows, ["user", "system"], after=at("2024-01-02 00:00:00"), before=at("2024-01-04 00:00:00"), status="completed").select("episode_id")


@query("flt9_apply_view_types", f"""WITH {X.FACTS_OPEN_SQL}{X.ENTITIES_SQL}, r AS (SELECT f.*, CAST(row_number() OVER (PARTITION BY f.user_id ORDER BY valid_at DESC, edge_id) AS INTEGER) AS rank FROM facts_open f JOIN entities e ON e.user_id = f.user_id AND e.name = f.target
WHERE classification <= 2 AND label <> 'view' AND e.type IN ('product', 'concept') AND CASE WHEN f.user_id % 2 = 0 THEN valid_at >= {T2} ELSE invalid_at IS NULL END) SELECT edge_id, user_id, rank FROM r WHERE rank <= 20""")
def _(spark, d):
    views = X.table(spark, d, "events").select("user_id").distinct().selectExpr("user_id", "2 AS ceiling", "3 AS caller_ceiling", "array('view') AS hidden_labels", "array('product', 'concept') AS shown_types", "CASE WHEN user_id % 2 = 0 THEN 'since' ELSE 'current' END AS mode", "0 AS days", f"timestamp_ntz'{X.T2}' AS since", "20 AS max_facts")
    return P.apply_view(X.facts_open(spark, d), views, at(X.NOW), X.entities(spark, d)).select("edge_id", "user_id", "rank")


@query("flt10_apply_region_types", f"""WITH {X.FACTS_SQL}{X.ENTITIES_SQL} SELECT edge_id, f.user_id FROM facts f JOIN entities e ON e.user_id = f.user_id AND e.name = f.target WHERE label IN ('purchase', 'click') AND confidence >= 0.6 AND classification <= 2 AND target LIKE 'v%' AND e.type IN ('product', 'organization')""")
def _(spark, d):
    regions = X.table(spark, d, "events").select("user_id").distinct().selectExpr("user_id", "array('purchase', 'click') AS labels", "0.6D AS min_confidence", "2 AS ceiling", "array('v%') AS patterns", "array('product', 'organization') AS types")
    return P.apply_region(X.facts(spark, d), regions, X.entities(spark, d)).select("edge_id", "user_id")


@query("flt16_contracts", f"""WITH {X.FACTS_SQL} SELECT 'current_strict' AS contract, edge_id FROM facts WHERE invalid_at IS NULL UNION ALL SELECT 'historical_strict', edge_id FROM facts WHERE {valid(AS_OF)}""")
def _(spark, d):
    f = X.facts(spark, d)
    parts = [E.contract_filter(f, name, at(X.AS_OF)).select(F.lit(name).alias("contract"), "edge_id") for name in ("current_strict", "historical_strict")]
    return parts[0].unionByName(parts[1])


@query("flt21_expire_grants", f"SELECT event_id FROM events WHERE event_id % 5 = 0 OR ts + INTERVAL 9 DAY > {T2}")
def _(spark, d):
    end = F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp_ntz") + F.expr("interval 9 days"))
    return E.expire_grants(X.table(spark, d, "events").select("event_id", end.alias("expires_at")), at(X.T2)).select("event_id")


@query("flt21_expire_clarifications", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'answered' WHEN ts + INTERVAL 7 DAY <= {T2} THEN 'expired' ELSE 'pending' END AS status FROM events")
def _(spark, d):
    asked = X.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "answered").otherwise("pending").alias("status"), (F.col("ts").cast("timestamp_ntz") + F.expr("interval 7 days")).alias("expires_at"))
    return E.expire_clarifications(asked, at(X.T2)).select("event_id", "status")


@query("jn7_episode_diff", f"WITH {X.EPISODES_SQL} SELECT episode_id, user_id, 'gained' AS change FROM episodes WHERE created_at > TIMESTAMP '2024-01-02 00:00:00' AND created_at <= TIMESTAMP '2024-01-03 12:00:00'")
def _(spark, d):
    return E.episode_diff(X.episodes(spark, d), at("2024-01-02 00:00:00"), at("2024-01-03 12:00:00"))


@query("jn9_trace_in_window", f"""WITH u AS (SELECT 'r' || (event_id % 30) AS request_id, event_type AS source, event_id AS id, ts AS "at" FROM events WHERE event_type IN ('error', 'signup') AND ts >= {T1} AND ts < {T2}), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id, source ORDER BY "at" DESC, id DESC) AS INTEGER) AS rank FROM u) SELECT * FROM k WHERE rank <= 6""")
def _(spark, d):
    e = X.table(spark, d, "events").selectExpr("concat('r', event_id % 30) AS request_id", "event_id AS id", "cast(ts AS timestamp_ntz) AS at", "event_type")
    return R.trace_by_request({k: e.where(F.col("event_type") == k) for k in ("error", "signup")}, 6, at(X.T1), at(X.T2))


_RADAR = f"""{X.FACTS_OPEN_SQL}, g AS (SELECT user_id, source, label, count(*) FILTER (invalid_at IS NULL) AS active, count(*) FILTER (invalid_at IS NOT NULL AND {age('invalid_at')} <= 7) AS recent FROM facts_open GROUP BY ALL)"""


@query("agg1_conflict_edges", f"""WITH {_RADAR}, w AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(least(1.0, 0.5 + 0.15 * active::DOUBLE + 0.05 * recent::DOUBLE), 6) DESC, source, label) AS INTEGER) AS item FROM g WHERE active >= 2),
e AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, source, label ORDER BY valid_at DESC, edge_id) AS INTEGER) AS place FROM facts_open WHERE invalid_at IS NULL) SELECT user_id, item, source, label, place, edge_id FROM w JOIN e USING (user_id, source, label) WHERE item <= 3 AND place <= 10""")
def _(spark, d):
    f = X.facts_open(spark, d)
    return A.conflict_edges(A.conflict_radar(f, at(X.NOW)), f, 3)


@query("agg8_stale_questions", f"""WITH {X.FACTS_OPEN_SQL}, act AS (SELECT * FROM facts_open WHERE invalid_at IS NULL), imp AS (SELECT *, 0.4::DOUBLE * ln(1 + corroboration_count::DOUBLE) / ln(11.0::DOUBLE) + 0.3::DOUBLE / (1 + count(*) OVER (PARTITION BY user_id, label)) + 0.3::DOUBLE * least(1.0, sqrt((count(*) OVER (PARTITION BY user_id, source) + count(*) OVER (PARTITION BY user_id, target))::DOUBLE) / 10) AS importance FROM act),
e AS (SELECT *, round(greatest(0.0, least(1.0, confidence * least(1 + 0.1::DOUBLE * (corroboration_count - 1), 2.0) * pow(2.0::DOUBLE, -{age('valid_at')} / 5.0::DOUBLE) * (1 + 2 * importance))), 9) AS effective FROM imp), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(importance, 6) DESC, edge_id) AS INTEGER) AS rank FROM e WHERE effective < 0.9)
SELECT user_id, rank, edge_id, 'Is this still right: ' || fact || '?' AS question FROM r WHERE rank <= 5""")
def _(spark, d):
    return A.review_questions(A.stale_facts(X.facts_open(spark, d), at(X.NOW), 0.9, 5.0), 5)


@query("agg11_idle_users", f"WITH {X.FACTS_SQL} SELECT user_id FROM facts GROUP BY user_id HAVING {age('max(ingested_at)')} >= 2")
def _(spark, d):
    return U.idle_users(X.facts(spark, d), at(X.NOW), 2)


@query("agg31_key_changes", f"""WITH {X.ASSERTIONS_SQL}, b AS (SELECT *, lag(target) OVER w AS old_target FROM assertions WINDOW w AS (PARTITION BY user_id, source, label ORDER BY ingested_at, edge_id)), c AS (SELECT *, strftime(ingested_at, '%Y-%m') AS chapter, row_number() OVER (PARTITION BY user_id, strftime(ingested_at, '%Y-%m') ORDER BY ingested_at DESC, edge_id DESC) AS rank FROM b WHERE lower(old_target) <> lower(target))
SELECT user_id, chapter, count(*) AS changes, string_agg(label || ': ' || old_target || ' to ' || target, '; ' ORDER BY rank) FILTER (rank <= 3) AS newest FROM c GROUP BY ALL""")
def _(spark, d):
    return U.key_changes(K.belief_changes(X.assertions(spark, d), 1 << 30))


@query("win2_belief_changes_since", f"""WITH {X.ASSERTIONS_SQL}, b AS (SELECT *, lag(target) OVER w AS old_target FROM assertions WINDOW w AS (PARTITION BY user_id, source, label ORDER BY ingested_at, edge_id)), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ingested_at DESC, edge_id DESC) AS rn FROM b WHERE lower(old_target) <> lower(target) AND ingested_at >= {T2})
SELECT user_id, edge_id AS new_edge_id, old_target, target AS new_target FROM c WHERE rn <= 10""")
def _(spark, d):
    return K.belief_changes(X.assertions(spark, d), 10, at(X.T2)).select("user_id", "new_edge_id", "old_target", "new_target")


@query("win3_user_heads", f"""WITH {X.EPISODES_SQL}, h AS (SELECT user_id, session_id, arg_max(episode_id, (created_at, episode_id)) AS head_episode_id, max(created_at) AS head_at, count(*) AS version FROM episodes GROUP BY ALL)
SELECT user_id, session_id, head_episode_id, version FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY head_at DESC, version DESC, session_id DESC) = 1""")
def _(spark, d):
    said = X.episodes(spark, d)
    return E.user_heads(E.thread_head(said), said.select("user_id", "session_id").distinct())


@query("win8_delete_messages", f"WITH {X.EPISODES_SQL}, i AS (SELECT session_id, episode_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, episode_id) - 1 AS idx FROM episodes) SELECT session_id, episode_id FROM i WHERE NOT (session_id % 2 = 0 AND idx = 1)")
def _(spark, d):
    said = X.episodes(spark, d)
    return E.delete_messages(said, said.select("session_id").distinct().where("session_id % 2 = 0").withColumn("idx", F.lit(1))).select("session_id", "episode_id")


@query("win10_replay_dead_letters", f"""WITH {X.DELIVERIES_SQL}, r AS (SELECT webhook_id, delivery_id, CAST(row_number() OVER (PARTITION BY webhook_id ORDER BY delivery_id) AS INTEGER) AS rank FROM deliveries WHERE delivery_id > 200 AND NOT delivered AND attempts >= 3) SELECT * FROM r WHERE rank <= 4""")
def _(spark, d):
    sent = X.deliveries(spark, d).withColumn("dead_letter", ~F.col("delivered") & (F.col("attempts") >= 3))
    return U.replay(sent, sent.select("webhook_id").distinct().withColumn("after_id", F.lit(200)), 4, delivered=None, dead_letter=True).select("webhook_id", "delivery_id", "rank")


_CHANGES = f"""SELECT 'fact_added' AS change, CAST(user_id AS BIGINT) AS user_id, edge_id AS id, CAST(NULL AS DOUBLE) AS delta FROM facts WHERE ingested_at > {T1} AND ingested_at <= {T2} UNION ALL SELECT 'fact_superseded', user_id, edge_id, NULL FROM facts WHERE invalid_at > {T1} AND invalid_at <= {T2}
UNION ALL SELECT 'confidence_shifted', user_id, edge_id, shift FROM s WHERE ingested_at > {T1} AND ingested_at <= {T2} AND shift <> 0 UNION ALL SELECT c, user_id, episode_id, NULL FROM episodes, (VALUES ('head_advanced'), ('episode_added')) v(c) WHERE created_at > {T1} AND created_at <= {T2}"""


@query("set2_change_events", f"""WITH {X.FACTS_SQL}, {X.EPISODES_SQL}, s AS (SELECT *, round(confidence - lag(confidence) OVER (PARTITION BY user_id, source, label ORDER BY ingested_at, edge_id), 6) AS shift FROM facts)
{_CHANGES}""")
def _(spark, d):
    return K.change_events(X.facts(spark, d), X.episodes(spark, d), at(X.T1), at(X.T2))


@query("set2_change_report", f"""WITH {X.FACTS_SQL}, {X.EPISODES_SQL}, s AS (SELECT *, round(confidence - lag(confidence) OVER (PARTITION BY user_id, source, label ORDER BY ingested_at, edge_id), 6) AS shift FROM facts), e AS ({_CHANGES})
SELECT *, CAST(NULL AS VARCHAR) AS summary FROM e UNION ALL SELECT 'summary', user_id, NULL, NULL, count(*) FILTER (change = 'fact_added') || ' added facts, ' || count(*) FILTER (change = 'fact_superseded') || ' superseded facts, '
|| count(*) FILTER (change = 'confidence_shifted') || ' confidence deltas, ' || count(*) FILTER (change = 'head_advanced') || ' head changes, ' || count(*) FILTER (change = 'episode_added') || ' added episodes' FROM e GROUP BY user_id""")
def _(spark, d):
    return K.change_report(X.facts(spark, d), X.episodes(spark, d), X.T1, X.T2)


@query("snk4_purge_sessions", f"WITH {X.EPISODES_SQL} SELECT 'episodes' AS \"table\", count(*) AS removed FROM episodes WHERE session_id % 3 = 0")
def _(spark, d):
    said = X.episodes(spark, d)
    return I.purge({"episodes": said}, said.where("session_id % 3 = 0"), "session_id")[1]


@query("agg24_merge_sets", """WITH t AS (SELECT user_id AS resource, event_type AS element, event_id % 40 AS tag, bool_or(event_id % 4 = 0) AS removed, bool_or(event_id % 4 <> 0) AS added FROM events GROUP BY ALL) SELECT DISTINCT resource, element FROM t WHERE added AND NOT removed""")
def _(spark, d):
    return crdt.merge_sets(X.table(spark, d, "events").selectExpr("user_id AS resource", "event_type AS element", "event_id % 40 AS tag", "CASE WHEN event_id % 4 = 0 THEN 'remove' ELSE 'add' END AS op"))


@query("agg24_merge_maps", """WITH d AS (SELECT user_id AS resource, event_type AS field, epoch_us(ts) // 1000 AS wall, event_id % 5 AS counter, 'n' || (event_id % 3) AS node, event_id % 4 = 0 AS deleted, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events),
m AS (SELECT resource, field, max((wall, counter, node, deleted, value)) AS top FROM d GROUP BY ALL) SELECT resource, field, struct_extract_at(top, 5) AS value FROM m WHERE NOT struct_extract_at(top, 4)""")
def _(spark, d):
    e = X.table(spark, d, "events")
    return crdt.merge_maps(e.select(F.col("user_id").alias("resource"), F.col("event_type").alias("field"), F.unix_millis(F.col("ts").cast("timestamp")).alias("wall"), (F.col("event_id") % 5).alias("counter"), F.concat(F.lit("n"), F.col("event_id") % 3).alias("node"), (F.col("event_id") % 4 == 0).alias("deleted"), F.get_json_object("props", "$.k").cast("long").alias("value")))


@query("agg25_compare_clocks", """WITH c AS (SELECT user_id AS resource, 'n' || (event_id % 3) AS node, max(event_id) FILTER (event_id % 2 = 0) AS l, max(event_id) FILTER (event_id % 2 = 1) AS r FROM events GROUP BY ALL), o AS (SELECT resource, bool_or(coalesce(l, 0) > coalesce(r, 0)) AS a, bool_or(coalesce(l, 0) < coalesce(r, 0)) AS b FROM c GROUP BY resource)
SELECT resource, CASE WHEN a AND b THEN 'concurrent' WHEN a THEN 'after' WHEN b THEN 'before' ELSE 'equal' END AS "order" FROM o""")
def _(spark, d):
    e = X.table(spark, d, "events").selectExpr("user_id AS resource", "concat('n', event_id % 3) AS node", "event_id AS counter")
    left, right = (crdt.merge_clocks(e.where(F.col("counter") % 2 == side)) for side in (0, 1))
    return crdt.compare_clocks(left, right)


@query("vec3_namespace_report", f"WITH {X.VECTORS_SQL} SELECT tenant, count(*) AS vectors, count(*) FILTER (vec_id % 9 = 0) AS wrong FROM vectors GROUP BY tenant")
def _(spark, d):
    v = X.vectors(spark, d).withColumn("vector", F.when(F.col("vec_id") % 9 == 0, F.slice("vector", 1, 10)).otherwise(F.col("vector")))
    return M.namespace_report(v, 64)


@query("vec3_vectors_exist", "SELECT event_id AS vec_id, event_id IN (SELECT vec_id FROM embeddings) AS found FROM events")
def _(spark, d):
    return M.vectors_exist(X.table(spark, d, "events").select(F.col("event_id").alias("vec_id")), X.vectors(spark, d))


@query("scl9_preview", f"WITH {X.EPISODES_SQL} SELECT episode_id, CASE WHEN length(content) > 40 THEN content[1:40] || '...' ELSE content END AS preview FROM episodes")
def _(spark, d):
    return X.episodes(spark, d).select("episode_id", T.preview(F.col("content"), 40).alias("preview"))


@query("scl11_for_tier", f"""WITH {X.VECTORS_SQL}, t AS (SELECT vec_id, len(vector) AS dims, CASE WHEN a < 7 THEN 'full' WHEN a < 30 THEN 'half' WHEN a < 90 THEN 'int8' ELSE 'binary' END AS tier FROM (SELECT *, {age('created_at')} AS a FROM vectors))
SELECT vec_id, tier, CASE WHEN tier IN ('full', 'half') THEN dims END AS numbers, CASE WHEN tier = 'int8' THEN dims END AS codes, CASE WHEN tier = 'binary' THEN dims END AS signs FROM t""")
def _(spark, d):
    v = X.vectors(spark, d).withColumn("tier", S.tier_for_age(S.age_days(at(X.NOW), F.col("created_at"))))
    q = v.select("vec_id", "tier", V.quantize_for_tier(F.col("vector"), F.col("tier")).alias("q"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return q.select("vec_id", "tier", size("q.numbers").alias("numbers"), size("q.codes").alias("codes"), F.length("q.signs").alias("signs"))


@query("scl14_ball", f"""WITH {X.VECTORS_SQL}, n AS (SELECT vec_id, sqrt(list_dot_product(vector, vector)) AS n FROM vectors) SELECT vec_id, round(tanh(n / 2), 6) AS depth, round(n, 4) AS back, round(tanh(n), 4) AS doubled FROM n""")
def _(spark, d):
    scaled = lambda v, f: F.transform(v, lambda x: x.cast("double") * F.col(f))
    p = X.vectors(spark, d).withColumn("f", T.ball_factor(F.col("vector"))).withColumn("p", scaled("vector", "f"))
    p = p.withColumn("g", T.log_factor(F.col("p"))).withColumn("twice", T.mobius_add(F.col("p"), F.col("p")))  # adding a point to itself doubles its length along the geodesic
    return p.select("vec_id", F.round(T.hierarchy_depth(F.col("p")), 6).alias("depth"), F.round(S.l2_norm(scaled("p", "g")), 4).alias("back"), F.round(S.l2_norm(F.col("twice")), 4).alias("doubled"))


@query("scl15_clarification_question", """WITH e AS (SELECT event_id, 'u' || user_id AS entity, event_type AS label, event_id % 4 AS n FROM events)
SELECT event_id, CASE n WHEN 0 THEN 'Can you clarify the current status of ' || entity || '''s ' || label || '?' WHEN 2 THEN 'We have conflicting information about ' || entity || '''s ' || label || '. Is it "f1" or "f2"?'
ELSE 'We have ' || n || ' conflicting facts about ' || entity || '''s ' || label || ': ' || array_to_string(list_transform(range(1, n + 1), lambda i: i || '. "f' || i || '"'), ', ') || '. Which is current?' END AS question FROM e""")
def _(spark, d):
    n = (F.col("event_id") % 4).cast("int")
    facts = F.slice(F.array(F.lit("f1"), F.lit("f2"), F.lit("f3")), F.lit(1), n)
    return X.table(spark, d, "events").select("event_id", T.clarification_question(F.concat(F.lit("u"), "user_id"), F.col("event_type"), facts).alias("question"))


@query("ret8_agent_and_user_context", f"""WITH {X.FACTS_SQL}, l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, edge_id) AS rank, fact FROM facts WHERE invalid_at IS NULL), c AS (SELECT user_id, string_agg(fact, chr(10) ORDER BY rank) AS context FROM l WHERE rank <= 4 GROUP BY user_id),
a AS (SELECT DISTINCT user_id, 'a' || user_id AS agent FROM events) SELECT a.user_id, agent, CASE WHEN a.user_id % 2 = 0 THEN 'core of ' || agent END AS core, context FROM a LEFT JOIN c USING (user_id)""")
def _(spark, d):
    agents = X.table(spark, d, "events").selectExpr("user_id", "concat('a', user_id) AS agent").distinct()
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("confidence"), "edge_id"))
    lines = K.facts_current(X.facts(spark, d)).withColumn("rank", rank).where("rank <= 4").select("user_id", "rank", F.col("fact").alias("line"))
    return U.agent_and_user_context(agents, agents.where("user_id % 2 = 0").select("agent", F.concat(F.lit("core of "), "agent").alias("core")), lines)


@query("scl1_fact_relevance", f"""WITH {X.FACTS_SQL} SELECT edge_id, round(CASE WHEN scope = 'stable' THEN confidence ELSE confidence * greatest(0.2::DOUBLE, least(2.0::DOUBLE, 1 + 0.35::DOUBLE * (CASE WHEN invalid_at IS NOT NULL THEN 0.2 ELSE 0.6 + 0.4 * exp(-{age('valid_at')} / 120.0::DOUBLE) END::DOUBLE - 0.5::DOUBLE) * 1.6::DOUBLE)) END, 6) AS relevance FROM facts""")
def _(spark, d):
    fits = S.fact_temporal_score("current", S.age_days(at(X.NOW), F.col("valid_at")), F.col("invalid_at").isNotNull())
    relevance = F.when(F.col("scope") == "stable", F.col("confidence")).otherwise(S.blend(F.col("confidence"), 0.35, fits))
    return X.facts(spark, d).select("edge_id", F.round(relevance, 6).alias("relevance"))
