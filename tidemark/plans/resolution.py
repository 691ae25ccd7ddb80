"""Queries that resolve names and lay answers and hypotheses on facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.operators import paths as P
from tidemark.operators import resolution as R
from tidemark.plans.registry import AS_OF, NOW, age, query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import at


@query("jn2_resolve_entities", f"""WITH {X.ASSERTIONS_SQL}, o AS (SELECT user_id, lower(target) AS key, min(target) AS name, count(*) AS mention_count FROM assertions WHERE valid_at < {AS_OF} GROUP BY user_id, lower(target)),
n AS (SELECT user_id, lower(target) AS key, count(*) AS c, arg_max('V' || substr(target, 2), (valid_at, target)) AS name, arg_max(fact, (valid_at, target)) AS summary FROM assertions WHERE valid_at >= {AS_OF} GROUP BY user_id, lower(target))
SELECT user_id, coalesce(o.name, n.name) AS name, coalesce(mention_count, 0) + coalesce(c, 0) AS mention_count, n.summary, mention_count IS NULL AS is_new FROM o FULL JOIN n USING (user_id, key)""")
def _(spark, d):
    a = X.assertions(spark, d)
    old = a.where(F.col("valid_at") < at(X.AS_OF)).groupBy("user_id", F.col("target").alias("name")).agg(F.count("*").alias("mention_count")).withColumn("summary", F.lit(None).cast("string"))
    new = a.where(F.col("valid_at") >= at(X.AS_OF)).select("user_id", F.upper("target").alias("name"), F.col("fact").alias("summary"), F.col("valid_at").alias("at"))
    return R.resolve_entities(new, old)


@query("jn3_resolve_aliases", f"""WITH {X.ASSERTIONS_SQL}{X.ENTITIES_SQL}, e AS (SELECT user_id, name AS entity, lower(name) AS key FROM entities UNION SELECT user_id, name, 'item ' || substr(name, 2) FROM entities),
k AS (SELECT user_id, key, min(entity) AS entity FROM e GROUP BY ALL), m AS (SELECT edge_id, user_id, CASE edge_id % 3 WHEN 0 THEN ' Item ' || substr(target, 2) ELSE upper(target) END AS mention FROM assertions)
SELECT edge_id, mention, entity FROM m LEFT JOIN k ON k.user_id = m.user_id AND k.key = lower(trim(mention))""")
def _(spark, d):
    e = X.entities(spark, d).withColumn("aliases", F.array(F.concat(F.lit("Item "), F.expr("substr(name, 2)"))))
    m = X.assertions(spark, d).selectExpr("edge_id", "user_id", "CASE edge_id % 3 WHEN 0 THEN ' Item ' || substr(target, 2) ELSE upper(target) END AS mention")
    return R.resolve_aliases(m, e).select("edge_id", "mention", "entity")


@query("jn4_resolve_relationships", f"WITH {X.ASSERTIONS_SQL} SELECT edge_id, source, target FROM assertions WHERE edge_id % 4 <> 0 AND edge_id % 6 <> 0")
def _(spark, d):
    a = X.assertions(spark, d).withColumn("episode_id", F.col("source_episode_id"))
    found = a.where("edge_id % 4 <> 0").selectExpr("episode_id", "upper(source) AS name").unionByName(a.where("edge_id % 6 <> 0").selectExpr("episode_id", "upper(target) AS name"))
    return R.resolve_relationships(a, found).select("edge_id", "source", "target")


@query("jn8_causal_chains", f"""WITH {X.FACTS_SQL} SELECT edge_id, user_id, CASE WHEN edge_id % 11 <> 0 THEN 'said in episode ' || source_episode_id ELSE 'no episode left' END AS reason,
round(confidence * CASE WHEN edge_id % 11 <> 0 THEN 1.0 ELSE 0.5 END::DOUBLE, 6) AS chain_confidence FROM facts""")
def _(spark, d):
    kept = X.table(spark, d, "events").where("event_id % 11 <> 0").select(F.col("event_id").alias("episode_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
    return R.causal_chains(X.facts(spark, d), kept)


@query("jn9_trace_by_request", f"""WITH {X.EPISODES_SQL}, u AS (SELECT json_extract_string(metadata, '$.request_id') AS request_id, 'episode' AS source, episode_id AS id, created_at AS "at" FROM episodes
UNION ALL SELECT 'r' || (event_id % 30), 'delivery', event_id, ts FROM events WHERE event_type = 'error' UNION ALL SELECT 'r' || (event_id % 30), 'audit', event_id, ts FROM events WHERE event_type = 'signup'),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id, source ORDER BY "at" DESC, id DESC) AS INTEGER) AS rank FROM u) SELECT * FROM k WHERE rank <= 4""")
def _(spark, d):
    e = X.table(spark, d, "events").selectExpr("concat('r', event_id % 30) AS request_id", "event_id AS id", "cast(ts AS timestamp_ntz) AS at", "event_type")
    said = X.episodes(spark, d).select(F.get_json_object("metadata", "$.request_id").alias("request_id"), F.col("episode_id").alias("id"), F.col("created_at").alias("at"))
    return R.trace_by_request({"episode": said, "delivery": e.where("event_type = 'error'"), "audit": e.where("event_type = 'signup'")}, 4)


@query("jn11_resolve_user", """WITH u AS (SELECT c_custkey AS user_id, 'x' || (c_custkey % 700) AS external_id, c_name AS name FROM customer), k AS (SELECT user_id, 0 AS p, CAST(user_id AS VARCHAR) AS ident FROM u UNION ALL SELECT user_id, 1, external_id FROM u UNION ALL SELECT user_id, 2, name FROM u),
b AS (SELECT ident, arg_min(user_id, (p, user_id)) AS user_id, min(p) AS p FROM k GROUP BY ident), i AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'x' || o_custkey WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN 'nobody' ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS ident FROM orders)
SELECT o_orderkey, ident, user_id, CASE p WHEN 0 THEN 'id' WHEN 1 THEN 'external_id' WHEN 2 THEN 'name' END AS matched_by FROM i LEFT JOIN b USING (ident)""")
def _(spark, d):
    users = X.table(spark, d, "customer").selectExpr("c_custkey AS user_id", "concat('x', c_custkey % 700) AS external_id", "c_name AS name")
    ident = "CASE o_orderkey % 4 WHEN 0 THEN concat('x', o_custkey) WHEN 1 THEN cast(o_custkey AS string) WHEN 2 THEN 'nobody' ELSE concat('Customer#', lpad(cast(o_custkey AS string), 9, '0')) END AS ident"
    return R.resolve_user(X.table(spark, d, "orders").selectExpr("o_orderkey", ident), users)


@query("jn12_apply_clarifications", f"""WITH {X.FACTS_OPEN_SQL}, g AS (SELECT user_id, source, label, max(edge_id) AS winner FROM facts_open WHERE invalid_at IS NULL GROUP BY ALL HAVING count(*) > 1)
SELECT edge_id, coalesce(invalid_at, CASE WHEN winner <> edge_id THEN {NOW} END) AS invalid_at, coalesce(invalid_at IS NULL AND winner <> edge_id, false) AS closed_by_answer FROM facts_open LEFT JOIN g USING (user_id, source, label)""")
def _(spark, d):
    f = X.facts_open(spark, d)
    asked = f.where("invalid_at is null").groupBy("user_id", "source", "label").agg(F.collect_list("edge_id").alias("conflict_ids"), F.max("edge_id").alias("winner")).where("size(conflict_ids) > 1")
    return R.apply_clarifications(f, asked.withColumn("answered_at", at(X.NOW))).select("edge_id", "invalid_at", "closed_by_answer")


@query("jn13_apply_hypotheticals", f"""WITH {X.FACTS_SQL}, r AS (SELECT user_id, source AS e, label AS l, edge_id, fact, confidence FROM facts WHERE invalid_at IS NULL), h0 AS (SELECT user_id, 'u' || user_id AS e, CASE WHEN event_id % 3 = 0 THEN 'rumour' ELSE event_type END AS l, event_id, value FROM events WHERE user_id % 5 = 0),
h AS (SELECT user_id, e, l, 'what if ' || max(event_id) AS t, arg_max(round(value, 2), event_id) AS c FROM h0 GROUP BY ALL)
SELECT user_id, edge_id, coalesce(t, fact) AS fact, coalesce(c, confidence) AS relevance, CASE WHEN t IS NULL THEN 'kept' WHEN edge_id IS NULL THEN 'novel' ELSE 'override' END AS kind FROM r FULL JOIN h USING (user_id, e, l)""")
def _(spark, d):
    hyps = X.table(spark, d, "events").where("user_id % 5 = 0").selectExpr("user_id", "concat('U', user_id) AS entity", "CASE WHEN event_id % 3 = 0 THEN 'Rumour' ELSE upper(event_type) END AS label", "event_id AS seq", "concat('what if ', event_id) AS text", "round(value, 2) AS confidence")
    return R.apply_hypotheticals(X.facts(spark, d).where("invalid_at is null").withColumn("relevance", F.col("confidence")), hyps)


@query("jn14_revalidate", f"""WITH {X.FACTS_SQL}, c AS (SELECT event_id - event_id % 3 AS edge_id, max(ts) AS ts, 0.9::DOUBLE AS conf FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT edge_id, coalesce(conf, confidence) AS confidence, coalesce(ts, valid_at) AS decays_from FROM facts LEFT JOIN c USING (edge_id)""")
def _(spark, d):
    said = X.table(spark, d, "events").where("event_type = 'view'").selectExpr("event_id - event_id % 3 AS edge_id", "cast(ts AS timestamp_ntz) AS confirmed_at", "0.9D AS confidence")
    return R.revalidate(X.facts(spark, d), said).select("edge_id", "confidence", "decays_from")


@query("grf4_expand_one_hop", f"""WITH {X.FACTS_OPEN_SQL}{X.ENTITIES_SQL}, h AS (SELECT user_id, name, mention_count::DOUBLE AS score, row_number() OVER (PARTITION BY user_id ORDER BY mention_count DESC, name) AS rn FROM entities)
SELECT h.user_id AS query_id, edge_id, fact, round(score * 0.8, 6) AS relevance FROM h JOIN facts_open f ON f.user_id = h.user_id AND f.source = h.name WHERE rn <= 3 AND invalid_at IS NULL""")
def _(spark, d):
    hits = X.entities(spark, d).select(F.col("user_id").alias("query_id"), "user_id", "name", F.col("mention_count").cast("double").alias("score"))
    return R.expand_one_hop(hits, X.facts_open(spark, d))


@query("grf5_entity_profile", f"""WITH {X.FACTS_OPEN_SQL}{X.ENTITIES_SQL}, act AS (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY valid_at DESC, edge_id) AS ro, row_number() OVER (PARTITION BY user_id, target ORDER BY valid_at DESC, edge_id) AS ri FROM facts_open WHERE invalid_at IS NULL),
o AS (SELECT user_id, source AS name, count(*) AS n, string_agg(edge_id, ',' ORDER BY ro) FILTER (ro <= 3) AS l FROM act GROUP BY ALL), i AS (SELECT user_id, target AS name, count(*) AS n, string_agg(edge_id, ',' ORDER BY ri) FILTER (ri <= 3) AS l FROM act GROUP BY ALL)
SELECT e.user_id, e.name, e.type, coalesce(o.n, 0) AS out_facts, coalesce(o.l, '') AS out_newest, coalesce(i.n, 0) AS in_facts, coalesce(i.l, '') AS in_newest FROM entities e LEFT JOIN o USING (user_id, name) LEFT JOIN i USING (user_id, name)""")
def _(spark, d):
    return R.entity_profile(X.entities(spark, d), X.facts_open(spark, d), 3)


@query("agg33_generate_clarifications", f"""WITH {X.FACTS_OPEN_SQL}, g AS (SELECT user_id, source, label, count(*) FILTER (invalid_at IS NULL) AS active, count(*) FILTER (invalid_at IS NOT NULL AND {age('invalid_at')} <= 7) AS recent, list_sort(list(DISTINCT target) FILTER (invalid_at IS NULL)) AS t FROM facts_open GROUP BY ALL),
s AS (SELECT *, round(least(1.0, 0.5 + 0.15 * active::DOUBLE + 0.05 * recent::DOUBLE), 6) AS severity FROM g WHERE active >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY severity DESC, source, label) AS rn FROM s WHERE severity >= 0.6)
SELECT user_id, source, label, severity, CASE WHEN len(t) = 2 THEN 'We have conflicting information about ' || source || '''s ' || label || '. Is it "' || t[1] || '" or "' || t[2] || '"?' ELSE 'We have ' || len(t) || ' conflicting facts about ' || source || '''s ' || label || ': ' || array_to_string(list_transform(t, lambda x, i: i || '. "' || x || '"'), ', ') || '. Which is current?' END AS question, {NOW} + INTERVAL 7 DAY AS expires_at FROM r WHERE rn <= 5""")
def _(spark, d):
    f = X.facts_open(spark, d)
    return R.questions(A.conflict_radar(f, at(X.NOW)), f, at(X.NOW))


_EDGES = """graph_facts AS (SELECT CAST(event_id AS BIGINT) AS edge_id, CAST(user_id AS BIGINT) AS src, CAST(1000000000 + day(ts) * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS BIGINT) AS dst FROM events)"""
_PATHS = f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src AS a, dst AS b FROM graph_facts UNION SELECT dst, src FROM graph_facts), p AS (SELECT DISTINCT src, CAST((src * 11 + 3) % 150 AS BIGINT) AS dst FROM graph_facts),
far AS (SELECT DISTINCT dst AS t, dst AS node, 0 AS depth FROM p UNION SELECT far.t, b.b, depth + 1 FROM far JOIN b ON b.a = far.node WHERE depth < 20),
d AS (SELECT t, node, min(depth) AS d FROM far GROUP BY t, node), n AS (SELECT x.t, b.a AS node, min(b.b) AS next FROM b JOIN d x ON x.node = b.a JOIN d y ON y.t = x.t AND y.node = b.b AND y.d = x.d - 1 GROUP BY x.t, b.a),
e AS (SELECT least(src, dst) AS low, greatest(src, dst) AS high, min(edge_id) AS edge_id FROM graph_facts GROUP BY ALL),
s AS (SELECT p.src, p.dst, p.src AS node, d.d AS rest, 0 AS hop, CAST(NULL AS BIGINT) AS last FROM p JOIN d ON d.t = p.dst AND d.node = p.src UNION ALL SELECT s.src, s.dst, n.next, s.rest - 1, hop + 1, s.node FROM s JOIN n ON n.t = s.dst AND n.node = s.node WHERE s.rest > 0)"""


@query("grf2_shortest_path", f"{_PATHS} SELECT src, dst, CAST(max(hop) AS INTEGER) AS length FROM s GROUP BY src, dst")
def _(spark, d):
    return _paths(spark, d).select("src", "dst", "length")


@query("grf2_path_edges", f"""{_PATHS} SELECT src, dst, CAST(max(hop) AS INTEGER) AS length, string_agg(node, '>' ORDER BY hop) AS path, coalesce(string_agg(edge_id, ',' ORDER BY hop), '') AS edges
FROM s LEFT JOIN e ON e.low = least(s.node, s.last) AND e.high = greatest(s.node, s.last) GROUP BY src, dst""")
def _(spark, d):
    return _paths(spark, d)


def _paths(spark, d):
    edges = X.graph_facts(spark, d)
    return P.shortest_paths(edges.select("src").distinct().withColumn("dst", (F.col("src") * 11 + 3) % 150), edges)
