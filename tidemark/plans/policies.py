"""Queries over policies. The policy rows derive from the users and agents that the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import policies as P
from tidemark.plans.registry import AS_OF, age, query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import at


@query("flt4_entity_filter", f"WITH {X.ASSERTIONS_SQL}{X.ENTITIES_SQL} SELECT user_id, name, type FROM entities WHERE lower(type) = 'product' AND contains(lower(name), '3')")
def _(spark, d):
    return P.entity_filter(X.entities(spark, d), "Product", "3").select("user_id", "name", "type")


_LABEL = "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' ' || event_type WHEN 2 THEN repeat(event_type || ' ', 40) || 'x' WHEN 3 THEN event_type || '!' WHEN 4 THEN event_type || '_é 1-b' ELSE event_type END"


@query("flt8_valid_label", f"""WITH l AS (SELECT event_id, {_LABEL} AS label FROM events) SELECT event_id, CASE WHEN strlen(label) = 0 THEN 'empty' WHEN strlen(label) > 128 THEN 'too long' WHEN trim(label) <> label THEN 'edge whitespace'
WHEN NOT regexp_full_match(label, '[\\p{{L}}\\p{{N}}_\\- ]+') THEN 'bad character' END AS reason FROM l""")
def _(spark, d):
    labels = X.table(spark, d, "events").select("event_id", F.expr(_LABEL).alias("label"))
    return labels.select("event_id", P.label_problem(F.col("label")).alias("reason"))


_VIEWS = ("user_id", "CAST(user_id % 4 AS INT) AS ceiling", "2 AS caller_ceiling", "CASE user_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'current' ELSE 'days' END AS mode", "10 AS days", "3 + user_id % 5 AS max_facts")


@query("flt9_apply_view", f"""WITH {X.FACTS_OPEN_SQL}, views AS (SELECT DISTINCT {', '.join(_VIEWS)} FROM events), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY valid_at DESC, edge_id) AS INTEGER) AS rank FROM facts_open JOIN views USING (user_id)
WHERE classification <= least(ceiling, caller_ceiling) AND label NOT IN ('error') AND CASE mode WHEN 'current' THEN invalid_at IS NULL WHEN 'days' THEN {age('valid_at')} <= days ELSE true END) SELECT edge_id, user_id, rank FROM r WHERE rank <= max_facts""")
def _(spark, d):
    views = X.table(spark, d, "events").selectExpr(*_VIEWS, "array('error') AS hidden_labels").distinct()
    return P.apply_view(X.facts_open(spark, d), views, at(X.NOW)).select("edge_id", "user_id", "rank")


@query("flt10_apply_region", f"""WITH {X.FACTS_SQL} SELECT edge_id, user_id FROM facts WHERE label IN ('purchase', 'signup') AND confidence >= 0.5 + (user_id % 4)::DOUBLE / 10 AND classification <= 2
AND (lower(target) LIKE 'v1%' OR lower(target) LIKE '%3')""")
def _(spark, d):
    regions = X.table(spark, d, "events").selectExpr("user_id", "array('purchase', 'signup') AS labels", "0.5D + CAST(user_id % 4 AS DOUBLE) / 10 AS min_confidence", "2 AS ceiling", "array('v1%', '%3') AS patterns").distinct()
    return P.apply_region(X.facts(spark, d), regions).select("edge_id", "user_id")


@query("flt11_scope_rows", f"""WITH {X.FACTS_SQL} SELECT 'c' || (user_id % 10) AS caller, edge_id FROM facts WHERE source_agent_id = 'a' || (user_id % 3) AND classification <= 1 + user_id % 3""")
def _(spark, d):
    grants = X.table(spark, d, "events").selectExpr("user_id AS granted_user", "concat('c', user_id % 10) AS caller", "concat('a', user_id % 3) AS granted_agent", "1 + user_id % 3 AS ceiling").distinct()
    return P.scope_rows(X.facts(spark, d), grants).select("caller", "edge_id")


_RULES = P.load_rules("""[
 {"name": "no-errors", "priority": 5, "on": ["read"], "action": "block", "if": {"all": [{"field": "label", "op": "eq", "value": "error"}, {"not": {"field": "confidence", "op": "lt", "value": 0.7}}]}},
 {"name": "hide-v4", "priority": 2, "on": ["read", "write"], "action": "redact", "if": {"field": "fact", "op": "matches", "value": "v4$"}},
 {"name": "raise", "priority": 1, "on": ["read"], "action": "reclassify", "level": 3, "if": {"any": [{"field": "target", "op": "eq", "value": "v0"}, {"field": "label", "op": "contains", "value": "SIGN"}]}},
 {"name": "late", "priority": 9, "on": ["read"], "action": "warn", "if": {"field": "confidence", "op": "gt", "value": 0.9}},
 {"name": "off", "priority": 0, "enabled": false, "on": ["read"], "action": "block", "if": {"field": "label", "op": "eq", "value": "click"}}]""")
_JUDGED = f"""WITH {X.FACTS_SQL}, m AS (SELECT edge_id, fact, classification, label = 'error' AND NOT confidence < 0.7 AS blocked, fact LIKE '%v4' AS redact, target = 'v0' OR contains(label, 'sign') AS raised, confidence > 0.9 AS late FROM facts),
judged AS (SELECT edge_id, fact, CASE WHEN blocked THEN 'no-errors' END AS blocked_by, redact, CASE WHEN raised THEN 3 ELSE classification END AS classification, CASE WHEN late AND NOT blocked THEN 'late' ELSE '' END AS warnings,
concat_ws(',', CASE WHEN raised THEN 'raise' END, CASE WHEN redact THEN 'hide-v4' END, CASE WHEN blocked THEN 'no-errors' END, CASE WHEN late AND NOT blocked THEN 'late' END) AS applied FROM m)"""


@query("flt12_guardrail_eval", f"{_JUDGED} SELECT edge_id, blocked_by, redact, classification, warnings, applied FROM judged")
def _(spark, d):
    return P.guardrail_eval(X.facts(spark, d), _RULES, "read").select("edge_id", "blocked_by", "redact", "classification", "warnings", "applied")


@query("flt13_redact_facts", f"{_JUDGED} SELECT edge_id, CASE WHEN redact THEN '[redacted]' ELSE fact END AS fact, classification FROM judged WHERE blocked_by IS NULL")
def _(spark, d):
    return P.redacted(P.guardrail_eval(X.facts(spark, d), _RULES, "read")).select("edge_id", "fact", "classification")


_IDENTITY = """CASE event_id % 5 WHEN 0 THEN '{"mission":"m","style":{"tone":"dry"}}' WHEN 1 THEN '{"mission":"m","name":"n"}' WHEN 2 THEN '{"values":[{"User_Mail":"x"}]}' WHEN 3 THEN '{"persona":"user"}' ELSE 'none' END"""


@query("flt19_identity_guard", "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'unknown key' WHEN 2 THEN 'forbidden key' WHEN 4 THEN 'not an object' END AS reason FROM events")
def _(spark, d):
    return X.table(spark, d, "events").select("event_id", P.identity_problem(F.expr(_IDENTITY)).alias("reason"))


@query("flt6_prefilter", f"""WITH {X.ASSERTIONS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_at DESC, edge_id DESC) AS rn FROM assertions), f AS (SELECT *, label = 'purchase' AND confidence > 0.9 AS fits FROM s WHERE rn <= 20)
SELECT user_id, count(*) AS before, count(*) FILTER (fits) AS after, round(count(*) FILTER (fits)::DOUBLE / count(*), 6) AS ratio, count(*) FILTER (fits) = 0 AS relaxed FROM f GROUP BY user_id""")
def _(spark, d):
    return P.prefilter(X.assertions(spark, d), (F.col("label") == "purchase") & (F.col("confidence") > 0.9), "user_id", "valid_at", "edge_id", 20)[1]


@query("flt6_prefiltered_rows", f"""WITH {X.ASSERTIONS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_at DESC, edge_id DESC) AS rn FROM assertions), f AS (SELECT *, label = 'purchase' AND confidence > 0.9 AS fits FROM s WHERE rn <= 20),
w AS (SELECT *, count(*) FILTER (fits) OVER (PARTITION BY user_id) AS n FROM f) SELECT edge_id, user_id FROM w WHERE n = 0 OR fits""")
def _(spark, d):
    return P.prefilter(X.assertions(spark, d), (F.col("label") == "purchase") & (F.col("confidence") > 0.9), "user_id", "valid_at", "edge_id", 20)[0].select("edge_id", "user_id")


@query("jn10_accessible_regions", f"""WITH a AS (SELECT DISTINCT user_id % 30 AS agent, user_id AS region_id, 3 AS level FROM events UNION ALL
SELECT event_id % 30, user_id, 1 + event_id % 3 FROM events WHERE event_id % 7 = 0 OR ts + INTERVAL 5 DAY > {AS_OF}), b AS (SELECT agent, region_id, max(level) AS level FROM a GROUP BY ALL)
SELECT agent, region_id, CASE level WHEN 3 THEN 'manage' ELSE 'write' END AS permission FROM b WHERE level >= 2""")
def _(spark, d):
    e = X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    regions = e.selectExpr("user_id AS region_id", "user_id % 30 AS owner").distinct()
    grants = e.selectExpr("event_id % 30 AS agent", "user_id AS region_id", "CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'manage' END AS permission", "CASE WHEN event_id % 7 <> 0 THEN ts + INTERVAL 5 DAY END AS expires_at")
    return P.accessible_regions(regions, grants, at(X.AS_OF), "write")
