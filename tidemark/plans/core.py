"""Typed loads, normalisers, parsers, extraction, tiered contexts, compression sweeps and anti-entropy."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import extraction as E
from tidemark.functions import normalise as N
from tidemark.operators import context as C
from tidemark.operators import crdt
from tidemark.operators import vectors as V
from tidemark.plans.registry import age, query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import at
from tidemark.sources.shared import shared_folder
from tidemark.sources.tables import read_table
from tidemark.streaming import replicas
from tidemark.streaming.windows import in_any_order


@query("src1_read_table", "SELECT event_id, user_id, event_type, ts, value, CAST(0 AS BIGINT) AS attempts, false AS delivered, false AS dead_letter, CAST(1 AS INTEGER) AS classification FROM events")
def _(spark, d):
    return read_table(spark, d, "events").drop("props").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("win6_token_budget_tiered", f"""WITH {X.FACTS_SQL}, f AS (SELECT user_id AS query_id, edge_id, fact || '. Seen ' || access_count || ' times' AS fact, source, label, target, valid_at, (edge_id % 50 + 1)::DOUBLE / 50 AS relevance FROM facts),
t AS (SELECT *, CASE WHEN relevance >= max(relevance) OVER q * (1 - 0.6::DOUBLE) THEN 1 WHEN relevance >= max(relevance) OVER q * 0.15::DOUBLE THEN 2 ELSE 3 END AS tier FROM f WINDOW q AS (PARTITION BY query_id)),
l AS (SELECT *, '- ' || CASE tier WHEN 1 THEN fact WHEN 2 THEN regexp_extract(fact, '^([^.!?]*[.!?])', 1) ELSE source || ' ' || label || ' ' || target || ' (' || strftime(valid_at, '%b %Y') || ')' END AS line FROM t),
s AS (SELECT *, sum(CAST(ceil((strlen(line) + 1) / 4.0) AS BIGINT)) OVER (PARTITION BY query_id, tier ORDER BY relevance DESC, edge_id ROWS UNBOUNDED PRECEDING) AS c FROM l),
a AS (SELECT *, CASE WHEN bool_or(tier = 1) OVER q THEN 3 + coalesce(max(c) FILTER (tier = 1 AND 3 + c <= 150) OVER q, 0) ELSE 0 END AS run1 FROM s WINDOW q AS (PARTITION BY query_id)),
b AS (SELECT *, CASE WHEN bool_or(tier = 2) OVER q AND 212 - run1 > 5 THEN run1 + 5 + coalesce(max(c) FILTER (tier = 2 AND run1 + 5 + c <= 212) OVER q, 0) ELSE run1 END AS run2 FROM a WINDOW q AS (PARTITION BY query_id))
SELECT query_id, edge_id, CAST(tier AS INTEGER) AS tier, line FROM b WHERE CASE tier WHEN 1 THEN 3 + c <= 150 WHEN 2 THEN 212 - run1 > 5 AND run1 + 5 + c <= 212 ELSE run2 + 4 < 250 AND run2 + 4 + c <= 250 END""")
def _(spark, d):
    f = X.facts(spark, d)
    told = f.select(F.col("user_id").alias("query_id"), "edge_id", F.concat("fact", F.lit(". Seen "), "access_count", F.lit(" times")).alias("fact"), "source", "label", "target", "valid_at", ((F.col("edge_id") % 50 + 1) / 50).alias("relevance"))
    return C.token_budget_tiered(told, 250)


_NAMES = "['Person', 'ORG', 'company', 'place', 'Idea', 'gizmo'][event_id % 6 + 1]"
_CLASSES = "[' Public', 'internal', 'CONFIDENTIAL ', 'restricted', 'secret', NULL][event_id % 6 + 1]"
_MIMES = "['image/png', 'Audio/ogg', 'video/mp4', 'text/plain', 'application/pdf', 'application/zip', 'application/msword'][event_id % 7 + 1]"


@query("scl10_normalisers", f"""WITH e AS (SELECT event_id, lower({_NAMES}) AS n, lower(trim({_CLASSES})) AS c, lower({_MIMES}) AS m FROM events)
SELECT event_id, CASE WHEN n IN ('org', 'company') THEN 'organization' WHEN n = 'place' THEN 'location' WHEN n IN ('idea', 'topic') THEN 'concept' ELSE n END AS entity_type,
CAST(CASE c WHEN 'public' THEN 0 WHEN 'confidential' THEN 2 WHEN 'restricted' THEN 3 ELSE 1 END AS INTEGER) AS classification,
CASE WHEN m LIKE 'image/%' THEN 'image' WHEN m LIKE 'audio/%' THEN 'audio' WHEN m LIKE 'video/%' THEN 'video' WHEN m LIKE 'text/%' OR m IN ('application/pdf', 'application/msword') THEN 'document' END AS kind FROM e""")
def _(spark, d):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    names = pick(["Person", "ORG", "company", "place", "Idea", "gizmo"], 6)
    classes = pick([" Public", "internal", "CONFIDENTIAL ", "restricted", "secret", None], 6)
    mimes = pick(["image/png", "Audio/ogg", "video/mp4", "text/plain", "application/pdf", "application/zip", "application/msword"], 7)
    return X.table(spark, d, "events").select("event_id", N.entity_type_norm(names).alias("entity_type"), N.classification_norm(classes).alias("classification"), N.mime_to_type(mimes).alias("kind"))


_JSON = """'{"summary":" s' || event_id || ' ","topics":["a' || user_id || '"," b ","","c"]}'"""
_RAW = f"""CASE event_id % 5 WHEN 0 THEN {_JSON} WHEN 1 THEN '```json' || chr(10) || {_JSON} || chr(10) || '```' WHEN 2 THEN ' Said ' || event_id || '. TOPICS: x, y' || user_id || ',, z ' WHEN 3 THEN '  plain ' || event_id ELSE '{{"summary":"  ","topics":["q"]}}' END"""


@query("scl17_parse_digest", f"""WITH e AS (SELECT event_id, {_RAW} AS raw FROM events), i AS (SELECT *, trim(replace(replace(trim(raw), '```json', ''), '```', ''), ' ' || chr(10)) AS inner_text FROM e),
p AS (SELECT *, json_valid(inner_text) AND coalesce(trim(json_extract_string(CASE WHEN json_valid(inner_text) THEN inner_text END, '$.summary')), '') <> '' AS good FROM i)
SELECT event_id, CASE WHEN good THEN trim(json_extract_string(CASE WHEN good THEN inner_text END, '$.summary')) WHEN contains(raw, 'TOPICS:') THEN trim(split_part(raw, 'TOPICS:', 1)) ELSE trim(raw) END AS summary,
array_to_string(CASE WHEN good THEN list_filter(list_transform(json_extract_string(CASE WHEN good THEN inner_text END, '$.topics[*]'), lambda x: trim(x)), lambda x: x <> '')
WHEN contains(raw, 'TOPICS:') THEN list_filter(list_transform(string_split(split_part(raw, 'TOPICS:', 2), ','), lambda x: trim(x)), lambda x: x <> '') ELSE [] END, '|') AS topics FROM p""")
def _(spark, d):
    e = X.table(spark, d, "events")
    body = F.format_string('{"summary":" s%d ","topics":["a%d"," b ","","c"]}', "event_id", "user_id")
    n = F.col("event_id") % 5
    raw = F.when(n == 0, body).when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 2, F.format_string(" Said %d. TOPICS: x, y%d,, z ", "event_id", "user_id"))
    raw = raw.when(n == 3, F.format_string("  plain %d", "event_id")).otherwise('{"summary":"  ","topics":["q"]}')
    out = e.select("event_id", N.parse_digest(raw).alias("p"))
    return out.select("event_id", F.col("p.summary").alias("summary"), F.array_join("p.topics", "|").alias("topics"))


@query("scl17_parse_narrative", """WITH e AS (SELECT event_id, user_id, '{"narrative_text":"n' || event_id || '","chapters":[{"title":"t' || user_id || '"}]}' AS j FROM events)
SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 'n' || event_id WHEN event_id % 5 = 3 THEN 'told ' || event_id END AS narrative_text, CASE WHEN event_id % 5 < 3 THEN 't' || user_id WHEN event_id % 5 = 3 THEN '' END AS titles FROM e""")
def _(spark, d):
    body = F.format_string('{"narrative_text":"n%d","chapters":[{"title":"t%d"}]}', "event_id", "user_id")
    n = F.col("event_id") % 5
    raw = F.when(n == 0, body).when(n == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), body, F.lit(" - done"))).when(n == 3, F.format_string(" told %d ", "event_id")).otherwise("  ")
    out = X.table(spark, d, "events").select("event_id", N.parse_narrative(raw).alias("p"))
    return out.select("event_id", F.col("p.narrative_text").alias("narrative_text"), F.array_join(F.col("p.chapters")["title"], "|").alias("titles"))


@query("gen2_chunk_structural")
def _(spark, d):
    return E.chunk_structural(X.table(spark, d, "documents")).select("doc_id", "chunk_index", "page", "section", "char_offset", "char_count", F.sha2("text", 256).alias("text_sha256"))


@query("gen4_extract_facts", f"""WITH {X.EPISODES_SQL}, n AS (SELECT episode_id, regexp_extract_all(content, '\\b[A-Z][a-z]+') AS w, regexp_matches(coalesce(content, ''), '[A-Za-z]') AS ok FROM episodes),
p AS (SELECT episode_id, w, unnest(range(1, len(w))) AS i FROM n WHERE ok) SELECT episode_id, w[i] AS source, 'mentions' AS label, w[i + 1] AS target, CAST(NULL AS VARCHAR) AS error FROM p
UNION ALL SELECT episode_id, NULL, NULL, NULL, 'no words' FROM n WHERE NOT ok""")
def _(spark, d):
    facts, dead = E.extract_facts(X.episodes(spark, d), E.neighbours_extractor)
    return facts.withColumn("error", F.lit(None).cast("string")).unionByName(dead.withColumns({c: F.lit(None).cast("string") for c in ("source", "label", "target")}))


@query("str14_compression_sweep", f"""WITH {X.VECTORS_SQL}, t AS (SELECT vec_id, created_at, CASE WHEN a < 7 THEN 'full' WHEN a < 30 THEN 'half' WHEN a < 90 THEN 'int8' ELSE 'binary' END AS tier, ['full', 'half', 'int8', 'binary'][vec_id % 4 + 1] AS stored FROM (SELECT *, {age('created_at')} AS a FROM vectors))
SELECT vec_id, stored, tier FROM t WHERE tier <> stored AND list_position(['full', 'half', 'int8', 'binary'], tier) > list_position(['full', 'half', 'int8', 'binary'], stored) ORDER BY created_at, vec_id LIMIT 100""")
def _(spark, d):
    v = X.vectors(spark, d).withColumn("stored", F.element_at(F.array(*map(F.lit, V.TIERS)), (F.col("vec_id") % 4 + 1).cast("int")))
    return V.compression_sweep(v, at(X.NOW), 100).select("vec_id", "stored", "tier")


@query("scl11_quantize_f16", f"WITH {X.VECTORS_SQL} SELECT vec_id, len(vector) AS dims, true AS close FROM vectors")
def _(spark, d):
    out = X.vectors(spark, d).select("vec_id", "vector", V.quantize_f16(F.col("vector")).alias("v"))
    near = F.forall(F.zip_with("vector", "v", lambda x, y: (F.abs(x) >= F.abs(y)) & (F.abs(x - y) * 1024 <= F.abs(x))), lambda ok: ok)
    return out.select("vec_id", F.size("v").alias("dims"), near.alias("close"))


_ITEMS = "i AS (SELECT 'u' || user_id || ':' || event_type AS key, event_type, 'n' || (event_id % 3) AS node, epoch_us(ts) // 1000 AS wall, event_id % 5 AS counter, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value, event_id FROM events)"


def _field(sql: str) -> str:
    for i in range(1, 5):
        sql = sql.replace(f"top[{i}]", f"struct_extract_at(top, {i})")
    return sql


_MERGED = _field(f"""WITH {_ITEMS}, m AS (SELECT event_id % 2 AS side, key, max((wall, counter, node, value)) AS top FROM i GROUP BY ALL),
a AS (SELECT key, max(top) AS top FROM m GROUP BY key) SELECT key, top[1] AS wall, top[2] AS counter, top[3] AS node, top[4] AS value FROM a""")


def _replicas(spark, d):
    e = X.table(spark, d, "events")
    rows = e.select(F.concat(F.lit("u"), "user_id", F.lit(":"), "event_type").alias("key"), F.concat(F.lit("n"), F.col("event_id") % 3).alias("node"), F.unix_millis(F.col("ts").cast("timestamp")).alias("wall"), (F.col("event_id") % 5).alias("counter"), F.get_json_object("props", "$.k").cast("long").alias("value"), "event_id")
    return rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id")


@query("str15_anti_entropy", _MERGED)
def _(spark, d):
    return crdt.anti_entropy(*_replicas(spark, d))


@query("str15_stream_anti_entropy", _MERGED)
def _(spark, d):
    """The same of a stored replica, to which the other one's rows come as a stream in no order of time."""
    local, remote = _replicas(spark, d)
    folder = f"{shared_folder(spark)}/replica-{uuid.uuid4().hex}"
    replicas.create_replica(local, folder, 1)
    replicas.stream_anti_entropy(in_any_order(remote, "wall"), folder, f"{folder}-state", 1)
    return replicas.read_replica(spark, folder)
