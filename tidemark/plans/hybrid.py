"""Hybrid retrieval over all users: every event whose id is divisible by 20 asks something."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hybrid as H
from tidemark.plans.registry import NOW, age, query, valid
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import at

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}0-9]+'), lambda w: w <> '')"
_TOK = "CAST(ceil((strlen(line) + 1) / 4.0) AS BIGINT)"
_BLEND = "{0} * greatest(0.2::DOUBLE, least(2.0::DOUBLE, 1 + {1} * ({2} - 0.5::DOUBLE) * 1.6::DOUBLE))"
_FACT_FIT = f"CASE intent WHEN 'historical' THEN CASE WHEN {valid('as_of')} THEN 0.95 ELSE 0.2 END::DOUBLE WHEN 'recent' THEN exp(-{age('valid_at')} / 30.0::DOUBLE) ELSE CASE WHEN invalid_at IS NOT NULL THEN 0.2 ELSE 0.6 + 0.4 * exp(-{age('valid_at')} / 120.0::DOUBLE) END::DOUBLE END"
_EPISODE_FIT = f"CASE intent WHEN 'historical' THEN exp(-{age('created_at')} / 180.0::DOUBLE) ELSE exp(-{age('created_at')} / 21.0::DOUBLE) END"

SQL = f"""WITH {X.FACTS_SQL}{X.ENTITIES_SQL}, {X.EPISODES_SQL}, n AS (SELECT count(*) AS n FROM embeddings), emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
i0 AS (SELECT CAST(user_id AS BIGINT) AS user_id, 'fact' AS kind, CAST(edge_id AS VARCHAR) AS id, fact AS text, edge_id % n AS v FROM facts, n UNION ALL SELECT user_id, 'entity', name, name, (user_id * 31 + CAST(substr(name, 2) AS BIGINT)) % n FROM entities, n UNION ALL SELECT user_id, 'episode', CAST(episode_id AS VARCHAR), content, episode_id % n FROM episodes, n),
items AS (SELECT i0.*, vector FROM i0 JOIN emb ON vec_id = v),
q AS (SELECT event_id AS query_id, CAST(user_id AS BIGINT) AS user_id, vector, CASE WHEN event_id % 3 = 2 THEN ts END AS as_of, ['current', 'recent', 'historical'][event_id % 3 + 1] AS intent, CASE event_id % 3 WHEN 0 THEN 0.2 ELSE 0.55 END::DOUBLE AS weight,
  CASE event_id % 3 WHEN 0 THEN [event_type, 'v' || k] WHEN 1 THEN ['changed', 'recently', event_type, 'v' || k] ELSE ['history', event_type, 'v' || k] END AS terms
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS k FROM events WHERE event_id % 20 = 0), n JOIN emb ON vec_id = event_id % n),
vs AS (SELECT query_id, kind, id, round(list_dot_product(q.vector, i.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(i.vector, i.vector))), 6) AS score FROM q JOIN items i USING (user_id)),
w AS (SELECT user_id, kind, id, {_WORDS} AS w FROM items), total AS (SELECT kind, count(*) AS n, avg(len(w)) AS mean FROM w GROUP BY kind), qt AS (SELECT query_id, user_id, unnest(terms) AS term FROM q),
tf AS (SELECT user_id, kind, id, l, term, count(*)::DOUBLE AS tf FROM (SELECT user_id, kind, id, len(w) AS l, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT kind, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
ts AS (SELECT query_id, kind, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))) AS s FROM qt JOIN tf USING (user_id, term) JOIN df USING (kind, term) JOIN total USING (kind) GROUP BY ALL),
lists AS (SELECT query_id, kind, id, row_number() OVER (PARTITION BY src, query_id, kind ORDER BY score DESC, id) AS rank FROM (SELECT 'v' AS src, * FROM vs UNION ALL SELECT 't', query_id, kind, id, round(s / (s + 1), 6) FROM ts)),
fused AS (SELECT query_id, kind, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists WHERE rank <= CASE kind WHEN 'entity' THEN 10 WHEN 'fact' THEN 15 ELSE 5 END GROUP BY ALL), f AS (SELECT * FROM fused JOIN (SELECT query_id, user_id, intent, weight, as_of FROM q) USING (query_id)),
hits AS (SELECT query_id, CAST(edge_id AS VARCHAR) AS id, intent, weight, as_of, score, fact, valid_at, invalid_at, scope, expires_at FROM f JOIN facts ON f.user_id = facts.user_id AND id = CAST(edge_id AS VARCHAR) WHERE kind = 'fact'),
best AS (SELECT * FROM f WHERE kind = 'entity' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 3),
hops AS (SELECT query_id, CAST(edge_id AS VARCHAR) AS id, intent, weight, as_of, score * 0.8::DOUBLE AS score, fact, valid_at, invalid_at, scope, expires_at FROM best b JOIN facts ON b.user_id = facts.user_id AND b.id = source),
told AS (SELECT * FROM hits UNION ALL SELECT * FROM hops p WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = p.query_id AND h.id = p.id)),
fit AS (SELECT * FROM told WHERE CASE WHEN intent = 'historical' THEN {valid('as_of')} ELSE invalid_at IS NULL AND (scope <> 'time_bounded' OR expires_at IS NULL OR expires_at > {NOW}) END),
every AS (SELECT query_id, 'fact' AS section, id, fact AS text, CASE WHEN scope = 'stable' THEN score ELSE {_BLEND.format('score', 'weight', '(' + _FACT_FIT + ')')} END AS r FROM fit
UNION ALL SELECT query_id, 'entity', id, id, {_BLEND.format('score', '(weight * 0.4::DOUBLE)', '0.6::DOUBLE')} FROM f WHERE kind = 'entity'
UNION ALL SELECT query_id, 'episode', id, content, {_BLEND.format('score', 'weight', '(' + _EPISODE_FIT + ')')} FROM f JOIN episodes e ON e.user_id = f.user_id AND CAST(e.episode_id AS VARCHAR) = f.id WHERE kind = 'episode' AND (intent = 'historical' OR {_EPISODE_FIT} >= 0.01)),
r AS (SELECT query_id, section, id, '- ' || text AS line, round(r, 6) AS relevance, row_number() OVER (PARTITION BY query_id, section ORDER BY round(r, 6) DESC, id) AS rank FROM every),
c AS (SELECT *, sum({_TOK}) OVER (PARTITION BY query_id, section ORDER BY rank) AS c FROM r),
u1 AS (SELECT *, 4 + c AS used FROM c WHERE section = 'entity' AND 4 + c <= 160), b1 AS (SELECT query_id, max(used) AS b FROM u1 GROUP BY 1),
u2 AS (SELECT c.*, coalesce(b, 0) + 4 + c AS used FROM c LEFT JOIN b1 USING (query_id) WHERE section = 'fact' AND coalesce(b, 0) + 4 + c <= 160), b2 AS (SELECT query_id, greatest(coalesce(b1.b, 0), coalesce(x.b, 0)) AS b FROM b1 FULL JOIN (SELECT query_id, max(used) AS b FROM u2 GROUP BY 1) x USING (query_id)),
u3 AS (SELECT c.*, coalesce(b, 0) + 6 + c AS used FROM c LEFT JOIN b2 USING (query_id) WHERE section = 'episode' AND coalesce(b, 0) + 6 + c <= 160)
SELECT query_id, section, CAST(rank AS INTEGER) AS rank, id, relevance, CAST(used AS BIGINT) AS used_tokens FROM (SELECT * FROM u1 UNION ALL SELECT * FROM u2 UNION ALL SELECT * FROM u3)"""


@query("ret1_hybrid_retrieve", SQL)
def _(spark, d):
    v = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    n = v.agg(F.count("*").alias("n")).scalar()
    facts, episodes = X.facts(spark, d), X.episodes(spark, d)

    def items(df, kind, ident, text, number):
        return df.select(F.col("user_id").cast("long").alias("user_id"), F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"), F.col(text).alias("text"), (number % n).alias("v"))

    named = items(X.entities(spark, d), "entity", "name", "name", F.col("user_id") * 31 + F.substring("name", 2, 20).cast("long"))
    every = items(facts, "fact", "edge_id", "fact", F.col("edge_id")).unionByName(named).unionByName(items(episodes, "episode", "episode_id", "content", F.col("episode_id"))).join(v, "v").drop("v")
    e = X.table(spark, d, "events").where("event_id % 20 = 0").withColumn("thing", F.concat_ws(" ", "event_type", F.concat(F.lit("v"), F.get_json_object("props", "$.k").cast("long") % 5)))
    kind = F.col("event_id") % 3
    said = F.when(kind == 0, F.concat(F.lit("What is the "), "thing")).when(kind == 1, F.concat(F.lit("What changed recently for "), "thing")).otherwise(F.concat(F.lit("The history of "), "thing", F.lit(" as of 2024")))
    asked = e.select(F.col("event_id").alias("query_id"), F.col("user_id").cast("long").alias("user_id"), said.alias("text"), F.when(kind == 2, F.col("ts").cast("timestamp_ntz")).alias("as_of"), (F.col("event_id") % n).alias("v"))
    return H.hybrid_retrieve(asked.join(v, "v").drop("v"), every, facts, episodes, at(X.NOW), 160)
