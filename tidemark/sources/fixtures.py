"""Memory tables staged from the driver's tables, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.facts import supersede

NOW, T1, AS_OF, T2 = "2024-01-31 00:00:00", "2024-01-10 00:00:00", "2024-01-15 00:00:00", "2024-01-20 00:00:00"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k, i = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    user, target = F.concat(F.lit("u"), F.col("user_id")), F.concat(F.lit("v"), k % 5)
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(
        i.alias("edge_id"), "user_id", user.alias("source"), F.col("event_type").alias("label"), target.alias("target"),
        F.concat_ws(" ", user, "event_type", target).alias("fact"), ts.alias("valid_at"), ts.alias("ingested_at"), i.alias("source_episode_id"),
        (F.lit(0.5) + (i % 50) / 100).alias("confidence"), (1 + i % 4).alias("corroboration_count"), (i % 4).cast("int").alias("classification"),
        F.concat(F.lit("a"), i % 3).alias("source_agent_id"), (i % 6).alias("access_count"),
        F.when(i % 10 == 0, "stable").when(i % 10 == 1, "time_bounded").otherwise("mutable").alias("scope"),
        F.when(i % 10 == 1, ts + F.expr("interval 7 days")).alias("expires_at"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supersede(assertions(spark, sf_dir))


def facts_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("valid_at") + F.expr("interval 5 days")
    return assertions(spark, sf_dir).withColumn("invalid_at", F.when(end < at(NOW), end))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assertions(spark, sf_dir)
    people = a.groupBy("user_id", F.col("source").alias("name")).agg(F.count("*").alias("mention_count"), F.max("valid_at").alias("updated_at")).withColumn("type", F.lit("person"))
    kinds = F.element_at(F.array(F.lit("product"), F.lit("organization"), F.lit("concept")), (F.substring("name", 2, 9).cast("int") % 3 + 1))
    things = a.groupBy("user_id", F.col("target").alias("name")).agg(F.count("*").alias("mention_count"), F.max("valid_at").alias("updated_at")).withColumn("type", kinds)
    things = things.where(~((F.col("user_id") % 10 == 0) & (F.col("name") == "v4")))
    return people.unionByName(things)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    tags = F.concat(F.lit('{"tags":["t'), turn % 4, F.lit('"], "request_id":"r'), conv % 30, F.lit('"}'))
    return c.select(
        (conv * 1000 + turn).alias("episode_id"), conv.alias("session_id"), (conv % 20).alias("user_id"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.expr("make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")).alias("created_at"),
        "role", F.col("text").alias("content"), F.when(turn % 3 == 0, "message").when(turn % 3 == 1, "text").otherwise("json").alias("type"), tags.alias("metadata"),
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who touched what: every event joins its user with the thing (day and number) that it names."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").cast("long").alias("src"), (F.lit(1_000_000_000).cast("long") + F.dayofmonth("ts") * 100 + k).alias("dst"))


def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the id of each event as edge_id."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").cast("long").alias("edge_id"), F.col("user_id").cast("long").alias("src"), (F.lit(1_000_000_000).cast("long") + F.dayofmonth("ts") * 100 + k).alias("dst"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("delivery_id"), F.col("user_id").alias("webhook_id"), (F.col("event_type") != "error").alias("delivered"), (1 + F.col("event_id") % 4).alias("attempts"), F.col("ts").cast("timestamp_ntz").alias("created_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.col("label").alias("tenant"), F.col("embedding").alias("vector"), (at(NOW) - F.expr("make_dt_interval(cast(vec_id % 120 as int), 0, 0, 0)")).alias("created_at"))


ASSERTIONS_SQL = """assertions AS (SELECT event_id AS edge_id, user_id, 'u' || user_id AS source, event_type AS label, 'v' || (k % 5) AS target,
  'u' || user_id || ' ' || event_type || ' v' || (k % 5) AS fact, ts AS valid_at, ts AS ingested_at, event_id AS source_episode_id,
  CAST(0.5 AS DOUBLE) + CAST(event_id % 50 AS DOUBLE) / 100 AS confidence, 1 + event_id % 4 AS corroboration_count, CAST(event_id % 4 AS INTEGER) AS classification,
  'a' || (event_id % 3) AS source_agent_id, event_id % 6 AS access_count,
  CASE event_id % 10 WHEN 0 THEN 'stable' WHEN 1 THEN 'time_bounded' ELSE 'mutable' END AS scope,
  CASE WHEN event_id % 10 = 1 THEN ts + INTERVAL 7 DAY END AS expires_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
FACTS_SQL = (
    ASSERTIONS_SQL
    + """, facts AS (SELECT *, lead(ingested_at) OVER w AS invalid_at, lead(source_episode_id) OVER w AS invalidated_by
  FROM assertions WINDOW w AS (PARTITION BY user_id, source, label ORDER BY ingested_at, edge_id))"""
)
FACTS_OPEN_SQL = ASSERTIONS_SQL + f""", facts_open AS (SELECT *, CASE WHEN valid_at + INTERVAL 5 DAY < TIMESTAMP '{NOW}' THEN valid_at + INTERVAL 5 DAY END AS invalid_at FROM assertions)"""
ENTITIES_SQL = """, entities AS (SELECT user_id, source AS name, count(*) AS mention_count, max(valid_at) AS updated_at, 'person' AS type FROM assertions GROUP BY ALL
  UNION ALL SELECT user_id, target, count(*), max(valid_at), ['product', 'organization', 'concept'][CAST(substr(target, 2) AS INTEGER) % 3 + 1] FROM assertions
  WHERE NOT (user_id % 10 = 0 AND target = 'v4') GROUP BY user_id, target)"""
EPISODES_SQL = """episodes AS (SELECT CAST(conv_id AS BIGINT) * 1000 + turn AS episode_id, CAST(conv_id AS BIGINT) AS session_id, CAST(conv_id % 20 AS BIGINT) AS user_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at, role, text AS content,
  CASE turn % 3 WHEN 0 THEN 'message' WHEN 1 THEN 'text' ELSE 'json' END AS type,
  '{"tags":["t' || (turn % 4) || '"], "request_id":"r' || (conv_id % 30) || '"}' AS metadata FROM conversations)"""
GRAPH_SQL = """graph_edges AS (SELECT CAST(user_id AS BIGINT) AS src, CAST(1000000000 + day(ts) * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS BIGINT) AS dst FROM events)"""
DELIVERIES_SQL = "deliveries AS (SELECT event_id AS delivery_id, user_id AS webhook_id, event_type <> 'error' AS delivered, 1 + event_id % 4 AS attempts, ts AS created_at FROM events)"
VECTORS_SQL = f"vectors AS (SELECT vec_id, label AS tenant, CAST(embedding AS DOUBLE[]) AS vector, TIMESTAMP '{NOW}' - to_days(CAST(vec_id % 120 AS INTEGER)) AS created_at FROM embeddings)"
