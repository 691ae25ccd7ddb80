"""Queries over streams, run over the files that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.streaming import ordered as O
from tidemark.streaming import stateful as V
from tidemark.streaming import windows as Z


def _deliveries(spark, d):
    return Z.stream_files(spark, d, "events.parquet").selectExpr("event_id", "user_id AS webhook_id", "event_type <> 'error' AS delivered", "ts")


@query("str3_stream_heads", f"WITH {X.EPISODES_SQL} SELECT session_id, arg_max(episode_id, (created_at, episode_id)) AS head_episode_id, max(created_at) AS head_at, count(*) AS version FROM episodes GROUP BY session_id")
def _(spark, d):
    said = Z.stream_files(spark, d, "conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("episode_id"), F.col("conv_id").alias("session_id"), (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.expr("make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")).alias("created_at"))
    return Z.run_to_end(Z.stream_heads(said))


@query("str4_activity_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n_session FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS closes, count(*) AS n FROM s GROUP BY user_id, n_session""")
def _(spark, d):
    return Z.run_to_end(Z.activity_sessions(Z.stream_files(spark, d, "events.parquet"), "ts", "user_id", "6 hours"))


@query("str5_tumbling_rate", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id AS webhook_id, count(*) AS n, count(*) > 2 AS throttled FROM events GROUP BY 1, 2")
def _(spark, d):
    return Z.run_to_end(Z.tumbling_rate(_deliveries(spark, d), "ts", "1 hour", 2))


@query("str6_sliding_failure_rate", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(i AS INTEGER)) AS window_start, user_id AS webhook_id, event_type = 'error' AS failed FROM events, range(0, 4) r(i))
SELECT window_start, webhook_id, count(*) AS n, round(count(*) FILTER (failed)::DOUBLE / count(*), 6) AS failure_rate FROM w GROUP BY 1, 2""")
def _(spark, d):
    return Z.run_to_end(Z.sliding_failure_rate(_deliveries(spark, d), "ts", "4 hours", "1 hour"))


@query("str9_stream_dedupe", "SELECT DISTINCT user_id, event_id % 70 AS key FROM events")
def _(spark, d):
    keyed = Z.stream_files(spark, d, "events.parquet").withColumn("key", F.col("event_id") % 70)
    return Z.run_to_end(Z.stream_dedupe(keyed, "ts", ["user_id", "key"], "365 days").select("user_id", "key"), "append")


@query("str12_event_fanout", "SELECT event_id, 'h' || user_id AS subscription_id FROM events WHERE user_id % 4 <> 0 AND event_type IN ('purchase', CASE WHEN user_id % 2 = 0 THEN 'error' ELSE 'view' END)")
def _(spark, d):
    hooks = X.table(spark, d, "events").selectExpr("user_id", "concat('h', user_id) AS subscription_id", "array('purchase', CASE WHEN user_id % 2 = 0 THEN 'error' ELSE 'view' END) AS types", "user_id % 4 <> 0 AS enabled").distinct()
    return Z.run_to_end(Z.event_fanout(Z.stream_files(spark, d, "events.parquet"), hooks), "append")


# Assertions come in three turns; what is closed and changed is the same as over the whole table.
def _typed(spark, d):
    return X.assertions(spark, d).selectExpr("cast(user_id AS bigint) AS user_id", "source", "label", "cast(edge_id AS bigint) AS edge_id", "target", "cast(ingested_at AS timestamp) AS ingested_at")


def _asserted(spark, d):
    stream, later = Z.in_turns(_typed(spark, d), "ingested_at")
    return Z.run_to_end(O.stream_fact_changes(stream), "append", later)


@query("str1_stream_supersede", f"""WITH {X.FACTS_SQL} SELECT 'added' AS change, edge_id, CAST(NULL AS BIGINT) AS closed_by, ingested_at AS happened_at FROM facts
UNION ALL SELECT 'superseded', edge_id, invalidated_by, invalid_at FROM facts WHERE invalid_at IS NOT NULL""")
def _(spark, d):
    out = _asserted(spark, d).where("change IN ('added', 'superseded')")
    return out.select("change", "edge_id", F.col("other_id").alias("closed_by"), F.col("at").cast("timestamp_ntz").alias("happened_at"))


@query("str2_stream_belief_changes", f"""WITH {X.ASSERTIONS_SQL}, b AS (SELECT *, lag(target) OVER w AS old_target, lag(edge_id) OVER w AS old_edge_id FROM assertions WINDOW w AS (PARTITION BY user_id, source, label ORDER BY ingested_at, edge_id))
SELECT edge_id AS new_edge_id, old_edge_id, old_target, target AS new_target, ingested_at AS changed_at FROM b WHERE lower(old_target) <> lower(target)""")
def _(spark, d):
    out = _asserted(spark, d).where("change = 'changed'")
    return out.select(F.col("edge_id").alias("new_edge_id"), F.col("other_id").alias("old_edge_id"), "old_target", "new_target", F.col("at").cast("timestamp_ntz").alias("changed_at"))


def _last(spark, d, kinds: str):
    """The last word on each edge, of a stream whose facts come in no order of time."""
    late = Z.in_any_order(_typed(spark, d), "edge_id")
    out = Z.run_to_end(O.stream_fact_changes(late, "400 days"), "append").where(f"change IN ({kinds})")
    return out.groupBy("edge_id").agg(F.max_by(F.struct("change", "other_id", "old_target", "new_target", "at"), "version").alias("last")).select("edge_id", "last.*")


@query("str1_late_facts", f"WITH {X.FACTS_SQL} SELECT edge_id, invalidated_by AS closed_by, invalid_at AS closed_at FROM facts WHERE invalid_at IS NOT NULL")
def _(spark, d):
    out = _last(spark, d, "'superseded', 'corrected'")
    return out.select("edge_id", F.col("other_id").alias("closed_by"), F.col("at").cast("timestamp_ntz").alias("closed_at"))


@query("str2_late_facts", f"""WITH {X.ASSERTIONS_SQL}, b AS (SELECT *, lag(target) OVER w AS old_target, lag(edge_id) OVER w AS old_edge_id FROM assertions WINDOW w AS (PARTITION BY user_id, source, label ORDER BY ingested_at, edge_id))
SELECT edge_id AS new_edge_id, old_edge_id, old_target, target AS new_target, ingested_at AS changed_at FROM b WHERE lower(old_target) <> lower(target)""")
def _(spark, d):
    out = _last(spark, d, "'changed', 'unchanged'").where("change = 'changed'")
    return out.select(F.col("edge_id").alias("new_edge_id"), F.col("other_id").alias("old_edge_id"), "old_target", "new_target", F.col("at").cast("timestamp_ntz").alias("changed_at"))


_BREAKER = f"""WITH RECURSIVE {X.DELIVERIES_SQL}, o AS (SELECT *, epoch_us(created_at) AS t, row_number() OVER (PARTITION BY webhook_id ORDER BY created_at, delivery_id) AS rn FROM deliveries),
s AS (SELECT webhook_id, delivery_id, rn, 'sent' AS decision, CASE WHEN delivered THEN 0 ELSE 1 END AS failures, 'closed' AS state, CAST(0 AS BIGINT) AS opened FROM o WHERE rn = 1
UNION ALL SELECT o.webhook_id, o.delivery_id, o.rn, CASE WHEN shut THEN 'rejected' ELSE 'sent' END, CASE WHEN shut THEN failures WHEN o.delivered THEN 0 ELSE failures + 1 END,
CASE WHEN shut THEN 'open' WHEN o.delivered THEN 'closed' WHEN state = 'open' OR failures + 1 >= 2 THEN 'open' ELSE 'closed' END, CASE WHEN NOT shut AND NOT o.delivered AND (state = 'open' OR failures + 1 >= 2) THEN o.t ELSE opened END
FROM (SELECT s.*, s.state = 'open' AND p.t < s.opened + 43200000000 AS shut FROM s JOIN o p ON p.webhook_id = s.webhook_id AND p.rn = s.rn + 1) s JOIN o ON o.webhook_id = s.webhook_id AND o.rn = s.rn + 1)
SELECT webhook_id, delivery_id, decision, state FROM s"""


def _sent(spark, d):
    return X.deliveries(spark, d).selectExpr("cast(webhook_id AS bigint) AS webhook_id", "cast(delivery_id AS bigint) AS delivery_id", "delivered", "cast(created_at AS timestamp) AS created_at")


@query("str7_circuit_breaker", _BREAKER)
def _(spark, d):
    stream, later = Z.in_turns(_sent(spark, d), "created_at")
    return Z.run_to_end(V.circuit_breaker(stream, 2, 43_200), "append", later)


@query("str7_circuit_breaker_table", _BREAKER)
def _(spark, d):
    return V.circuit_breaker(_sent(spark, d), 2, 43_200)


@query("str8_stream_retry", """WITH g AS (SELECT l_orderkey AS delivery_id, count(*) AS attempts, bool_or(l_linenumber = 5) AS delivered, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1)
SELECT delivery_id, attempts, CASE WHEN delivered THEN 'delivered' WHEN attempts >= 3 THEN 'dead_letter' ELSE 'pending' END AS status, CASE WHEN NOT delivered AND attempts < 3 THEN epoch_ms(last_at) + CAST(500 * pow(2, attempts - 1) AS BIGINT) END AS due_ms FROM g""")
def _(spark, d):
    attempts = Z.stream_files(spark, d, "lineitem.parquet").selectExpr("l_orderkey AS delivery_id", "l_linenumber = 5 AS success", "cast(l_shipdate AS timestamp) AS at")
    return Z.run_to_end(Z.stream_retry(attempts, 3))


# Attempts of a user's deliveries; the stream's watermark ends an hour before the last of them.
_ATTEMPTS = "user_id * 4 + event_id % 4"
_RETRIES = f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY t, success DESC) AS rn FROM (SELECT {_ATTEMPTS} AS delivery_id, event_type = 'purchase' AS success, ts AS t, date_trunc('millisecond', max(ts) OVER () - INTERVAL 1 HOUR) AS until FROM events) WHERE t < until),
s AS (SELECT delivery_id, rn, t, success, until, CAST(1 AS BIGINT) AS n FROM a WHERE rn = 1
UNION ALL SELECT a.delivery_id, a.rn, a.t, a.success, a.until, CASE WHEN s.success OR s.n >= 3 THEN 1 ELSE s.n + 1 END FROM s JOIN a ON a.delivery_id = s.delivery_id AND a.rn = s.rn + 1),
w AS (SELECT *, lead(t) OVER (PARTITION BY delivery_id ORDER BY rn) AS next, t + to_hours(CAST(20 * pow(2, n - 1) AS INTEGER)) AS due FROM s)
SELECT delivery_id, n AS attempts, CASE WHEN success THEN 'delivered' ELSE 'dead_letter' END AS outcome, t AS "at" FROM w WHERE success OR n >= 3
UNION ALL SELECT delivery_id, n, 'retry', due FROM w WHERE NOT success AND n < 3 AND (due < next OR next IS NULL) AND due < until"""


def _attempts(spark, d):
    return X.table(spark, d, "events").selectExpr(f"cast({_ATTEMPTS} AS bigint) AS delivery_id", "event_type = 'purchase' AS success", "cast(ts AS timestamp) AS at")


@query("str8_retry_timers", _RETRIES)
def _(spark, d):
    stream, later = Z.in_turns(_attempts(spark, d), "at", 4)
    out = Z.run_to_end(O.stream_retry_timers(stream, 3, 20 * 3_600_000, "1 hour"), "append", later)
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("str8_retry_replay", _RETRIES)
def _(spark, d):
    rows = _attempts(spark, d)
    last = rows.agg(F.unix_millis(F.max("at") - F.expr("INTERVAL 1 HOUR"))).first()[0]
    return O.retries_of_table(rows, (last or 0) * 1000, 3, 20 * 3_600_000).withColumn("at", F.col("at").cast("timestamp_ntz"))


def _rated(spark, d):
    """Ratings of -1 to 1 that users give."""
    return X.table(spark, d, "events").select(F.col("user_id").cast("long").alias("user_id"), F.concat(F.lit("a"), F.col("event_id") % 3).alias("agent"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3 - 1).cast("double").alias("rating"))


def _feedback(spark, d, rated):
    """Ratings, a table or a stream of them, with vectors: the query is the vector of the user's own number, the item the event's."""
    v = X.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = v.agg(F.count("*").alias("n")).scalar()
    e = rated.withColumns({"q": F.col("user_id") % n, "i": F.col("event_id") % n})
    out = e.join(v.select(F.col("vec_id").alias("i"), F.col("vector").alias("item")), "i").join(v.select(F.col("vec_id").alias("q"), F.col("vector").alias("query")), "q")
    return out.select("user_id", "agent", "event_id", "at", "query", "item", "rating")


@query("lor2_train_adapters")
def _(spark, d):
    return V.train_adapters(_feedback(spark, d, _rated(spark, d)), matrices=False)


@query("str10_stream_adapters")
def _(spark, d):
    stream, later = Z.in_turns(_rated(spark, d), "at")
    out = Z.run_to_end(V.train_adapters(_feedback(spark, d, stream), matrices=False), "append", later)
    return out.groupBy("user_id", "agent").agg(F.max("updates").alias("updates"), F.max_by("norm", "updates").alias("norm"))
