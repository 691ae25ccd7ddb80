"""Queries over imports. The exports are staged from conversations as JSON texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import NOW, query
from tidemark.sources import fixtures as X
from tidemark.sources import imports as I
from tidemark.sources.fixtures import at

_FIELDS = ("CASE turn % 5 WHEN 4 THEN NULL ELSE 's' || conv_id END", "CASE WHEN (conv_id + turn) % 11 = 0 THEN 'robot' ELSE role END", "CASE WHEN (conv_id + turn) % 13 = 0 THEN ' ' ELSE text END", "CASE turn % 4 WHEN 0 THEN '2024-01-05T10:00:00Z' WHEN 1 THEN '1704500000' WHEN 2 THEN NULL ELSE 'soon' END")
_RAW = f"raw AS (SELECT conv_id * 1000 + turn AS line, conv_id % 20 AS user_id, {_FIELDS[0]} AS session, {_FIELDS[1]} AS role, {_FIELDS[2]} AS content, {_FIELDS[3]} AS created_at FROM conversations)"
_TYPED = f"""{_RAW}, typed AS (SELECT line, user_id, coalesce(session, 'default') AS session, role, CASE created_at WHEN '2024-01-05T10:00:00Z' THEN TIMESTAMP '2024-01-05 10:00:00' WHEN '1704500000' THEN TIMESTAMP '2024-01-06 00:13:20' WHEN 'soon' THEN NULL ELSE {NOW} END AS created_at,
CASE WHEN trim(content) = '' THEN 'no content' WHEN role NOT IN ('user', 'assistant', 'system', 'tool') THEN 'bad role' WHEN created_at = 'soon' THEN 'bad time' END AS problem FROM raw)"""


def _raw(spark, d):
    c = X.table(spark, d, "conversations")
    fields = F.struct(*[F.expr(e).alias(n) for n, e in zip(("session", "role", "content", "created_at"), _FIELDS, strict=True)])
    one = F.to_json(fields)
    value = F.when(F.col("turn") % 3 == 0, one).when(F.col("turn") % 3 == 1, F.concat(F.lit(" ["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"messages":['), one, F.lit("]}")))
    return I.import_ndjson(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), (F.col("conv_id") % 20).alias("user_id"), value.alias("value")))


@query("src2_import_ndjson", f"WITH {_RAW} SELECT line, session, role, sha256(content) AS content_sha256, created_at FROM raw")
def _(spark, d):
    return _raw(spark, d).select("line", "session", "role", F.sha2("content", 256).alias("content_sha256"), "created_at")


@query("src5_normalise_import", f"WITH {_TYPED} SELECT line, session, role, created_at, problem FROM typed")
def _(spark, d):
    return I.normalise(_raw(spark, d), "default", at(X.NOW)).select("line", "session", "role", "created_at", "problem")


@query("src6_import_report", f"""WITH {_TYPED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, problem IS NOT NULL ORDER BY line) AS rn FROM typed)
SELECT user_id, count(*) AS total, count(*) FILTER (problem IS NULL) AS imported, count(problem) AS failed, count(DISTINCT session) FILTER (problem IS NULL) AS sessions, coalesce(string_agg(line || ':' || problem, ',' ORDER BY line) FILTER (problem IS NOT NULL AND rn <= 20), '') AS errors FROM r GROUP BY user_id""")
def _(spark, d):
    return I.import_report(I.normalise(_raw(spark, d), "default", at(X.NOW)), "user_id")


@query("src7_dedupe_import", "SELECT user_id, event_id % 700 AS key, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(spark, d):
    e = X.table(spark, d, "events").select("user_id", (F.col("event_id") % 700).alias("key"), "event_id")
    return I.dedupe_import(e, ["user_id", "key"], ["event_id"])


@query("src3_import_conversation_tree", "SELECT 'c' || conv_id AS session, role, sha256(text) AS content_sha256, CAST(1704067200 + turn AS VARCHAR) AS created_at FROM conversations WHERE trim(text) <> ''")
def _(spark, d):
    c = X.table(spark, d, "conversations")
    node = F.struct(F.struct(F.struct("role").alias("author"), (F.lit(1704067200.0) + F.col("turn")).alias("create_time"), F.struct(F.array("text").alias("parts")).alias("content")).alias("message"))
    trees = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), "turn"), node))).alias("mapping"))
    texts = trees.select(F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("title"), "mapping")).alias("value"))
    return I.import_conversation_tree(texts).select("session", "role", F.sha2("content", 256).alias("content_sha256"), "created_at")


@query("src4_import_chunked_prompt", "SELECT conv_id, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, sha256(text) AS content_sha256 FROM conversations WHERE turn % 6 <> 5")
def _(spark, d):
    c = X.table(spark, d, "conversations")
    parts = F.when(F.col("turn") % 2 == 1, F.array(F.struct("text")))
    chunk = F.struct("turn", F.when(F.col("role") == "user", "user").otherwise("model").alias("role"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"), parts.alias("parts"), (F.col("turn") % 6 == 5).alias("isThought"))
    texts = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks")).select("conv_id", F.to_json(F.struct(F.struct("chunks").alias("chunkedPrompt"))).alias("value"))
    return I.import_chunked_prompt(texts).select("conv_id", "role", F.sha2("content", 256).alias("content_sha256"))


@query("gen3_chunk_pages", r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS page FROM p),
s AS (SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(part) AS INTEGER) AS n_chars FROM u) SELECT * FROM s WHERE n_chars > 0""")
def _(spark, d):
    return I.chunk_pages(X.table(spark, d, "documents"), "\n")


@query("snk4_purge", f"""WITH {X.EPISODES_SQL}, g AS (SELECT DISTINCT user_id FROM events WHERE user_id % 7 = 0) SELECT 'events' AS "table", count(*) AS removed FROM events WHERE user_id IN (SELECT user_id FROM g) UNION ALL SELECT 'episodes', count(*) FROM episodes WHERE user_id IN (SELECT user_id FROM g)""")
def _(spark, d):
    e = X.table(spark, d, "events")
    return I.purge({"events": e, "episodes": X.episodes(spark, d)}, e.where("user_id % 7 = 0"))[1]
