"""Queries over vectors, texts, retrieval policies and budgets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import texts as T
from tidemark.operators import fusion as M
from tidemark.operators import retrieval as R
from tidemark.plans.registry import NOW, age, query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import at

_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def _phrases(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _holds(words: tuple[str, ...], text: str = "low") -> str:
    return f"len(list_filter({_phrases(words)}, lambda p: contains({text}, p)))"


# Texts: what each turn of a conversation would ask for, with phrases that the staging adds to it

_ASKED = """CASE (conv_id + turn) % 7 WHEN 0 THEN 'What changed since 2023? ' WHEN 1 THEN 'Who is this, lately? ' WHEN 2 THEN 'How does it relate to AB2024x? ' WHEN 3 THEN 'Is there any news as of now ' WHEN 4 THEN 'What is the latest timeline over time ' ELSE '' END"""
_ASKED_SQL = f"a AS (SELECT conv_id * 1000 + turn AS episode_id, lower({_ASKED} || text) AS low FROM conversations)"


def _asked(spark, d):
    return X.table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS episode_id", f"concat({_ASKED}, text) AS text")


@query("scl6_temporal_intent", f"WITH {_ASKED_SQL} SELECT episode_id, CASE WHEN regexp_matches(low, '(^|[^0-9a-z])20[0-9]{{2}}([^0-9a-z]|$)') OR {_holds(T.HISTORICAL)} > 0 THEN 'historical' WHEN {_holds(T.RECENT)} > 0 THEN 'recent' ELSE 'current' END AS intent FROM a")
def _(spark, d):
    return _asked(spark, d).select("episode_id", T.temporal_intent(F.col("text")).alias("intent"))


_KINDS = " ".join(f"WHEN {k}_n > 0 THEN '{k}'" for k in T.QUERY_KINDS)
_SCORES = " ".join(f"WHEN {k}_n > 0 THEN least(1.0, 0.5 + 0.15 * ({k}_n - 1)::DOUBLE)" for k in T.QUERY_KINDS)


@query("scl7_query_type", f"WITH {_ASKED_SQL}, n AS (SELECT episode_id, {', '.join(f'{_holds(w)} AS {k}_n' for k, w in T.QUERY_KINDS.items())} FROM a) SELECT episode_id, CASE {_KINDS} ELSE 'summary' END AS kind, round(CASE {_SCORES} ELSE 0.0 END::DOUBLE, 6) AS confidence FROM n")
def _(spark, d):
    return _asked(spark, d).select("episode_id", T.query_type(F.col("text")).alias("t")).select("episode_id", "t.kind", "t.confidence")


@query("scl2_episode_temporal_score", f"WITH {X.EPISODES_SQL} SELECT episode_id, round(greatest(0.2, least(2.0, 1 + 0.35::DOUBLE * (exp(-{age('created_at')} / 21.0::DOUBLE) - 0.5) * 1.6)), 6) AS factor FROM episodes")
def _(spark, d):
    score = T.episode_temporal_score("current", S.age_days(at(X.NOW), F.col("created_at")))
    return X.episodes(spark, d).select("episode_id", F.round(S.blend(F.lit(1.0), 0.35, score), 6).alias("factor"))


@query("flt18_prune_stale_episodes", f"WITH {X.EPISODES_SQL} SELECT episode_id FROM episodes WHERE exp(-{age('created_at')} / 21.0::DOUBLE) >= 0.26")
def _(spark, d):
    return X.episodes(spark, d).where(T.episode_temporal_score("current", S.age_days(at(X.NOW), F.col("created_at"))) >= 0.26).select("episode_id")


@query("scl16_strip_tags", r"""SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS text_sha256,
nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages""")
def _(spark, d):
    return X.table(spark, d, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text_sha256"), T.doc_title(F.col("html")).alias("title"))


# Vectors


_PAIRS = f"{X.VECTORS_SQL}, p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.vector AS q, v.vector AS v FROM vectors q JOIN vectors v USING (tenant) WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"


_OPS = "SELECT vec_id % 400 AS vec_id, vec_id AS seq, CASE WHEN vec_id % 9 = 0 THEN 'delete' ELSE 'upsert' END AS op"


@query("vec3_upsert_vectors", f"WITH l AS ({_OPS} FROM embeddings), b AS (SELECT vec_id, arg_max(op, seq) AS op, max(seq) AS seq FROM l GROUP BY vec_id) SELECT vec_id, seq FROM b WHERE op = 'upsert'")
def _(spark, d):
    log = X.table(spark, d, "embeddings").selectExpr("vec_id % 400 AS vec_id", "vec_id AS seq", "CASE WHEN vec_id % 9 = 0 THEN 'delete' ELSE 'upsert' END AS op", "embedding AS vector")
    return M.upsert_vectors(log).select("vec_id", "seq")


@query("fus6_contradiction_rank", f"""WITH {_PAIRS}, s AS (SELECT query_id, id, round({_COS.format('q[1:42]', 'v[1:42]')} - {_COS.format('q[43:]', 'v[43:]')}, 6) AS score FROM p), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def _(spark, d):
    v = X.vectors(spark, d)
    return M.contradiction_rank(v.where("vec_id % 20 = 0"), v, 42, 5)


def _top(spark, d, k):
    v = X.vectors(spark, d)
    return R.cosine_topk(v.where("vec_id % 20 = 0"), v, k)


_BALL = "list_transform({0}, lambda x: x * CASE WHEN n{0} > 0 THEN tanh(n{0} / 2) / n{0} ELSE 0.0 END)"


@query("fus3_hyperbolic_rerank", f"""WITH {_PAIRS}, s AS (SELECT *, {_COS.format('q', 'v')} AS cos, sqrt(list_dot_product(q, q)) AS nq, sqrt(list_dot_product(v, v)) AS nv FROM p), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 6) DESC, id) AS rn FROM s),
b AS (SELECT *, {_BALL.format('q')} AS bq, {_BALL.format('v')} AS bv FROM c WHERE rn <= 10), g AS (SELECT *, acosh(greatest(1.0, 1 + 2 * list_dot_product(list_transform(range(1, len(bq) + 1), lambda i: bq[i] - bv[i]), list_transform(range(1, len(bq) + 1), lambda i: bq[i] - bv[i])) / greatest((1 - list_dot_product(bq, bq)) * (1 - list_dot_product(bv, bv)), 1e-12::DOUBLE))) AS gap FROM b),
f AS (SELECT query_id, id, 0.7::DOUBLE * cos + 0.3::DOUBLE / (1 + gap) AS score FROM g) SELECT query_id, id, round(score, 6) AS score FROM f""")
def _(spark, d):
    v = X.vectors(spark, d)
    found = _top(spark, d, 10).select("query_id", "id").join(v.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "query_id").join(v.select(F.col("vec_id").alias("id"), "vector"), "id")
    return M.hyperbolic_rerank(found).select("query_id", "id", "score")


@query("fus2_mmr", f"""WITH RECURSIVE {_PAIRS}, s AS (SELECT query_id, id, round({_COS.format('q', 'v')}, 6) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s),
t AS (SELECT query_id, id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0.0 END AS rel FROM r WHERE rn <= 10),
c AS (SELECT DISTINCT query_id, 0 AS pick, CAST(-1 AS BIGINT) AS id, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[]) AS rels FROM t
UNION ALL SELECT query_id, pick + 1, id, list_append(ids, id), list_append(rels, rel) FROM (SELECT c.query_id, c.pick, c.ids, c.rels, CAST(t.id AS BIGINT) AS id, t.rel,
row_number() OVER (PARTITION BY c.query_id ORDER BY round(0.7::DOUBLE * t.rel - 0.3::DOUBLE * coalesce(list_max(list_transform(c.rels, lambda x: 1 - abs(t.rel - x))), 0.0), 9) DESC, t.id) AS place
FROM c JOIN t ON c.query_id = t.query_id WHERE c.pick < 5 AND NOT list_contains(c.ids, CAST(t.id AS BIGINT))) WHERE place = 1) SELECT query_id, id, CAST(pick AS INTEGER) AS pick FROM c WHERE pick > 0""")
def _(spark, d):
    return M.mmr(_top(spark, d, 10), 5)


@query("scl11_quantize_int8", f"""WITH {X.VECTORS_SQL}, m AS (SELECT vec_id, vector, list_min(vector) AS low, (list_max(vector) - list_min(vector)) / 255 AS step FROM vectors)
SELECT vec_id, round(low, 6) AS low, array_to_string(list_transform(vector, lambda x: CAST(floor((x - low) / step + 0.5) AS INTEGER)), ',') AS codes, array_to_string(list_transform(vector, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM m""")
def _(spark, d):
    v = X.vectors(spark, d).withColumn("vector", F.col("vector").cast("array<double>"))
    return v.select("vec_id", T.quantize_int8(F.col("vector")).alias("q"), T.quantize_binary(F.col("vector")).alias("bits")).select("vec_id", F.round("q.low", 6).alias("low"), F.array_join(F.col("q.codes").cast("array<string>"), ",").alias("codes"), "bits")


def _adapters(spark, d):
    """Adapters of rank 2 for half the tenants, from the first two vectors of each."""
    v = X.vectors(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("tenant").orderBy("vec_id"))).where("rank <= 2 and tenant % 2 = 0")
    rows = v.groupBy(F.col("tenant").cast("long").alias("user_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vector"))), lambda x: x["vector"].cast("array<double>")).alias("a"))
    return rows.select("user_id", F.lit("a0").alias("agent"), "a", F.transform(F.arrays_zip(F.col("a")[0], F.col("a")[1]), lambda z: F.array(z["0"], z["1"])).alias("b"))


_ADAPTERS = f"{X.VECTORS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY vec_id) AS rn FROM vectors), ad AS (SELECT tenant, max(vector) FILTER (rn = 1) AS a1, max(vector) FILTER (rn = 2) AS a2 FROM k WHERE tenant % 2 = 0 GROUP BY tenant)"


@query("lor1_adapt", f"""WITH {_ADAPTERS}, m AS (SELECT vec_id, CASE WHEN a1 IS NULL THEN vector ELSE list_transform(range(1, len(vector) + 1), lambda i: vector[i] + (a1[i] * list_dot_product(a1, vector) + a2[i] * list_dot_product(a2, vector)) * 0.125::DOUBLE) END AS v FROM vectors LEFT JOIN ad USING (tenant))
SELECT vec_id, round(v[1], 5) AS first, round(sqrt(list_dot_product(v, v)), 5) AS norm FROM m""")
def _(spark, d):
    v = X.vectors(spark, d).select("vec_id", F.col("tenant").cast("long").alias("user_id"), F.lit("a0").alias("agent"), "vector")
    return M.adapt(v, _adapters(spark, d)).select("vec_id", F.round(F.col("vector")[0], 5).alias("first"), F.round(S.l2_norm(F.col("vector")), 5).alias("norm"))


@query("agg28_adapter_stats", f"WITH {_ADAPTERS} SELECT CAST(tenant AS BIGINT) AS user_id, 'a0' AS agent, round(sqrt(list_dot_product(a1, a1) + list_dot_product(a2, a2)), 6) AS norm_a, round(sqrt(list_dot_product(a1, a1) + list_dot_product(a2, a2)), 6) AS norm_b FROM ad")
def _(spark, d):
    return M.adapter_stats(_adapters(spark, d))


# Retrieval


_HEADERS = {"facts": "Current facts:", "episodes": "Relevant conversation excerpts:"}


@query("win5_token_budget", f"""WITH {X.FACTS_SQL}, {X.EPISODES_SQL}, f AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, edge_id) AS rank, '- ' || fact AS line FROM facts WHERE invalid_at IS NULL),
e AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, episode_id DESC) AS rank, '- ' || content AS line FROM episodes),
fr AS (SELECT *, 4 + sum(CAST(ceil((strlen(line) + 1) / 4.0) AS BIGINT)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM f), fk AS (SELECT * FROM fr WHERE used <= 300), u AS (SELECT query_id, max(used) AS used FROM fk GROUP BY 1),
er AS (SELECT e.query_id, rank, line, coalesce(u.used, 0) + 8 + sum(CAST(ceil((strlen(line) + 1) / 4.0) AS BIGINT)) OVER (PARTITION BY e.query_id ORDER BY rank) AS used FROM e LEFT JOIN u USING (query_id))
SELECT query_id, 'facts' AS section, CAST(rank AS INTEGER) AS rank, CAST(used AS BIGINT) AS used_tokens FROM fk UNION ALL SELECT query_id, 'episodes', CAST(rank AS INTEGER), CAST(used AS BIGINT) FROM er WHERE used <= 300""")
def _(spark, d):
    f = X.facts(spark, d).where("invalid_at is null")
    f = f.select(F.col("user_id").alias("query_id"), F.lit("facts").alias("section"), F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("confidence"), "edge_id")).alias("rank"), F.concat(F.lit("- "), "fact").alias("line"))
    e = X.episodes(spark, d)
    e = e.select(F.col("user_id").alias("query_id"), F.lit("episodes").alias("section"), F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("episode_id"))).alias("rank"), F.concat(F.lit("- "), "content").alias("line"))
    return M.token_budget(f.unionByName(e), _HEADERS, 300).drop("line")


@query("ret4_retrieval_policy", """WITH q AS (SELECT event_id AS query_id, user_id, CASE event_id % 4 WHEN 0 THEN 'precision' WHEN 1 THEN 'recall' END AS policy, CASE event_id % 5 WHEN 0 THEN 20 WHEN 1 THEN 90000 END AS mt FROM events), p AS (SELECT query_id, coalesce(policy, CASE WHEN user_id % 2 = 0 THEN 'stability' END, 'default') AS policy, mt FROM q)
SELECT query_id, policy, CAST(greatest(100, least(10000, coalesce(mt, CASE policy WHEN 'precision' THEN 400 WHEN 'recall' THEN 700 ELSE 500 END))) AS INTEGER) AS max_tokens, CASE policy WHEN 'precision' THEN 0.55 WHEN 'recall' THEN 0.15 WHEN 'stability' THEN 0.4 ELSE 0.3 END::DOUBLE AS min_score, CASE policy WHEN 'precision' THEN 0.35 WHEN 'recall' THEN 0.2 WHEN 'stability' THEN 0.8 END::DOUBLE AS time_weight FROM p""")
def _(spark, d):
    e = X.table(spark, d, "events")
    asked = e.selectExpr("event_id AS query_id", "user_id", "CASE event_id % 4 WHEN 0 THEN 'precision' WHEN 1 THEN 'recall' END AS policy", "CASE event_id % 5 WHEN 0 THEN 20 WHEN 1 THEN 90000 END AS max_tokens")
    return M.retrieval_policy(asked, e.where("user_id % 2 = 0").select("user_id", F.lit("stability").alias("user_policy")).distinct())


@query("ret5_goal_adjust", f"""WITH {X.FACTS_SQL} SELECT edge_id, round(CASE WHEN user_id % 3 = 0 THEN greatest(0.01, least(10.0, confidence * CASE label WHEN 'purchase' THEN 8.0 WHEN 'error' THEN 0.001 ELSE 1.0 END::DOUBLE * CASE WHEN contains(fact, 'v1') THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN contains(fact, 'view') THEN 0.5 ELSE 1.0 END::DOUBLE)) ELSE confidence END, 6) AS relevance FROM facts""")
def _(spark, d):
    goals = X.table(spark, d, "events").where("user_id % 3 = 0").selectExpr("user_id", "map('purchase', 8.0D, 'error', 0.001D) AS label_boost", "array('V1') AS keywords", "array('view') AS suppress")
    return M.goal_adjust(X.facts(spark, d).withColumn("relevance", F.col("confidence")), goals.dropDuplicates(["user_id"])).select("edge_id", "relevance")


@query("ret3_explain", f"""WITH {_PAIRS}, s AS (SELECT query_id, id, round({_COS.format('q', 'v')}, 6) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn, row_number() OVER (PARTITION BY query_id ORDER BY id) AS ri FROM s)
SELECT query_id, id, CASE WHEN rn <= 5 THEN 'semantic' ELSE 'graph' END AS reason FROM r WHERE rn <= 5 OR (rn <= 10 AND id % 2 = 0)""")
def _(spark, d):
    top = _top(spark, d, 10)
    return M.explain({"semantic": top.where("rank <= 5"), "graph": top.where("id % 2 = 0")})


@query("ret2_structured_context", f"""WITH {X.FACTS_OPEN_SQL}, k AS (SELECT user_id, 'key_facts' AS section, CAST(row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, edge_id) AS INTEGER) AS rank, edge_id FROM facts_open WHERE invalid_at IS NULL), c AS (SELECT user_id, 'changes' AS section, CAST(row_number() OVER (PARTITION BY user_id ORDER BY invalid_at DESC, edge_id) AS INTEGER) AS rank, edge_id FROM facts_open WHERE invalid_at > {NOW} - INTERVAL 30 DAY)
SELECT * FROM k WHERE rank <= 10 UNION ALL SELECT * FROM c WHERE rank <= 5 UNION ALL SELECT user_id, 'relationships', CAST(row_number() OVER (PARTITION BY user_id ORDER BY corroboration_count DESC, valid_at DESC, edge_id) AS INTEGER) AS rank, edge_id FROM facts_open WHERE invalid_at IS NULL QUALIFY rank <= 8
UNION ALL SELECT user_id, 'open_questions', CAST(row_number() OVER (PARTITION BY user_id ORDER BY several DESC, edge_id) AS INTEGER) AS rank, edge_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id, source, label) AS several, row_number() OVER (PARTITION BY user_id, source, label ORDER BY valid_at DESC, edge_id DESC) AS n FROM facts_open WHERE invalid_at IS NULL) WHERE n = 1 AND several > 1 QUALIFY rank <= 5""")
def _(spark, d):
    return M.structured_context(X.facts_open(spark, d), at(X.NOW))


@query("ret6_recall_eval", f"""WITH {X.FACTS_SQL}, c AS (SELECT user_id, string_agg('- ' || fact, chr(10) ORDER BY edge_id) AS context, arg_min(fact, edge_id) AS first FROM facts WHERE invalid_at IS NULL GROUP BY user_id)
SELECT user_id AS case_id, contains(context, 'purchase v1') AS right, contains(first, 'click') AS stale FROM c""")
def _(spark, d):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "fact"))), lambda x: F.concat(F.lit("- "), x["fact"])), "\n")
    contexts = X.facts(spark, d).where("invalid_at is null").groupBy(F.col("user_id").alias("case_id")).agg(lines.alias("context"))
    return M.recall_eval(contexts.withColumns({"contains": F.array(F.lit("Purchase v1")), "not_contains": F.array(F.lit("CLICK"))}))


@query("ret7_recent_fallback", f"""WITH {X.EPISODES_SQL}, n AS (SELECT user_id, episode_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, episode_id DESC) AS INTEGER) AS rank FROM episodes), q AS (SELECT event_id AS query_id, user_id FROM events WHERE event_type <> 'purchase')
SELECT query_id, episode_id, rank FROM q JOIN n USING (user_id) WHERE rank <= 3""")
def _(spark, d):
    e = X.table(spark, d, "events").select(F.col("event_id").alias("query_id"), "user_id", "event_type")
    return M.recent_fallback(e.drop("event_type"), e.where("event_type = 'purchase'").select("query_id"), X.episodes(spark, d))
