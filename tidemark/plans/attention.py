"""Attention over the neighbours of each query's nearest vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import attention as N
from tidemark.operators import retrieval as R
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X

_NOISE = "(((({0}) * 2654435761) % 1000)::DOUBLE / 1000 - 0.5::DOUBLE) * 2 * {1}"
_FEATURES = f"""{X.VECTORS_SQL}, n AS (SELECT count(*) AS n FROM embeddings), c0 AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.vector, v.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(v.vector, v.vector))), 6) AS score, v.vector
FROM vectors q JOIN vectors v USING (tenant) WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), c AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10),
w AS (SELECT h AS head, d, (SELECT list({_NOISE.format('h * 10000 + i * 8 + d', 'sqrt(2.0::DOUBLE / 72)')} ORDER BY i) FROM range(64) r(i)) AS row_, {_NOISE.format('(h + 4) * 10000 + d', 'sqrt(1.0::DOUBLE / 16)')} AS own, {_NOISE.format('(h + 4) * 10000 + d + 8', 'sqrt(1.0::DOUBLE / 16)')} AS other, {_NOISE.format('80000 + h * 8 + d', 'sqrt(1.0::DOUBLE / 32)')} AS out FROM range(4) a(h), range(8) b(d)),
e AS (SELECT query_id, id, head, d, own, other, out, list_dot_product(vector, row_) AS h FROM c, w), l AS (SELECT query_id, id, head, sum(own * h) AS own, sum(other * h) AS other FROM e GROUP BY ALL),
t0 AS (SELECT event_id % n AS src, (event_id * 7 + CAST(json_extract_string(props, '$.k') AS BIGINT)) % n AS dst, 0.5::DOUBLE + (event_id % 50)::DOUBLE / 100 AS weight FROM events, n), t AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM t0 UNION ALL SELECT dst, src, weight FROM t0) WHERE src <> dst GROUP BY ALL),
near AS (SELECT a.query_id, b.id, a.id AS "from", weight FROM c a JOIN t ON t.src = a.id JOIN c b ON b.id = t.dst AND b.query_id = a.query_id UNION ALL SELECT query_id, id, id, 1.0 FROM c),
r AS (SELECT near.*, x.head, (CASE WHEN x.own + y.other > 0 THEN x.own + y.other ELSE 0.2::DOUBLE * (x.own + y.other) END) * weight AS s FROM near JOIN l x ON x.query_id = near.query_id AND x.id = near.id JOIN l y ON y.query_id = near.query_id AND y.id = near."from" AND y.head = x.head),
sm AS (SELECT *, exp(s - max(s) OVER (PARTITION BY query_id, id, head)) AS ex FROM r), sh AS (SELECT *, ex / (sum(ex) OVER (PARTITION BY query_id, id, head) + 1e-10::DOUBLE) AS share FROM sm),
mx AS (SELECT sh.query_id, sh.id, sh.head, e.d, e.out, sum(share * e.h) AS x FROM sh JOIN e ON e.query_id = sh.query_id AND e.id = sh."from" AND e.head = sh.head GROUP BY ALL), f AS (SELECT query_id, id, head, d, out, CASE WHEN x < 0 THEN exp(x) - 1 ELSE x END AS feature FROM mx),
p AS (SELECT query_id, id, 1 / (1 + exp(-sum(feature * out))) AS p FROM f GROUP BY ALL)"""


def _candidates(spark, d):
    v = X.vectors(spark, d)
    best = R.cosine_topk(v.where("vec_id % 20 = 0"), v, 10).select("query_id", "id", "score")
    return best.join(v.select(F.col("vec_id").alias("id"), F.col("vector").cast("array<double>").alias("vector")), "id")


def _edges(spark, d):
    n = X.table(spark, d, "embeddings").agg(F.count("*").alias("n")).scalar()
    e = X.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select((F.col("event_id") % n).alias("src"), ((F.col("event_id") * 7 + F.col("k")) % n).alias("dst"), (F.lit(0.5) + (F.col("event_id") % 50) / 100).alias("weight"))


@query("fus4_attention_rerank", f"WITH {_FEATURES} SELECT query_id, id, round(p, 6) AS model, round(0.6::DOUBLE * score + (1 - 0.6::DOUBLE) * p, 6) AS score FROM c JOIN p USING (query_id, id)")
def _(spark, d):
    return N.attention_rerank(_candidates(spark, d), _edges(spark, d), N.initial_weights(spark, 64))


@query("fus5_attention_feedback", f"""WITH {_FEATURES}, g AS (SELECT query_id, id, (CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END - p) * p * (1 - p) * 0.01::DOUBLE AS g FROM p)
SELECT CAST(head AS INTEGER) AS head, CAST(d AS INTEGER) AS d, round(sum(g * feature), 8) AS step FROM f JOIN g USING (query_id, id) GROUP BY ALL UNION ALL SELECT -1, -1, round(sum(g), 8) FROM g""")
def _(spark, d):
    found = _candidates(spark, d)
    return N.attention_feedback(found, _edges(spark, d), N.initial_weights(spark, 64), found.where("id % 3 = 0")).withColumn("step", F.round("step", 8))
