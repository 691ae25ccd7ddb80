"""Queries of exact search in blocks and of the index of cells and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import retrieval as R
from tidemark.operators import vector_index as I
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X

_ALL = f"""{X.VECTORS_SQL}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.vector, v.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(v.vector, v.vector))), 6) AS score
FROM vectors q JOIN vectors v ON {{0}} WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"""


@query(
    "vec1_min_score_all_tenants",
    f"WITH {_ALL.format('true')} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.25::DOUBLE) WHERE rank <= 8",
)
def _(spark, d):
    v = X.vectors(spark, d)
    return R.cosine_topk(v.where("vec_id % 20 = 0"), v, 8, 0.25, same_tenant=False)


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    v, folder = X.vectors(spark, d), I.index_folder(spark)
    I.build_index(v, folder)
    return v, folder


@query("vec2_cosine_topk_lsh")
def _(spark, d):
    v, folder = _indexed(spark, d)
    return I.search_index(v.where("vec_id % 20 = 0"), v, folder, 5)


@query("vec2_recall", f"WITH {_ALL.format('q.tenant = v.tenant')} SELECT count(DISTINCT query_id) AS queries, count(*) AS pairs, true AS reached FROM s")
def _(spark, d):
    """How many pairs exact search compares, and whether nine in ten of its five best are among those of the index."""
    v, folder = _indexed(spark, d)
    asked = v.where("vec_id % 20 = 0")
    exact, found = R.cosine_topk(asked, v, 5), I.search_index(asked, v, folder, 5).withColumn("hit", F.lit(True))
    recall = exact.join(found.select("query_id", "id", "hit"), ["query_id", "id"], "left").agg((F.count("hit") >= 0.9 * F.count("*")).alias("reached"))
    sizes = v.groupBy("tenant").agg((F.count("*") - 1).alias("others"), F.count_if(F.col("vec_id") % 20 == 0).alias("asked"))
    whole = sizes.agg(F.sum("asked").alias("queries"), F.sum(F.col("asked") * F.col("others")).alias("pairs"))
    return whole.withColumn("reached", recall.scalar())
