"""Re-ranking of candidates by graph attention, and its feedback, as joins, windows and groupings.

A layer of HEADS heads with WIDTH values each: every candidate's vector is projected, looks at itself and at
the candidates that an edge of the graph ties it to, and takes in their projections by softmax weights; the
outcome of all heads is projected to one score. Lists of candidates are short, as top k leaves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import dot

HEADS, WIDTH = 4, 8
# Slope of attention below zero, share of the fused score, learning rate.
SLOPE, SHARE, RATE = 0.2, 0.6, 0.01


def _noise(seed: Column, scale: float) -> Column:
    """A number within scale that the seed sets."""
    return (F.pmod(seed * F.lit(2654435761), F.lit(1000)) / 1000 - 0.5) * 2 * scale


def initial_weights(spark: SparkSession, dims: int) -> DataFrame:
    """(head, d, row, own, other, out): for each value of each head its row of the projection, its parts of the attention vector, and of the output's."""
    cells = spark.range(HEADS * WIDTH * dims).select((F.col("id") % WIDTH).cast("int").alias("d"), (F.expr(f"id div {WIDTH}") % dims).cast("int").alias("i"), F.expr(f"cast(id div {WIDTH * dims} as int)").alias("head"))
    cell = _noise(F.col("head").cast("long") * 10_000 + F.col("i") * WIDTH + F.col("d"), (2 / (dims + WIDTH)) ** 0.5)
    rows = cells.withColumn("cell", cell).groupBy("head", "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "cell"))), lambda x: x["cell"]).alias("row"))
    seed = (F.col("head").cast("long") + HEADS) * 10_000 + F.col("d")
    out = _noise(F.lit(HEADS * 20_000).cast("long") + F.col("head") * WIDTH + F.col("d"), (1 / (HEADS * WIDTH)) ** 0.5)
    part = (1 / (2 * WIDTH)) ** 0.5
    return rows.withColumns({"own": _noise(seed, part), "other": _noise(seed + WIDTH, part), "out": out})


def _features(candidates: DataFrame, edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, id, head, d, feature, out): what each head makes of each candidate. candidates: query_id, id, vector; edges: src, dst, weight."""
    table = weights.agg(F.collect_list(F.struct("head", "d", "row", "own", "other", "out"))).scalar()  # HEADS * WIDTH rows
    each = candidates.select("query_id", "id", "vector", F.explode(table).alias("w")).select("query_id", "id", "w.*", dot(F.col("vector"), F.col("w.row")).alias("h"))
    looks = each.groupBy("query_id", "id", "head").agg(F.sum(F.col("own") * F.col("h")).alias("own"), F.sum(F.col("other") * F.col("h")).alias("other"))
    ids = candidates.select("query_id", "id")
    ties = edges.select("src", "dst", "weight").where("src <> dst")
    ties = ties.union(ties.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    near = ids.withColumnRenamed("id", "src").join(ties, "src").join(ids.withColumnRenamed("id", "dst"), ["query_id", "dst"]).select("query_id", F.col("dst").alias("id"), F.col("src").alias("from"), "weight")
    near = near.unionByName(ids.select("query_id", "id", F.col("id").alias("from"), F.lit(1.0).alias("weight")))
    raw = near.join(looks.select("query_id", "id", "head", "own"), ["query_id", "id"]).join(looks.select("query_id", F.col("id").alias("from"), "head", "other"), ["query_id", "from", "head"])
    score = F.col("own") + F.col("other")
    raw = raw.withColumn("score", F.when(score > 0, score).otherwise(SLOPE * score) * F.col("weight"))
    group = W.partitionBy("query_id", "id", "head")
    raw = raw.withColumn("e", F.exp(F.col("score") - F.max("score").over(group))).withColumn("share", F.col("e") / (F.sum("e").over(group) + 1e-10))
    taken = raw.select("query_id", "id", "head", "from", "share").join(each.select("query_id", F.col("id").alias("from"), "head", "d", "h", "out"), ["query_id", "from", "head"])
    mixed = taken.groupBy("query_id", "id", "head", "d", "out").agg(F.sum(F.col("share") * F.col("h")).alias("x"))
    return mixed.select("query_id", "id", "head", "d", F.when(F.col("x") < 0, F.exp("x") - 1).otherwise(F.col("x")).alias("feature"), "out")


def attention_rerank(candidates: DataFrame, edges: DataFrame, weights: DataFrame, bias: float = 0.0, share: float = SHARE) -> DataFrame:
    """(query_id, id, model, score): the model's score of each candidate (query_id, id, score, vector), and the blend with its own."""
    raw = _features(candidates, edges, weights).groupBy("query_id", "id").agg(F.sum(F.col("feature") * F.col("out")).alias("raw"))
    model = 1 / (1 + F.exp(-(F.col("raw") + bias)))
    return candidates.select("query_id", "id", "score").join(raw, ["query_id", "id"]).select("query_id", "id", F.round(model, 6).alias("model"), F.round(share * F.col("score") + (1 - share) * model, 6).alias("score"))


def attention_feedback(candidates: DataFrame, edges: DataFrame, weights: DataFrame, used: DataFrame, bias: float = 0.0, rate: float = RATE) -> DataFrame:
    """(head, d, step): how one round of feedback moves the output's weights, towards candidates that were used (query_id, id); head and d -1 are the bias.

    Gradients are of each candidate's own features and error, summed over all queries.
    """
    features = _features(candidates, edges, weights)
    raw = features.groupBy("query_id", "id").agg(F.sum(F.col("feature") * F.col("out")).alias("raw"))
    p = 1 / (1 + F.exp(-(F.col("raw") + bias)))
    seen = raw.join(used.select("query_id", "id").distinct().withColumn("target", F.lit(1.0)), ["query_id", "id"], "left").withColumn("p", p)
    seen = seen.select("query_id", "id", ((F.coalesce("target", F.lit(0.0)) - F.col("p")) * F.col("p") * (1 - F.col("p")) * rate).alias("g"))
    steps = features.join(seen, ["query_id", "id"]).groupBy("head", "d").agg(F.sum(F.col("g") * F.col("feature")).alias("step"))
    return steps.unionByName(seen.agg(F.sum("g").alias("step")).select(F.lit(-1).alias("head"), F.lit(-1).alias("d"), "step"))
