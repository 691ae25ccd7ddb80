"""Contexts under a token budget in tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import estimate_tokens

# Headers of the three tiers.
HEADERS = ("Key facts:\n", "Additional context:\n", "Also relevant:\n")


def token_budget_tiered(facts: DataFrame, most: int, ratios: tuple[float, float, float] = (0.60, 0.25, 0.15)) -> DataFrame:
    """(query_id, edge_id, tier, line) of the facts (query_id, edge_id, fact, source, label, target, valid_at, relevance) that fit.

    Facts near the query's best relevance are told in full, the next by their first sentence, the rest as one line. Each tier ends at its
    first line that doesn't fit; what a tier leaves of its share the second may use, and all that is left the third. Running sums
    decide, so a query is one window, not one Python group.
    """
    query = W.partitionBy("query_id")
    first, second = int(most * ratios[0] + 1e-6), int(most * ratios[0] + 1e-6) + int(most * ratios[1] + 1e-6)
    head = [-(-len(h.encode()) // 4) for h in HEADERS]
    top = F.max("relevance").over(query)
    tier = F.when(F.col("relevance") >= top * (1 - ratios[0]), 1).when(F.col("relevance") >= top * ratios[2], 2).otherwise(3)
    sentence = F.coalesce(F.nullif(F.regexp_extract("fact", r"(?s)^([^.!?]*[.!?])", 1), F.lit("")), F.col("fact"))
    short = F.concat_ws(" ", "source", "label", "target", F.concat(F.lit("("), F.date_format("valid_at", "MMM yyyy"), F.lit(")")))
    out = facts.withColumn("tier", tier)
    out = out.withColumn("line", F.concat(F.lit("- "), F.when(F.col("tier") == 1, F.col("fact")).when(F.col("tier") == 2, sentence).otherwise(short)))
    order = W.partitionBy("query_id", "tier").orderBy(F.desc("relevance"), "edge_id").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("sum", F.sum(estimate_tokens(F.concat("line", F.lit("\n")))).over(order))
    # After each tier: tokens so far. A tier that may not open adds nothing.
    has = [F.max(F.col("tier") == t).over(query) for t in (1, 2, 3)]
    opens1 = has[0] & F.lit(head[0] <= first)
    fits1 = opens1 & (head[0] + F.col("sum") <= first)
    out = out.withColumn("run1", F.when(opens1, head[0] + F.coalesce(F.max(F.when((F.col("tier") == 1) & fits1, F.col("sum"))).over(query), F.lit(0))).otherwise(0))
    opens2 = has[1] & (F.col("run1") < second) & (second - F.col("run1") > head[1])
    fits2 = opens2 & (F.col("run1") + head[1] + F.col("sum") <= second)
    spent2 = F.col("run1") + head[1] + F.coalesce(F.max(F.when((F.col("tier") == 2) & fits2, F.col("sum"))).over(query), F.lit(0))
    out = out.withColumns({"fits1": fits1, "fits2": fits2, "run2": F.when(opens2, spent2).otherwise(F.col("run1"))})
    fits3 = has[2] & (F.col("run2") + head[2] < most) & (F.col("run2") + head[2] + F.col("sum") <= most)
    out = out.withColumn("fits", F.when(F.col("tier") == 1, F.col("fits1")).when(F.col("tier") == 2, F.col("fits2")).otherwise(fits3))
    return out.where("fits").select("query_id", "edge_id", "tier", "line")
