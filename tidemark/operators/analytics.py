"""Reports over facts, episodes, deliveries and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import age_days, effective_confidence, tier_for_age
from tidemark.operators.percentiles import exact_percentiles
from tidemark.operators.facts import SLOT, facts_current


def conflict_radar(facts: DataFrame, now: Column, recent_days: int = 7) -> DataFrame:
    """Slots with several active facts or recent supersessions, and how severe that is."""
    active = F.count_if(F.col("invalid_at").isNull())
    recent = F.count_if(F.col("invalid_at").isNotNull() & (age_days(now, F.col("invalid_at")) <= recent_days))
    out = facts.groupBy(*SLOT).agg(active.alias("active"), recent.alias("recent")).where("active > 1 or recent > 0")
    severe = F.when(F.col("active") >= 2, F.least(F.lit(1.0), 0.5 + 0.15 * F.col("active") + 0.05 * F.col("recent"))).otherwise(F.least(F.lit(0.5), 0.1 * F.col("recent")))
    return out.withColumns({"needs_resolution": F.col("active") >= 2, "severity": F.round(severe, 6)})


def conflict_edges(radar: DataFrame, facts: DataFrame, most: int, edges: int = 10) -> DataFrame:
    """The active facts of each user's `most` severest slots that need resolution, newest first, `edges` of each: (user_id, item, source, label, place, edge_id)."""
    item = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("severity"), "source", "label"))
    worst = radar.where("needs_resolution").withColumn("item", item).where(F.col("item") <= most).select(*SLOT, "item")
    place = F.row_number().over(W.partitionBy(*SLOT).orderBy(F.desc("valid_at"), "edge_id"))
    return facts_current(facts).withColumn("place", place).where(F.col("place") <= edges).join(worst, list(SLOT)).select("user_id", "item", "source", "label", "place", "edge_id")


def review_questions(stale: DataFrame, most: int) -> DataFrame:
    """The most important stale facts of each user as questions."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("importance"), "edge_id"))
    return stale.withColumn("rank", rank).where(F.col("rank") <= most).select("user_id", "rank", "edge_id", F.format_string("Is this still right: %s?", "fact").alias("question"))


def fact_coherence(facts: DataFrame) -> DataFrame:
    """1 less the share of active slots with different objects, by user."""
    slots = facts_current(facts).groupBy(*SLOT).agg((F.count_distinct(F.lower("target")) > 1).alias("conflict"))
    return slots.groupBy("user_id").agg(F.round(1 - F.count_if("conflict") / F.count("*"), 6).alias("fact_coherence"))


def temporal_coherence(facts: DataFrame, now: Column, window_days: int = 30) -> DataFrame:
    inside = age_days(now, F.col("ingested_at")) <= window_days
    corroborated = F.count_if(inside & F.col("invalid_at").isNull() & (F.col("corroboration_count") >= 2))
    superseded = F.count_if(F.col("invalid_at").isNotNull() & (age_days(now, F.col("invalid_at")) <= window_days))
    out = facts.groupBy("user_id").agg(corroborated.alias("corroborated"), superseded.alias("superseded"))
    total = F.col("corroborated") + F.col("superseded")
    return out.withColumn("temporal_coherence", F.round(F.when(total == 0, 0.9).otherwise(0.2 + 0.8 * F.col("corroborated") / F.greatest(total, F.lit(1))), 6))


def entity_coherence(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """The share of active facts that hold together; a fact with an unknown end doesn't."""
    kinds = entities.select("user_id", "name", "type")
    out = facts_current(facts).join(kinds.toDF("user_id", "source", "source_type"), ["user_id", "source"], "left").join(kinds.toDF("user_id", "target", "target_type"), ["user_id", "target"], "left")
    good = F.col("source_type").isNotNull() & F.col("target_type").isNotNull() & (((F.col("source_type") != F.col("target_type")) & (F.col("confidence") >= 0.5)) | (F.col("corroboration_count") >= 2) | (F.col("confidence") >= 0.7))
    return out.groupBy("user_id").agg(F.round(F.avg(F.coalesce(good, F.lit(False)).cast("double")), 6).alias("entity_coherence"), F.count("*").alias("active"))


def node_degree(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.lit(1).alias("out")), F.struct(F.col(dst).alias("node"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.out").cast("long").alias("out_degree"), F.sum(1 - F.col("e.out")).cast("long").alias("in_degree"), F.count("*").alias("degree"))


def edge_importance(facts: DataFrame) -> DataFrame:
    """Corroboration, rarity of the label and connectedness of the ends, over active facts of each user."""
    active = facts_current(facts)
    labels = active.groupBy("user_id", "label").agg(F.count("*").alias("label_count"))
    outs = active.groupBy("user_id", "source").agg(F.count("*").alias("outs"))
    ins = active.groupBy("user_id", "target").agg(F.count("*").alias("ins"))
    out = active.join(labels, ["user_id", "label"]).join(outs, ["user_id", "source"]).join(ins, ["user_id", "target"])
    value = 0.4 * F.log(1 + F.col("corroboration_count").cast("double")) / F.log(F.lit(11.0)) + 0.3 / (1 + F.col("label_count")) + 0.3 * F.least(F.lit(1.0), F.sqrt((F.col("outs") + F.col("ins")).cast("double")) / 10)
    return out.withColumn("importance", value)


def stale_facts(facts: DataFrame, now: Column, threshold: float = 0.5, half_life: float = 30.0) -> DataFrame:
    """Active facts whose effective confidence has fallen under the threshold."""
    scored = edge_importance(facts)
    effective = effective_confidence(F.col("confidence"), F.col("corroboration_count"), age_days(now, F.col("valid_at")), half_life, F.col("importance"), F.col("invalid_at").isNotNull())
    return scored.withColumn("effective", effective).where(F.col("effective") < threshold).select("edge_id", "user_id", "fact", F.round("importance", 6).alias("importance"), F.round("effective", 6).alias("effective"))


def session_rollup(episodes: DataFrame) -> DataFrame:
    """Count, head and last activity of each session; equal times go to the larger id."""
    head = F.max(F.struct("created_at", "episode_id"))
    return episodes.groupBy("session_id", "user_id").agg(F.count("*").alias("episodes"), head.alias("head")).select("session_id", "user_id", "episodes", F.col("head.episode_id").alias("head_episode_id"), F.col("head.created_at").alias("last_activity"))


def policy_preview(episodes: DataFrame, now: Column, days: dict[str, int]) -> DataFrame:
    """Rows that a retention policy would remove, by user and type with totals."""
    limit = F.create_map(*[x for k, v in days.items() for x in (F.lit(k), F.lit(v))])
    old = age_days(now, F.col("created_at")) >= limit[F.col("type")]
    return episodes.where(old).rollup("user_id", "type").agg(F.count("*").alias("affected"))


def webhook_stats(deliveries: DataFrame, now: Column, window_days: int = 7, most: int = 3) -> DataFrame:
    failed, spent = ~F.col("delivered"), F.col("attempts") >= most
    recent = age_days(now, F.col("created_at")) <= window_days
    out = deliveries.groupBy("webhook_id").agg(
        F.count_if(F.col("delivered")).alias("delivered"), F.count_if(failed & ~spent).alias("pending"), F.count_if(failed & spent).alias("dead_letter"),
        F.count_if(failed & recent).alias("recent_failures"), F.count_if(recent).alias("recent"),
    )
    return out.withColumn("failure_rate", F.round(F.when(F.col("recent") > 0, F.col("recent_failures") / F.col("recent")).otherwise(0.0), 6)).drop("recent")


def span_usage(spans: DataFrame) -> DataFrame:
    """Calls, tokens, error rate and latency by user, model and operation, with all subtotals. Percentiles are exact, linear between ranks."""
    by = ["user_id", "model", "operation"]
    rate = F.round(F.count_if(~F.col("success")) / F.count("*"), 6).alias("error_rate")
    out = spans.cube(*by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), rate, F.grouping_id().cast("int").alias("level"))
    # Each row once for each set of columns that are summed over, with those null, as cube has it.
    sets = F.explode(F.array(*map(F.lit, range(2 ** len(by))))).alias("level")
    each = spans.select(*by, "latency", sets)
    each = each.select("latency", "level", *(F.when(F.col("level").bitwiseAND(1 << (len(by) - 1 - n)) == 0, F.col(c)).alias(c) for n, c in enumerate(by)))
    spent = exact_percentiles(each, [*by, "level"], "latency", {"p50": 0.5, "p95": 0.95})
    spent = spent.select(F.struct(*by, "level").alias("g"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    return out.withColumn("g", F.struct(*by, "level")).join(spent, "g", "left").select(*by, "calls", "tokens", "error_rate", "p50", "p95")


def compression_report(vectors: DataFrame, now: Column) -> DataFrame:
    """Vectors and bytes by age tier: 4, 2, 1 and 1/8 bytes a dimension."""
    tiered = vectors.select(tier_for_age(age_days(now, F.col("created_at"))).alias("tier"), F.size("vector").alias("dims"))
    width = F.element_at(F.create_map(F.lit("full"), F.lit(4.0), F.lit("half"), F.lit(2.0), F.lit("int8"), F.lit(1.0), F.lit("binary"), F.lit(0.125)), F.col("tier"))
    out = tiered.groupBy("tier").agg(F.count("*").alias("vectors"), F.sum(F.col("dims") * width).alias("bytes"), F.sum(F.col("dims") * 4.0).alias("full_bytes"))
    return out.select("tier", "vectors", "bytes", F.round(100 * (1 - F.col("bytes") / F.col("full_bytes")), 6).alias("savings"))
