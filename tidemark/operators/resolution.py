"""Resolving names, users and relations, and overlays that answers and hypotheses lay on facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.texts import clarification_question


def resolve_entities(extracted: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities after new mentions: names meet ignoring case; a hit counts on and takes the newest summary, a miss is a new row."""
    key = F.lower(F.trim("name"))
    new = extracted.groupBy("user_id", key.alias("key")).agg(F.count("*").alias("new_mentions"), F.max(F.struct("at", "name", "summary")).alias("newest"))
    out = entities.withColumn("key", key).join(new, ["user_id", "key"], "full_outer")
    return out.select(
        "user_id", F.coalesce("name", "newest.name").alias("name"), (F.coalesce("mention_count", F.lit(0)) + F.coalesce("new_mentions", F.lit(0))).alias("mention_count"),
        F.coalesce("newest.summary", "summary").alias("summary"), F.col("mention_count").isNull().alias("is_new"),
    )


def resolve_aliases(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Names with the entity that bears the name or the alias; of several the least entity name."""
    known = entities.select("user_id", F.col("name").alias("entity"), F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    known = known.groupBy("user_id", F.lower(F.trim("alias")).alias("key")).agg(F.min("entity").alias("entity"))
    return names.withColumn("key", F.lower(F.trim("mention"))).join(known, ["user_id", "key"], "left").drop("key")


def resolve_relationships(relations: DataFrame, extracted: DataFrame) -> DataFrame:
    """Relations both of whose ends were found in their own episode."""
    ends = extracted.select("episode_id", F.lower("name").alias("key")).distinct()
    out = relations
    for end in ("source", "target"):
        out = out.join(ends.withColumnRenamed("key", f"{end}_key"), (out["episode_id"] == ends["episode_id"]) & (F.lower(end) == F.col(f"{end}_key")), "left_semi")
    return out


def causal_chains(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Each fact with the episode it came from and what closed it. Facts whose episode is gone have less confidence."""
    source = episodes.select(F.col("episode_id").alias("source_episode_id"), F.col("created_at").alias("said_at"))
    out = facts.join(source, "source_episode_id", "left")
    found = F.col("said_at").isNotNull()
    reason = F.when(found, F.concat(F.lit("said in episode "), "source_episode_id")).otherwise("no episode left")
    return out.select("edge_id", "user_id", reason.alias("reason"), F.round(F.col("confidence") * F.when(found, 1.0).otherwise(0.5), 6).alias("chain_confidence"))


def trace_by_request(parts: dict[str, DataFrame], limit: int, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """All artifacts of each request in [start, end), tagged with their source; the newest of each source. Parts have request_id, id, at."""
    tagged = None
    for name, part in parts.items():
        part = part if start is None else part.where(F.col("at") >= start)
        part = part if end is None else part.where(F.col("at") < end)
        part = part.where("request_id is not null").select("request_id", F.lit(name).alias("source"), "id", "at")
        tagged = part if tagged is None else tagged.unionByName(part)
    rank = F.row_number().over(W.partitionBy("request_id", "source").orderBy(F.desc("at"), F.desc("id")))
    return tagged.withColumn("rank", rank).where(F.col("rank") <= limit)


def resolve_user(idents: DataFrame, users: DataFrame) -> DataFrame:
    """Identifiers with the user whose id, else external id, else name they are; of several users the least."""
    keys = users.select("user_id", F.posexplode(F.array(F.col("user_id").cast("string"), "external_id", "name")).alias("priority", "ident")).where("ident is not null")
    how = F.when(F.col("best.priority") == 0, "id").when(F.col("best.priority") == 1, "external_id").otherwise("name")
    best = keys.groupBy("ident").agg(F.min(F.struct("priority", "user_id")).alias("best")).select("ident", "best.user_id", how.alias("matched_by"))
    return idents.join(best, "ident", "left")


def apply_clarifications(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """Facts after answers (conflict_ids, winner, answered_at): losers that are still open close at the answer."""
    lost = answers.select(F.explode("conflict_ids").alias("edge_id"), "winner", "answered_at").where("edge_id <> winner").groupBy("edge_id").agg(F.min("answered_at").alias("answered_at"))
    return facts.join(lost, "edge_id", "left").withColumns({"closed_by_answer": F.col("invalid_at").isNull() & F.col("answered_at").isNotNull(), "invalid_at": F.coalesce("invalid_at", "answered_at")}).drop("answered_at")


def apply_hypotheticals(facts: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """What-if view: the last hypothesis of a slot (user, entity, label, ignoring case) overrides its facts, or adds a fact."""
    last = F.max(F.struct("seq", "entity", "label", "text", "confidence")).alias("h")
    keyed = hypotheses.groupBy("user_id", F.lower("entity").alias("entity_key"), F.lower("label").alias("label_key")).agg(last)
    real = facts.select("user_id", F.lower("source").alias("entity_key"), F.lower("label").alias("label_key"), "edge_id", "fact", "relevance")
    out = real.join(keyed, ["user_id", "entity_key", "label_key"], "full_outer")
    kind = F.when(F.col("h").isNull(), "kept").when(F.col("edge_id").isNull(), "novel").otherwise("override")
    return out.select("user_id", "edge_id", F.coalesce("h.text", "fact").alias("fact"), F.coalesce("h.confidence", "relevance").alias("relevance"), kind.alias("kind"))


def revalidate(facts: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Confirmed facts take the newest confirmation's confidence and start to age anew."""
    newest = confirmations.groupBy("edge_id").agg(F.max(F.struct("confirmed_at", F.col("confidence").alias("confirmed"))).alias("c"))
    out = facts.join(newest, "edge_id", "left")
    return out.withColumns({"confidence": F.coalesce("c.confirmed", "confidence"), "decays_from": F.coalesce("c.confirmed_at", "valid_at")}).drop("c")


def expand_one_hop(hits: DataFrame, facts: DataFrame, top: int = 3, factor: float = 0.8) -> DataFrame:
    """Outgoing facts of each query's best entities that it hasn't found already. hits: query_id, user_id, name, score."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "name"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "user_id", F.col("name").alias("source"), "score")
    return best.join(facts.where("invalid_at is null").select("user_id", "source", "edge_id", "fact"), ["user_id", "source"]).select("query_id", "edge_id", "fact", F.round(F.col("score") * factor, 6).alias("relevance"))


def entity_profile(entities: DataFrame, facts: DataFrame, most: int = 20) -> DataFrame:
    """Each entity with counts of its active facts and the newest of them on either side."""
    active = facts.where("invalid_at is null")
    out = entities.select("user_id", "name", "type")
    for side, end in (("out", "source"), ("in", "target")):
        rank = F.row_number().over(W.partitionBy("user_id", end).orderBy(F.desc("valid_at"), "edge_id"))
        total = F.count("*").over(W.partitionBy("user_id", end))
        newest = active.withColumns({"rank": rank, "total": total}).where(F.col("rank") <= most)
        listed = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "edge_id"))), lambda x: x["edge_id"].cast("string")))
        grouped = newest.groupBy("user_id", F.col(end).alias("name")).agg(F.max("total").alias(f"{side}_facts"), listed.alias(f"{side}_newest"))
        out = out.join(grouped, ["user_id", "name"], "left")
    return out.na.fill({"out_facts": 0, "in_facts": 0, "out_newest": "", "in_newest": ""})


def questions(radar: DataFrame, facts: DataFrame, now: Column, least: float = 0.6, most: int = 5, days: int = 7, shown: int = 20) -> DataFrame:
    """The worst conflicts of each user as questions that expire."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("severity"), "source", "label"))
    worst = radar.where(F.col("needs_resolution") & (F.col("severity") >= least)).withColumn("rank", rank).where(F.col("rank") <= most)
    # Of a conflict with many objects the first ones in the alphabet are told: distinct first, then ranked, so that no list outgrows what is shown.
    keys = ["user_id", "source", "label"]
    each = facts.where("invalid_at is null").join(worst.select(*keys), keys, "left_semi").select(*keys, "target").distinct()
    each = each.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("target"))).where(F.col("place") <= shown)
    texts = each.groupBy(*keys).agg(F.array_sort(F.collect_list("target")).alias("targets"))
    return worst.join(texts, ["user_id", "source", "label"]).select(
        "user_id", "source", "label", "severity", clarification_question(F.col("source"), F.col("label"), F.col("targets")).alias("question"), (now + F.make_dt_interval(F.lit(days))).alias("expires_at"),
    )
