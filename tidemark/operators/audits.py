"""Audit chains, incidents, pipeline steps, proposals, coherence reports, experiences and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import age_days, episode_backoff_ms, experience_weight
from tidemark.operators import analytics as A
from tidemark.operators.facts import facts_current
from tidemark.operators.percentiles import exact_percentiles


def chain_hash(action: Column, from_version: Column, to_version: Column, prev_hash: Column, created_at: Column) -> Column:
    millis = F.unix_millis(created_at.cast("timestamp"))
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (action, from_version, to_version, prev_hash, millis)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def audit_chain_verify(events: DataFrame, owner: str) -> DataFrame:
    """Each event's state: legacy (before the first hash), ok, altered (its hash isn't its content's) or unlinked.

    The first hashed event may name no predecessor; each later one must name the hash before it.
    """
    order = W.partitionBy(owner).orderBy("created_at", "event_id")
    hashed = F.col("event_hash") != ""
    started = F.max(hashed).over(order.rowsBetween(W.unboundedPreceding, 0))
    before = F.max(hashed).over(order.rowsBetween(W.unboundedPreceding, -1))
    prior = F.when(F.coalesce(before, F.lit(False)), F.lag("event_hash").over(order))
    right = F.col("event_hash") == chain_hash(F.col("action"), F.col("from_version"), F.col("to_version"), F.col("prev_hash"), F.col("created_at"))
    linked = F.coalesce(F.col("prev_hash"), F.lit("")) == F.coalesce("prior", F.lit(""))
    state = F.when(~F.col("started"), "legacy").when(~right, "altered").when(~linked, "unlinked").otherwise("ok")
    return events.withColumns({"started": started, "prior": prior}).withColumn("state", state).drop("started", "prior")


def violations(audit: DataFrame, start: Column, end: Column) -> DataFrame:
    inside = (F.col("created_at") > start) & (F.col("created_at") <= end)
    return audit.where(inside & F.startswith("action", F.lit("policy_violation_"))).groupBy("user_id", "action").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))


def audit_export(parts: dict[str, DataFrame], start: Column, end: Column) -> DataFrame:
    """Several audit tables as one log of (start, end], each row tagged with its table."""
    out = None
    for name, part in parts.items():
        tagged = part.where((F.col("created_at") > start) & (F.col("created_at") <= end)).withColumn("kind", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def audit_file(log: DataFrame, path: str) -> None:
    """The log as JSON lines in order of time, in the folder `path`."""
    log.orderBy("created_at", "kind", "id").write.json(path)


def incidents(stats: DataFrame, conflicts: DataFrame) -> DataFrame:
    """What needs attention: dead letters and high failure rates of webhooks, backlogs, and severe conflicts of users."""
    def rule(df: DataFrame, kind: str, severity: str, when: str, subject: str, size: str) -> DataFrame:
        return df.where(when).select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col(subject).alias("subject"), F.col(size).cast("double").alias("size"))

    found = rule(stats, "dead_letters", "high", "dead_letter > 0", "webhook_id", "dead_letter")
    found = found.unionByName(rule(stats, "failure_rate", "high", "failure_rate >= 0.3", "webhook_id", "failure_rate"))
    found = found.unionByName(rule(stats, "backlog", "medium", "pending >= 5", "webhook_id", "pending"))
    worst = conflicts.where("needs_resolution").groupBy("user_id").agg(F.max("severity").alias("severity"), F.count("*").alias("n"))
    found = found.unionByName(rule(worst, "conflict", "high", "severity >= 0.9", "user_id", "severity"))
    return found.unionByName(rule(worst, "many_conflicts", "low", "n >= 4", "user_id", "n"))


def step_metrics(runs: DataFrame) -> DataFrame:
    """Of each pipeline step: executions, outcomes, retries, error rate and mean time."""
    failed = F.count_if(~F.col("success"))
    return runs.groupBy("step").agg(
        F.count("*").alias("executions"), F.count_if("success").alias("successes"), failed.alias("failures"), F.sum("retries").alias("retries"),
        F.round(failed / F.count("*"), 6).alias("error_rate"), F.round(F.avg("duration"), 6).alias("mean_duration"),
    )


def structural_coherence(entities: DataFrame, facts: DataFrame, components: DataFrame) -> DataFrame:
    """1 less 0.8 of communities and 0.4 of isolated entities, as shares of the entities of each user.

    components: user_id, name, component of every entity that a fact touches; others are their own communities.
    """
    out = entities.select("user_id", "name").join(components, ["user_id", "name"], "left")
    lone = F.count_if(F.col("component").isNull())
    groups = F.count_distinct("component") + lone
    n = F.count("*")
    score = F.when(n <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.8 * groups / n - 0.4 * lone / n)))
    return out.groupBy("user_id").agg(n.alias("entities"), groups.alias("communities"), lone.alias("isolated"), F.round(score, 6).alias("structural_coherence"))


def coherence_report(entities: DataFrame, facts: DataFrame, components: DataFrame, now: Column, window_days: int) -> DataFrame:
    """The four coherences of each user, weighted, and what to do about low ones."""
    out = structural_coherence(entities, facts, components).select("user_id", "structural_coherence")
    for part in (A.entity_coherence(entities, facts).select("user_id", "entity_coherence"), A.fact_coherence(facts), A.temporal_coherence(facts, now, window_days).select("user_id", "temporal_coherence")):
        out = out.join(part, "user_id", "left")
    names = ("entity", "fact", "temporal", "structural")
    out = out.na.fill(1.0, [f"{n}_coherence" for n in names])
    # Weights of the parts.
    weights = {"entity": 0.20, "fact": 0.35, "temporal": 0.20, "structural": 0.25}
    total = sum((F.col(f"{n}_coherence") * w for n, w in weights.items()), F.lit(0.0))
    advice = F.concat_ws(",", *[F.when(F.col(f"{n}_coherence") < 0.5, f"review {n}") for n in names])
    return out.withColumns({"coherence": F.round(total, 5), "advice": advice})


def relevance_of_entities(entities: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Offline relevance from mentions, age and degree, of every entity."""
    ends = facts_current(facts).select("user_id", F.explode(F.array("source", "target")).alias("name"))
    degree = ends.groupBy("user_id", "name").agg(F.count("*").alias("degree"))
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 86_400_000_000
    score = 0.3 * F.log1p("mention_count") / 6 + 0.4 * F.exp(-days / 120) + 0.3 * F.log1p(F.coalesce("degree", F.lit(0))) / 4
    return entities.join(degree, ["user_id", "name"], "left").select("user_id", "name", F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 6).alias("relevance"))


def idle_users(facts: DataFrame, now: Column, idle_days: int) -> DataFrame:
    """Users (user_id) whose last fact came in at least so many days ago: those that are due for a digest."""
    return facts.groupBy("user_id").agg(F.max("ingested_at").alias("last")).where(age_days(now, F.col("last")) >= idle_days).select("user_id")


def digest_inputs(entities: DataFrame, facts: DataFrame, most_entities: int = 80, most_facts: int = 60) -> DataFrame:
    """Counts and the leading lines of each user: most mentioned entities, newest active facts."""
    def leading(df: DataFrame, order: list[Column], most: int, line: Column, name: str) -> DataFrame:
        ranked = df.withColumns({"rank": F.row_number().over(W.partitionBy("user_id").orderBy(*order)), "total": F.count("*").over(W.partitionBy("user_id"))}).where(F.col("rank") <= most)
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
        return ranked.groupBy("user_id").agg(F.max("total").alias(name), lines.alias(f"{name}_lines"))

    who = leading(entities, [F.desc("mention_count"), F.col("name")], most_entities, F.format_string("%s (%s)", "name", "type"), "entities")
    what = leading(facts_current(facts), [F.desc("valid_at"), F.col("edge_id")], most_facts, F.col("fact"), "facts")
    return who.join(what, "user_id", "left").na.fill({"facts": 0, "facts_lines": ""})


def experience_importance(events: DataFrame, near: int = 49) -> DataFrame:
    """Novelty, surprise and weight of each event against the agent's events just before it in the same category."""
    last = W.partitionBy("agent").orderBy("at", "event_id").rowsBetween(-near, -1)
    out = events.withColumn("past", F.collect_list(F.struct("category", "confidence")).over(last))
    like = F.filter("past", lambda p: p["category"] == F.col("category"))
    out = out.withColumns({"n": F.size(like), "total": F.aggregate(like, F.lit(0.0), lambda a, p: a + p["confidence"])}).drop("past")
    score = 0.4 / (1 + F.col("n")) + 0.35 * (1 - F.abs(F.col("confidence") - F.col("total") / F.greatest("n", F.lit(1)))) + 0.25 * F.col("weight")
    return out.withColumn("importance", F.round(F.when(F.col("n") == 0, 1.0).otherwise(score), 6)).drop("total")


def fork_experiences(events: DataFrame, categories: list[str], min_confidence: float, min_weight: float, now: Column, most: int, half_life: float = 30.0) -> DataFrame:
    """What a copy of each agent takes along: the newest events of some categories that still weigh enough."""
    weight = experience_weight(F.col("weight"), F.col("confidence"), age_days(now, F.col("at")), half_life, F.lit(0.0))
    rank = F.row_number().over(W.partitionBy("agent").orderBy(F.desc("at"), F.desc("event_id")))
    kept = events.where(F.col("category").isin(categories) & (F.col("confidence") >= min_confidence) & (weight >= min_weight)).withColumn("rank", rank).where(F.col("rank") <= most)
    return kept.select(F.concat("agent", F.lit("-fork")).alias("agent"), F.sha2(F.concat_ws(":", "agent", "event_id"), 256).alias("fork_id"), "event_id", "rank")


def agent_and_user_context(agents: DataFrame, cores: DataFrame, lines: DataFrame) -> DataFrame:
    """agents (agent, user_id, ...) with each one's identity core (agent, core) and its user's context, the lines (user_id, rank, line) in order; lines must be few a user, as a budget leaves them."""
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    return agents.join(cores, "agent", "left").join(lines.groupBy("user_id").agg(told.alias("context")), "user_id", "left")


def agent_context(events: DataFrame, now: Column, newest: int = 50, shown: int = 8, half_life: float = 30.0) -> DataFrame:
    """Of each agent's newest experiences: how many, the first shown ones, and the decayed weight of all."""
    rank = F.row_number().over(W.partitionBy("agent").orderBy(F.desc("at"), F.desc("event_id")))
    weight = experience_weight(F.col("weight"), F.col("confidence"), age_days(now, F.col("at")), half_life, F.lit(0.0))
    near = events.withColumns({"rank": rank, "decayed": weight}).where(F.col("rank") <= newest)
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", "event_id")))), lambda x: x["event_id"].cast("string")), ",")
    return near.groupBy("agent").agg(F.count("*").alias("experiences"), first.alias("shown"), F.round(F.sum("decayed"), 5).alias("weight"))


def identity_at(versions: DataFrame, version: int) -> DataFrame:
    """Each agent's identity at a version, and the rollback row that makes it the newest version again."""
    numbered = versions.withColumn("version", F.row_number().over(W.partitionBy("agent").orderBy("at", "event_id")))
    then = F.max(F.when(F.col("version") <= version, F.struct("version", "core"))).alias("then")
    return numbered.groupBy("agent").agg(then, F.max("version").alias("last")).select("agent", F.col("then.version").alias("restored"), "then.core", (F.col("last") + 1).alias("version"))


def replay(events: DataFrame, after: DataFrame, most: int, delivered: bool | None = False, dead_letter: bool | None = None) -> DataFrame:
    """The next events of each webhook after its cursor (webhook_id, after_id): delivered or not, dead letters or not; None takes both."""
    rank = F.row_number().over(W.partitionBy("webhook_id").orderBy("delivery_id"))
    wanted = F.lit(True)
    for column, value in (("delivered", delivered), ("dead_letter", dead_letter)):
        wanted = wanted if value is None else wanted & (F.col(column) == value)
    return events.join(after, "webhook_id").where((F.col("delivery_id") > F.col("after_id")) & wanted).withColumn("rank", rank).where(F.col("rank") <= most)


def proposal_status(proposals: DataFrame, votes: DataFrame, now: Column) -> DataFrame:
    """approved once enough approvers voted and the cooling hours are over, expired after the deadline, else pending.

    Proposals carry their risk's policy: quorum, cooling_hours, deadline_hours. A rejection by anyone rejects.
    """
    cast = votes.groupBy("proposal_id").agg(F.count_distinct(F.when(F.col("approve"), F.col("voter"))).alias("approvers"), F.max(~F.col("approve")).alias("refused"))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3_600_000_000
    enough = F.coalesce("approvers", F.lit(0)) >= F.col("quorum")
    status = F.when(F.coalesce("refused", F.lit(False)), "rejected").when(enough & (hours >= F.col("cooling_hours")), "approved").when(hours > F.col("deadline_hours"), "expired").otherwise("pending")
    return proposals.join(cast, "proposal_id", "left").select("proposal_id", F.coalesce("approvers", F.lit(0)).alias("approvers"), status.alias("status"))


def narrative_inputs(episodes: DataFrame) -> DataFrame:
    """Chapters of each user by month: sessions and episodes in order, with the running count of versions."""
    sessions = episodes.groupBy("user_id", "session_id").agg(F.min("created_at").alias("first_at"), F.count("*").alias("episodes"))
    month = F.date_format("first_at", "yyyy-MM").alias("chapter")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_at", "session_id"))), lambda x: x["session_id"].cast("string")), ",")
    chapters = sessions.groupBy("user_id", month).agg(listed.alias("sessions"), F.sum("episodes").alias("episodes"))
    return chapters.withColumn("version", F.row_number().over(W.partitionBy("user_id").orderBy("chapter")))


def key_changes(changes: DataFrame, most: int = 3) -> DataFrame:
    """What each chapter (month) of a user tells of changed beliefs: how many, and the newest of them. changes: rows of belief_changes."""
    chapter = F.date_format("changed_at", "yyyy-MM")
    rank = F.row_number().over(W.partitionBy("user_id", "chapter").orderBy(F.desc("changed_at"), F.desc("new_edge_id")))
    told = changes.withColumn("chapter", chapter).withColumn("rank", rank)
    line = F.when(F.col("rank") <= most, F.struct("rank", F.format_string("%s: %s to %s", "label", "old_target", "new_target").alias("line")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "; ")
    return told.groupBy("user_id", "chapter").agg(F.count("*").alias("changes"), lines.alias("newest"))


def state_digest(items: DataFrame) -> DataFrame:
    """(replica, prefix, digest): a hash of the items by the first character of their keys, and one over them (prefix '').

    The hashes of the items meet by exclusive or, so a prefix of any size is aggregated in parts and in any order.
    """
    leaf = F.sha2(F.concat_ws("=", "key", "value"), 256)
    parts = [F.bit_xor(F.conv(F.substring("leaf", 1 + 15 * i, 15), 16, 10).cast("long")) for i in range(4)]
    by_prefix = items.select("replica", F.substring("key", 1, 1).alias("prefix"), leaf.alias("leaf")).groupBy("replica", "prefix")
    by_prefix = by_prefix.agg(F.sha2(F.concat_ws("|", F.count("*"), *parts), 256).alias("digest"))
    root = by_prefix.groupBy("replica").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))
    return by_prefix.unionByName(root.withColumn("prefix", F.lit("")))


def digest_diff(digests: DataFrame, a: str, b: str) -> DataFrame:
    """Prefixes whose hashes differ between two replicas."""
    left, right = (digests.where((F.col("replica") == r) & (F.col("prefix") != "")).select("prefix", F.col("digest").alias(f"d{i}")) for i, r in enumerate((a, b)))
    return left.join(right, "prefix", "full_outer").where(~F.col("d0").eqNullSafe(F.col("d1"))).select("prefix")


def eval_report(results: DataFrame, gate: float) -> DataFrame:
    """Accuracy, stale rate and latency of each pack, and whether accuracy meets the gate. Percentiles are exact, linear between ranks."""
    out = results.groupBy("pack").agg(F.avg(F.col("right").cast("double")).alias("accuracy"), F.avg(F.col("stale").cast("double")).alias("stale_rate"))
    spent = exact_percentiles(results, ["pack"], "latency", {"p50": 0.5, "p95": 0.95}).withColumnRenamed("pack", "of")
    out = out.join(spent, F.col("pack").eqNullSafe(F.col("of")), "left")
    return out.select("pack", *[F.round(c, 6).alias(c) for c in ("accuracy", "stale_rate", "p50", "p95")], (F.col("accuracy") >= gate).alias("passed"))


def ranking_metrics(ranked: DataFrame) -> DataFrame:
    """Accuracy at 1, precision at 3 and gain at 5 (one hit is ideal) over queries. ranked: query_id, rank, hit."""
    hit = F.col("hit").cast("double")
    each = ranked.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, hit).otherwise(0.0)).alias("a1"), (F.sum(F.when(F.col("rank") <= 3, hit).otherwise(0.0)) / 3).alias("p3"),
        F.max(F.when(F.col("rank") <= 5, hit / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("g5"),
    )
    return each.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("a1", "accuracy_1"), ("p3", "precision_3"), ("g5", "ndcg_5"))])


def attachment_counts(attachments: DataFrame, kinds: list[str]) -> DataFrame:
    """Attachments of each user by kind, a column each; the kinds are given, so no pass is needed to find them."""
    return attachments.groupBy("user_id").pivot("kind", kinds).count().na.fill(0)


def retry_state(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Each delivery after its attempts: delivered, dead_letter, or pending with the wait before the next one."""
    out = attempts.groupBy("delivery_id").agg(F.count("*").alias("attempts"), F.max("success").alias("delivered"))
    status = F.when(F.col("delivered"), "delivered").when(F.col("attempts") >= most, "dead_letter").otherwise("pending")
    return out.select("delivery_id", "attempts", status.alias("status"), F.when(status == "pending", episode_backoff_ms(F.col("attempts"), most)).alias("wait_ms"))
