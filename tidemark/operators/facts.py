"""The bi-temporal fact graph: supersession, as-of views, differences and conflicts.

A fact is valid at t if valid_at <= t and t < invalid_at, or invalid_at is null. Facts are closed, never
deleted, by the next assertion on their (user_id, source, label) in the order of ingestion.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.vector_index import dealt

SLOT = ("user_id", "source", "label")
#: Facts of one slot and time bucket that meet in one task, about.
FACTS_OF_A_PART = 1 << 13


def valid_at(t: Column) -> Column:
    return (F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (t < F.col("invalid_at")))


def _ingested():
    return W.partitionBy(*SLOT).orderBy("ingested_at", "edge_id")


def supersede(assertions: DataFrame) -> DataFrame:
    """Each assertion with the time and the episode that closed it; one window by slot."""
    return assertions.withColumns({"invalid_at": F.lead("ingested_at").over(_ingested()), "invalidated_by": F.lead("source_episode_id").over(_ingested())})


def belief_changes(assertions: DataFrame, newest: int = 1000, since: Column | None = None) -> DataFrame:
    """Where the object of a slot changes, ignoring case: old and new; the newest of each user, from `since` on."""
    before = assertions.withColumns({"old_target": F.lag("target").over(_ingested()), "old_edge_id": F.lag("edge_id").over(_ingested())})
    changed = before.where(F.lower("old_target") != F.lower("target"))
    changed = changed if since is None else changed.where(F.col("ingested_at") >= since)
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ingested_at"), F.desc("edge_id")))
    changed = changed.withColumn("rank", rank).where(F.col("rank") <= newest)
    return changed.select("user_id", "source", "label", "old_edge_id", F.col("edge_id").alias("new_edge_id"), "old_target", F.col("target").alias("new_target"), F.col("ingested_at").alias("changed_at"))


def facts_current(facts: DataFrame) -> DataFrame:
    return facts.where("invalid_at is null")


def facts_as_of(facts: DataFrame, t: Column) -> DataFrame:
    return facts.where(valid_at(t))


def edge_filter(facts: DataFrame, limit: int, source: str | None = None, target: str | None = None, label: str | None = None, at: Column | None = None, include_invalidated: bool = False, max_class: int | None = None) -> DataFrame:
    """The literal filter set, newest first. Without include_invalidated a since-closed fact is dropped even if `at` is given."""
    out = facts
    for column, value in (("source", source), ("target", target), ("label", label)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if max_class is None else out.where(F.col("classification") <= max_class)
    out = out if at is None else out.where(valid_at(at))
    out = out if include_invalidated else facts_current(out)
    return out.orderBy(F.desc("valid_at"), "edge_id").limit(limit)


def drop_expired(facts: DataFrame, now: Column, intent: str = "current") -> DataFrame:
    if intent not in ("current", "auto"):
        return facts
    return facts.where((F.col("scope") != "time_bounded") | F.col("expires_at").isNull() | (F.col("expires_at") > now))


def agent_filter(df: DataFrame, agent_id: str) -> DataFrame:
    return df.where(F.col("source_agent_id") == agent_id)


def resolve_fact_names(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Names of both ends; an end without an entity is Unknown."""
    names = entities.select("user_id", "name")
    source = names.select("user_id", F.col("name").alias("source"), F.col("name").alias("source_name"))
    target = names.select("user_id", F.col("name").alias("target"), F.col("name").alias("target_name"))
    out = facts.join(source, ["user_id", "source"], "left").join(target, ["user_id", "target"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("source_name", "target_name")})


def find_conflicting(new: DataFrame, facts: DataFrame) -> DataFrame:
    """Active facts with the same ends and label as a new assertion."""
    keys = ["user_id", "source", "target", "label"]
    return new.select(*keys, F.col("edge_id").alias("new_edge_id")).join(facts_current(facts).select(*keys, "edge_id"), keys).where("edge_id <> new_edge_id").select("new_edge_id", "edge_id")


def _bucket(c: Column, days: int) -> Column:
    return F.floor(F.unix_micros(c.cast("timestamp")) / (days * 86_400_000_000))


def _spans(facts: DataFrame, horizon: Column, days: int) -> DataFrame:
    """Facts once for each time bucket that they span; open ones up to the horizon."""
    first = _bucket(F.col("valid_at"), days)
    return facts.withColumn("bucket", F.explode(F.sequence(first, F.greatest(_bucket(F.coalesce("invalid_at", horizon), days), first))))


def fact_as_of_join(rows: DataFrame, facts: DataFrame, ts: str, horizon: Column, bucket_days: int = 7) -> DataFrame:
    """Each row of rows (user_id, label, ts) with the fact valid then.

    Facts are cut into the time buckets that they span, so the join has equality keys and long histories spread out.
    """
    spans = _spans(facts, horizon, bucket_days).select("user_id", "label", "bucket", "edge_id", "target", "valid_at", "invalid_at")
    return rows.withColumn("bucket", _bucket(F.col(ts), bucket_days)).join(spans, ["user_id", "label", "bucket"]).where(valid_at(F.col(ts))).drop("bucket")


def snapshot_diff(facts: DataFrame, t1: Column, t2: Column) -> DataFrame:
    """Facts gained and lost between two times: one pass, since a fact knows its own interval."""
    then, now = valid_at(t1), valid_at(t2)
    return facts.select("edge_id", "user_id", "fact", F.when(now & ~then, "gained").when(then & ~now, "lost").alias("change")).where("change is not null")


def time_travel_summary(facts: DataFrame, t1: Column, t2: Column) -> DataFrame:
    return snapshot_diff(facts, t1, t2).groupBy("user_id").agg(F.count_if(F.col("change") == "gained").alias("gained"), F.count_if(F.col("change") == "lost").alias("lost"))


def timeline(facts: DataFrame, episodes: DataFrame, start: Column, end: Column) -> DataFrame:
    """What was added, superseded and said in [start, end), and how heads of sessions moved, one row an event.

    Every episode that is newer than all before it in its session advances the head.
    """
    def part(df: DataFrame, kind: str, user: str, ident: str, ts: str) -> DataFrame:
        return df.where((F.col(ts) >= start) & (F.col(ts) < end)).select(F.lit(kind).alias("event"), F.col(user).cast("long").alias("user_id"), F.col(ident).alias("id"), F.col(ts).alias("happened_at"))

    return part(facts, "fact_added", "user_id", "edge_id", "ingested_at").unionByName(part(facts, "fact_superseded", "user_id", "edge_id", "invalid_at")).unionByName(part(episodes, "episode_added", "user_id", "episode_id", "created_at")).unionByName(part(head_moves(episodes), "head_advanced", "user_id", "episode_id", "created_at"))


def changes_since(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Counts of facts added and superseded in (start, end] by user."""
    if end <= start:
        raise ValueError("the end must lie after the start")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    inside = lambda c: (F.col(c) > lo) & (F.col(c) <= hi)
    out = facts.groupBy("user_id").agg(F.count_if(inside("ingested_at")).alias("added"), F.count_if(inside("invalid_at")).alias("superseded"))
    return out.where("added + superseded > 0").withColumn("summary", F.format_string("%d added, %d superseded", "added", "superseded"))


def head_moves(episodes: DataFrame) -> DataFrame:
    """Episodes that became the head of their session when they were added, in the order of ids, with the head before."""
    earlier = W.partitionBy("session_id").orderBy("episode_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.max(F.struct("created_at", "episode_id")).over(earlier)
    moved = episodes.withColumn("before", before).where(F.col("before").isNull() | (F.struct("created_at", "episode_id") > F.col("before")))
    return moved.withColumn("old_head", F.col("before.episode_id")).drop("before")


def change_events(facts: DataFrame, episodes: DataFrame, start: Column, end: Column) -> DataFrame:
    """(change, user_id, id, delta): facts added and superseded, shifts of confidence within a slot, head moves and episodes of (start, end].

    delta is the confidence of a fact less that of the one it follows in its slot, for shifts alone.
    """
    inside = lambda c: (F.col(c) > start) & (F.col(c) <= end)
    none = F.lit(None).cast("double")

    def part(df: DataFrame, name: str, ident: str, delta: Column = none) -> DataFrame:
        return df.select(F.lit(name).alias("change"), F.col("user_id").cast("long").alias("user_id"), F.col(ident).alias("id"), delta.alias("delta"))

    shift = F.round(F.col("confidence") - F.lag("confidence").over(_ingested()), 6)
    shifted = facts.withColumn("shift", shift).where(inside("ingested_at") & (F.col("shift") != 0))
    out = part(facts.where(inside("ingested_at")), "fact_added", "edge_id").unionByName(part(facts.where(inside("invalid_at")), "fact_superseded", "edge_id"))
    out = out.unionByName(part(shifted, "confidence_shifted", "edge_id", F.col("shift"))).unionByName(part(head_moves(episodes).where(inside("created_at")), "head_advanced", "episode_id"))
    return out.unionByName(part(episodes.where(inside("created_at")), "episode_added", "episode_id"))


# How a user's changes are named in the summary line, in its order.
CHANGES = {"fact_added": "added facts", "fact_superseded": "superseded facts", "confidence_shifted": "confidence deltas", "head_advanced": "head changes", "episode_added": "added episodes"}


def change_report(facts: DataFrame, episodes: DataFrame, start: str, end: str) -> DataFrame:
    """(user_id, change, id, delta, summary): the change_events of (start, end] as one list, and a row `summary` of each user who has any, with a line that counts them by kind.

    An end that is not after the start is an error. Users without changes have no rows.
    """
    if end <= start:
        raise ValueError("the end must lie after the start")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    events = change_events(facts, episodes, lo, hi)
    counted = F.concat_ws(", ", *[F.format_string(f"%d {told}", F.count_if(F.col("change") == name)) for name, told in CHANGES.items()])
    lines = events.groupBy("user_id").agg(counted.alias("summary")).withColumn("change", F.lit("summary"))
    return events.unionByName(lines, allowMissingColumns=True)


def sweep(ids: list[int], starts: list[int], ends: list[int | None], objects: list[str], beginners: set[int]) -> tuple[list[int], list[int]]:
    """Pairs of intervals [start, end) with different objects of which one is a beginner that starts while the other is active.

    Starts are taken in order; what has ended by then leaves the active set, which is kept by object, so that each start
    meets only those of other objects: work is in proportion to the intervals and the pairs that come out.
    """
    active: dict[str, set[int]] = {}
    ending: list[tuple[int, int, str]] = []
    low, high = [], []
    for start, ident, end, name in sorted(zip(starts, ids, ends, objects, strict=True), key=lambda x: (x[0], x[1])):
        while ending and ending[0][0] <= start:
            _, gone, of = heapq.heappop(ending)
            active[of].discard(gone)
            if not active[of]:
                del active[of]
        if ident in beginners:
            for other, held in active.items():
                if other != name:
                    low += [min(x, ident) for x in held]
                    high += [max(x, ident) for x in held]
        active.setdefault(name, set()).add(ident)
        if end is not None:
            heapq.heappush(ending, (end, ident, name))
    return low, high


def contradictions(facts: DataFrame, horizon: Column, bucket_days: int = 7) -> DataFrame:
    """Pairs of facts of one slot with different objects whose validity overlaps.

    A pair is found where the later of the two begins: in the time bucket of that start, among the facts that span the bucket. There
    a sweep over starts and ends gives out only facts of different objects. A slot's bucket of many facts is dealt into
    parts of both, so that none is one task's work. Open facts reach to the horizon, which no fact begins after.
    """
    keys, fields = [*SLOT, "bucket"], ("edge_id", "object", "start", "stop")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    clean = facts.where("edge_id is not null and target is not null and valid_at is not null and (invalid_at is null or invalid_at > valid_at)")
    clean = clean.withColumns({"object": F.lower("target"), "start": micros("valid_at"), "stop": micros("invalid_at")})
    spans = _spans(clean, horizon, bucket_days).select(*keys, *fields)
    begun = clean.withColumn("bucket", _bucket(F.col("valid_at"), bucket_days)).select(*keys, *(F.col(c).alias(f"new_{c}") for c in fields))
    left, right = dealt(begun, spans, keys, "new_edge_id", "edge_id", FACTS_OF_A_PART, FACTS_OF_A_PART)

    parts = [*keys, "part", "turn"]
    # Small parts share a task's call: about FACTS_OF_A_PART facts go into one.
    call = F.pmod(F.xxhash64(*parts), F.lit(max(1, clean.count() // FACTS_OF_A_PART))).alias("call")
    unit = F.to_json(F.struct(*parts)).alias("unit")
    left = left.select(call, unit, "user_id", "label", *(f"new_{c}" for c in fields))
    right = right.select(call, unit, *fields)

    def meet(new: pa.Table, held: pa.Table) -> pa.Table:
        units: dict[str, tuple[dict, set, set]] = {}
        for table, prefix, which in ((held, "", 0), (new, "new_", 1)):
            for u, ident, start, stop, name in zip(*(table.column(c).to_pylist() for c in ("unit", *(prefix + f for f in ("edge_id", "start", "stop", "object")))), strict=True):
                both, *sides = units.setdefault(u, ({}, set(), set()))
                both[ident] = (start, stop, name)
                sides[which].add(ident)
        place = {x: n for n, x in enumerate(zip(new.column("unit").to_pylist(), new.column("new_edge_id").to_pylist(), strict=True))}
        rows, pairs = [], []
        for u, (both, others, beginners) in units.items():
            ids = list(both)
            for a, b in zip(*sweep(ids, *([both[i][k] for i in ids] for k in range(3)), beginners), strict=True):
                early, late = (a, b) if (both[a][0], a) < (both[b][0], b) else (b, a)
                if early in others:  # else both begin here, and the pair is given out where the earlier one is dealt
                    rows.append(place[u, late])
                    pairs.append((a, b))
        slots = new.take(pa.array(rows, pa.int64()))
        return pa.table({"user_id": slots.column("user_id"), "label": slots.column("label"), "id1": pa.array([a for a, _ in pairs], pa.int64()), "id2": pa.array([b for _, b in pairs], pa.int64())})

    kinds = {f.name: f.dataType.simpleString() for f in facts.schema.fields}
    return left.groupBy("call").cogroup(right.groupBy("call")).applyInArrow(meet, f"user_id {kinds['user_id']}, label {kinds['label']}, id1 long, id2 long")


def edge_reinforcement(accesses: DataFrame) -> DataFrame:
    return accesses.groupBy("edge_id").agg(F.count("*").alias("accesses"), F.max("at").alias("last_access"))
