"""Episodes: filters, heads, pages and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import age_days
from tidemark.operators.facts import valid_at


def _newest():
    return W.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("episode_id"))


def _oldest():
    return W.partitionBy("session_id").orderBy("created_at", "episode_id")


def processable(episodes: DataFrame) -> DataFrame:
    return episodes.where((F.trim("content") != "") & (F.col("role") != "system"))


def tags_of(metadata: str = "metadata") -> Column:
    return F.from_json(metadata, "tags array<string>")["tags"]


def episode_filter(episodes: DataFrame, roles: list[str], tags_any: list[str] | None = None, tags_all: list[str] | None = None, after: Column | None = None, before: Column | None = None, status: str | None = None) -> DataFrame:
    """Episodes of some roles with any or all of some tags, said in [after, before), in one processing status."""
    out = episodes.where(F.col("role").isin(roles))
    out = out if after is None else out.where(F.col("created_at") >= after)
    out = out if before is None else out.where(F.col("created_at") < before)
    out = out if status is None else out.where(F.col("status") == status)
    if tags_any:
        out = out.where(F.arrays_overlap(tags_of(), F.array(*map(F.lit, tags_any))))
    for tag in tags_all or ():
        out = out.where(F.array_contains(tags_of(), tag))
    return out


def thread_head(episodes: DataFrame) -> DataFrame:
    """The newest episode of each session, and the version: how many there are."""
    ranked = episodes.withColumns({"rank": F.row_number().over(_newest()), "version": F.count("*").over(W.partitionBy("session_id"))})
    return ranked.where("rank = 1").select("session_id", F.col("episode_id").alias("head_episode_id"), F.col("created_at").alias("head_at"), "version")


def user_heads(heads: DataFrame, sessions: DataFrame) -> DataFrame:
    """The session of each user whose head is newest; of equal times the larger version, then the larger id. sessions: user_id, session_id."""
    best = F.max(F.struct("head_at", "version", "session_id", "head_episode_id")).alias("best")
    return heads.join(sessions, "session_id").groupBy("user_id").agg(best).select("user_id", "best.session_id", "best.head_episode_id", "best.version")


def delete_messages(episodes: DataFrame, deletions: DataFrame) -> DataFrame:
    """Episodes without those at the given places of their sessions (session_id, idx), counted from 0 in order of time."""
    indexed = episodes.withColumn("idx", F.row_number().over(_oldest()) - 1)
    return indexed.join(deletions.select("session_id", "idx"), ["session_id", "idx"], "left_anti").drop("idx")


def messages_page(episodes: DataFrame, first: int, size: int) -> DataFrame:
    index = F.row_number().over(_oldest()) - 1
    return episodes.withColumn("idx", index).where((F.col("idx") >= first) & (F.col("idx") < first + size)).select("session_id", "idx", "episode_id")


def retention_split(episodes: DataFrame, now: Column, days: dict[str, int]) -> DataFrame:
    limit = F.create_map(*[x for k, v in days.items() for x in (F.lit(k), F.lit(v))])
    return episodes.select("episode_id", "type", (age_days(now, F.col("created_at")) < F.coalesce(limit[F.col("type")], F.lit(1 << 30))).alias("retained"))


def summary_trigger(episodes: DataFrame, every: int = 10) -> DataFrame:
    n = F.row_number().over(_oldest())
    return episodes.withColumn("n", n).where(F.col("n") % every == 0).select("session_id", "episode_id", "n")


def contract_filter(rows: DataFrame, contract: str = "support_safe", as_of: Column | None = None) -> DataFrame:
    """support_safe: episodes that users said; current_strict: current facts; historical_strict: facts valid at as_of, which must be given."""
    if contract == "support_safe":
        return rows.where("role = 'user'")
    if contract == "current_strict":
        return rows.where("invalid_at is null")
    if contract != "historical_strict":
        raise ValueError(f"no such contract: {contract}")
    if as_of is None:
        raise ValueError("historical_strict needs as_of")
    return rows.where(valid_at(as_of))


def page_numbers(rows: DataFrame, owner: str, ts: str, ident: str, size: int) -> DataFrame:
    """Newest first, the page of each row among its owner's: keyset pagination for all owners at once."""
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc(ts), F.desc(ident)))
    return rows.withColumn("page", F.floor((rank - 1) / size))


def expire(rows: DataFrame, now: Column, ts: str, days: int) -> DataFrame:
    """Rows that are not older than so many days."""
    return rows.where(age_days(now, F.col(ts)) < days)


def expire_grants(grants: DataFrame, now: Column) -> DataFrame:
    """Grants that have no end or end later."""
    return grants.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def expire_clarifications(asked: DataFrame, now: Column) -> DataFrame:
    """Pending questions past their end become expired; answered ones stay."""
    return asked.withColumn("status", F.when((F.col("status") == "pending") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status")))


def episode_diff(episodes: DataFrame, t1: Column, t2: Column) -> DataFrame:
    """Episodes that are there at the later of two times only: gained if t2 is the later, else lost."""
    then, now = F.col("created_at") <= t1, F.col("created_at") <= t2
    return episodes.select("episode_id", "user_id", F.when(now & ~then, "gained").when(then & ~now, "lost").alias("change")).where("change is not null")
