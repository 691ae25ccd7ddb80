"""What a caller may see: views, regions, scopes, guardrails, label and identity checks.

Policy rows are tables too, joined on the user or agent that they belong to, so one plan serves all callers.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import age_days

# The keys that an identity may have, and what no key of it may contain.
IDENTITY_KEYS = ("boundaries", "capabilities", "mission", "persona", "style", "values")
FORBIDDEN_IN_KEYS = ("address", "email", "episode", "external_id", "phone", "session", "user")

#: Guardrails don't look at contents beyond this size.
MOST_BYTES = 100_000


def entity_filter(entities: DataFrame, kind: str | None = None, name_part: str | None = None) -> DataFrame:
    """By type and by part of the name, both ignoring case."""
    out = entities if kind is None else entities.where(F.lower("type") == kind.lower())
    return out if name_part is None else out.where(F.contains(F.lower("name"), F.lit(name_part.lower())))


def label_problem(label: Column) -> Column:
    """Why a label can't be used; null if it can."""
    size = F.octet_length(label)
    return (
        F.when(label.isNull() | (size == 0), "empty").when(size > 128, "too long").when(F.trim(label) != label, "edge whitespace").when(~label.rlike(r"^[\p{L}\p{N}_\- ]+$"), "bad character")
    )


def apply_view(facts: DataFrame, views: DataFrame, now: Column, entities: DataFrame | None = None) -> DataFrame:
    """Facts that each user's view shows, the newest max_facts of them.

    A view row has user_id, ceiling, caller_ceiling, hidden_labels, mode (all, current, days, since), days, since where that mode occurs,
    and max_facts. With entities a view's shown_types name the types of targets that it shows. Users without a view see nothing.
    """
    if entities is not None:
        kinds = entities.select("user_id", F.col("name").alias("target"), F.col("type").alias("target_type"))
        facts = facts.join(kinds, ["user_id", "target"])
    seen = facts.join(views, "user_id").where(F.col("classification") <= F.least("ceiling", "caller_ceiling")).where(~F.array_contains("hidden_labels", F.col("label")))
    seen = seen if entities is None else seen.where(F.array_contains("shown_types", F.col("target_type")))
    timely = F.when(F.col("mode") == "current", F.col("invalid_at").isNull()).when(F.col("mode") == "days", age_days(now, F.col("valid_at")) <= F.col("days"))
    timely = timely.when(F.col("mode") == "since", F.col("valid_at") >= F.col("since")) if "since" in views.columns else timely
    timely = timely.otherwise(True)
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("valid_at"), "edge_id"))
    return seen.where(timely).withColumn("rank", rank).where("rank <= max_facts")


def apply_region(facts: DataFrame, regions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Facts inside the regions of their user: labels, target patterns (like), least confidence and ceiling; with entities also the types of targets."""
    if entities is not None:
        kinds = entities.select("user_id", F.col("name").alias("target"), F.col("type").alias("target_type"))
        facts = facts.join(kinds, ["user_id", "target"]).join(regions.select("user_id", F.explode("types").alias("target_type")), ["user_id", "target_type"], "left_semi")
    fits = F.array_contains("labels", F.col("label")) & (F.col("confidence") >= F.col("min_confidence")) & (F.col("classification") <= F.col("ceiling"))
    named = F.expr("exists(patterns, p -> lower(target) like p)")
    return facts.join(regions, "user_id").where(fits & named)


def scope_rows(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows of the users and agents that each caller is granted, up to its ceiling. A grant names one of each."""
    return rows.join(grants, (rows["user_id"] == grants["granted_user"]) & (rows["source_agent_id"] == grants["granted_agent"])).where(F.col("classification") <= F.col("ceiling"))


def accessible_regions(regions: DataFrame, grants: DataFrame, now: Column, least: str = "read") -> DataFrame:
    """(agent, region_id, permission): owners manage; others need a grant that hasn't expired and suffices."""
    order = {"read": 1, "write": 2, "manage": 3}
    level = F.when(F.col("permission") == "read", 1).when(F.col("permission") == "write", 2).when(F.col("permission") == "manage", 3).otherwise(0)
    owned = regions.select(F.col("owner").alias("agent"), "region_id", F.lit(3).alias("level"))
    live = grants.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("agent", "region_id", level.alias("level"))
    best = owned.unionByName(live.join(regions.select("region_id"), "region_id", "left_semi")).groupBy("agent", "region_id").agg(F.max("level").alias("level"))
    return best.where(F.col("level") >= order[least]).select("agent", "region_id", F.when(F.col("level") == 3, "manage").when(F.col("level") == 2, "write").otherwise("read").alias("permission"))


def condition(tree: dict) -> Column:
    """A condition of a rule as a column. Missing values never match."""
    if "all" in tree or "any" in tree:
        parts = [condition(t) for t in tree.get("all", tree.get("any"))]
        return reduce(lambda a, b: a & b if "all" in tree else a | b, parts)
    if "not" in tree:
        return ~condition(tree["not"])
    field, op, value = F.col(tree["field"]), tree["op"], tree["value"]
    if op == "matches":
        found = field.rlike(value) & (F.octet_length(field) <= MOST_BYTES)
    else:
        found = {"eq": field == value, "gt": field > value, "lt": field < value, "contains": F.contains(F.lower(field.cast("string")), F.lower(F.lit(str(value))))}[op]
    return F.coalesce(found, F.lit(False))


def guardrail_eval(rows: DataFrame, rules: list[dict], trigger: str) -> DataFrame:
    """Each row's verdict: blocked_by, redact, classification, warnings and the rules that applied.

    Rules go by ascending priority; the first that blocks ends the list. The rules compile into one projection.
    """
    live = sorted((r for r in rules if r.get("enabled", True) and trigger in r["on"]), key=lambda r: (r["priority"], r["name"]))
    none = F.lit(None).cast("struct<name:string,action:string,level:int>")
    hits = [F.when(condition(r["if"]), F.struct(F.lit(r["name"]).alias("name"), F.lit(r["action"]).alias("action"), F.lit(r.get("level", 0)).cast("int").alias("level"))).otherwise(none) for r in live]
    matched = F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else F.array().cast("array<struct<name:string,action:string,level:int>>")
    out = rows.withColumn("matched", matched)
    first = F.array_position(F.transform("matched", lambda h: h["action"]), "block")
    out = out.withColumn("matched", F.when(first > 0, F.slice("matched", F.lit(1), first.cast("int"))).otherwise(F.col("matched")))

    def names(action: str) -> Column:
        return F.transform(F.filter("matched", lambda h: h["action"] == action), lambda h: h["name"])

    highest = F.array_max(F.transform(F.filter("matched", lambda h: h["action"] == "reclassify"), lambda h: h["level"]))
    return out.withColumns({
        "blocked_by": F.try_element_at(names("block"), F.lit(1)), "redact": F.size(names("redact")) > 0,
        "classification": F.greatest("classification", F.coalesce(highest, F.lit(0))), "warnings": F.array_join(names("warn"), ","), "applied": F.array_join(F.transform("matched", lambda h: h["name"]), ","),
    }).drop("matched")


def redacted(judged: DataFrame) -> DataFrame:
    """What is left of judged rows: blocked ones go, redacted ones lose their text."""
    return judged.where("blocked_by is null").withColumn("fact", F.when(F.col("redact"), "[redacted]").otherwise(F.col("fact")))


def identity_problem(identity: Column) -> Column:
    """Why an identity (JSON) is refused: not an object, an unknown top-level key, or a forbidden word in a key at any depth."""
    top = F.json_object_keys(identity)
    keys = F.regexp_extract_all(F.lower(identity), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    bad = F.exists(keys, lambda k: reduce(lambda a, b: a | b, [F.contains(k, F.lit(w)) for w in FORBIDDEN_IN_KEYS]))
    unknown = F.size(F.array_except(top, F.array(*map(F.lit, IDENTITY_KEYS)))) > 0
    return F.when(top.isNull(), "not an object").when(unknown, "unknown key").when(bad, "forbidden key")


def prefilter(rows: DataFrame, keep: Column, owner: str, ts: str, ident: str, scan_limit: int) -> tuple[DataFrame, DataFrame]:
    """Of each owner's newest scan_limit rows those that pass, or all of them where none does; and counts by owner."""
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc(ts), F.desc(ident)))
    scanned = rows.withColumn("scan_rank", rank).where(F.col("scan_rank") <= scan_limit).withColumn("fits", F.coalesce(keep, F.lit(False)))
    passing = F.count_if("fits").over(W.partitionBy(owner))
    kept = scanned.withColumn("passing", passing).where((F.col("passing") == 0) | F.col("fits")).drop("scan_rank", "passing", "fits")
    report = scanned.groupBy(owner).agg(F.count("*").alias("before"), F.count_if("fits").alias("after"))
    return kept, report.withColumns({"ratio": F.round(F.col("after") / F.col("before"), 6), "relaxed": F.col("after") == 0})


def load_rules(text: str) -> list[dict]:
    return json.loads(text)
