"""Chat exports to one table of messages, what failed and why, and documents cut into parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The roles that a message may have.
ROLES = ("user", "assistant", "system", "tool")

_MESSAGE = "struct<session:string,role:string,content:string,created_at:string>"


def import_ndjson(lines: DataFrame) -> DataFrame:
    """Raw messages of texts (column value): each an object, an array of objects, or an object with messages."""
    many = F.from_json("value", f"array<{_MESSAGE}>")
    one, wrapped = F.from_json("value", _MESSAGE), F.from_json("value", f"struct<messages:array<{_MESSAGE}>>")["messages"]
    found = F.when(F.startswith(F.ltrim("value"), F.lit("[")), many).otherwise(F.coalesce(wrapped, F.array(one)))
    kept = [c for c in lines.columns if c != "value"]
    return lines.select(*kept, F.posexplode(found).alias("position", "m")).select(*kept, "position", "m.*")


def import_conversation_tree(exports: DataFrame) -> DataFrame:
    """Raw messages of exports whose nodes lie in a mapping; the title is the session, empty messages go."""
    shape = "struct<title:string,mapping:map<string,struct<message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>>>>>"
    kept = [c for c in exports.columns if c != "value"]
    out = exports.withColumn("doc", F.from_json("value", shape))
    out = out.select(*kept, F.col("doc.title").alias("session"), F.explode(F.map_values("doc.mapping")).alias("node"))
    out = out.select(*kept, "session", F.col("node.message.author.role").alias("role"), F.array_join("node.message.content.parts", "\n").alias("content"), F.col("node.message.create_time").cast("long").cast("string").alias("created_at"))
    return out.where("role is not null and trim(content) <> ''")


def import_chunked_prompt(exports: DataFrame) -> DataFrame:
    """Raw messages of chunked prompts: text or joined parts; model is the assistant; thoughts go."""
    shape = "struct<chunkedPrompt:struct<chunks:array<struct<role:string,text:string,parts:array<struct<text:string>>,isThought:boolean>>>>"
    kept = [c for c in exports.columns if c != "value"]
    out = exports.select(*kept, F.posexplode(F.from_json("value", shape)["chunkedPrompt"]["chunks"]).alias("position", "c")).where(~F.coalesce("c.isThought", F.lit(False)))
    text = F.coalesce("c.text", F.array_join(F.transform("c.parts", lambda p: p["text"]), ""))
    return out.select(*kept, "position", F.when(F.col("c.role") == "model", "assistant").otherwise(F.col("c.role")).alias("role"), text.alias("content"))


def normalise(raw: DataFrame, default_session: str, now: Column) -> DataFrame:
    """Typed messages with a problem column, null for good rows. Times are RFC 3339 or Unix seconds; without one it is now."""
    seconds = F.expr("try_cast(created_at as bigint)")
    parsed = F.coalesce(F.when(seconds.isNotNull(), F.timestamp_seconds(seconds)), F.try_to_timestamp("created_at"))
    when = F.when(F.col("created_at").isNull(), now).otherwise(parsed.cast("timestamp_ntz"))
    problem = F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "no content").when(~F.coalesce(F.lower("role").isin(*ROLES), F.lit(False)), "bad role").when(when.isNull(), "bad time")
    return raw.withColumns({"problem": problem, "created_at": when, "session": F.coalesce("session", F.lit(default_session)), "role": F.lower("role")})


def import_report(typed: DataFrame, owner: str, errors: int = 20) -> DataFrame:
    """Of each owner's import: rows, good and bad ones, sessions that it touches, and the first errors."""
    bad = F.col("problem").isNotNull()
    rank = F.row_number().over(W.partitionBy(owner, bad).orderBy("line"))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bad & (F.col("rank") <= errors), F.struct("line", "problem")))), lambda x: F.concat_ws(":", x["line"], x["problem"])), ",")
    return typed.withColumn("rank", rank).groupBy(owner).agg(F.count("*").alias("total"), F.count_if(~bad).alias("imported"), F.count_if(bad).alias("failed"), F.count_distinct(F.when(~bad, F.col("session"))).alias("sessions"), first.alias("errors"))


def dedupe_import(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rank = 1").drop("rank")


def chunk_pages(docs: DataFrame, separator: str = "\f") -> DataFrame:
    """(doc_id, page, start, n_chars) of the non-empty parts between separators, which is taken literally."""
    pieces = F.split("text", "\\Q" + separator + "\\E")
    out = docs.select("doc_id", F.posexplode(pieces).alias("page", "part")).withColumn("n_chars", F.char_length("part"))
    before = F.sum(F.col("n_chars") + len(separator)).over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("start", F.coalesce(before, F.lit(0))).where("n_chars > 0").select("doc_id", "page", "start", "n_chars")


def purge(tables: dict[str, DataFrame], owners: DataFrame, by: str = "user_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the rows of some owners, users or sessions (`by`), and how many rows each loses."""
    gone, lost = owners.select(by).distinct(), None
    for name, table in tables.items():
        n = table.join(gone, by, "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("table"), "removed")
        lost = n if lost is None else lost.unionByName(n)
    return {name: t.join(gone, by, "left_anti") for name, t in tables.items()}, lost
