"""Typed loads of the memory tables: columns by name and type, defaults for those that older files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each table: type, and the default of missing columns and null values as SQL, or None. A missing classification is internal (1).
TABLES: dict[str, dict[str, tuple[str, str | None]]] = {
    "edges": {
        "edge_id": ("bigint", None), "user_id": ("bigint", None), "source": ("string", None), "target": ("string", None), "label": ("string", None), "fact": ("string", "''"),
        "valid_at": ("timestamp", None), "invalid_at": ("timestamp", None), "ingested_at": ("timestamp", None), "source_episode_id": ("bigint", None), "invalidated_by": ("bigint", None),
        "confidence": ("double", "1.0"), "corroboration_count": ("bigint", "1"), "classification": ("int", "1"), "source_agent_id": ("string", None), "access_count": ("bigint", "0"),
        "scope": ("string", "'mutable'"), "expires_at": ("timestamp", None), "metadata": ("string", "'{}'"),
    },
    "entities": {
        "user_id": ("bigint", None), "name": ("string", None), "type": ("string", "'concept'"), "summary": ("string", None), "aliases": ("array<string>", "array()"), "mention_count": ("bigint", "1"),
        "classification": ("int", "1"), "updated_at": ("timestamp", None), "metadata": ("string", "'{}'"),
    },
    "episodes": {
        "episode_id": ("bigint", None), "session_id": ("bigint", None), "user_id": ("bigint", None), "created_at": ("timestamp", None), "ingested_at": ("timestamp", None), "role": ("string", "'user'"),
        "content": ("string", "''"), "type": ("string", "'message'"), "status": ("string", "'pending'"), "retry_count": ("bigint", "0"), "metadata": ("string", "'{}'"),
    },
    "vectors": {"vec_id": ("bigint", None), "tenant": ("string", None), "vector": ("array<float>", None), "created_at": ("timestamp", None), "payload": ("map<string,string>", "map()")},
    "events": {
        "event_id": ("bigint", None), "user_id": ("bigint", None), "event_type": ("string", None), "ts": ("timestamp", None), "value": ("double", None), "props": ("string", "'{}'"),
        "attempts": ("bigint", "0"), "delivered": ("boolean", "false"), "dead_letter": ("boolean", "false"), "classification": ("int", "1"),
    },
    "spans": {
        "span_id": ("bigint", None), "user_id": ("bigint", None), "model": ("string", None), "operation": ("string", None), "tokens": ("bigint", "0"), "latency": ("double", None),
        "success": ("boolean", "true"), "started_at": ("timestamp", None),
    },
}


def typed(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of the table in their types; others are left out, so that the scan doesn't read them."""
    have = {c.lower() for c in df.columns}
    out = []
    for column, (kind, default) in TABLES[name].items():
        value = F.col(column).cast(kind) if column in have else F.lit(None).cast(kind)
        out.append((value if default is None else F.coalesce(value, F.expr(default).cast(kind))).alias(column))
    return df.select(*out)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of that name in the folder."""
    return typed(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"), name)
