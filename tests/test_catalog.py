"""Every query over the memory tables against its SQL in DuckDB, and formulas at fixed points."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import facts, graph
from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value:.5f}" if isinstance(value, float) else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{DATA}/{file}'")
    df = catalog.QUERIES[name](spark, DATA)
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_empty_facts(spark):
    empty = catalog.X.assertions(spark, DATA).where("false")
    assert facts.supersede(empty).count() == 0
    assert facts.belief_changes(empty).count() == 0


def test_changes_since_rejects_empty_window(spark):
    with pytest.raises(ValueError):
        facts.changes_since(catalog.X.facts(spark, DATA), "2024-01-02 00:00:00", "2024-01-02 00:00:00")


def test_formulas(spark):
    row = spark.range(1).select(
        scalars.effective_confidence(F.lit(0.5), F.lit(3), F.lit(30), 30.0, 0.0, F.lit(False)).alias("a"),
        scalars.tier_for_age(F.lit(7)).alias("b"), scalars.episode_backoff_ms(F.lit(2), 3).alias("c"), scalars.episode_backoff_ms(F.lit(3), 3).alias("d"),
        scalars.estimate_tokens(F.lit("éa")).alias("e"),
    ).first()
    assert row["a"] == pytest.approx(0.5 * 1.2 * 0.5) and row["b"] == "half" and row["c"] == 1000 and row["d"] is None and row["e"] == 1


def test_long_path_is_one_component(spark):
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = graph.connected_components(edges)
    assert found.select("component").distinct().collect()[0][0] == 0 and found.count() == 41
