"""Operators that SQL can't check, against brute force, and edge cases."""

from pyspark.sql import functions as F

from tidemark.operators import audits, fusion, policies
from tidemark.sources import imports

DATA = "/root/testdata/sf0.001"


def test_mmr_takes_different_items(spark):
    ranked = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.99), (1, 3, 0.2), (2, 7, 0.0)], "query_id long, id long, score double")
    got = {(r["query_id"], r["pick"]): r["id"] for r in fusion.mmr(ranked, 3).collect()}
    assert got[1, 1] == 1 and got[2, 1] == 7 and sorted(got[1, i] for i in (1, 2, 3)) == [1, 2, 3]
    # After the first pick: 0.7 * 0.99 - 0.3 * 0.99 beats 0.7 * 0.2 - 0.3 * 0.2.
    assert got[1, 2] == 2


def test_labels_and_identities(spark):
    row = spark.range(1).select(
        policies.label_problem(F.lit(None).cast("string")).alias("a"), policies.label_problem(F.lit("é" * 65)).alias("b"), policies.label_problem(F.lit("works at")).alias("c"),
        policies.identity_problem(F.lit("{}")).alias("d"), policies.identity_problem(F.lit('{"style":{"e":{"My_Email":1}}}')).alias("e"), policies.identity_problem(F.lit("[]")).alias("f"),
    ).first()
    assert row["a"] == "empty" and row["b"] == "too long" and row["c"] is None and row["d"] is None and row["e"] == "forbidden key" and row["f"] == "not an object"


def test_rules_without_matches_and_none(spark):
    facts = spark.createDataFrame([(1, "f", None, 1)], "edge_id long, fact string, label string, classification int")
    rule = [{"name": "r", "priority": 1, "on": ["read"], "action": "block", "if": {"field": "label", "op": "eq", "value": "x"}}]
    for rules in (rule, []):
        row = policies.guardrail_eval(facts, rules, "read").first()
        assert row["blocked_by"] is None and row["applied"] == "" and row["classification"] == 1 and row["redact"] is False


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([("a", "k1", "1"), ("a", "k2", "2"), ("b", "k2", "2"), ("b", "k1", "1"), ("b", "z", "0")], "replica string, key string, value string")
    assert [r["prefix"] for r in audits.digest_diff(audits.state_digest(a), "a", "b").collect()] == ["z"]


def test_imports_of_bad_lines(spark):
    lines = spark.createDataFrame([(1, "not json"), (2, "[]"), (3, None), (4, '{"role":"USER","content":"hi","created_at":"x"}')], "line long, value string")
    typed = imports.normalise(imports.import_ndjson(lines), "s", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    assert {r["line"]: r["problem"] for r in typed.collect()} == {1: "no content", 3: "no content", 4: "bad time"}


def test_structural_chunks():
    from tidemark.functions import extraction as E

    body = "This line has enough words to be no heading at all, and it ends with a stop.\n"
    text = f"1. Start\n{body}{body}\fSECOND PART\n{body}\n\nLast Words Here\nshort"
    got = [(page, section, at, piece.splitlines()[0]) for piece, page, section, at in E.structural_pieces(text, 1500)]
    n = len(body)
    assert got == [(1, "1. Start", 0, "1. Start"), (2, "SECOND PART", 9 + 2 * n + 1, "SECOND PART"), (2, "Last Words Here", 9 + 2 * n + 1 + 12 + n, "Last Words Here")]
    assert [p[0].count("\n") for p in E.structural_pieces(body * 5, 150)] == [1, 1, 0] and list(E.structural_pieces("", 10)) == []
    assert [E.is_heading(x) for x in ("ab", "2.1 Scope", "ALL CAPS", "a plain line of words", "Title Case Line", "One")] == [False, True, True, False, True, False]


def test_dead_letters(spark):
    from tidemark.functions import extraction as E

    said = spark.createDataFrame([(1, "Ann met Bob and Carl"), (2, "123"), (3, None), (4, "nobody")], "episode_id long, content string")
    facts, dead = E.extract_facts(said, E.neighbours_extractor)
    assert {tuple(r) for r in facts.collect()} == {(1, "Ann", "mentions", "Bob"), (1, "Bob", "mentions", "Carl")}
    assert {(r["episode_id"], r["error"]) for r in dead.collect()} == {(2, "no words"), (3, "no words")}


def test_adapters_by_stream_and_by_table(spark):
    from tidemark.plans import stateful
    from tidemark.plans.registry import QUERIES

    table = {(r["user_id"], r["agent"]): (r["updates"], r["norm"]) for r in QUERIES["lor2_train_adapters"](spark, DATA).collect()}
    stream = {(r["user_id"], r["agent"]): (r["updates"], r["norm"]) for r in QUERIES["str10_stream_adapters"](spark, DATA).collect()}
    assert stateful and table == stream and any(n > 0 for n, _ in table.values())


def test_adapter_step_by_hand():
    import numpy as np
    import pandas as pd

    from tidemark.streaming import stateful as V

    rows = pd.DataFrame({"user_id": [1, 1], "agent": ["a", "a"], "event_id": [1, 2], "at": [1, 2], "query": [[1.0, 0.0]] * 2, "item": [[0.0, 1.0]] * 2, "rating": [0.0, -1.0]})
    (updates, a, b), out = V.adapter_step(None, rows)
    low = np.array(a).reshape(V.RANK, 2) @ [0, 1]
    assert updates == 1 and np.allclose(np.array(b).reshape(2, V.RANK), V.STEP * np.outer([-1, 1], low)) and out["updates"][0] == 1


def test_audit_file_and_empty_graph(spark, tmp_path):
    from tidemark.operators import graph

    log = audits.audit_export({"a": spark.sql("select 1 as id, timestamp_ntz'2024-01-02 00:00:00' as created_at"), "b": spark.sql("select 2 as id, timestamp_ntz'2024-01-01 00:00:00' as created_at")}, F.lit("2023-01-01").cast("timestamp_ntz"), F.lit("2025-01-01").cast("timestamp_ntz"))
    audits.audit_file(log, str(tmp_path / "log"))
    assert [r["id"] for r in spark.read.json(str(tmp_path / "log")).orderBy("created_at").collect()] == [2, 1]
    names = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert {tuple(r) for r in graph.connected_components(names).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert graph.label_propagation(names.where("false")).count() == 0 and graph.label_propagation(names, 3).count() == 5
    near = graph.bfs(spark.createDataFrame([("a",)], "node string"), names, 5, 2)
    assert {tuple(r) for r in near.collect()} == {("a", "a", 0), ("a", "b", 1)}
