"""Conflicts, routes, proofs, upserts, chunks and embeddings at their edges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import models
from tidemark.operators import agents
from tidemark.sources import exports


def test_conflict_edges(spark):
    proposals = spark.createDataFrame([(1, "a", "Prefer short answers", "style"), (2, "b", None, None), (3, "c", "avoid jargon", "tone")], "proposal_id long, agent_id string, proposal string, candidate_core string")
    events = spark.createDataFrame([(1, "a", "short please"), (2, "a", "do not be SHORT"), (3, "a", "unrelated"), (4, "b", "short"), (5, "c", "jargon jargon"), (6, "c", None), (7, "z", "short")], "event_id long, agent_id string, signal string")
    got = {r[0]: tuple(r)[1:] for r in agents.conflict_analysis(proposals, events).collect()}
    assert got == {1: (1, 1, 0.5, "review_conflicts"), 2: (0, 0, 0.0, "proceed"), 3: (0, 1, 1.0, "reject")}


def test_routes(spark):
    texts = [("hello",), (None,), ("latest recap of all the values",), ("Do you recall? a chat about it",), ("how does x relate",)]
    got = [tuple(r.r) for r in spark.createDataFrame(texts, "text string").select(agents.route(F.col("text")).alias("r")).collect()]
    assert got == [("hybrid", 0.6), ("hybrid", 0.6), ("head", 0.0), ("historical", 0.0), ("hybrid", 0.6)]


def test_proof(spark):
    sha = lambda b: hashlib.sha256(b).digest()
    x, y, z = (sha(b"leaf:" + k) for k in (b"x", b"y", b"z"))
    low, high = sha(b"node:" + x + y), sha(b"node:" + z + z)
    root = sha(b"node:" + low + high).hex()
    path = [(x.hex(), True), (high.hex(), False)]
    df = spark.createDataFrame([("y", path, root), ("z", path, root), ("x", None, x.hex()), (None, path, root)], "key string, siblings array<struct<hash:string,left:boolean>>, root string")
    assert [r.ok for r in df.select(agents.allowlist_proof_ok(F.col("key"), F.col("siblings"), F.col("root")).alias("ok")).collect()] == [True, False, True, False]


def test_upsert_is_idempotent(spark, tmp_path):
    target = spark.createDataFrame([(1, "a", 0), (None, "n", 0), (2, "b", 0)], "id long, v string, seq int")
    batch = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (None, "m", 1), (3, "e", 1)], "id long, v string, seq int")
    once = exports.upsert_files(target, batch, ["id"], "seq", str(tmp_path), 1)
    twice = exports.upsert_files(once, batch, ["id"], "seq", str(tmp_path), 2)
    want = {(1, "d"), (None, "m"), (2, "b"), (3, "e")}
    assert {(r.id, r.v) for r in once.collect()} == want == {(r.id, r.v) for r in twice.collect()}


def test_chunks_cover_the_text(spark):
    text = "One two. " * 300 + "x" * 4000 + "é\n" * 50
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n "), (5, "short")], "doc_id long, text string")
    rows = models.chunk_fixed(docs, 1000, 100).collect()
    mine = sorted((r.char_offset, r.text) for r in rows if r.doc_id == 1)
    covered = set()
    for at, piece in mine:
        assert piece in text and len(piece) <= 1000
        covered |= set(range(at, at + 1000))
    assert covered >= set(range(len(text))) and [r.text for r in rows if r.doc_id == 5] == ["short"]
    assert {r.doc_id for r in rows} == {1, 5}
    with pytest.raises(ValueError):
        models.chunk_fixed(docs, 100, 80)


def test_embeddings(spark):
    df = spark.createDataFrame([("Red fox",), ("fox RED",), (None,), ("",)], "t string")
    a, b, c, d = (r.vector for r in models.embed(df, "t", models.hashing_embedder).collect())
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and not any(c) and not any(d)


def test_upserts_leave_other_folders_alone(spark, tmp_path):
    """Two upserts in a row: what they don't touch keeps its files, byte by byte and name by name; a repeated batch changes no row."""
    folder = str(tmp_path / "table")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    table = lambda: {r["id"]: r["v"] for r in exports.read_buckets(spark, folder).collect()}
    exports.create_buckets(spark.createDataFrame([(i, "old") for i in range(300)] + [(None, "old")], "id long, v string"), ["id"], folder, 16)
    before, want = files(), {i: "old" for i in range(300)} | {None: "old"}
    for rows in ([(7, "x", 1), (7, "y", 2), (1000, "new", 1)], [(None, "z", 1), (8, "w", 5)]):
        batch = spark.createDataFrame(rows, "id long, v string, seq int")
        touched = exports.upsert_buckets(batch, ["id"], "seq", folder, 16)
        want |= {i: v for i, v, _ in rows}
        after = files()
        assert table() == want and 0 < len(touched) <= 2
        kept = {p for p in before if int(p.parent.name.split("=")[1]) not in touched}
        assert kept and all(after[p] == before[p] for p in kept) and not any(p in after for p in before if p not in kept)
        exports.upsert_buckets(batch, ["id"], "seq", folder, 16)
        assert table() == want
        before = files()
    assert exports.upsert_buckets(batch.where("false"), ["id"], "seq", folder, 16) == [] and files() == before


def test_signals_by_grams(spark):
    from tidemark.operators import agents

    proposals = [(1, 10, "We should deploy the service", "stable core"), (1, 11, "Don't rollback", None), (2, 20, None, None), (1, 12, "𝕏 éé ab", "")]
    events = [(1, 1, "deployment failed"), (1, 2, "never deploy this"), (1, 3, "the core service"), (1, 4, "no"), (1, 5, None), (2, 6, "deploy"), (1, 7, "𝕏"), (1, 8, "éé"), (1, 9, "rollback rollback")]
    found = agents.conflict_signals(spark.createDataFrame(proposals, "agent_id long, proposal_id long, proposal string, candidate_core string"), spark.createDataFrame(events, "agent_id long, event_id long, signal string")).collect()
    want = set()
    for agent, p, text, core in proposals:
        about = f"{text or ''} {core or ''}".lower()
        for other, e, signal in events:
            if agent == other and any(len(w.encode()) > 3 and w in about for w in (signal or "").lower().split()):
                want.add((p, e))
    assert {(r["proposal_id"], r["event_id"]) for r in found} == want and len(found) == len(want) and {(12, 7), (12, 8)} <= want


def test_pieces_go_back_in_small_batches(spark, monkeypatch):
    """A batch's texts and pieces aren't held together: of many texts each batch given back has few characters, and no text is read before its turn."""
    import pyarrow as pa

    from tidemark.functions import extraction

    monkeypatch.setattr(models, "GIVEN", 500)
    docs = spark.createDataFrame([(n, f"Some words here. {n} " * 40 if n % 5 else None) for n in range(60)], "doc_id long, text string")
    given = {}
    for name, chunk in (("fixed", models.chunk_fixed), ("structural", extraction.chunk_structural)):
        frame = type("Frame", (), {"dtypes": docs.dtypes, "select": lambda self, *c: self, "mapInArrow": lambda self, run, schema: run})()
        batches = list(chunk(frame, 200, **({"overlap": 20} if name == "fixed" else {}))(iter([pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()])])))
        assert len(batches) > 10 and max(sum(map(len, b.column("text").to_pylist())) for b in batches) < 500 + 1000
        given[name] = sorted(map(tuple, (r.values() for b in batches for r in b.to_pylist())))
        found = chunk(docs, 200, **({"overlap": 20} if name == "fixed" else {}))
        assert sorted(map(tuple, found.collect())) == given[name] and len({r[0] for r in given[name]}) == 48
