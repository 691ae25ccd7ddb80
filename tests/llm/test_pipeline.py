"""The stages of the pipeline, each on its own input, and all of them in a row."""

import json
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, score double, copy_ int, key string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: toxic documents, exact and near copies, a copy of a test item, shared lines, nulls, empty texts, columns with clashing names."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(600)}"
    body = lambda n: " ".join(word() for _ in range(n))
    item = body(30)
    rows = []
    for n in range(900):
        rows.append((n, body(80) + (" vile foul" if n % 6 == 0 else ""), f"s{n % 8}"))
    base = body(200)
    rows += [(1000 + n, base, f"s{n % 8}") for n in range(20)]
    rows += [(1100 + n, base.replace(base.split()[5 * n + 3], "edited", 1), f"s{n}") for n in range(6)]
    rows += [(1250, f"{body(40)} {item} {body(40)}", "s1")]
    rows += [(1300 + n, f"{body(60)}\nAll rights reserved to us.\n{body(60)}", f"s{n % 8}") for n in range(16)]
    rows += [(1400, None, "s1"), (1401, "", None), (None, body(50), "s2"), (1402, body(9000), "s3")]
    out = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, 1, "k") for i, t, s in rows], COLUMNS)
    docs.coalesce(2).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(n, 1, int(n % 6 == 0)) for n in range(900)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["toxicity", "line dedup", "near dedup", "decontamination"])
def test_stage(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = _stage(name)(spark, docs, folder)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept, ids = {r["doc_id"]: r for r in out.collect()}, {r["doc_id"] for r in docs.collect()}
    gone = ids - set(kept)
    if name == "toxicity":
        toxic = {n for n in range(900) if n % 6 == 0}
        assert gone <= toxic and len(gone) >= 0.9 * len(toxic)
    elif name == "line dedup":
        assert not gone and "rights" not in kept[1303]["text"] and kept[1000]["text"] == kept[1019]["text"] != "" and kept[1400]["text"] is None
    elif name == "near dedup":
        assert gone == set(range(1001, 1020)) | set(range(1100, 1106))
    else:
        assert gone == {1250}
    assert _stage(name)(spark, docs.where("false"), folder).count() == 0


def test_packing_stage_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    packed = _stage("packing")(spark, docs, folder)
    want = sum(-(-len((r["text"] or "").encode()) // 4) + 1 for r in docs.collect())
    assert packed.agg(F.sum("n_tokens")).first()[0] == want
    assert _stage("packing")(spark, docs.where("false"), folder).count() == 0
    out = corpus_pipeline.run(spark, folder)
    left = {r["doc_id"] for r in out.collect()}
    assert {1000, 1303, 1400, 1401, None} <= left and 1250 not in left and 1001 not in left and 6 not in left
    assert json.dumps(sorted(out.columns)) == json.dumps(sorted(packed.columns))
