"""A corpus pipeline: toxicity, line deduplication, near-duplicate removal, decontamination, packing.

Each stage works on all rows that the one before has kept; every stage but the last returns the
columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._tables import written
from tidemark.llm.decontamination import drop_contaminated
from tidemark.llm.lines import drop_shared_lines
from tidemark.llm.near import drop_near_duplicates
from tidemark.llm.packing import pack_sequences
from tidemark.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The stages learn a model, hash, and pack greedily, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each result a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
