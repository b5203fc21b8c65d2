"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and token output.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All but
the last return the columns of documents, whatever others there are. ``run`` writes each stage to the shared
folder, reads it again, as a cluster job would, and removes the one before.

Documents with null or empty text, or without a letter, go in the first stage; repeated rows (one doc_id and
text) are one document after the second, and rows with null doc_id, which no id could stand for, stay. Of ties
in near-dedup the smallest doc_id is kept. Long texts are read whole, an empty table passes all stages. Columns
may have any name that doesn't begin with ``_sw_``; those make the stages raise or, where they can, pass.

No SQL says the whole (byte-pair encoding is not SQL); the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sleuthwork.llm import decontaminate, language_id, mixing, near_dedup, token_output
from sleuthwork.llm._common import discard, materialize, reachable


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter; the automata are trained on the labelled ones among ``docs``."""
    reachable(spark)
    return language_id.with_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    reachable(spark)
    return near_dedup.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold eight words in a row of a benchmark item, or windows of two items."""
    reachable(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or drops documents' words until the sources have their target shares."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold of each document."""
    reachable(spark)
    return token_output.token_output(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
