"""Corpus pipeline over ``documents``: stages run in order, each on all rows its predecessor kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import bpe_lexicon, line_runs, repetition, simhash_trie, string_tiling
from riskflow.llm.common import documents, kept_rows
from riskflow.llm.queries import byte_bpe_path
from riskflow.session import scratch_path
from riskflow.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 3)."""
    return repetition.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines (operator 1); a text that loses all its lines goes.

    ``n_chars`` follows the text.
    """
    cut = line_runs.drop_repeated_runs(docs)
    left = cut.where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of SimHash fingerprints (operator 9).

    Rows that repeat that id stay with it; rows without an id stay.
    """
    found = simhash_trie.near_duplicates(docs, words=3, max_bits=2)
    return kept_rows(docs, found.where("doc_id <> component_id").select("doc_id"), "doc_id")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 7)."""
    return string_tiling.without_leaks(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left (operator 6)."""
    return bpe_lexicon.digests(bpe_lexicon.encode_documents(docs, byte_bpe_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encode", encode),
]

#: Byte-pair merging is not expressible in SQL; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = documents(spark, sf_dir, *COLUMNS)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
