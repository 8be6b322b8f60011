"""A corpus pipeline: documents through five filters, each stage written as Parquet and read again by the next.

Stages return the columns of documents, but for the last, which adds what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import stages
from kindred.llm._shared import read, stage, unstage

STAGES = [
    ("language_id", stages.keep_identified),
    ("line_dedup", stages.drop_recurring_lines),
    ("near_dedup", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_contaminated),
    ("mixing", stages.mix_sources),
]

#: The line templates, similarity links and dependent rounding go beyond one SQL statement; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        left = stage(step(spark, docs, sf_dir), name)
        unstage(docs)
        docs = left
    return docs
