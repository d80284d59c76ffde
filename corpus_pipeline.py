"""The corpus pipeline: what of ``documents`` goes into training, and how it is packed.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns the columns of documents; the last returns where each piece of text is packed. Stages
keep null ids, repeated rows, and columns that they don't know; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import fresh, read
from skyloom.llm.decontaminate import decontaminate
from skyloom.llm.language_id import held_out, keep_accepted, train
from skyloom.llm.line_dedup import dedup_lines
from skyloom.llm.near_dedup import WORD, drop_near_duplicates
from skyloom.llm.packing import pack_documents
from skyloom.storage import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those that their most likely language explains
    badly. Learns from the documents that aren't held out."""
    model = train(docs.filter(~held_out()))
    return keep_accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated runs of lines out; a document that loses all its words goes. ``n_chars`` is
    that of the text that is left."""
    removed = fresh(docs, "n_removed")
    cleaned = dedup_lines(docs, removed=removed)
    left = cleaned.filter((F.col(removed) == 0) | F.col("text").rlike(WORD))
    changed = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.withColumn("n_chars", F.coalesce(changed, "n_chars")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity of 0.8 or more."""
    return drop_near_duplicates(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents lies in the packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark),
    ("pack", pack),
]

#: The models' sums, the tilings and the packing aren't SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stored and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
