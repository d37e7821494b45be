"""Corpus preparation in five stages: language ID, line dedup, near-dedup, decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows it is given and returns all columns
of ``docs``; the last adds the tokens. Between stages the documents are written as Parquet in the
shared checkpoint folder, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonality.llm import bpe, decontaminate, language_id, line_dedup, simhash
from tonality.llm.common import written_once
from tonality.session import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language nothing can tell (``und``), go."""
    return language_id.keep_identified(docs, n=3, dims=1024)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more stay in the first of them only; no document goes."""
    return line_dedup.drop_lines(docs, min_docs=10, min_chars=1, keep_first=True)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (3-word shingles, 2 bits): the one with the smallest id."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of ``benchmark``, also with other numbers or names, go."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, benchmark, window=8, min_tokens=13, by_run=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns and ``n_tokens``, ``ids``, ``decoded_sha256`` (these replace columns of the same names)."""
    import public_tokenizers

    outputs = ("n_tokens", "ids", "decoded_sha256")
    done = bpe.encode_texts(docs.drop(*outputs), public_tokenizers.path("word_bpe_49k.json"), outputs)
    return done.select("row.*", *outputs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("bpe", tokenize),
]

ORACLE_SQL = None  # fingerprints, cosines, slots and merges have no SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_once(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
