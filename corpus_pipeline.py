"""A corpus pipeline: language, repeated lines, near copies, benchmark, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
and read again before the next.  All but the last return the columns of
`documents`.

Line dedup comes before the Jaccard join, so of a near copy it leaves the few
lines that differ; these would not be found near to anything any more.  Texts
that lose 80 percent of their words to it therefore go with what is left, unless
they hold the first occurrence of something (`line_dedup.drop_copies`).

Null texts and texts without a letter have no language and go in the first
stage; empty tables pass all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridweave.llm import bpe, decontaminate, jaccard, language_id, line_dedup
from gridweave.llm.common import read, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go."""
    return language_id.keep_identified(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks are cut from the texts; what is nearly all cut goes."""
    return line_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that shingles of five words connect at 0.8 or more, one stays."""
    return jaccard.keep_one(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids, of which the digests and counts are the result."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark),
    ("byte_bpe", tokens),
]

#: Language identification, rolling hashes and byte-pair merges have no form in
#: SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
