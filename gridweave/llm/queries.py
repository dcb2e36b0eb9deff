"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.llm import bpe, decontaminate, html_extract, jaccard, language_id, line_dedup, media, secrets, sharding, warc
from gridweave.llm.common import read


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits_of_pages(spark, sf_dir)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read(spark, sf_dir, "documents"))


def op6_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(read(spark, sf_dir, "documents"))


def op8_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op10_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


EVERY = (
    op1_warc_revisits,
    op2_language_id,
    op3_template_decontamination,
    op4_html_main_text,
    op5_secret_scan,
    op6_bpe_merge_replay,
    op7_audio_features,
    op8_line_chunk_dedup,
    op9_jaccard_join,
    op10_karmarkar_karp_shards,
)
QUERIES = {f.__name__: f for f in EVERY}
ORACLES: dict[str, str] = {"op1_warc_revisits": warc.ORACLE, "op3_template_decontamination": decontaminate.ORACLE}
