"""Queries of the text operators: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retentio.llm import (chat, cube, decontaminate, digest, fill_middle, licenses, line_chunks, ngram_join, personal, quality,
                          secret_scan, sharding, token_links)
from retentio.llm.tables import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("detections")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_edits(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix(read(spark, sf_dir, "documents")).drop("key", "copies")


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup(read(spark, sf_dir, "documents"))


def op6_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(chat.format_chats(rows))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("key")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transform(read(spark, sf_dir, "documents")))


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.align(read(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.find(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_fingerprint": op2_fingerprint,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_line_chunks": op5_line_chunks,
    "op6_format_chats": op6_format_chats,
    "op7_shard": op7_shard,
    "op8_ngram_join": op8_ngram_join,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality": op10_quality,
    "op11_fill_middle": op11_fill_middle,
    "op12_token_links": op12_token_links,
    "op13_personal_data": op13_personal_data,
}

ORACLES: dict[str, str] = {
    "op5_line_chunks": line_chunks.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
}
