"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import alignment, chat, clusters, decontamination, language, media, mixing, near, packing, passages, privacy, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(_read(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_read(spark, sf_dir, "documents")).withColumnRenamed("digest", "media_sha256")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, toxicity.label_columns())
    return toxicity.score(docs.select("doc_id", "text"), model).drop("text")


def op2_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(_read(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(_read(spark, sf_dir, "conversations"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_read(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_read(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(_read(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_privacy": op2_privacy,
    "op3_chat": op3_chat,
    "op4_near": op4_near,
    "op5_media": op5_media,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_language": op9_language,
    "op10_passages": op10_passages,
    "op11_clusters": op11_clusters,
    "op12_alignment": op12_alignment,
    "op13_packing": op13_packing,
}
ORACLE = {"op3_chat": chat.ORACLE, "op7_mixing": mixing.ORACLE, "op11_clusters": clusters.ORACLE}
