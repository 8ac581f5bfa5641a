"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, dartminhash, editcount, exact, langid, licenses, media, packing, periods, simhash, structure, toxicity
from .common import table


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_features(media.write_matroska(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = editcount.build_index(table(spark, sf_dir, "documents"))
    edited = editcount.apply_edits(index.withColumn("edits", editcount.sample_edits(F.col("doc_id"), F.col("text"))))
    return edited.select("doc_id", "tokens_before", "n_tokens", "n_edits", "encoded_chars", F.size("starts").alias("n_leaves"), F.sha2("text", 256).alias("text_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), prompt_share=packing.PROMPT_SHARE, limits=packing.DOCUMENTS)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(table(spark, sf_dir, "documents"))


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair_digests(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    ops = (op1_chat_rotation, op2_matroska, op3_exact_dedup, op4_edit_counts, op5_packing, op6_bpe, op7_licenses, op8_toxicity, op9_dartminhash, op10_language, op11_simhash, op12_periods, op13_structure)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_rotation": chat.ORACLE, "op3_exact_dedup": exact.ORACLE, "op7_licenses": licenses.oracle(), "op13_structure": structure.oracle()}
