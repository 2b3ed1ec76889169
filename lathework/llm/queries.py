"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, fingerprints, html_extract, langid, neardup, oracles, packing, quality, ranked, repair_ids, secrets_scan, shards, whitening
from .common import table


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near").cast("long").alias("n_near"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets_scan.scan(docs)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_weak"
    )


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train_and_identify(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.sharded(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_ids.read_files(repair_ids.write_files(table(spark, sf_dir, "documents")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs.select("doc_id", "text"), model).drop("text")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_all(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_main_text": op1_main_text,
        "op2_language": op2_language,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_shards": op4_shards,
        "op5_decontamination": op5_decontamination,
        "op6_secrets": op6_secrets,
        "op7_packing": op7_packing,
        "op8_token_ids": op8_token_ids,
        "op9_fingerprints": op9_fingerprints,
        "op10_quality": op10_quality,
        "op11_nearest": op11_nearest,
        "op12_ranked_search": op12_ranked_search,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": oracles.OP3, "op5_decontamination": oracles.OP5, "op12_ranked_search": oracles.OP12}
