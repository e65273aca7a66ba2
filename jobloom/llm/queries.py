"""The registered queries of this subpackage: each reads whole tables and returns its operator's whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from jobloom.llm import decontamination, fill_in_middle, licences, line_dedup, lm_scoring, mixing, pieces, quality, sharding, simhash, suffix_dedup, toxicity, vector_codes
from jobloom.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("n_lines_removed").cast("long").alias("n_lines_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "shard")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.decoded(pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("d", "k")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.rearranged(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_pieces": op5_pieces,
    "op6_licences": op6_licences,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_mixing": op12_mixing,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {
    "op2_line_dedup": line_dedup.oracle,
    "op4_sharding": sharding.oracle,
    "op7_decontamination": decontamination.oracle,
    "op8_quality": quality.oracle,
    "op9_suffix_dedup": suffix_dedup.oracle,
    "op11_fill_in_middle": fill_in_middle.oracle,
    "op12_mixing": mixing.oracle,
    "op13_vector_codes": vector_codes.oracle,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql() for name, sql in ORACLES.items()}
