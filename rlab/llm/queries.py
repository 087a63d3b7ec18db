"""The registered queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlab.llm import audit, chat, decontaminate, langid, mixing, neardup, negatives, ngramjoin, quality, shards, substring, tokencount, warc
from rlab.sources.io import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(shards.shard(_table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op6_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(chat.CONTROL_TURNS, turns.schema)
    return chat.digest(chat.format_turns(turns.unionByName(control)))


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op9_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold=85)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(_table(spark, sf_dir, "documents"), shingle=4, threshold=85)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_repeated_bytes,
        op2_stratified_shards,
        op3_token_counts,
        op4_language,
        op5_warc_index,
        op6_quality_ratio,
        op7_chat_format,
        op8_temperature_mix,
        op9_benchmark_hits,
        op10_near_duplicates,
        op11_ngram_join,
        op12_filter_audit,
        op13_hard_negatives,
    )
}

ORACLES: dict[str, str] = {
    "op1_repeated_bytes": substring.ORACLE,
    "op5_warc_index": warc.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op9_benchmark_hits": decontaminate.ORACLE,
    "op10_near_duplicates": neardup.ORACLE,
    "op11_ngram_join": ngramjoin.ORACLE,
    "op12_filter_audit": audit.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
