"""The corpus pipeline: language, near-duplicates, benchmark contamination, mixture, shards.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from rlab.llm import decontaminate, langid, mixing, neardup, shards
from rlab.llm.shared import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without letters and those of uncertain language go."""
    return langid.keep_known(docs)


#: Words of a shingle, percent of shingles that near-duplicates share, and bins of a band of the near-duplicate stage.
SHINGLE, THRESHOLD, ROWS = 5, 80, 7


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id. Where rows repeat an id, one row of each
    group of linked texts."""
    return neardup.deduplicate(docs, shingle=SHINGLE, threshold=THRESHOLD, rows=ROWS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tempered mixture of sources, at a budget of as many tokens as came in; a row for each time taken."""
    return mixing.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return shards.digest(shards.shard(docs))


#: Bytes of one Arrow batch of whole rows: long documents would make batches of default row counts large.
BATCH_BYTES = 8 << 20


_BATCH_OPTION = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(stage):
    """The stage, with Arrow batches of bounded bytes. Spark reads the option when the result is written, so it stays set in
    the session; ``run`` puts it back at its end."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(_BATCH_OPTION, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", _small_batches(language)),
    ("near_duplicates", _small_batches(near_duplicates)),
    ("decontamination", _small_batches(decontamination)),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: A trained network and signatures are not SQL; the pipeline is tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(_BATCH_OPTION)
    try:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(_BATCH_OPTION, before)
    return STAGES[-1][1](spark, docs, sf_dir)
