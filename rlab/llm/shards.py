"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; all sources are then interleaved by fractional rank
(rank - 1/2) / rows of the source; the interleaved order is cut into shards of equal row counts (at most one apart),
so that every shard holds each source in the mixture's proportion.

No window spans a source or the corpus: a rank is the number of rows in the earlier hash buckets of the source (a small
table of counts) plus a rank inside one bucket, and so is the position in the interleaved order. A source with a third
of all rows is therefore spread over many tasks.

Defined cases: a null text has size 1 (0 bytes plus 1) and CRC-32 0; a null source is a source of its own; repeated
rows keep a place each, and equal rows are interchangeable; an empty table gives no rows; only the named columns are
read, so extra columns do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlab.llm.shared import stored

SHARDS = 8
SEED = 17
#: Rows aimed at in one bucket, and so in one window partition.
BUCKET_ROWS = 10_000
#: Buckets whose counts are summed up before they are ordered.
SPAN = 1000


def _offsets(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Rows in all earlier buckets. ``counts`` has one row for each bucket; buckets are summed up in spans of ``SPAN``, so no
    window holds all of them."""
    spans = counts.withColumn("_span", F.expr(f"{bucket} div {SPAN}"))
    earlier = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy(*by, "_span").agg(F.sum("n").alias("_sum"))
    ahead = sums.select(*by, "_span", F.coalesce(F.sum("_sum").over(earlier(by, "_span")), F.lit(0)).alias("_ahead_span"))
    inside = spans.withColumn("_inside", F.coalesce(F.sum("n").over(earlier([*by, "_span"], bucket)), F.lit(0)))
    return inside.join(ahead, [*by, "_span"]).select(*by, bucket, (F.col("_ahead_span") + F.col("_inside")).alias("before"))


def interleave(rows: DataFrame, source: Column, order: Column, total: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with their 0-based position ``pos`` in the interleaved order. ``order``: a seeded 64-bit hash, by which
    a source is shuffled. Rows that tie in everything are interchangeable."""
    columns = rows.columns
    buckets = max(1, -(-total // bucket_rows))
    tie = [F.col(c) for c in columns]
    keyed = rows.select(*columns, F.coalesce(source.cast("string"), F.lit("\x00null")).alias("_src"), order.alias("_h"))
    keyed = keyed.withColumn("_b", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * buckets).cast("long"))
    counts = keyed.groupBy("_src", "_b").agg(F.count(F.lit(1)).alias("n"))
    offsets = _offsets(counts, ["_src"], "_b").withColumnRenamed("before", "_before")
    totals = counts.groupBy("_src").agg(F.sum("n").alias("_n"))
    within = F.row_number().over(Window.partitionBy("_src", "_b").orderBy("_h", *tie))
    ranked = keyed.withColumn("_in", within).join(offsets, ["_src", "_b"]).join(totals, "_src")
    ranked = ranked.withColumn("_frac", (F.col("_before") + F.col("_in") - 0.5) / F.col("_n"))
    ranked = ranked.withColumn("_c", F.least(F.floor(F.col("_frac") * buckets), F.lit(buckets - 1)).cast("long"))
    ranked = stored(ranked.drop("_b", "_before", "_in", "_n"), "ranked")
    ahead = _offsets(ranked.groupBy("_c").agg(F.count(F.lit(1)).alias("n")), [], "_c").withColumnRenamed("before", "_ahead")
    place = F.row_number().over(Window.partitionBy("_c").orderBy("_frac", "_h", "_src", *tie))
    placed = ranked.withColumn("_place", place).join(ahead, "_c")
    return placed.select(*columns, (F.col("_ahead") + F.col("_place") - 1).alias("pos"))


def cut(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """Adds shard and slot: contiguous cuts of the positions, sizes at most one apart, slots gapless from 0."""
    pos = F.col("pos")
    shard = F.expr(f"(pos * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (pos - first).cast("long")).drop("pos")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row of ``docs``."""
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    total = docs.count()
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32"))
    return cut(interleave(slim, F.col("source"), order, total), total, shards)


def digest(sharded: DataFrame) -> DataFrame:
    """The contract's columns: the law is `rows`."""
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
