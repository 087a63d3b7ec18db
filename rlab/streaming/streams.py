"""Incremental flows: results that arrive more than once, encoding of new blobs, windowed scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rlab.functions.vectors import encode
from rlab.sources.io import VectorStore, append_new


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_event_time(stream: DataFrame, when: str) -> DataFrame:
    """Times without a zone as UTC timestamps, which watermarks need."""
    return stream.withColumn(when, F.col(when).cast("timestamp"))


def first_of_each(stream: DataFrame, key: list[str], when: str, late: str) -> DataFrame:
    """One row for each key; state is dropped with the watermark."""
    return with_event_time(stream, when).withWatermark(when, late).dropDuplicatesWithinWatermark(key)


def least_of_each(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the one of least ``order``, and of all columns where that ties."""
    rest = [c for c in batch.columns if c not in order]
    least = F.min(F.struct(*order, *rest)).alias("_row")
    return batch.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(least).select(*[F.col(f"_row.{c}").alias(c) for c in batch.columns])


def stream_results(stream: DataFrame, key: list[str], when: str, out: str, checkpoint: str, order: list[str] | None = None) -> StreamingQuery:
    """Appends one row for each key: of the first batch that has the key, the row of least time, then least ``order``, then of
    all columns. A key that an earlier batch or run stored is skipped, so restarts do not repeat rows; the store itself is the
    state, and none is held in memory."""

    def add(batch: DataFrame, _: int) -> None:
        append_new(least_of_each(batch, key, [when, *(order or [])]), out, key)

    return with_event_time(stream, when).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_encode(stream: DataFrame, encoder, store: VectorStore, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Encodes blobs that the store lacks and appends their vectors."""

    def add(batch: DataFrame, _: int) -> None:
        new = store.missing(batch.dropDuplicates(["blob_sha"]))
        store.write(encode(new.select("blob_sha", "project", text), text, encoder, keep_text=False))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_scores(rows: DataFrame, when: str, value: str, by: list[str], width: str = "1 day") -> DataFrame:
    """Mean and count of a value by tumbling window and key, for batch and stream alike."""
    out = rows.groupBy(F.window(F.col(when), width).alias("_w"), *by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(F.col("_w.start").alias("window_start"), *by, "mean", "n")


def stream_scores(stream: DataFrame, when: str, value: str, by: list[str], late: str = "1 day", width: str = "1 day") -> DataFrame:
    """``window_scores`` of a stream; rows that come after the watermark are dropped."""
    return window_scores(with_event_time(stream, when).withWatermark(when, late), when, value, by, width)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs an append-mode stream over what is there now into Parquet and gives the rows."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
