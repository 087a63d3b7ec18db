"""Vector arithmetic on array columns, in double precision, and a deterministic default encoder."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that an encoder is given at once.
ENCODED = 256


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    size = F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a))
    return F.transform(a, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column, guard: float = 0.0) -> Column:
    """Cosine; with a zero vector 0. ``guard`` is added to the product of the lengths."""
    size = norm(a) * norm(b) + guard
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def vec_mean(df: DataFrame, by: list[str], vec: str, name: str = "vec") -> DataFrame:
    """Mean vector of each group: one partial aggregate for each place, so no group is gathered."""
    places = df.select(*by, F.posexplode(F.col(vec)).alias("_at", "_x"))
    means = places.groupBy(*by, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_all"))
    return packed.select(*by, F.col("_all._x").alias(name))


class HashEncoder:
    """Encoder plug-in that needs no model: signed hashed term counts of white-space words, after a prefix."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = crc32(word.encode())
                row[(h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
        return out


def encode(df: DataFrame, text: str, encoder, name: str = "vec", normalise: bool = True, keep_text: bool = True) -> DataFrame:
    """``df`` with the vectors of a text column. The encoder is loaded once in each task and called with at most ``ENCODED`` texts
    at a time; all other columns pass by as they came. ``keep_text``: whether the texts go along."""
    columns = [c for c in df.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED):
                part = batch.slice(at, ENCODED)
                vectors = np.asarray(encoder(part.column(text).to_pylist()), dtype=np.float32).reshape(part.num_rows, -1)
                if normalise:
                    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
                    vectors = vectors / np.where(sizes == 0, 1, sizes)
                places = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * vectors.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(places, pa.array(vectors.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists], names=[*columns, name])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in columns)
    return df.mapInArrow(run, f"{kept}{name} array<float>")
