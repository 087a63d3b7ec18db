"""Hard-negative mining with rotated one-bit codes and deterministic score intervals.

Components are scaled to whole numbers, floor(256 * x), and a score is an integer inner product. Every vector v is turned
by one fixed random rotation and coded by signs: one bit for each place and, beside them, the alignment of the vector with its
code, which is the best multiple of the code. What the code leaves over is coded in the same way, ``LEVELS`` times; of the
last remainder only the length is stored. The components of an anchor are cut into ``PLANES`` bit planes, so that its product
with a code is a sum of popcounts. Cauchy-Schwarz bounds what is left out: the remainder of v by its length times that of the
part of the anchor which is orthogonal to the last code, and the rounding of the anchor by its length times the alignments.
So every score lies in its interval, for certain; a row is scored in whole numbers only if its interval reaches the scores
that are still wanted. Results are those of a scan over all pairs.

An anchor's positives are its best other rows of the same label; the negatives of a positive are the best rows of other
labels whose score is 50 to 95 percent of the positive's. Higher scores come first, ties by the smaller id.

Scale: codes are written once. Anchors are a stated share of the rows; they go out in blocks of about ``BLOCK_BYTES``, one
after another, each against all rows. A task keeps the best few rows of each anchor of the block, whatever it reads, in tiles of
at most ``TILE_CELLS`` scores, and gives them out at its end; they are merged by anchor.

Defined cases: rows without id, label or vector, with an empty vector, with a component that is null or not finite, or
beyond ``MOST`` in size, where scores would leave 64 bits, take no part; vectors are compared with those of the same number
of components; rows that repeat an id are rows of their own, but an anchor is never compared with rows of its own id; a
positive of a score below zero has no negatives, as half of it exceeds 95 percent of it; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlab.llm.shared import parts_for, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in percent of its positive's.
LEAST_PERCENT, MOST_PERCENT = 50, 95
LEVELS, PLANES = 4, 6
BLOCK_BYTES = 16 << 20
TILE_CELLS = 1 << 21
MOST = float(1 << 18)
_NONE = np.iinfo(np.int64).min
_SEED = 20_240_229


@functools.lru_cache(maxsize=8)
def rotation(n: int) -> np.ndarray:
    """A fixed random rotation of n components."""
    return np.linalg.qr(np.random.default_rng(_SEED).standard_normal((n, n)))[0]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits (..., n) as 64-bit words (..., ceil(n / 64)); the last is filled up with zeros."""
    room = -bits.shape[-1] % 64
    full = np.concatenate((bits, np.zeros((*bits.shape[:-1], room), bool)), axis=-1)
    return np.ascontiguousarray(np.packbits(full, axis=-1)).view(np.uint64)


def encode(vectors: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels, words), alignments (rows, levels) and the length of the last remainder, of whole-number rows."""
    n = vectors.shape[1]
    left = vectors.astype(np.float64) @ rotation(n)
    codes, alignments = [], []
    for _ in range(levels):
        sign = left >= 0
        alignment = np.abs(left).sum(axis=1) / np.sqrt(n)
        left = left - np.where(sign, 1.0, -1.0) * (alignment / np.sqrt(n))[:, None]
        codes.append(_packed(sign))
        alignments.append(alignment)
    return np.stack(codes, axis=1), np.stack(alignments, axis=1), np.sqrt((left**2).sum(axis=1))


class Anchors:
    """Anchors of one number of components, ready for popcounts: bit planes of their rotated components."""

    def __init__(self, vectors: np.ndarray, planes: int = PLANES):
        self.vectors, self.n = vectors.astype(np.int64), vectors.shape[1]
        turned = vectors.astype(np.float64) @ rotation(self.n)
        self.low = turned.min(axis=1, keepdims=True)
        top = (1 << planes) - 1
        self.step = np.maximum((turned.max(axis=1, keepdims=True) - self.low) / top, 1e-12)
        cut = np.clip(np.rint((turned - self.low) / self.step), 0, top).astype(np.int64)
        self.error = np.sqrt(((turned - self.low - self.step * cut) ** 2).sum(axis=1, keepdims=True))
        self.total = cut.sum(axis=1, keepdims=True)
        self.square = (turned**2).sum(axis=1, keepdims=True)
        self.planes = np.stack([_packed((cut >> b & 1).astype(bool)) for b in range(planes)], axis=1)

    def intervals(self, which: np.ndarray, codes: np.ndarray, alignments: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The middle and half width of the interval that holds the score of each anchor in ``which`` with each coded row."""
        low, step, total, error, root = self.low[which], self.step[which], self.total[which], self.error[which], np.sqrt(self.n)
        middle, product = np.zeros((len(which), len(codes))), None
        for level in range(codes.shape[1]):
            ones = np.bitwise_count(codes[:, level]).sum(axis=1, dtype=np.int64)
            count = np.zeros(middle.shape, dtype=np.int32)
            for b in range(self.planes.shape[1]):
                for word in range(codes.shape[2]):
                    count += np.bitwise_count(codes[None, :, level, word] & self.planes[which, b, word][:, None]).astype(np.int32) << b
            product = low * (2 * ones - self.n) + step * (2 * count - total)
            middle += product * (alignments[:, level] / root)
        along = np.maximum(np.abs(product) / root - error, 0)
        across = np.sqrt(np.maximum(self.square[which] - along**2, 0))
        size = np.sqrt(self.square[which]) * (alignments.sum(axis=1) + rest)
        return middle, error * alignments.sum(axis=1) + across * rest + 1e-9 * size + 1e-6


class Best:
    """The best ``k`` (score, id) of each of many lists, by score, then smaller id."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((lists, k), _NONE), np.full((lists, k), np.iinfo(np.int64).max)

    @property
    def floor(self) -> np.ndarray:
        """Below this score nothing enters a list."""
        return self.scores[:, -1]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        enters = scores >= self.floor[lists]
        lists, scores, ids = lists[enters], scores[enters], ids[enters]
        if not len(lists):
            return
        touched = np.unique(lists)
        lists = np.concatenate((np.repeat(touched, self.k), lists))
        scores, ids = np.concatenate((self.scores[touched].ravel(), scores)), np.concatenate((self.ids[touched].ravel(), ids))
        order = np.lexsort((ids, -scores, lists))  # the lowest whole number stays itself under negation, so it is last
        order = order[np.argsort(scores[order] == _NONE, kind="stable")]
        order = order[np.argsort(lists[order], kind="stable")]
        place = np.arange(len(order)) - np.searchsorted(lists[order], lists[order])
        kept = order[place < self.k]
        self.scores[touched], self.ids[touched] = scores[kept].reshape(-1, self.k), ids[kept].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, place = np.nonzero(self.scores != _NONE)
        return lists, self.scores[lists, place], self.ids[lists, place]


_CODED = "row long, vec_id long, label long, n int, vector binary, code binary, alignment binary, rest double"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("vector")
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            vectors = flat[starts[at][:, None] + np.arange(n)].astype(np.int32)
            codes, alignments, rest = encode(vectors)
            taken = batch.take(pa.array(at))
            blob = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            columns = [*(taken.column(c) for c in ("row", "vec_id", "label")), pa.array(np.full(len(at), n), pa.int32()), blob(vectors), blob(codes), blob(alignments), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "label", "n", "vector", "code", "alignment", "rest"])


def coded(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """Whole-number vectors with their codes, as a written table: one row for each row that takes part."""
    x = F.col(f"`{vector_col}`")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) > MOST))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("int"))
    slim = vectors.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & (F.size(x) > 0) & ~bad)
    slim = slim.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), whole.alias("vector"))
    return stored(slim.mapInArrow(_encoded, _CODED), "codes")


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


class _Rows:
    """The coded rows of one batch and one number of components."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        self.vectors, self.alignments, self.rest = _matrix(batch.column("vector"), np.int32), _matrix(batch.column("alignment"), np.float64), batch.column("rest").to_numpy()
        self.codes = _matrix(batch.column("code"), np.uint64).reshape(len(self.ids), self.alignments.shape[1], -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("n").to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), batch if len(at) == len(sizes) else batch.take(pa.array(at))


class _Block:
    """A block of anchors of one number of components; ``windows`` (anchors, positives, 2) bounds their negatives' scores."""

    def __init__(self, table: pa.RecordBatch, windows: np.ndarray | None):
        self.keys, self.ids, self.labels = (table.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.anchors, self.windows = Anchors(_matrix(table.column("vector"), np.int32)), windows

    def scored(self, rows: _Rows, who: np.ndarray, of: np.ndarray, least: np.ndarray, most: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) of all pairs of ``who`` and ``of``, of unlike ids, whose interval reaches ``least`` to ``most``
        (of each anchor); ``least`` may rise while it runs."""
        wide = max(1, min(len(of), 2048))
        tall = max(1, TILE_CELLS // wide)
        for at in range(0, len(of), wide):
            some = of[at : at + wide]
            for down in range(0, len(who), tall):
                which = who[down : down + tall]
                middle, half = self.anchors.intervals(which, rows.codes[some], rows.alignments[some], rows.rest[some])
                near = middle + half >= least(which)[:, None]
                if most is not None:
                    near &= middle - half <= most[which][:, None]
                i, j = np.nonzero(near & (self.ids[which][:, None] != rows.ids[some]))
                i, j = which[i], some[j]
                for cut in range(0, len(i), 1 << 16):
                    a, r = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
                    yield a, r, np.einsum("ij,ij->i", self.anchors.vectors[a], rows.vectors[r].astype(np.int64))


def _positives(blocks: dict[int, _Block], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(len(b.ids), k) for n, b in blocks.value.items()}
        for batch in batches:
            for n, part in _by_size(batch):
                if n not in best:
                    continue
                block, rows, found = blocks.value[n], _Rows(part), best[n]
                for label in np.intersect1d(block.labels, rows.labels):
                    who, of = np.flatnonzero(block.labels == label), np.flatnonzero(rows.labels == label)
                    for a, r, score in block.scored(rows, who, of, lambda which, found=found: found.floor[which], None):
                        found.add(a, score, rows.ids[r])
        for n, found in best.items():
            lists, scores, ids = found.rows()
            yield pa.RecordBatch.from_arrays([pa.array(blocks.value[n].keys[lists]), pa.array(ids), pa.array(scores)], names=["row", "id", "score"])

    return run


def _negatives(blocks: dict[int, _Block], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(b.windows.shape[0] * b.windows.shape[1], k) for n, b in blocks.value.items()}
        for batch in batches:
            for n, part in _by_size(batch):
                if n not in best:
                    continue
                block, rows, found = blocks.value[n], _Rows(part), best[n]
                slots = block.windows.shape[1]
                most = block.windows[:, :, 1].max(axis=1)

                def least(which: np.ndarray, block=block, found=found) -> np.ndarray:
                    floor = found.floor.reshape(block.windows.shape[:2])[which]
                    return np.maximum(block.windows[which, :, 0], floor).min(axis=1)

                everyone = np.arange(len(block.ids))
                for a, r, score in block.scored(rows, everyone, np.arange(len(rows.ids)), least, most):
                    other = block.labels[a] != rows.labels[r]
                    for slot in range(slots):
                        low, high = block.windows[a, slot].T
                        fits = other & (score >= low) & (score <= high)
                        found.add(a[fits] * slots + slot, score[fits], rows.ids[r[fits]])
        for n, found in best.items():
            lists, scores, ids = found.rows()
            slots = blocks.value[n].windows.shape[1]
            columns = [pa.array(blocks.value[n].keys[lists // slots]), pa.array((lists % slots + 1).astype(np.int32)), pa.array(ids), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "place", "id", "score"])

    return run


def _blocks(anchors: DataFrame, windows: bool) -> dict[int, _Block]:
    """One block of anchors on the driver; its size is bounded by ``BLOCK_BYTES``."""
    out = {}
    table = anchors.toArrow()
    for n in sorted(set(table.column("n").to_pylist())):
        part = table.filter(pc.equal(table.column("n"), n)).combine_chunks().to_batches()[0]
        bounds = None
        if windows:
            bounds = np.tile(np.array([np.iinfo(np.int64).max, _NONE]), (part.num_rows, POSITIVES, 1))
            for k, scores in enumerate(part.column("scores").to_pylist()):
                for slot, score in enumerate(scores):
                    bounds[k, slot] = -(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100
        out[n] = _Block(part, bounds)
    return out


def _in_blocks(codes: DataFrame, anchors: DataFrame, n_blocks: int, windows: bool, task: Callable, schema: str, name: str) -> DataFrame:
    """What ``task`` gives for each block of anchors against all rows; each block's result is a written table of its own."""
    out = None
    for b in range(n_blocks):
        blocks = _blocks(anchors.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b), windows)
        if blocks:
            shared = codes.sparkSession.sparkContext.broadcast(blocks)
            found = stored(codes.mapInArrow(task(shared), schema), name)
            out = found if out is None else out.union(found)
    return codes.sparkSession.createDataFrame([], schema) if out is None else out


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor, positive and negative.
    ``is_anchor`` is a condition on ``vec_id``."""
    codes = coded(vectors, id_col, label_col, vector_col)
    anchors = codes.where(is_anchor).select("row", "vec_id", "label", "n", "vector")
    n_bytes = anchors.agg(F.coalesce(F.sum(4 * F.octet_length("vector") + 256), F.lit(0))).first()[0]
    n_blocks = parts_for(n_bytes, BLOCK_BYTES, 1)

    found = _in_blocks(codes, anchors, n_blocks, False, lambda shared: _positives(shared, positives), "row long, id long, score long", "positives")
    first = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    good = stored(found.withColumn("place", first).where(F.col("place") <= positives), "positives")
    listed = good.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("scores"))
    known = stored(anchors.join(listed, "row"), "anchors")
    found = _in_blocks(codes, known, n_blocks, True, lambda shared: _negatives(shared, negatives), "row long, place int, id long, score long", "negatives")
    first = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("score"), "id"))
    hard = found.withColumn("rank", first).where(F.col("rank") <= negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    paired = hard.join(good.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), ["row", "place"]).join(known.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return paired.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, b) AS INTEGER) AS rank,
       b AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
QUALIFY row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, b) <= 3
"""
