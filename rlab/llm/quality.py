"""Quality rules by a hashed n-gram log-likelihood ratio between trusted documents and the raw corpus.

Words are the runs of anything but ASCII white space; features are the words and the pairs of neighbouring words of a
document, hashed into ``BUCKETS`` bins. Multinomials are counted over all documents and over trusted ones (labelled of
good quality). A document scores the mean of log p_trusted - log p_raw over its features, so length does not matter.

No document is judged by itself: trusted documents fall into ``FOLDS`` folds by a hash of their id, and a document of a
fold is scored with the trusted counts of the other folds. So trusted documents score as unseen ones of their kind do, and
the threshold, the mean of their scores less ``SPREAD`` standard deviations, holds for documents without a label too.

Words and pairs have a multinomial each. The ratio of a bin is log((t + c) / (e + c)): t is its trusted count, e the count
that it would have among as many trusted features if they were like the raw corpus, c a number of features, ``PRIOR``, that
is asked for as evidence. So what is seldom in trusted and raw texts alike says nothing in a small corpus, where few pairs
occur twice, and what is frequent in the raw corpus and missing from trusted texts says the same at every size. A document
at or above the threshold is kept, unless the base rules already failed it.

Counts cover every document, those of trusted ones and the threshold every trusted document: documents are joined to the
distinct ids of good labels. All count vectors have a fixed length.

Defined cases: a null or empty text has no words and fails the base rules; without a trusted document in every fold's
complement there is no ratio, the score is 0 and the base rules decide alone; labels that repeat an id count once, null
labels and null ids not at all; repeated rows are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rlab.llm.scan import NOT_SPACE, U64, flat, mix, ngrams, owners, pieces, prefix_hash, span_hash, words
from rlab.llm.shared import lookup, stored

BUCKETS = 1 << 16
FOLDS = 2
#: Features of evidence that the ratio of a word and of a pair is shrunk by. Pairs are seldom, and ask for more.
PRIOR = (1.0, 16.0)
SPREAD = 4.0
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring bounds."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _same_as_earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of keys that occurred before, and of keys that occur more than once."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    later, repeated = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:]] = equal
    repeated[order[1:]] = equal
    repeated[order[:-1]] |= equal
    return later, repeated


class Scan:
    """What one piece of texts holds: base counts of each text, and the feature bins of all."""

    def __init__(self, texts: pa.Array, buckets: int):
        raw, offsets = flat(texts)
        starts, ends, before = words(raw, offsets, NOT_SPACE)
        sums = prefix_hash(raw)
        hashes = span_hash(sums, starts, ends)
        self.n_words = np.diff(before)
        doc_of = owners(self.n_words)
        salt = mix(doc_of.astype(U64) + U64(1))
        self.word_chars = _per_doc(NOT_SPACE[raw] & ((raw & 0xC0) != 0x80), offsets)
        self.n_symbols = _per_doc(_SYMBOL[raw], offsets)

        line_ends = np.flatnonzero(raw == 10)
        line_starts = np.concatenate(([0], line_ends[:-1] + 1)) if len(line_ends) else line_ends
        full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[full], line_ends[full]
        lines_before = np.searchsorted(line_starts, offsets)
        line_keys = span_hash(sums, line_starts, line_ends) ^ mix(owners(np.diff(lines_before)).astype(U64) + U64(1))
        self.n_dup_lines = _per_doc(_same_as_earlier(line_keys)[0], lines_before)

        n = REPEAT_WINDOW
        windows = ngrams(hashes, n)
        inside = np.flatnonzero(doc_of[: len(windows)] == doc_of[n - 1 :]) if len(windows) else np.zeros(0, np.int64)
        found = inside[_same_as_earlier(windows[inside] ^ salt[inside])[1]]
        edges = np.zeros(len(starts) + 1, dtype=np.int32)
        edges[found] += 1
        np.subtract.at(edges, found + n, 1)
        self.n_repeat_words = _per_doc(np.cumsum(edges[:-1]) > 0, before)

        pairs = ngrams(hashes, 2)
        same = doc_of[:-1] == doc_of[1:] if len(doc_of) else np.zeros(0, bool)
        shift = U64(64 - buckets.bit_length() + 1)
        self.singles, self.single_bounds = (hashes >> shift).astype(np.int64), before
        self.pairs = (pairs[same] >> shift).astype(np.int64) + buckets  # behind the bins of the words
        self.pair_bounds = np.concatenate(([0], np.cumsum(np.maximum(self.n_words - 1, 0))))

    def scores(self, ratio: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """The mean ratio of each text's features, in the row of its fold."""
        total = np.zeros(len(self.n_words))
        for bins, bounds in ((self.singles, self.single_bounds), (self.pairs, self.pair_bounds)):
            doc = owners(np.diff(bounds))  # a text's sum is taken in its own order, whatever stands beside it
            total += np.bincount(doc, weights=ratio[fold[doc], bins], minlength=len(total))
        return total / np.maximum(1, self.n_words + np.maximum(self.n_words - 1, 0))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids labelled of good quality, once each, as a written table."""
    return stored(labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id")).distinct(), "trusted-ids")


def fold_of(doc_id: Column) -> Column:
    """The fold of an id (a null id has the first)."""
    return F.coalesce(F.pmod(F.xxhash64(doc_id.cast("long"), F.lit(FOLDS)), F.lit(FOLDS)), F.lit(0)).cast("int")


def feature_counts(docs: DataFrame, ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, trusted): feature counts over all documents, and over the trusted ones (``ids``) of each fold (an array).
    Words have the buckets up to ``buckets``, pairs as many behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins_of_all = 2 * buckets
        raw, trusted = np.zeros(bins_of_all, dtype=np.int64), np.zeros((FOLDS, bins_of_all), dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                scan = Scan(piece.column("text"), buckets)
                fold = np.asarray(piece.column("fold").to_numpy(zero_copy_only=False))  # -1: not trusted
                for bins, counts in ((scan.singles, scan.n_words), (scan.pairs, np.maximum(scan.n_words - 1, 0))):
                    raw += np.bincount(bins, minlength=bins_of_all)
                    of = np.repeat(fold, counts)
                    for k in range(FOLDS):
                        trusted[k] += np.bincount(bins[of == k], minlength=bins_of_all)
        some = np.flatnonzero(raw)
        folds = pa.array(list(trusted[:, some].T), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), folds], names=["bucket", "raw", "trusted"])

    ids = lookup(ids)
    slim = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    fold = F.when(F.col("_id").isNotNull(), fold_of(F.col("_doc"))).otherwise(-1)
    flagged = slim.join(ids, F.col("_doc") == F.col("_id"), "left").select("text", fold.alias("fold"))
    sums = [F.sum(F.col("trusted")[k]) for k in range(FOLDS)]
    return flagged.mapInArrow(run, "bucket int, raw long, trusted array<long>").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.array(*sums).alias("trusted"))


def log_ratio(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray | None:
    """The ratio of every bin for the documents of each fold (an array of fixed size: fold, bin); None if a fold has no
    trusted documents outside it."""
    raw, trusted = np.zeros(2 * buckets), np.zeros((FOLDS, 2 * buckets))
    for row in counts.collect():
        raw[row.bucket], trusted[:, row.bucket] = row.raw, row.trusted
    others = trusted.sum(axis=0) - trusted
    if not others[:, :buckets].sum(axis=1).all():
        return None
    ratios = []
    for half, prior in zip((slice(0, buckets), slice(buckets, None)), PRIOR, strict=True):
        like_raw = others[:, half].sum(axis=1, keepdims=True) * raw[half] / max(1.0, raw[half].sum())
        ratios.append(np.log((others[:, half] + prior) / (like_raw + prior)))
    return np.concatenate(ratios, axis=1)


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def score_documents(docs: DataFrame, ratio: np.ndarray | None, buckets: int = BUCKETS) -> DataFrame:
    """Base counts and score of every document, with the ratio of its fold."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                scan = Scan(piece.column("text"), buckets)
                scores = np.zeros(piece.num_rows)
                if shared.value is not None:
                    scores = scan.scores(shared.value, np.asarray(piece.column("fold").to_numpy(zero_copy_only=False)))
                counts = (scan.n_words, scan.word_chars, scan.n_symbols, scan.n_dup_lines, scan.n_repeat_words)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(scores)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold_of(F.col("doc_id")).alias("fold")).mapInArrow(run, _SCHEMA)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, spread: float = SPREAD) -> DataFrame:
    """Base counts, score, base_failed, threshold and kept of every document."""
    ids = trusted_ids(labels)
    ratio = log_ratio(feature_counts(docs, ids, buckets), buckets)
    threshold = None
    scored = stored(score_documents(docs, ratio, buckets), "scored")
    if ratio is not None:
        trusted = scored.join(ids, scored["doc_id"] == ids["_id"], "left_semi")
        nano = F.round(1e9 * F.col("score")).cast("decimal(38,0)")  # whole numbers, so that no sum hangs on its order
        n, total, squares = trusted.where(F.col("n_words") > 0).agg(F.count(F.lit(1)), F.sum(nano), F.sum((nano * nano).cast("decimal(38,0)"))).first()
        if n:
            threshold = float(total) / n / 1e9 - spread * math.sqrt(max(0, int(n * squares - total * total))) / n / 1e9
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passed = F.lit(True) if threshold is None else F.col("score") >= F.lit(threshold)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passed).alias("kept"), "score", F.lit(threshold).cast("double").alias("threshold"),
    )
