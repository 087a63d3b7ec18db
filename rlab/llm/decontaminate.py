"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all training token windows.

Texts are lower-cased (A-Z only) and cut into words of digits, ASCII letters and anything above ASCII. A window is
``n`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Every window of a
document is looked up by its 64-bit hash; hits are verified word by word. Words inside hits can be removed as spans,
or the documents that have any can be dropped.

The broadcast set is bounded: up to ``BLOCK_WINDOWS`` windows of at most ``BLOCK_BYTES`` (both are counted first) go out with
their texts, in one pass. Beyond either, only 8-byte hashes go out, ``HASHES`` for each window of a block in one pass; a pass
gives the windows that it finds, and these are verified by a join with the benchmark's on the words themselves. Such hits are
merged by the text's digest and joined to the documents. The rows are the same either way.

Defined cases: a null or empty text has no words, no hits and is kept; null or wordless items never occur; repeated
items each count; equal windows of several items count for each of them; empty tables give no hits or no rows;
rows that repeat a doc_id are judged each on its own text; extra columns are kept by ``clean`` and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlab.llm.scan import ALNUM, flat, ngrams, owners, pieces, prefix_hash, span_hash, words
from rlab.llm.shared import stored

WINDOW = 10
#: Most windows that are broadcast with their texts, and most bytes of these (words may be long).
BLOCK_WINDOWS, BLOCK_BYTES = 100_000, 16 << 20
#: Hashes that one pass broadcasts for each window of a block: 16 MB at the default.
HASHES = 20

_SPANS = "array<struct<start:int,stop:int>>"
HITS = f"n_words long, n_hit long, item_ids array<long>, spans {_SPANS}"


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id") -> DataFrame:
    """(item_id, n_win, window): all windows of all items as normalised words joined by one blank."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)
    found = benchmark.select(F.col(id_col).cast("long").alias("item_id"), tokens.alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    windows = F.transform(starts, lambda at: F.array_join(F.slice("w", at, size), " "))
    return found.select("item_id", size.alias("n_win"), F.explode(windows).alias("window")).distinct()


class WindowSet:
    """Sorted window hashes of the benchmark, by number of words, with their texts and items."""

    def __init__(self, rows: list[tuple[int, int, str]]):
        self.by_size: dict[int, tuple[np.ndarray, list[str], list[list[int]]]] = {}
        grouped: dict[int, dict[str, list[int]]] = {}
        for item, size, text in rows:
            grouped.setdefault(size, {}).setdefault(text, []).append(item)
        for size, items in grouped.items():
            texts = list(items)
            raw, offsets = flat(pa.array(texts, pa.string()))
            starts, ends, _ = words(raw, offsets, ALNUM)
            hashes = ngrams(span_hash(prefix_hash(raw), starts, ends), size)[::size]
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = (hashes[order], [texts[k] for k in order], [items[texts[k]] for k in order])

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, int, int, list[int]]]]:
        """Words per text, and (text, first word, last word + 1, items) of every verified hit."""
        raw, offsets = flat(texts, lower=True)
        starts, ends, before = words(raw, offsets, ALNUM)
        counts = np.diff(before)
        hashes = span_hash(prefix_hash(raw), starts, ends)
        doc_of = owners(counts)
        hits = []
        for size, (known, strings, items) in self.by_size.items():
            grams = ngrams(hashes, size)
            if not len(grams):
                continue
            at = np.searchsorted(known, grams)
            at[at == len(known)] = 0
            same = (known[at] == grams) & (doc_of[: len(grams)] == doc_of[size - 1 :])
            for k in np.flatnonzero(same):
                text = b" ".join(raw[starts[j] : ends[j]].tobytes() for j in range(k, k + size)).decode()
                spot = int(at[k])
                while spot < len(known) and known[spot] == grams[k]:
                    if strings[spot] == text:
                        low = int(before[doc_of[k]])
                        hits.append((int(doc_of[k]), int(k) - low, int(k) - low + size, items[spot]))
                    spot += 1
        return counts, hits


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [{"start": a, "stop": b} for a, b in out]


_HIT_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.int64())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ]
)


def _summaries(found: WindowSet, texts: pa.Array) -> pa.StructArray:
    counts, hits = found.scan(texts)
    by_doc: dict[int, tuple[list, set]] = {}
    for doc, start, stop, items in hits:
        spans, ids = by_doc.setdefault(doc, ([], set()))
        spans.append((start, stop))
        ids.update(items)
    rows = []
    for doc, n in enumerate(counts.tolist()):
        spans, ids = by_doc.get(doc, ((), ()))
        merged = _merge(spans)
        rows.append({"n_words": n, "n_hit": sum(s["stop"] - s["start"] for s in merged), "item_ids": sorted(ids), "spans": merged})
    return pa.array(rows, _HIT_TYPE)


def _scan_block(docs: DataFrame, rows: list[tuple[int, int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = WindowSet(shared.value)
        for batch in batches:
            for piece in pieces(batch, "text"):
                hit = _summaries(found, piece.column("text"))
                kept = [piece.column(k) for k in range(piece.num_columns - 1)]
                names = piece.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*kept, *hit.flatten()], names=[*names, *_HIT_TYPE.names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1])
    return docs.mapInArrow(run, f"{kept}, {HITS}")


def _window_hashes(windows: DataFrame) -> DataFrame:
    """(n_win, hash) of all distinct windows, as texts are looked up by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "window"):
                raw, offsets = flat(piece.column("window"))
                starts, ends, before = words(raw, offsets, ALNUM)
                hashes, sizes = span_hash(prefix_hash(raw), starts, ends), piece.column("n_win").to_numpy()
                found = np.zeros(len(sizes), dtype=np.int64)
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    found[own] = ngrams(hashes, int(size))[before[own]].view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("n_win"), pa.array(found)], names=["n_win", "hash"])

    return windows.select("n_win", "window").mapInArrow(run, "n_win int, hash long").distinct()


def _candidates(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """(_sha, start, stop, window) of every run of words of a text (_sha, text) whose hash is among ``hashes``."""
    table = hashes.toArrow()
    sizes, known = table.column("n_win").to_numpy(), table.column("hash").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast({int(n): np.sort(known[sizes == n]) for n in np.unique(sizes)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                raw, offsets = flat(piece.column("text"), lower=True)
                starts, ends, before = words(raw, offsets, ALNUM)
                hashes, doc_of = span_hash(prefix_hash(raw), starts, ends), owners(np.diff(before))
                for size, wanted in shared.value.items():
                    grams = ngrams(hashes, size)
                    if not len(grams):
                        continue
                    at = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
                    hits = np.flatnonzero((wanted[at] == grams) & (doc_of[: len(grams)] == doc_of[size - 1 :]))
                    if len(hits):
                        low = hits - before[doc_of[hits]]
                        found = [b" ".join(raw[starts[j] : ends[j]].tobytes() for j in range(k, k + size)).decode() for k in hits]
                        columns = [piece.column("_sha").take(pa.array(doc_of[hits])), pa.array(low.astype(np.int32)), pa.array((low + size).astype(np.int32)), pa.array(found, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["_sha", "start", "stop", "window"])

    return texts.mapInArrow(run, "_sha binary, start int, stop int, window string")


def _hits_by_text(texts: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """(_sha, n_hit, item_ids, spans) of every text (_sha, text) that any window hits; one pass for each ``most`` hashes."""
    hashes = stored(_window_hashes(windows), "window-hashes")
    passes = max(1, -(-hashes.count() // most))
    dealt = hashes.withColumn("_b", F.pmod(F.xxhash64("hash"), F.lit(passes)))
    found = reduce(DataFrame.unionByName, [_candidates(texts, dealt.where(F.col("_b") == b).drop("_b")) for b in range(passes)])
    sure = found.join(windows, "window").select("_sha", F.array("item_id").alias("item_ids"), F.array(F.struct("start", "stop")).alias("spans"))
    # equal texts give equal hits, so sets of them are what one of them has
    merged = sure.groupBy("_sha").agg(F.flatten(F.collect_set("item_ids")).alias("item_ids"), F.flatten(F.collect_set("spans")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merge([(s["start"], s["stop"]) for s in found]) for found in batch.column("spans").to_pylist()]
            n_hit = pa.array([sum(s["stop"] - s["start"] for s in found) for found in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_sha"), n_hit, batch.column("item_ids"), pa.array(spans, _HIT_TYPE.field("spans").type)], names=["_sha", "n_hit", "item_ids", "spans"])

    listed = merged.select("_sha", F.array_sort(F.array_distinct("item_ids")).alias("item_ids"), "spans")
    return stored(listed.mapInArrow(merge, f"_sha binary, n_hit long, item_ids array<long>, spans {_SPANS}"), "hits")


def find_hits(docs: DataFrame, benchmark: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", n: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: ``id_cols``, n_words, n_hit, item_ids (sorted) and the merged spans of hit words."""
    slim = docs.select(*id_cols, F.col(text_col).alias("text"))
    windows = stored(benchmark_windows(benchmark, n), "windows")
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("n_bytes")).first()
    if size.n <= block and size.n_bytes <= BLOCK_BYTES:
        return _scan_block(slim, [tuple(r) for r in windows.collect()])
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    hits = _hits_by_text(slim.select(sha.alias("_sha"), "text"), windows, HASHES * block)
    counted = _scan_block(slim.select(*id_cols, sha.alias("_sha"), "text"), []).drop("n_hit", "item_ids", "spans")
    joined = counted.join(hits, "_sha", "left")
    none = [F.array().cast(kind) for kind in ("array<long>", _SPANS)]
    return joined.select(*id_cols, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none[0]).alias("item_ids"), F.coalesce("spans", none[1]).alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, n: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents whose share of hit words is at most ``max_share`` (0: no hit at all), with all their columns."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text").alias("_text"))
    hits = find_hits(packed, benchmark, ("_row",), "_text", n, block)
    return hits.where(F.col("n_hit") <= max_share * F.col("n_words")).select("_row.*")


def strip_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, text): the texts without the words of verified hits, and without what stands between those words."""
    found = find_hits(docs.select("doc_id", "text", F.col("text").alias("_text")), benchmark, ("doc_id", "_text"), "text", n, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cut in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if cut:
                    raw, offsets = flat(pa.array([text], pa.string()), lower=True)
                    starts, ends, _ = words(raw, offsets, ALNUM)
                    data, at, kept = text.encode(), 0, []
                    for s in cut:
                        kept.append(data[at : starts[s["start"]]])
                        at = int(ends[s["stop"] - 1])
                    text = b"".join([*kept, data[at:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "_text", "spans").mapInArrow(run, f"doc_id {kind}, text string")


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns from ``find_hits``."""
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), hits AS (
  SELECT d.doc_id, d.k, d.size, x.item_id
  FROM (SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS win
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM words, sizes WHERE len(w) >= size)) d
  JOIN windows x ON x.size = d.size AND x.win = d.win
), covered AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS spot FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
