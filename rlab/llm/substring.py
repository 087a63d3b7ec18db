"""Exact substring deduplication by bucket-pointer refinement, spread over Spark groups.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document of smaller id. Suffixes only
have to be ordered to that depth, and only where strings can be equal, so they are dealt out by q-gram buckets:

1. Every window of ``LENGTH`` bytes names one of its q-grams as its anchor: the one of least hash, the leftmost of
   these. Equal windows have equal anchors at equal places. Neighbouring windows of one anchor form a segment.
2. Anchors are the initial q-gram buckets. Each group of documents sends its distinct anchor hashes, packed, to the hash
   ranges that it has any for; the reply flags those that occur in two documents. Most text ends here.
3. Segments of repeated anchors are sent, distinct within a group, with the smallest id that holds them. In a range,
   equal segments are merged; a bucket of one distinct segment is final. All others are refined: bucket identifiers of
   8 bytes are sorted together with those 8 bytes later, which gives identifiers of 16 bytes, and these are reused for 32
   and for the full depth. In each pass only buckets that still hold two positions are sorted; settled ones keep their
   identifier. Windows in one final bucket are equal, and the smallest id of the bucket decides.
4. The reply says, for each segment, who holds it first and which of its windows a smaller id has as well.

A group sends at most one message for each anchor that it holds, so messages are linear in the bytes however many groups
and ranges there are; they are built and read as whole columns. Segments are equal where a polynomial hash modulo
2**61 - 1 of all their bytes and the hash of their anchor are.

Equal texts are found first by digest; of these only the smallest id takes part, so thousands of copies cost one. An
anchor that more than ``HOT_GROUPS`` groups hold is dealt out by whole windows instead of by anchor, so no bucket gathers
a common passage with all its surroundings. Groups are dealt by a hash of id and text, so rows without
an id are spread, and each scan reuses one shuffle of the texts.

Defined cases: a null or empty text has no bytes and nothing is removed from it; texts below ``LENGTH`` are left alone;
rows that repeat an id are judged each, and never against each other; a row without id counts as larger than all;
overlaps count, matches do not cross documents, and strings are judged on the input; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlab.llm.scan import U64, flat, mix, prefix_hash, rolling_hash, runs, span_hash
from rlab.llm.shared import parts_for, stored, text_bytes

LENGTH = 50
Q = 20
SPAN = LENGTH - Q + 1  # windows that can share an anchor
GROUP_BYTES, RANGE_BYTES = 2 << 20, 4 << 20
HOT_GROUPS = 4096
_BLOCK = 1 << 20
_LOW = U64((1 << 22) - 1)
NO_ID = (1 << 63) - 1


def _hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of short spans, ordered by start, a block of bytes at a time."""
    out = np.empty(len(starts), dtype=U64)
    for low in range(0, len(raw), _BLOCK):
        a, b = np.searchsorted(starts, (low, low + _BLOCK))
        if a == b:
            continue
        sums = prefix_hash(raw[low : int(ends[a:b].max())])
        out[a:b] = span_hash(sums, starts[a:b] - low, ends[a:b] - low)
    return out


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor hash (even) and document of every segment, in order."""
    n = len(raw) - LENGTH + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none.astype(U64), none
    long = np.flatnonzero(np.diff(offsets) > LENGTH)  # a line feed follows each text
    edges = np.zeros(len(raw) + 1, dtype=np.int8)
    edges[offsets[long]] += 1
    edges[offsets[long + 1] - LENGTH] -= 1
    valid = np.cumsum(edges[:n], dtype=np.int8) > 0
    firsts, anchors, hashes = [], [], []
    before = -1
    for low in range(0, n, _BLOCK):
        high = min(low + _BLOCK, n)
        part = raw[low : high + LENGTH - 1]
        grams = rolling_hash(part, Q)
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=U64)
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: width - SPAN], least[SPAN - width :])
        at = (least & _LOW).astype(np.int64)
        new = np.concatenate(([low == 0 or at[0] + low != before or not valid[low - 1]], (at[1:] != at[:-1]) | ~valid[low : high - 1]))
        first = np.flatnonzero(new & valid[low:high])
        firsts.append(first + low)
        hashes.append(mix(grams[at[first]] + U64(1)) & ~U64(1))  # least hashes are small ones: spread them over the ranges again
        anchors.append(at[first] + low)
        before = at[-1] + low
    first, hashed = np.concatenate(firsts), np.concatenate(hashes)
    _, stops = runs(valid)
    run_of = np.searchsorted(stops, first, side="right")
    last = np.minimum(np.concatenate((first[1:], [n])), stops[run_of]) - 1 if len(first) else first
    return first, last, hashed, np.searchsorted(offsets, first, side="right") - 1


def _cuts(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges, of n, that sorted hashes fall into, and where each begins (with the total at the end)."""
    ranges = (hashes >> U64(32)) * U64(n) >> U64(32)
    starts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(ranges) else np.zeros(0, np.int64)
    return ranges[starts].astype(np.int64), np.append(starts, len(hashes))


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Neighbouring slices of an array as binary values, without copies."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _values(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The binary values of a column, one after another."""
    parts = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and at[-1] > at[0]:
            parts.append(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]])
    return np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)


class Group:
    """The documents of one group that take part, by id, and their segments. Copies of smaller ids do not take part."""

    def __init__(self, docs: pa.Table, side: pa.Table):
        order = np.argsort(docs.column("id").to_numpy(), kind="stable")
        docs = docs.take(pa.array(order)).combine_chunks()
        texts = docs.column("text").combine_chunks()
        kinds = side.column("kind").to_numpy()
        copies = set(zip(side.column("slot").filter(kinds == 0).to_pylist(), side.column("data").filter(kinds == 0).to_pylist(), strict=True))
        self.ids, self.all_texts = docs.column("id").to_numpy(), texts
        if copies:
            some = {i for i, _ in copies}
            marks = [i in some and t.is_valid and (i, hashlib.sha256(t.as_buffer()).digest()) in copies for i, t in zip(self.ids.tolist(), texts.cast(pa.binary()), strict=True)]
            self.copy = np.array(marks, dtype=bool)
        else:
            self.copy = np.zeros(len(self.ids), dtype=bool)
        self.own = np.flatnonzero(~self.copy)
        self.raw, self.offsets = flat(texts.take(pa.array(self.own)))
        self.first, self.last, self.anchor, doc = segments(self.raw, self.offsets)
        self.id_of = self.ids[self.own][doc] if len(doc) else np.zeros(0, np.int64)

    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchor hashes, and whether two ids of this group have it."""
        order = np.argsort(self.anchor, kind="stable")
        hashes, ids = self.anchor[order], self.id_of[order]
        start = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        stop = np.concatenate((start[1:], [len(hashes)])) - 1 if len(start) else start
        return hashes[start], ids[start] != ids[stop]

    def keep_repeated(self, side: pa.Table) -> None:
        """Only the segments of anchors that the replies call repeated; those of hot ones as single windows."""
        known, _ = self.distinct_anchors()
        flags = _values(_rows(side, 1).column("data"), np.uint8)  # in the order of the ranges, so of the known anchors
        repeated, hot = flags > 0, flags > 1
        at = np.searchsorted(known, self.anchor)
        some, many = repeated[at] & ~hot[at], np.flatnonzero(repeated[at] & hot[at])
        first, last, anchor, ids = self.first[some], self.last[some], self.anchor[some], self.id_of[some]
        if len(many):
            counts = self.last[many] - self.first[many] + 1
            starts = np.repeat(self.first[many] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            first, last = np.concatenate((first, starts)), np.concatenate((last, starts))
            anchor = np.concatenate((anchor, _hash_spans(self.raw, starts, starts + LENGTH)))
            ids = np.concatenate((ids, np.repeat(self.id_of[many], counts)))
            order = np.argsort(first, kind="stable")
            first, last, anchor, ids = first[order], last[order], anchor[order], ids[order]
        self.first, self.last, self.anchor, self.id_of = first, last, anchor, ids
        content = _hash_spans(self.raw, first, last + LENGTH)
        order = np.lexsort((content, anchor))  # stable: of equal segments, the smallest id comes first
        a, c = anchor[order], content[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))) if len(order) else np.zeros(0, bool)
        self.head = order[new]
        self.record = np.empty(len(order), dtype=np.int64)
        self.record[order] = np.cumsum(new) - 1


def _rows(side: pa.Table, kind: int) -> pa.Table:
    """The messages of one kind, in the order of their ranges."""
    some = side.filter(pa.compute.equal(side.column("kind"), kind))
    return some.take(pa.array(np.argsort(some.column("slot").to_numpy(), kind="stable")))


def _cut(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after another."""
    ends = np.cumsum(sizes)
    return raw[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


_SIDE_SQL = "g int, kind int, slot long, n long, data binary, more binary"
_SEGMENTS_SQL = "g int, slot long, n long, anchors binary, ids binary, sizes binary, data binary"


def _side(g: pa.Array, kind: int, slot: pa.Array, n: pa.Array, data: pa.Array, more: pa.Array | None = None) -> pa.Table:
    names = ["g", "kind", "slot", "n", "data", "more"]
    return pa.Table.from_arrays([g, pa.array(np.full(len(g), kind, np.int32)), slot, n, data, pa.nulls(len(g), pa.binary()) if more is None else more], names=names)


def _none(types: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in types.split(", "))]).empty_table()


def _send_anchors(ranges: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _none(_SIDE_SQL)
        group, g = Group(docs, side), docs.column("g")[0].as_py()
        known, many = group.distinct_anchors()
        slots, bounds = _cuts(known, ranges)
        # an anchor is even: the last bit says that two documents of the group have it
        return _side(pa.array(np.full(len(slots), g, np.int32)), 1, pa.array(slots), pa.array(np.diff(bounds)), _binary(known | many.astype(U64), bounds))

    return run


def _find_repeated(hot_groups: int):
    def run(table: pa.Table) -> pa.Table:
        packed = _values(table.column("data"), U64)
        hashes, many = packed & ~U64(1), (packed & U64(1)).astype(bool)
        order = np.argsort(hashes, kind="stable")
        bucket = np.cumsum(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))) - 1
        size = np.bincount(bucket)
        some = np.bincount(bucket, weights=many[order]) > 0
        flags = np.empty(len(order), dtype=np.uint8)  # 0: in one document, 1: in several, 2: and in very many groups
        flags[order] = np.where(size > hot_groups, 2, (size > 1) | some)[bucket]
        bounds = np.concatenate(([0], np.cumsum(table.column("n").to_numpy())))
        g, slot, n = (table.column(c).combine_chunks() for c in ("g", "slot", "n"))
        return _side(g, 1, slot, n, _binary(flags, bounds))

    return run


def _send_segments(ranges: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _none(_SEGMENTS_SQL)
        group, g = Group(docs, side), docs.column("g")[0].as_py()
        if not len(group.first):
            return _none(_SEGMENTS_SQL)
        group.keep_repeated(side)
        head = group.head
        slots, bounds = _cuts(group.anchor[head], ranges)
        sizes = group.last[head] - group.first[head] + LENGTH
        text = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        return pa.Table.from_arrays(
            [
                pa.array(np.full(len(slots), g, np.int32)), pa.array(slots), pa.array(np.diff(bounds)), _binary(group.anchor[head], bounds), _binary(group.id_of[head], bounds),
                _binary(sizes.astype(np.uint8), bounds), _binary(_cut(group.raw, group.first[head], sizes), text),
            ],
            names=["g", "slot", "n", "anchors", "ids", "sizes", "data"],
        )

    return run


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Identifiers of pairs of identifiers below 2**32, by sorting them."""
    return np.unique(left.astype(U64) << U64(32) | right.astype(U64), return_inverse=True)[1]


def _refined(ids: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Sorts pairs of identifiers and gives ``ids`` at ``at`` new ones, above all that are there."""
    if len(at):
        ids[at] = int(ids.max()) + 1 + _pairs(left, right)


def refine(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Final bucket identifiers of the strings of ``LENGTH`` bytes at ``starts``: equal strings have equal identifiers.
    Identifiers of a depth are pairs of those of the depth before, at an offset and later; a position that is alone in
    its bucket is settled and keeps its identifier."""
    padded = np.concatenate((data, np.zeros(LENGTH, np.uint8)))
    codes = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view(U64).ravel()
    ids, depth = np.unique(codes, return_inverse=True)[1], 8
    while depth * 2 <= LENGTH:
        open_ = np.flatnonzero((np.bincount(ids) > 1)[ids])
        later = np.where(open_ + depth < len(ids), ids[np.minimum(open_ + depth, len(ids) - 1)], 0)
        _refined(ids, open_, ids[open_], later)
        depth *= 2
    final = ids[starts]
    open_ = np.flatnonzero((np.bincount(final) > 1)[final])
    _refined(final, open_, final[open_], ids[starts[open_] + LENGTH - depth])
    return np.unique(final, return_inverse=True)[1]


def _decide(table: pa.Table) -> pa.Table:
    """Of each segment, the smallest id that holds it (``data``) and a bit for each window that a smaller id has (``more``)."""
    counts = table.column("n").to_numpy()
    anchor, ids = _values(table.column("anchors"), U64), _values(table.column("ids"), np.int64)
    sizes, data = _values(table.column("sizes"), np.uint8).astype(np.int64), _values(table.column("data"), np.uint8)
    starts = np.cumsum(sizes) - sizes
    content = _hash_spans(data, starts, starts + sizes)
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    new_anchor = np.concatenate(([True], a[1:] != a[:-1]))
    new = new_anchor | np.concatenate(([True], c[1:] != c[:-1]))
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[order], heads)  # of each distinct segment
    of_anchor = (np.cumsum(new_anchor) - 1)[heads]
    open_ = np.bincount(of_anchor)[of_anchor] > 1  # buckets of one distinct segment are final
    mask = np.zeros(len(heads), dtype=np.uint32)
    todo = np.flatnonzero(open_)
    if len(todo):
        chosen = order[heads[todo]]
        text = _cut(data, starts[chosen], sizes[chosen])
        begin, windows = np.cumsum(sizes[chosen]) - sizes[chosen], sizes[chosen] - LENGTH + 1
        segment = np.repeat(np.arange(len(todo)), windows)
        place = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
        bucket = refine(text, begin[segment] + place)
        first = np.full(int(bucket.max()) + 1, NO_ID, dtype=np.int64)
        np.minimum.at(first, bucket, least[todo][segment])
        seen = first[bucket] < least[todo][segment]
        np.bitwise_or.at(mask, todo[segment[seen]], (np.uint32(1) << place[seen].astype(np.uint32)))
    record = np.empty(len(order), dtype=np.int64)
    record[order] = np.cumsum(new) - 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    g, slot, n = (table.column(c).combine_chunks() for c in ("g", "slot", "n"))
    return _side(g, 2, slot, n, _binary(least[record], bounds), _binary(mask[record], bounds))


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
_OUT_SQL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def _apply(docs: pa.Table, side: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return _OUT.empty_table()
    group = Group(docs, side)
    edges = np.zeros(len(group.raw) + 1, dtype=np.int32)
    if len(group.first):
        group.keep_repeated(side)
        replies = _rows(side, 2)  # in the order of the ranges, so of the group's distinct segments
        least, mask = _values(replies.column("data"), np.int64), _values(replies.column("more"), np.uint32)
        whole = least[group.record] < group.id_of
        np.add.at(edges, group.first[whole], 1)
        np.add.at(edges, group.last[whole] + LENGTH, -1)
        some = np.flatnonzero(~whole & (mask[group.record] > 0))
        bits = mask[group.record[some]]
        for k in range(SPAN):
            at = group.first[some[(bits >> np.uint32(k)) & np.uint32(1) > 0]] + k
            np.add.at(edges, at, 1)
            np.add.at(edges, at + LENGTH, -1)
    gone = np.cumsum(edges[:-1]) > 0
    starts, stops = runs(gone)
    rows = []
    for k, doc in enumerate(group.own):
        low, high = int(group.offsets[k]), int(group.offsets[k + 1]) - 1
        a, b = np.searchsorted(starts, (low, high))
        spans = [{"start": int(s) - low, "stop": int(e) - low} for s, e in zip(starts[a:b], stops[a:b], strict=True)]
        kept = group.raw[low:high][~gone[low:high]] if spans else group.raw[low:high]
        rows.append((int(group.ids[doc]), high - low, high - low - len(kept), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans))
    empty = hashlib.sha256(b"").hexdigest()
    for doc in np.flatnonzero(group.copy):
        n = len(group.all_texts[int(doc)].cast(pa.binary()).as_py())
        rows.append((int(group.ids[doc]), n, n, 1, empty, [{"start": 0, "stop": n}]))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, range_bytes: int = RANGE_BYTES, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are the maximal removed runs."""
    total = text_bytes(docs, text_col)
    groups, ranges = parts_for(total, group_bytes), parts_for(total, range_bytes)
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    group = F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int").alias("g")
    texts = slim.select(group, "id", "text")

    digests = slim.where(F.octet_length("text") >= LENGTH).select(group, "id", F.unhex(F.sha2("text", 256)).alias("sha"))
    # a written table, so that Spark can split the copies of a very common text in the join
    firsts = stored(digests.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("_c")).where("_c > 1").select("sha", "least"), "firsts")
    none = F.lit(None).cast("binary")
    copies = digests.join(firsts, "sha").where("id > least").select("g", F.lit(0).alias("kind"), F.col("id").alias("slot"), F.lit(0).cast("long").alias("n"), F.col("sha").alias("data"), none.alias("more"))
    by_group = texts.groupBy("g")
    anchors = by_group.cogroup(copies.groupBy("g")).applyInArrow(_send_anchors(ranges), _SIDE_SQL)
    repeated = anchors.groupBy("slot").applyInArrow(_find_repeated(hot_groups), _SIDE_SQL)
    sent = by_group.cogroup(copies.union(repeated).groupBy("g")).applyInArrow(_send_segments(ranges), _SEGMENTS_SQL)
    decided = sent.groupBy("slot").applyInArrow(_decide, _SIDE_SQL)
    out = by_group.cogroup(copies.union(repeated).union(decided).groupBy("g")).applyInArrow(_apply, _OUT_SQL)
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def without_spans(text: str | None, spans: list[dict]) -> str | None:
    """The text without the spans of bytes; what is left of a cut character goes too."""
    if text is None or not spans:
        return text
    data, at, kept = text.encode(), 0, []
    for span in spans:
        kept.append(data[at : span["start"]])
        at = span["stop"]
    return b"".join([*kept, data[at:]]).decode("utf-8", "ignore")


ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), c AS (
  SELECT doc_id, base, least(500, n - 49 - base) AS m, substring(h, 2 * base + 1, 1100) AS piece FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 500)) AS base FROM d WHERE n >= 50)
), w AS (
  SELECT doc_id, base + j AS k, substring(piece, 2 * j + 1, 100) AS s FROM (SELECT doc_id, base, piece, unnest(range(0, m)) AS j FROM c)
), f AS (
  SELECT s, min(doc_id) AS first FROM w GROUP BY s
), hit AS (
  SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (s) WHERE first < doc_id
), spans AS (
  SELECT doc_id, run, min(k) AS a, max(k) + 50 AS b FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM hit) GROUP BY ALL
), kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS n_spans
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS done FROM spans) JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
