"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document's set is its distinct shingles of 3 words or as many as asked (A-Z lower-cased, words between ASCII white
space; a text of fewer words is one shingle). One hash of each shingle serves all bins: the smallest value in each part
of the hash range is that bin's minimum; an empty bin takes the value of the first filled one in its own fixed random
order of bins. Bands of ``ROWS`` bins, or as many as asked, are bucket keys. In each bucket every document gets one
edge, to the smallest id in it: a star, so a bucket of m documents makes m - 1 edges.

Stars only propose: the components of the star edges are families, and two documents that share any bucket are in one
family. Links are then confirmed inside families on the full sets: members, ordered by set size, become centres in
turn, and a centre is held against all later members that its size allows and that are not yet in its component. So no
link is lost to a centre that two linked members are unlike, and no pair is ever emitted: a group returns its
components. A family whose sets exceed ``BLOCK_SHINGLES`` is dealt into blocks by hash, and every two blocks meet in one
task.

Documents of equal sets are collapsed to their smallest id first, with pre-aggregation, so thousands of copies cost
one. The number of bands follows from the threshold: a pair at it shares no bucket with a chance of at most ``MISS``, as
(1 - 0.85 ** 8) ** 40 and (1 - 0.8 ** 7) ** 55.

Defined cases: texts without words, empty or null, have an empty set, are linked with nothing and kept; ties: the
smallest id stays; a row without id is linked with nothing, is kept and has no component; an empty table gives no rows;
other columns, of any name and type, are not read, and ``deduplicate`` keeps them. Where rows repeat an id, the two
functions differ on purpose: ``near_duplicates`` judges ids, so all rows of an id have one component, that of all its
texts; ``deduplicate`` judges texts, so of the rows whose texts are linked, directly or through others, exactly one stays
(that of the smallest id, then digest; of equal rows one), and no text goes without a kept copy or near copy of it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlab.llm.components import components
from rlab.llm.scan import NOT_SPACE, U64, flat, mix, ngrams, owners, pieces, prefix_hash, span_hash, words
from rlab.llm.shared import lookup, stored

SHINGLE = 3
THRESHOLD = 85  # percent
ROWS = 8
#: The largest chance that a pair at the threshold shares no bucket.
MISS = 3e-6
#: Shingles of one block of a large family, 8 bytes each; a task holds two blocks.
BLOCK_SHINGLES = 1_000_000
_TRIES = 32


def bands_for(threshold: int = THRESHOLD, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` bins that miss a pair at the threshold with a chance of at most ``MISS``."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-((threshold / 100) ** rows)))) if threshold < 100 else 1


@functools.cache
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For every bin, all bins in a fixed random order, and the rank of each in it."""
    keys = mix(np.arange(bins * bins, dtype=U64) + U64(0x5851F42D4C957F2D)).reshape(bins, bins)
    order = np.argsort(keys, axis=1)
    return order, np.argsort(order, axis=1)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and the size of each set."""
    raw, offsets = flat(texts, lower=True)
    starts, ends, before = words(raw, offsets, NOT_SPACE)
    hashes = span_hash(prefix_hash(raw), starts, ends)
    grams = ngrams(hashes, n)
    sets, sizes = [], np.zeros(len(before) - 1, dtype=np.int64)
    for doc in range(len(before) - 1):
        low, high = before[doc], before[doc + 1]
        if high - low >= n:
            found = np.sort(grams[low : high - n + 1])
            found = found[np.concatenate(([True], found[1:] != found[:-1]))]
        else:
            found = ngrams(hashes[low:high], int(high - low)) if high > low else grams[:0]
        sets.append(found)
        sizes[doc] = len(found)
    return np.concatenate(sets) if sets else np.zeros(0, U64), sizes


def signatures(hashes: np.ndarray, sizes: np.ndarray, bins: int = bands_for() * ROWS) -> np.ndarray:
    """One-permutation signatures (sets x bins) of non-empty sets of sorted hashes, densified."""
    order, rank = _orders(bins)
    cell = owners(sizes) * bins + ((hashes >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    first = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, bool)
    out = np.zeros(len(sizes) * bins, dtype=U64)
    filled = np.zeros(len(sizes) * bins, dtype=bool)
    out[cell[first]], filled[cell[first]] = hashes[first], True
    filled = filled.reshape(-1, bins)
    row, col = np.nonzero(~filled)
    out = out.reshape(-1, bins)
    given = out.copy()
    for t in range(_TRIES):
        if not len(row):
            return given
        source = order[col, t]
        hit = filled[row, source]
        given[row[hit], col[hit]] = out[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for r in np.unique(row):  # sparse sets: the filled bin of least rank, which is what further tries would find
        empty, full = col[row == r], np.flatnonzero(filled[r])
        given[r, empty] = out[r, full[np.argmin(rank[empty][:, full], axis=1)]]
    return given


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), -1, rows)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=U64), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def _sign(shingle: int, threshold: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, sizes = shingle_sets(piece.column("text"), shingle)
                some = np.flatnonzero(sizes)
                ends = np.cumsum(sizes[some])
                one, two = np.zeros(len(sizes), dtype=U64), np.zeros(len(sizes), dtype=U64)
                bands: list[bytes | None] = [None] * len(sizes)
                if len(some):
                    at = ends - sizes[some]
                    one[some] = np.add.reduceat(mix(hashes), at)
                    two[some] = np.add.reduceat(mix(hashes ^ U64(0xA0761D6478BD642F)), at)
                    for doc, keys in zip(some, band_keys(signatures(hashes, sizes[some], bands_for(threshold, rows) * rows), rows), strict=True):
                        bands[doc] = keys.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("sha"), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(bands, pa.binary())],
                    names=["doc_id", "sha", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of one batch at a time: (key, smallest id in it) once for each key, and an edge (a, b) to it for every
    other member. So a bucket that a large share of all documents falls into moves one row for each batch."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), dtype=np.int64)
        ids = np.repeat(batch.column("node").to_numpy(), len(keys) // max(1, batch.num_rows))
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        head = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        least = ids[head][np.cumsum(head) - 1]
        edges = np.unique(np.stack((ids[~head], least[~head]), axis=1), axis=0)
        n, m = int(head.sum()), len(edges)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((keys[head], np.zeros(m, np.int64))), mask=np.arange(n + m) >= n),
                pa.array(np.concatenate((ids[head], edges[:, 0]))),
                pa.array(np.concatenate((np.zeros(n, np.int64), edges[:, 1])), mask=np.arange(n + m) < n),
            ],
            names=["key", "a", "b"],
        )


def _sets(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, sizes = shingle_sets(piece.column("text"), shingle)
                data, ends = hashes.tobytes(), np.cumsum(sizes) * 8
                cut = [data[e - 8 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                names = ["family", "blocks", "node"]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), pa.array(cut, pa.binary())], names=[*names, "shingles"])

    return run


def confirm(ids: np.ndarray, sets: list[np.ndarray], threshold: int = THRESHOLD) -> np.ndarray:
    """The smallest id that each set is linked to, directly or through others, on full sets."""
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((ids, sizes))
    sizes, m = sizes[order], len(sets)
    _, codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    codes = codes.astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    part = np.arange(m)
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=bool)
    reach = np.searchsorted(sizes, sizes * 100 // threshold, side="right")
    for centre in range(m):
        low, high = centre + 1, int(reach[centre])
        others = part[low:high] != part[centre]
        if not others.any():
            continue
        own = codes[starts[centre] : starts[centre + 1]]
        mark[own] = True
        if 4 * np.count_nonzero(others) < len(others):  # few are left: read only theirs
            some = low + np.flatnonzero(others)
            shared = np.array([np.count_nonzero(mark[codes[starts[k] : starts[k + 1]]]) for k in some])
        else:
            some = np.arange(low, high)
            shared = np.add.reduceat(mark[codes[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
        mark[own] = False
        linked = some[100 * shared >= threshold * (sizes[centre] + sizes[some] - shared)]
        if len(linked):
            joined = np.unique(np.append(part[linked], part[centre]))
            part[np.isin(part, joined)] = joined[0]
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, part, ids[order])
    out = np.empty(m, dtype=np.int64)
    out[order] = least[part]
    return out


def _confirm_group(threshold: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        sets = [np.frombuffer(x, dtype=U64) for x in table.column("shingles").to_pylist()]
        least = confirm(ids, sets, threshold)
        linked = least != ids
        return pa.table({"a": pa.array(ids[linked], pa.int64()), "b": pa.array(least[linked], pa.int64())})

    return run


_SIGNED = "doc_id long, sha binary, n_shingles long, h1 long, h2 long, bands binary"
KEY = ["n_shingles", "h1", "h2"]


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("sha"), text.alias("text"))


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, sha, n_shingles, node, root, least, best): node is the row that stands for its set, root the least
    node linked to it, least the smallest id with its set, best the (doc_id, sha) that stays of all texts linked to it.
    And the ids of more than one row."""
    slim = keyed_texts(docs, id_col, text_col)
    # rows are numbered in a written table, so that the numbers hold if a task runs again
    signed = stored(slim.mapInArrow(_sign(shingle, threshold, rows), _SIGNED).withColumn("row", F.monotonically_increasing_id()), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "sha", "row")).alias("r")
    reps = full.groupBy(*KEY).agg(first, F.first("bands").alias("bands"))
    reps = stored(reps.select(*KEY, F.col("r.row").alias("node"), F.struct("r.doc_id", "r.sha").alias("text_key"), "bands"), "sets")
    found = reps.select("node", "bands").mapInArrow(_stars, "key long, a long, b long")
    heads = found.where("key is not null").select("key", "a")
    centres = heads.groupBy("key").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key", "b")
    across = heads.join(centres, "key").where("a <> b").select("a", "b")
    stars = found.where("key is null").select("a", "b").union(across).distinct()
    families = components(stars, "families").select(F.col("id").alias("node"), F.col("component").alias("family"))

    members = families.join(reps.select("node", "n_shingles", "text_key"), "node")
    total = stored(members.groupBy("family").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks")), "families")
    members = stored(members.join(total, "family").select("node", "family", "blocks", F.col("text_key.doc_id").alias("_id"), F.col("text_key.sha").alias("_sha")), "members")
    # the rows of members by their ids first, then only these by id and digest
    near = slim.join(lookup(stored(members.select(F.col("_id").alias("doc_id")).distinct(), "member-ids")), "doc_id", "left_semi")
    texts = near.join(members.hint("merge"), (near["doc_id"] == members["_id"]) & (near["sha"] == members["_sha"])).select("family", "blocks", "node", "text")
    sets = texts.mapInArrow(_sets(shingle), "family long, blocks int, node long, shingles binary")
    repeated = repeated_ids(signed)
    if not repeated.isEmpty():  # equal rows of one id: one of them stands for the set
        sets = sets.dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own"))))
    dealt = sets.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")
    links = stored(dealt.groupBy("family", "i", "j").applyInArrow(_confirm_group(threshold), "a long, b long"), "links")
    if total.where("blocks > 1").isEmpty():  # one group saw the whole family, and gave each node its least one
        linked = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    else:
        linked = components(links, "links").where("id <> component").select(F.col("id").alias("node"), F.col("component").alias("root"))
    return place(signed, reps, linked), repeated


def repeated_ids(signed: DataFrame) -> DataFrame:
    """The ids of more than one row."""
    return stored(signed.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"), "repeated")


def place(signed: DataFrame, reps: DataFrame, linked: DataFrame) -> DataFrame:
    """Every row of ``signed`` with its node, root, least id and best text, from ``linked`` (node, root) of nodes that are
    linked to a smaller one."""
    linked = stored(linked, "linked")
    linked = linked.union(linked.select("root", "root").distinct()).join(reps.select("node", "text_key"), "node")
    best = stored(linked.groupBy("root").agg(F.min("text_key").alias("best")), "best")
    known_sets = stored(reps.drop("bands").join(linked.join(best, "root").select("node", "root", "best"), "node", "left"), "known-sets")

    # what a hot key is joined to is a written table, so that Spark can split the side of many rows
    placed = signed.select("doc_id", "sha", *KEY).join(known_sets, KEY, "left")
    known = F.col("doc_id").isNotNull()
    node, least = F.when(known, F.col("node")), F.when(known, F.coalesce("best.doc_id", "text_key.doc_id", "doc_id"))
    return placed.select("doc_id", "sha", "n_shingles", node.alias("node"), F.coalesce("root", "node").alias("root"), least.alias("least"), F.coalesce("best", "text_key").alias("best"))


def merge_ids(placed: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, least) of every row: the texts of one id are one, so their components are joined."""
    placed = placed.select("doc_id", "n_shingles", "node", "least")
    if not repeated.isEmpty():
        placed = stored(placed, "placed")
        own = stored(placed.where("node is not null").join(repeated, "doc_id", "left_semi").select("doc_id", "least").distinct(), "own")
        heads = stored(own.groupBy("doc_id").agg(F.min("least").alias("_head")), "heads")
        merged = components(own.join(heads, "doc_id").select(F.col("least").alias("a"), F.col("_head").alias("b")), "merged")
        merged = merged.select(F.col("id").alias("_from"), F.col("component").alias("_to"))
        placed = placed.join(heads, "doc_id", "left").withColumn("_from", F.coalesce("_head", "least")).join(merged, "_from", "left").withColumn("least", F.coalesce("_to", "_from"))
    return placed.select("doc_id", "n_shingles", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row. ``shingle``: words; ``threshold``: percent; ``rows``: bins of
    a band."""
    placed, repeated = _classes(docs, id_col, text_col, shingle, threshold, rows)
    placed = merge_ids(placed, repeated)
    return placed.select("doc_id", "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("least"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """One row of each group of linked texts, with all its columns, and all rows that are linked with nothing."""
    placed, repeated = _classes(docs, id_col, text_col, shingle, threshold, rows)
    known = placed.where("node is not null").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), ((F.col("doc_id") != F.col("best.doc_id")) | (F.col("sha") != F.col("best.sha"))).alias("_goes"))
    again = not repeated.isEmpty()
    if again:
        known = stored(known, "known")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"))
    row_id, text = F.col("_all").getField(id_col).cast("long"), F.col("_all").getField(text_col)
    keyed = keyed.withColumn("_doc", row_id)
    goes = known.where("_goes")
    if not again:  # every id stands in one row: no digest is needed, and the ids grow with the documents
        return keyed.join(goes.hint("merge"), F.col("_doc") == F.col("_id"), "left_anti").select("_all.*")
    keyed = keyed.withColumn("_digest", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    same = (F.col("_doc") == F.col("_id")) & (F.col("_digest") == F.col("_sha"))
    left = keyed.join(goes.distinct().hint("merge"), same, "left_anti")
    several = stored(known.where("not _goes").groupBy("_id", "_sha").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "several")
    one = left.join(several, same, "left_semi").groupBy("_doc", "_digest").agg(F.min_by("_all", F.to_json("_all")).alias("_all"))
    return left.join(several, same, "left_anti").select("_all.*").unionByName(one.select("_all.*"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k : k + 2], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM w
), x AS (
  SELECT doc_id, unnest(grams) AS g FROM s
), p AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS both_have FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT i, j FROM p JOIN s a ON a.doc_id = i JOIN s b ON b.doc_id = j WHERE 100 * both_have >= 85 * (len(a.grams) + len(b.grams) - both_have)
), e AS (
  SELECT i AS f, j AS t FROM l UNION ALL SELECT j, i FROM l
), reach AS (
  SELECT doc_id AS n, doc_id AS r FROM s UNION SELECT e.t, reach.r FROM reach JOIN e ON e.f = reach.n
)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN (SELECT n, min(r) AS c FROM reach GROUP BY n) ON n = doc_id
"""
