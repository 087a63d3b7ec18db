"""N-gram Jaccard join by vertical partitioning, and the components of its links.

A document's set is its distinct word n-grams. All n-grams have one global order, rare ones first (by the class of their
count, a power of two, then by hash); the order is cut into ``FRAGMENTS`` fragments, so every set falls into segments. Overlaps are counted fragment by fragment, from the segments of
that fragment alone, and the partial counts of a pair are summed. Two sets are linked when 100 * overlap >= threshold *
union. Nothing is estimated: what is left out below cannot be linked.

1. Covered sets. Whoever is linked shares at least threshold percent of the own n-grams, so a set with fewer n-grams that
   occur in another document is linked with nothing. This is tested on a quarter of all n-grams, chosen by hash (all, for
   short sets): the n-grams that a set may miss could all be in that quarter, and are allowed for. N-grams are dealt by
   ranges of their hash; an n-gram met twice in one batch moves once, so a passage of very many documents stays small.
2. Order. N-grams of the covered sets are counted and ordered; those of one set count for nothing but the set's size. Again
   sets with too few shared n-grams go.
3. Families. Linked sets share one of their first size - ceil(threshold * size) + 1 n-grams. For each such n-gram, all
   sets that hold it are joined to the least of them: a star. The components of the stars are families; links do not leave
   them.
4. Links. In each family the ``CENTRES`` sets with the fewest n-grams of their own are held against all members: each
   segment of a member meets the centres' segments of that fragment. A family of near copies becomes one component here,
   with work in proportion to its members. Where it does not, every set outside its largest component is held against all
   members of other components, in blocks of ``BLOCK`` by ``WIDE`` sets and by fragment; a pair is left out of a fragment if
   even full agreement before and behind it would not make a link.

Equal sets are one to begin with, so copies cost one. No pair of documents is given out, only links to centres and, of the
blocks, one link for each two components. A family whose members are alike enough to be covered and yet unlike costs the
square of its members outside its largest component, spread over blocks.

Sets are compared by 61-bit hashes of their n-grams; n-grams of one hash would count as one. Defined cases are those of the
near-duplicate operator: texts without words have an empty set and are linked with nothing; a row without id is linked with
nothing and has no component; rows that repeat an id are joined, as texts of one id are one; an empty table gives no
rows; other columns, of any name, are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rlab.llm.components import components
from rlab.llm.neardup import KEY, keyed_texts, merge_ids, place, repeated_ids, shingle_sets
from rlab.llm.scan import U64, mix, owners, pieces
from rlab.llm.shared import lookup, parts_for, stored, text_bytes

SHINGLE, THRESHOLD = 4, 85
FRAGMENTS, CENTRES = 8, 8
BLOCK, WIDE = 256, 2048
#: N-grams whose hash is 0 modulo this are tested for cover; sets of up to ``SHORT`` n-grams are tested with all.
SAMPLE, SHORT = 4, 64
#: Bytes of text for each range of hashes, so that a range holds about two million n-grams.
RANGE_BYTES, LEAST_RANGES = 64 << 20, 16
_PIECE_BYTES, _PIECE_ROWS = 2 << 20, 60_000
#: The global order is summed up in this many bits of the hash, by class.
_PART_BITS = 6
#: Sets that a task cuts into segments, or into rows of n-grams, at once.
_CUT_ROWS = 500
#: In place of a row: an n-gram that is not counted for any, and one that is known to occur in several.
_WITNESS, _SEVERAL = 65_535, 65_534


def needed(sizes: np.ndarray, threshold: int) -> np.ndarray:
    """The fewest n-grams of a set of this size that a linked set shares."""
    return -(-threshold * sizes // 100)


_SCANNED = "row long, doc_id long, sha binary, n_shingles long, h1 long, h2 long, credit long, range int, body binary"


def _scan(shingle: int, threshold: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Two kinds of rows: a document with its size and names, and the n-grams of one piece that fall into one hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, _PIECE_ROWS):
                for piece in pieces(batch.slice(at, _PIECE_ROWS), "text", _PIECE_BYTES):
                    yield from _scan_piece(piece, base, shingle, threshold, bits)
                    base += piece.num_rows

    return run


def _scan_piece(piece: pa.RecordBatch, base: int, shingle: int, threshold: int, bits: int) -> Iterator[pa.RecordBatch]:
    hashes, sizes = shingle_sets(piece.column("text"), shingle)
    m, some = len(sizes), np.flatnonzero(sizes)
    names = np.zeros((2, m), dtype=U64)
    if len(some):
        at = (np.cumsum(sizes) - sizes)[some]
        names[0, some], names[1, some] = np.add.reduceat(mix(hashes), at), np.add.reduceat(mix(hashes ^ U64(0xA0761D6478BD642F)), at)
    # of equal sets the first is looked at
    own = np.flatnonzero((sizes > 0) & np.asarray(piece.column("doc_id").is_valid()))
    first = np.zeros(m, dtype=bool)
    first[own[np.unique(names[:, own], axis=1, return_index=True)[1]]] = True
    of = owners(sizes)
    sampled = hashes & U64(SAMPLE - 1) == 0
    counted = first[of] & (sampled | (sizes[of] <= SHORT))
    posted = first[of] & (sampled | (sizes[of] * threshold <= SHORT * 100))  # whoever may be linked with a short set gives all
    missing = sizes - needed(sizes, threshold)
    credit = missing - np.bincount(of[counted], minlength=m)
    # n-grams of several sets of the piece are settled here and move once
    grams, rows = hashes[posted], np.where(counted[posted], of[posted], _WITNESS)
    order = np.argsort(grams)
    grams, rows = grams[order], rows[order]
    head = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(grams)))
    several = np.repeat(count > 1, count)
    credit += np.bincount(rows[several & (rows < _SEVERAL)], minlength=m)
    grams, rows = grams[head], np.where(count > 1, _SEVERAL, rows[head]).astype(np.uint16)
    short = (grams >> U64(32 - bits)).astype(np.uint32)
    ends = np.searchsorted(grams >> U64(64 - bits), np.arange(1, (1 << bits) + 1, dtype=U64)) 
    starts = np.concatenate(([0], ends[:-1]))
    ranges = np.flatnonzero(ends > starts)
    head_bytes = np.array([base], dtype=np.int64).tobytes()
    bodies = [head_bytes + short[a:b].tobytes() + rows[a:b].tobytes() for a, b in zip(starts[ranges].tolist(), ends[ranges].tolist(), strict=True)]
    k = len(ranges)
    pad = lambda column, kind: pa.concat_arrays([column, pa.nulls(k, kind)])
    columns = [
        pad(pa.array(np.arange(base, base + m)), pa.int64()),
        pad(piece.column("doc_id"), pa.int64()),
        pad(piece.column("sha"), piece.schema.field("sha").type),
        pad(pa.array(sizes), pa.int64()),
        pad(pa.array(names[0].view(np.int64)), pa.int64()),
        pad(pa.array(names[1].view(np.int64)), pa.int64()),
        pad(pa.array(credit, mask=~first), pa.int64()),
        pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array(ranges, pa.int32())]),
        pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array(bodies, pa.binary())]),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "sha", "n_shingles", "h1", "h2", "credit", "range", "body"])


def _met(table: pa.Table) -> pa.Table:
    """(row, credit): n-grams of one hash range that each row shares with others."""
    grams, rows = [], []
    for body in table.column("body").to_pylist():
        n = (len(body) - 8) // 6
        at = np.frombuffer(body, np.uint16, n, 8 + 4 * n).astype(np.int64)
        grams.append(np.frombuffer(body, np.uint32, n, 8))
        rows.append(np.where(at < _SEVERAL, at + np.frombuffer(body, np.int64, 1)[0], -at))
    grams, rows = np.concatenate(grams), np.concatenate(rows)
    order = np.argsort(grams, kind="stable")
    grams, rows = grams[order], rows[order]
    head = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    count = np.diff(np.append(head, len(grams)))
    shared = np.repeat((count > 1) | (np.maximum.reduceat(rows == -_SEVERAL, head)), count)
    rows, credit = np.unique(rows[shared & (rows >= 0)], return_counts=True)
    return pa.table({"row": rows, "credit": credit.astype(np.int64)})


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _CUT_ROWS):
            part = batch.slice(at, _CUT_ROWS)
            sets = part.column("shingles").to_pylist()
            row = pa.array(owners(np.array([len(s) // 8 for s in sets], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node").take(row), part.column("n").take(row), pa.array(np.frombuffer(b"".join(sets), np.int64))], names=["node", "n", "gram"])


def _sets(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, sizes = shingle_sets(piece.column("text"), shingle)
                data, ends = hashes.tobytes(), np.cumsum(sizes) * 8
                cut = [data[e - 8 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(sizes), pa.array(cut, pa.binary())], names=["node", "n", "shingles"])

    return run


def covered_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (row, doc_id, sha, n_shingles, h1, h2), all different sets (KEY, node, text_key), and the sets that may be
    linked (node, n, shingles)."""
    slim = keyed_texts(docs, id_col, text_col)
    bits = min(24, (parts_for(text_bytes(slim), RANGE_BYTES, LEAST_RANGES) - 1).bit_length())
    # rows are numbered in a written table, so that the numbers hold if a task runs again
    scanned = stored(slim.mapInArrow(_scan(shingle, threshold, bits), _SCANNED), "ngrams")
    signed = scanned.where("row is not null").select("row", "doc_id", "sha", *KEY)
    met = scanned.where("body is not null").select("range", "body").groupBy("range").applyInArrow(_met, "row long, credit long")
    credits = scanned.where("credit is not null").select("row", "credit").union(met).groupBy("row").agg(F.sum("credit").alias("credit"))
    alive = stored(credits.where("credit >= 0").select("row"), "covered-rows")
    first = F.min(F.struct("doc_id", "sha", "row")).alias("r")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy(*KEY).agg(first).select(*KEY, F.col("r.row").alias("node"), F.struct("r.doc_id", "r.sha").alias("text_key"))
    reps = stored(reps, "sets")
    keys = full.join(alive, "row", "left_semi").select(*KEY).distinct()
    chosen = stored(reps.join(keys, KEY, "left_semi").select("node", F.col("text_key.doc_id").alias("_id"), F.col("text_key.sha").alias("_sha")), "covered")
    near = slim.join(lookup(stored(chosen.select(F.col("_id").alias("doc_id")).distinct(), "covered-ids")), "doc_id", "left_semi")
    texts = near.join(chosen.hint("merge"), (near["doc_id"] == chosen["_id"]) & (near["sha"] == chosen["_sha"])).select("node", "text")
    sets = stored(texts.mapInArrow(_sets(shingle), "node long, n long, shingles binary").dropDuplicates(["node"]), "covered-sets")
    return signed, reps, sets


def _pack(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by set and global order as one row for each set that has enough of them for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, (None,)):
            if batch is not None and not batch.num_rows:
                continue
            columns = None if batch is None else [batch.column(c).to_numpy() for c in ("node", "n", "class", "gram")]
            if held is not None and columns is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            columns = columns or held
            if columns is None:
                return
            starts = [a for a, _ in _runs(columns[:1])]
            end = len(columns[0]) if batch is None else starts[-1]  # the last set may go on in the next batch
            held = [c[end:] for c in columns]
            bounds = [*(a for a in starts if a < end), end]
            node, n, size = columns[0][bounds[:-1]], columns[1][bounds[:-1]], np.diff(bounds)
            for at in np.array_split(np.flatnonzero(size >= needed(n, threshold)), max(1, end // 1_000_000)):
                cut = lambda data: pa.array([data[bounds[k] : bounds[k + 1]].tobytes() for k in at], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(n[at]), pa.array(size[at]), cut(columns[2].astype(np.uint8)), cut(columns[3])], names=["node", "n", "size", "classes", "grams"])

    return run


def ordered_sets(sets: DataFrame, threshold: int, fragments: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(node, n, size, classes, grams): of each set the n-grams that others have too, in the global order, where they are
    enough for a link; size is their number. And the bounds (class, gram) of the fragments, which hold about equally many
    n-grams: the order is summed up in parts of each class, at most some thousand in all."""
    grams = sets.mapInArrow(_explode_sets, "node long, n long, gram long")
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    counts = stored(counts.select("gram", "df", F.floor(F.log2("df")).cast("int").alias("class")), "gram-counts")
    parts = counts.groupBy("class", F.shiftright("gram", 64 - _PART_BITS).alias("part")).agg(F.sum("df").alias("n")).orderBy("class", "part").collect()
    total, seen, bounds = sum(r.n for r in parts), 0, []
    for r in parts:
        seen += r.n
        if len(bounds) + 1 < fragments and seen * fragments >= total * (len(bounds) + 1):
            bounds.append((r["class"], (r.part + 1 << 64 - _PART_BITS) - 1))
    shared = grams.join(counts.select("gram", "class").hint("merge"), "gram").select("node", "n", "class", "gram")
    shared = shared.repartition("node").sortWithinPartitions("node", "class", "gram")
    return stored(shared.mapInArrow(_pack(threshold), "node long, n long, size long, classes binary, grams binary"), "ordered-sets"), bounds


def _prefixes(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One of the first size - needed + 1 n-grams of a set is shared with whatever it is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column("size").to_numpy() - needed(batch.column("n").to_numpy(), threshold) + 1
            heads = [g[: 8 * k] for g, k in zip(batch.column("grams").to_pylist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), count)), pa.array(np.frombuffer(b"".join(heads), np.int64))], names=["node", "gram"])

    return run


def families(ordered: DataFrame, threshold: int) -> DataFrame:
    """(node, family): components of sets that share an n-gram of their prefixes. Sets without such a one are not listed."""
    posted = stored(ordered.select("node", "n", "size", "grams").mapInArrow(_prefixes(threshold), "node long, gram long"), "postings")
    heads = stored(posted.groupBy("gram").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gram", "b"), "stars")
    stars = posted.join(heads, "gram").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return components(stars, "families").select(F.col("id").alias("node"), F.col("component").alias("family"))


_SEGMENT = "family long, node long, n long, fragment int, before int, after int, grams binary"


def _cut(bounds: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments of each set: n-grams between two bounds of the global order, sorted by hash; before and after: how many
    shared n-grams lie in earlier and later segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CUT_ROWS):
                yield _cut_rows(batch.slice(at, _CUT_ROWS), bounds)

    return run


def _cut_rows(batch: pa.RecordBatch, bounds: list[tuple[int, int]]) -> pa.RecordBatch:
    sizes = batch.column("size").to_numpy()
    of = owners(sizes)
    kind, gram = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint8), np.frombuffer(b"".join(batch.column("grams").to_pylist()), np.int64)
    fragment = np.zeros(len(gram), dtype=np.int32)
    for bound_class, bound_gram in bounds:
        fragment += (kind > bound_class) | ((kind == bound_class) & (gram > bound_gram))
    runs = np.array(_runs([of, fragment]), dtype=np.int64).reshape(-1, 2)
    head, length = runs[:, 0], runs[:, 1] - runs[:, 0]
    row = of[head]
    before = head - (np.cumsum(sizes) - sizes)[row]
    grams = np.ascontiguousarray(gram[np.lexsort((gram, fragment, of))])
    cut = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((np.append(head, len(gram)) * 8).astype(np.int32)), pa.py_buffer(grams)])
    columns = [*(batch.column(c).take(pa.array(row)) for c in ("family", "node", "n")), pa.array(fragment[head]), pa.array(before.astype(np.int32)), pa.array((sizes[row] - before - length).astype(np.int32)), cut]
    return pa.RecordBatch.from_arrays(columns, names=["family", "node", "n", "fragment", "before", "after", "grams"])


def segments(ordered: DataFrame, members: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """The segments of all members of families."""
    listed = ordered.join(members, "node").select("family", "node", "n", "size", "classes", "grams")
    return stored(listed.mapInArrow(_cut(bounds), _SEGMENT), "segments")


def _runs(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Ranges of neighbours with equal keys."""
    n = len(keys[0])
    if not n:
        return []
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], n], strict=True))


def _overlaps(mine: np.ndarray, others: list[bytes]) -> np.ndarray:
    """Members of the sorted set ``mine`` in each of the sets."""
    flat = np.frombuffer(b"".join(others), np.int64)
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    bounds = np.concatenate(([0], np.cumsum([len(o) // 8 for o in others])))
    return np.diff(np.concatenate(([0], np.cumsum(mine[at] == flat)))[bounds])


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps of each segment with those of its family's centres (an array: one count for each centre)."""
    for batch in batches:
        counts = np.zeros((batch.num_rows, CENTRES), dtype=np.int64)
        grams = batch.column("grams").to_pylist()
        for low, high in _runs([batch.column("family").to_numpy(), batch.column("fragment").to_numpy()]):
            for centre in batch.column("centres")[low].as_py():
                counts[low:high, centre["place"] - 1] = _overlaps(np.frombuffer(centre["grams"], np.int64), grams[low:high])
        lists = pa.ListArray.from_arrays(np.arange(0, counts.size + 1, CENTRES, dtype=np.int32), counts.ravel())
        yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("node"), batch.column("n"), lists], names=["family", "node", "n", "counts"])


def centre_links(cut: DataFrame, ordered: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """(a, b): the members of each family that are linked to one of its centres."""
    spare = (F.col("n") - F.col("size")) / F.col("n")
    rank = F.row_number().over(Window.partitionBy("family").orderBy("spare", "node"))
    ranked = ordered.select("node", "n", spare.alias("spare")).join(members, "node").withColumn("place", rank)
    centres = stored(ranked.where(F.col("place") <= CENTRES).select("family", "node", "n", "place"), "centres")
    theirs = cut.join(centres.select("node", "place"), "node").groupBy("family", "fragment").agg(F.collect_list(F.struct("place", "grams")).alias("centres"))
    met = cut.select("family", "fragment", "node", "n", "grams").join(stored(theirs, "centre-segments").hint("merge"), ["family", "fragment"])
    partial = met.mapInArrow(_partials, "family long, node long, n long, counts array<long>")
    total = partial.groupBy("family", "node", "n").agg(F.array(*(F.sum(F.col("counts")[k]) for k in range(CENTRES))).alias("total"))
    known = stored(centres.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("place", "node", "n"))).alias("centres")), "centre-lists")
    pair = F.explode(F.arrays_zip("centres", F.slice("total", F.lit(1), F.size("centres")).alias("shared"))).alias("p")
    pairs = total.join(known, "family").select("node", "n", pair).select(F.col("node").alias("a"), "n", F.col("p.centres.node").alias("b"), F.col("p.centres.n").alias("m"), F.col("p.shared").alias("both_have"))
    return pairs.where((F.col("a") != F.col("b")) & (100 * F.col("both_have") >= threshold * (F.col("n") + F.col("m") - F.col("both_have")))).select("a", "b")


def _block_partials(threshold: int) -> Callable[[pa.Table], pa.Table]:
    """Partial overlaps of one fragment, of all pairs of one block that could still be linked, packed into one row."""

    def run(table: pa.Table) -> pa.Table:
        left = np.asarray(table.column("left"))
        grams = table.column("grams").to_pylist()
        outer, inner = np.flatnonzero(left), np.flatnonzero(~left)
        columns = {k: (table.column(k).to_numpy()[outer], table.column(k).to_numpy()[inner]) for k in ("node", "n", "before", "after", "label")}
        theirs = [grams[k] for k in inner]
        out = []
        for k, at in enumerate(outer):
            if not len(inner):
                break
            shared = _overlaps(np.frombuffer(grams[at], np.int64), theirs)
            n, m = columns["n"][0][k], columns["n"][1]
            most = shared + np.minimum(columns["before"][0][k], columns["before"][1]) + np.minimum(columns["after"][0][k], columns["after"][1])
            fits = (shared > 0) & (columns["label"][1] != columns["label"][0][k]) & (100 * most >= threshold * (n + m - most))
            out.append(np.stack([np.full(fits.sum(), k), np.flatnonzero(fits), shared[fits]]))
        found = np.concatenate(out, axis=1).astype(np.int64) if out else np.zeros((3, 0), np.int64)
        i, j, shared = found
        parts = [columns["node"][0][i], columns["node"][1][j], columns["n"][0][i], columns["n"][1][j], columns["label"][0][i], columns["label"][1][j], shared]
        return pa.table({"family": table.column("family")[:1], "i": table.column("i")[:1], "j": table.column("j")[:1], "pairs": pa.array([np.stack(parts).astype(np.int64).tobytes()], pa.binary())})

    return run


def _block_links(threshold: int) -> Callable[[pa.Table], pa.Table]:
    """The partial overlaps of all fragments of a block summed for each pair: one link for each two components."""

    def run(table: pa.Table) -> pa.Table:
        parts = np.concatenate([np.frombuffer(p, np.int64).reshape(7, -1) for p in table.column("pairs").to_pylist()], axis=1)
        order = np.lexsort((parts[1], parts[0]))
        parts = parts[:, order]
        head = np.flatnonzero(np.concatenate(([True], (np.diff(parts[0]) != 0) | (np.diff(parts[1]) != 0)))) if parts.shape[1] else np.zeros(0, np.int64)
        a, b, n, m, from_label, to_label, _ = parts[:, head]
        shared = np.add.reduceat(parts[6], head) if len(head) else np.zeros(0, np.int64)
        linked = np.flatnonzero(100 * shared >= threshold * (n + m - shared))
        if len(linked):
            linked = linked[np.unique(np.stack((from_label[linked], to_label[linked])), axis=1, return_index=True)[1]]
        return pa.table({"a": a[linked], "b": b[linked]})

    return run


def block_links(cut: DataFrame, members: DataFrame, links: DataFrame, threshold: int) -> DataFrame | None:
    """(a, b): further links of families that their centres have not made one component; None if there are none."""
    label = components(links, "centre-components").select(F.col("id").alias("node"), F.col("component").alias("label"))
    labelled = stored(members.join(label, "node", "left").select("node", "family", F.coalesce("label", "node").alias("label")), "labels")
    sizes = labelled.groupBy("family", "label").agg(F.count(F.lit(1)).alias("_n"))
    split = sizes.groupBy("family").agg(F.max(F.struct("_n", "label"))["label"].alias("largest"), F.sum("_n").alias("size"), F.max("_n").alias("most"))
    split = stored(split.where((F.col("size") > F.col("most")) & (F.col("size") > CENTRES)), "split")
    if split.isEmpty():
        return None
    blocks = lambda n, each: F.ceil(n / each).cast("int")
    dealt = labelled.join(split, "family").withColumn("rows", blocks(F.col("size") - F.col("most"), BLOCK)).withColumn("columns", blocks(F.col("size"), WIDE))
    own_row, own_column = F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("columns")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = dealt.where("label <> largest").select("node", "label", F.lit(True).alias("left"), own_row.alias("i"), "columns").select("node", "label", "left", "i", upto("columns").alias("j"))
    inner = dealt.select("node", "label", F.lit(False).alias("left"), own_column.alias("j"), "rows").select("node", "label", "left", upto("rows").alias("i"), "j")
    placed = stored(outer.unionByName(inner), "blocks")
    partial = cut.join(placed, "node").groupBy("family", "i", "j", "fragment").applyInArrow(_block_partials(threshold), "family long, i int, j int, pairs binary")
    return partial.groupBy("family", "i", "j").applyInArrow(_block_links(threshold), "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row. ``shingle``: words; ``threshold``: percent."""
    signed, reps, sets = covered_sets(docs, id_col, text_col, shingle, threshold)
    ordered, bounds = ordered_sets(sets, threshold, fragments)
    members = stored(families(ordered, threshold), "members")
    cut = segments(ordered, members, bounds)
    links = stored(centre_links(cut, ordered, members, threshold), "centre-links")
    more = block_links(cut, members, links, threshold)
    if more is not None:
        links = links.union(stored(more, "block-links"))
    linked = components(links, "links").where("id <> component").select(F.col("id").alias("node"), F.col("component").alias("root"))
    merged = merge_ids(place(signed, reps, linked), repeated_ids(signed))
    return merged.select("doc_id", "n_shingles", F.col("least").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k : k + 3], ' ')))
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
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN (SELECT n, min(r) AS c FROM reach GROUP BY n) ON n = doc_id
"""
