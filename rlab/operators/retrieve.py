"""Retrieval: BM25 and exact cosine top-k inside versioned snapshots, pooling of chunks, recall, project similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlab.functions import text as X
from rlab.functions import vectors as V
from rlab.operators.kbest import LISTED, KBest, offer_products
from rlab.operators.rank import topk_per_query
from rlab.sources.io import stored

#: Depths at which recall is reported.
RECALL_KS = [30, 40, 50, 60, 70, 80, 90, 100, 200, 300, 400, 500, 700]
#: Most bytes of query vectors in one broadcast block.
BLOCK_BYTES = 32 << 20
#: Most rows of a table that others are looked up in by broadcast.
BROADCAST_IDS = 500_000
#: Scores (item x query) that a task adds up at once.
CELLS = 4_000_000
#: Vectors in one part of a snapshot, and queries in one block, of ``cosine_topk_by``.
PART_ROWS, QUERY_ROWS = 20_000, 2_000


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate on every row."""
    return df.crossJoin(F.broadcast(one_row))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each row and distinct token, with the number of its tokens; all other columns go along."""
    for part in _slices(batches):
        lists = part.column("tokens")
        yield _counted(part, np.diff(lists.offsets.to_numpy()), lists.flatten())


def _count_code_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_count_terms``, of texts in the column ``tokens`` that are cut here as ``functions.text.code_tokens`` cuts them."""
    for part in _slices(batches):
        yield _counted(part, *X.cut_code_tokens(part.column("tokens")))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield batch.slice(at, 1000)


def _counted(part: pa.RecordBatch, sizes: np.ndarray, tokens: pa.Array) -> pa.RecordBatch:
    terms = tokens.dictionary_encode()
    n = max(1, len(terms.dictionary))
    cell, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + terms.indices.to_numpy(), return_counts=True)
    row = cell // n
    others = [c for c in part.schema.names if c != "tokens"]
    columns = [*(part.column(c).take(pa.array(row)) for c in others), pa.array(sizes[row].astype(np.int32)), terms.dictionary.take(pa.array(cell % n)), pa.array(tf.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=[*others, "dl", "term", "tf"])


def postings(corpus: DataFrame, by: list[str] | None = None, text: str | None = None) -> DataFrame:
    """(by, item_id, dl, term, tf) of a corpus with a ``tokens`` column: texts are cut into tokens once, a row's tokens are
    counted where the row is, and all statistics come from this written table. ``dl``: tokens of the item. An item is one row.
    ``text``: a column of texts to be cut into code tokens here, batch by batch, instead of ``tokens``."""
    names = [*(by or []), "item_id"]
    kinds = [f"`{n}` {corpus.schema[n].dataType.simpleString()}" for n in names]
    if text is not None:
        tall, count = corpus.where(F.col(text).isNotNull()).select(*names, F.col(text).alias("tokens")), _count_code_tokens
    else:
        tall, count = corpus.where("tokens is not null").select(*names, F.filter("tokens", lambda t: t.isNotNull()).alias("tokens")), _count_terms
    return stored(tall.mapInArrow(count, ", ".join([*kinds, "dl int", "term string", "tf long"])), "postings")


def term_statistics(corpus: DataFrame, by: list[str], posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by, term, df) and (by, n_docs, avgdl) of a corpus and its postings."""
    terms = posted.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    items, tokens = corpus.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs")), posted.groupBy(*by).agg(F.sum("tf").alias("_all"))
    both = items.join(tokens, by, "left") if by else attach(items, tokens)
    return terms, both.withColumn("avgdl", F.coalesce("_all", F.lit(0)) / F.col("n_docs")).drop("_all")


def query_postings(queries: DataFrame, corpus: DataFrame, by: list[str] | None = None, posted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What scorers with any constants share: (by, query_id, code, qtf) of the queries, and (by, item_id, code, dl, tf, avgdl,
    raw_idf, mean_idf) of the postings of their terms; ``code`` is a number of a term and ``by``. Terms are counted once. Up to
    ``BROADCAST_IDS`` query terms are looked up where the postings are, so only postings of query terms move."""
    by = by or []
    posted = postings(corpus, by) if posted is None else posted
    query_terms = queries.select(*by, "query_id", F.explode("tokens").alias("term")).groupBy(*by, "query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms, sizes = term_statistics(corpus, by, posted)
    terms, sizes = stored(terms, "terms"), stored(sizes, "sizes")
    terms = terms.join(F.broadcast(sizes), by) if by else attach(terms, sizes)
    terms = terms.withColumn("raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = terms.groupBy(*by).agg(F.avg("raw_idf").alias("mean_idf"))
    wanted = terms.join(query_terms.select(*by, "term").distinct(), [*by, "term"], "left_semi")
    wanted = wanted.join(mean, by) if by else attach(wanted, mean)
    # numbers are given when the table is written, so all who read it see the same
    wanted = lookup(stored(wanted.select(*by, "term", F.monotonically_increasing_id().alias("code"), "avgdl", "raw_idf", "mean_idf"), "wanted-terms"))
    asked = stored(query_terms.join(wanted, [*by, "term"]).select(*by, "query_id", "code", "qtf"), "query-terms")
    return asked, stored(posted.join(wanted, [*by, "term"]).select(*by, "item_id", "code", "dl", "tf", "avgdl", "raw_idf", "mean_idf"), "query-postings")


def lookup(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A stored table that others are looked up in: broadcast up to a counted number of rows, beyond that left to a merge."""
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")


def _weights(k1: float, b: float, eps: float) -> Column:
    idf = F.when(F.col("raw_idf") < 0, eps * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def bm25_scores(queries: DataFrame, corpus: DataFrame, by: list[str] | None = None, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, posted: DataFrame | None = None) -> DataFrame:
    """(by, query_id, item_id, score, n_terms) of all pairs that share a term. ``queries`` and ``corpus`` have an id and
    ``tokens``; a query's repeated tokens count each; n_terms: distinct terms shared. Okapi BM25: terms of negative idf
    get ``eps`` times the mean idf of the whole vocabulary. ``posted``: the corpus' postings, where several scorers share
    them. Postings are cut to query terms before they are shuffled."""
    by = by or []
    query_terms, found = query_postings(queries, corpus, by, posted)
    pairs = found.select("item_id", "code", _weights(k1, b, eps).alias("weight")).join(query_terms, "code")
    return pairs.groupBy(*by, "query_id", "item_id").agg(F.sum(F.col("weight") * F.col("qtf")).alias("score"), F.count(F.lit(1)).alias("n_terms"))


class _Block:
    """Query terms of one block as arrays: of each term the queries that have it, how often, and the most that it can add to
    their scores.

    Terms of a query that cannot lift an item to the query's floor, all together, are its minor ones. Items are found by the
    other terms; minor ones are looked up only where an item, with all of them, could reach the floor."""

    def __init__(self, rows: pd.DataFrame, names: list[str]):
        self.queries = rows[names].drop_duplicates().reset_index(drop=True)
        codes = rows.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
        term, keys = pd.factorize(rows["_key"])
        order = np.argsort(term, kind="stable")
        self.code = {key: k for k, key in enumerate(keys)}
        self.term, self.query, self.qtf = term[order], codes[order], rows["qtf"].to_numpy(dtype=np.float64)[order]
        self.most = np.maximum(rows["most"].to_numpy(dtype=np.float64)[order] * self.qtf, 0)
        self.by_most = np.lexsort((self.most, self.query))
        #: Items whose scores are added up at once.
        self.items = max(1, min(CELLS // max(1, len(self.queries)), 4 * CELLS // max(1, len(rows))))
        self.split(np.full(len(self.queries), -np.inf))

    def split(self, floor: np.ndarray) -> None:
        """Sets the minor terms of each query by its floor."""
        self.floor = floor.copy()
        query, most = self.query[self.by_most], self.most[self.by_most]
        total = np.cumsum(most)
        start = np.searchsorted(query, np.arange(len(floor)))
        total -= (total - most)[start][query] if len(query) else 0
        minor = np.zeros(len(query), dtype=bool)
        minor[self.by_most] = total < floor[query] - 1e-6
        self.rest = np.bincount(self.query[minor], weights=self.most[minor], minlength=len(floor))
        self.major, self.minor = (self._lists(np.flatnonzero(m)) for m in (~minor, minor))

    def _lists(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.searchsorted(self.term[which], np.arange(len(self.code) + 1))
        return starts, self.query[which], self.qtf[which]

    def _cells(self, lists: tuple[np.ndarray, np.ndarray, np.ndarray], item: np.ndarray, code: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each posting once for each query that has its term: the cell (item x query) and what it adds."""
        starts, query, qtf = lists
        counts = starts[code + 1] - starts[code]
        row = np.repeat(np.arange(len(code)), counts)
        at = np.repeat(starts[code] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return item[row] * len(self.queries) + query[at], weights[row] * qtf[at]

    def score(self, items: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """query, score, item and n_terms of all pairs that share a term and may reach the query's floor."""
        item, names = pd.factorize(items)
        term, found = pd.factorize(keys)
        code = np.array([self.code.get(key, -1) for key in found], dtype=np.int64)[term]
        known = np.flatnonzero(code >= 0)
        item, code, weights = item[known], code[known], weights[known]
        size = len(names) * len(self.queries)
        cell, adds = self._cells(self.major, item, code, weights)
        n_terms, scores = np.bincount(cell, minlength=size), np.bincount(cell, weights=adds, minlength=size)
        floor = np.tile(self.floor, len(names))
        if len(self.minor[1]):
            alive = (n_terms > 0) & (scores + np.tile(self.rest, len(names)) >= floor - 1e-6)
            some = np.flatnonzero(alive.reshape(len(names), -1).any(axis=1)[item])
            cell, adds = self._cells(self.minor, item[some], code[some], weights[some])
            inside = alive[cell]
            n_terms = n_terms * alive + np.bincount(cell[inside], minlength=size)
            scores += np.bincount(cell[inside], weights=adds[inside], minlength=size)
        good = np.flatnonzero((n_terms > 0) & (scores >= floor - 1e-9))
        return good % len(self.queries), np.round(scores[good], 9), names[good // len(self.queries)], n_terms[good]


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int, by: list[str] | None = None, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, posted: DataFrame | None = None, shared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The k best items of every query with rank, score and n_terms, as ``bm25_scores`` has them. Items that share no term are
    not listed. Scores are rounded to 9 places before they are ranked, so that the order does not hang on the order of a sum.

    The postings of query terms are sorted by item, and query terms go out in blocks of bounded size, one at a time; a task
    adds up the scores of some items at once and keeps its own k best, so the pairs that share a term are never rows of a
    shuffle. The k-th score so far bounds what is looked up at all: with the largest weight of each term, an item that
    cannot reach it is left out before its frequent terms are read. Each block's result is a written table of its own. ``shared``:
    what ``query_postings`` gives, where several scorers share it."""
    by = by or []
    query_terms, found = query_postings(queries, corpus, by, posted) if shared is None else shared
    spark, names = corpus.sparkSession, [*by, "query_id"]
    key = F.col("code").alias("_key")
    weights = found.select("item_id", key, _weights(k1, b, eps).alias("weight"))
    asked = query_terms.select(*names, key, "qtf").join(weights.groupBy("_key").agg(F.max("weight").alias("most")), "_key")
    asked = stored(asked, "query-terms")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]).alias("queries")).first()
    blocks = max(1, -(-size.n * 100 // BLOCK_BYTES), -(-size.queries * k // LISTED))
    by_item = weights.repartition("item_id").sortWithinPartitions("item_id")
    by_item = by_item if blocks == 1 else stored(by_item, "weights-by-item")
    kinds = [f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in names] + [f"item_id {corpus.schema['item_id'].dataType.simpleString()}", "score double", "n_terms long"]

    def of_block(rows: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows.toPandas())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block = _Block(shared.value, names)
            best = KBest(len(block.queries), k)
            for items, keys, values in _whole_items(batches, block.items):
                best.offer(*block.score(items, keys, values))
                if (best.floor > block.floor).any():
                    block.split(best.floor)
            found = best.rows()
            for at in range(0, len(found[0]) if found else 0, 100_000):
                query, score, item, n_terms = (c[at : at + 100_000] for c in found)
                owners = block.queries.iloc[query].reset_index(drop=True)
                yield pd.concat([owners, pd.DataFrame({"item_id": item, "score": score, "n_terms": n_terms})], axis=1)[[*names, "item_id", "score", "n_terms"]]

        return topk_per_query(by_item.mapInPandas(run, ", ".join(kinds)), k)

    # a written table: rankings are small against what they are made of, and are read more than once
    return stored(of_block(asked), "topk") if blocks == 1 else _blockwise(of_block, asked, blocks)


def _blockwise(of_block: Callable[[DataFrame], DataFrame], asked: DataFrame, blocks: int) -> DataFrame:
    """The results of all blocks of queries. Blocks run one after another, each into a table of its own, so one that is tried
    again finds nothing of the first try."""
    if blocks == 1:
        return of_block(asked)
    parts = [stored(of_block(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)), "topk") for n in range(blocks)]
    return reduce(DataFrame.union, parts)


def _whole_items(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows sorted by item, regrouped so that an item is never split, ``most`` items at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows = pd.concat(held)
        items = rows["item_id"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
        at = 0
        while len(starts) - at > most:  # the last item may go on in the next batch
            part = rows.iloc[starts[at] : starts[at + most]]
            yield part["item_id"].to_numpy(), part["_key"].to_numpy(), part["weight"].to_numpy()
            at += most
        held = [rows.iloc[starts[at] :]]
    if held:
        rows = held[0]
        yield rows["item_id"].to_numpy(), rows["_key"].to_numpy(), rows["weight"].to_numpy()


def _best_of_batches(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False, several: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank). Query vectors go out in blocks, one at a time, bounded by their bytes and by the
    entries of their lists; a task multiplies tiles of queries and vectors and keeps running lists of the k best.
    ``several``: an item may have several vectors, of which the best counts."""
    spark = vectors.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {vectors.schema['item_id'].dataType.simpleString()}, score double"
    known = vectors.select("item_id", "vec").where("vec is not null")
    asked = queries.select("query_id", "vec").where("vec is not null")

    def of_block(block: DataFrame) -> DataFrame:
        rows = block.collect()
        shared = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), _unit(np.array([r.vec for r in rows], dtype=np.float64)) if rows else None))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, left = shared.value
            if left is None:
                return
            best = KBest(len(ids), k, once=several)
            for batch in batches:
                if len(batch):
                    items = batch["item_id"].to_numpy()
                    offer_products(best, left, _unit(np.stack(batch["vec"].to_numpy()).astype(np.float64)), items, ids if exclude_self else None)
            found = best.rows()
            for at in range(0, len(found[0]) if found else 0, 100_000):
                query, score, item = (c[at : at + 100_000] for c in found)
                yield pd.DataFrame({"query_id": ids[query], "item_id": item, "score": score})

        found = known.mapInPandas(run, schema)
        return topk_per_query(found.groupBy("query_id", "item_id").agg(F.max("score").alias("score")) if several else found, k)

    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("dim")).first()
    return _blockwise(of_block, asked, max(1, -(-size.n * 8 * size.dim // BLOCK_BYTES), -(-size.n * k // LISTED)))


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank): exact cosine of a stated query set against all vectors."""
    return _best_of_batches(queries, vectors, k, exclude_self)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def cosine_topk_by(queries: DataFrame, vectors: DataFrame, by: str, k: int, part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """As ``cosine_topk``, each query only inside its snapshot. The vectors of a snapshot are dealt into parts of about
    ``part_rows`` and its queries into blocks of about ``query_rows``, by their counts; every block meets every part in a
    group of its own, which keeps its k best."""
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {vectors.schema['item_id'].dataType.simpleString()}, score double"
    parts = vectors.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts"))
    blocks = queries.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("_blocks"))
    sizes = stored(parts.join(blocks, by), "snapshot-sizes")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, by).withColumn("_block", own("query_id", "_blocks")).select(F.col(by).alias("_by"), "_block", every("_parts").alias("_part"), "query_id", F.col("vec").alias("_vec"))
    right = vectors.join(sizes, by).withColumn("_part", own("item_id", "_parts")).select(F.col(by).alias("_by"), every("_blocks").alias("_block"), "_part", "item_id", "vec")

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []}).astype({"query_id": q["query_id"].dtype, "item_id": v["item_id"].dtype})
        left, right = (_unit(np.stack(c.to_numpy()).astype(np.float64)) for c in (q["_vec"], v["vec"]))
        best = KBest(len(q), k)
        offer_products(best, left, right, v["item_id"].to_numpy())
        query, score, item = best.rows()
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[query], "item_id": item, "score": score})

    key = ["_by", "_block", "_part"]
    return topk_per_query(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema), k)


def containing(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, item_id) of all items whose text holds the query's whole text. The words of a passage but its first and
    last are whole words wherever it stands, so items are found by an equi-join on the one of these that the fewest items
    have (the longest of equal ones), and verified. Passages of fewer than three words have no such word and are held against
    every item."""
    cut = lambda c: F.split(c, r"[ \t\n]+")
    passages = queries.where(F.length("text") > 0).select("query_id", F.col("text").alias("_passage"), cut(F.col("text")).alias("_words"))
    inner = F.filter(F.slice("_words", 2, F.greatest(F.size("_words") - 2, F.lit(0))), lambda w: w != "")
    asked = stored(passages.select("query_id", F.explode(F.array_distinct(inner)).alias("_word")), "passage-words")
    words = corpus.select("item_id", F.explode(F.array_distinct(cut(F.col("text")))).alias("_word"))
    wanted = stored(words.join(asked.select("_word").distinct(), "_word", "left_semi"), "passage-postings")
    counts = wanted.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    ranked = asked.join(counts, "_word", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), -F.length("_word"), F.col("_word").alias("w")))["w"].alias("_word"))
    found = wanted.join(ranked, "_word").select("query_id", "item_id").distinct()
    texts, held = corpus.select("item_id", "text"), F.contains(F.col("text"), F.col("_passage"))
    sure = found.join(passages.select("query_id", "_passage"), "query_id").join(texts, "item_id").where(held)
    short = texts.join(passages.where(F.size(inner) == 0).select("_passage", "query_id"), held)
    # a written table: metrics read the ground truth several times
    return stored(sure.select("query_id", "item_id").union(short.select("query_id", "item_id")).distinct(), "containing")


def mark_relevant(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """``ranked`` with a ``relevant`` flag, by (query_id, item_id)."""
    marks = truth.select("query_id", "item_id").distinct().withColumn("relevant", F.lit(True))
    return ranked.join(marks, ["query_id", "item_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def chunk_encode_pool(df: DataFrame, encoder, size: int = 512, step: int = 462, prefix: str = "", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, vec): windows of tokens, each encoded with a prefix and normalised; the mean of a text's windows."""
    tokens = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda t: t != "")
    windows = df.select(F.col(id_col).alias("id"), F.posexplode(X.overlap_windows(tokens, size, step)).alias("chunk_no", "_w"))
    texts = windows.select("id", "chunk_no", F.concat(F.lit(prefix), F.array_join("_w", " ")).alias("text"))
    return V.vec_mean(V.encode(texts, "text", encoder), ["id"], "vec")


def chunk_max_sim(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k best items of a stated query set, by the largest cosine of an item's chunks
    (item_id, vec)."""
    return _best_of_batches(queries, chunks, k, several=True)


def function_features(reports: DataFrame, functions: DataFrame, pairs: DataFrame, most: int | None = 20) -> DataFrame:
    """(query_id, item_id, f1..f4): largest and mean cosine of a report's summary and description to the first ``most``
    functions of a file, by ``fn_no``, or with None to all of them. reports: query_id, summary_vec, description_vec;
    functions: item_id, fn_no, vec; pairs of files without functions get zeros."""
    taken = functions if most is None else functions.where(F.col("fn_no") < most)
    # lengths are taken once for a vector and each cosine once for a pair: files may have any number of functions
    sized = taken.select("item_id", "vec", V.norm(F.col("vec")).alias("_size"))
    asked = reports.select("*", *[V.norm(F.col(f"{c}_vec")).alias(f"_{c}_size") for c in ("summary", "description")])
    sims = pairs.join(asked, "query_id").join(sized, "item_id", "left")
    cosines = [(V.dot(F.col(f"{c}_vec"), F.col("vec")) / (F.col(f"_{c}_size") * F.col("_size") + 1e-8)).alias(f"_{c}") for c in ("summary", "description")]
    aggs = [f(x) for x in ("_summary", "_description") for f in (F.max, F.avg)]
    return sims.select("query_id", "item_id", *cosines).groupBy("query_id", "item_id").agg(*[F.coalesce(a, F.lit(0.0)).alias(f"f{k}") for k, a in enumerate(aggs, 1)])


def recall_at_k(ranked: DataFrame, truth: DataFrame, queries: DataFrame, ks: list[int], by: list[str] | None = None, denominator: str = "valid") -> DataFrame:
    """(by, k, hits, valid, recall): the share of queries with a relevant item at or above k. ``valid`` counts the queries
    that have ground truth, ``all`` every query. ``queries``: query_id and ``by``; queries that were never ranked stay
    in the denominator."""
    by = by or []
    hits = mark_relevant(ranked, truth).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_hit"))
    base = queries.select("query_id", *by).distinct()
    if denominator == "valid":
        base = base.join(truth.select("query_id").distinct(), "query_id", "left_semi")
    grid = base.join(hits, "query_id", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    out = grid.groupBy(*by, "k").agg(F.count(F.when(F.col("first_hit") <= F.col("k"), 1)).alias("hits"), F.count(F.lit(1)).alias("valid"))
    return out.withColumn("recall", F.col("hits") / F.col("valid"))


def retrieval_failures(reports: DataFrame, snapshots: DataFrame, vectors: DataFrame, report_vectors: DataFrame) -> DataFrame:
    """(reason, n): reports without a commit, without any vector in their snapshot, or without a vector of their own."""
    stocked = snapshots.join(vectors.select("blob_sha").distinct(), "blob_sha", "left_semi").select("commit_sha").distinct().withColumn("_stocked", F.lit(True))
    known = snapshots.select("commit_sha").distinct().withColumn("_known", F.lit(True))
    own = report_vectors.select("bug_id").distinct().withColumn("_own", F.lit(True))
    keyed = reports.select("bug_id", F.col("pre_fix_commit_sha").alias("commit_sha"))
    joined = keyed.join(known, "commit_sha", "left").join(stocked, "commit_sha", "left").join(own, "bug_id", "left")
    reason = F.when(F.col("_known").isNull(), "no_commit").when(F.col("_stocked").isNull(), "no_snapshot_vectors").when(F.col("_own").isNull(), "no_query_vector").otherwise("ok")
    return joined.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def ext_recall(ranks: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """(by, ext, n, mrr, recall_k..) over ground-truth files (path, rank); a missing rank counts 0."""
    shares = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    keyed = ranks.withColumn("ext", X.file_ext(F.col("path")))
    return keyed.groupBy(*by, "ext").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), *shares)


def hashed_sample(df: DataFrame, by: list[str], key: str, limit: int, seed: int = 7) -> DataFrame:
    """At most ``limit`` rows of each group, by digest of seed and key."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(X.seeded(seed, F.col(key)), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def pair_similarity(vectors: DataFrame, project: str, key: str, limit: int = 500, seed: int = 7) -> DataFrame:
    """(project_a, project_b, n_a, n_b, mean, std, median) of the cosines between samples of two projects: one matrix
    product for each pair. Samples are bounded by ``limit``, the feature of this operator, and so is a group."""
    sample = hashed_sample(vectors, [project], key, limit, seed).select(F.col(project).alias("p"), "vec")
    names = sample.select("p").distinct()
    pairs = names.select(F.col("p").alias("project_a")).join(names.select(F.col("p").alias("project_b")), F.col("project_a") < F.col("project_b"))
    both = pairs.withColumn("p", F.explode(F.array("project_a", "project_b"))).join(sample, "p")
    kind = sample.schema["p"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["project_a"].iloc[0], pdf["project_b"].iloc[0]
        one, two = (_unit(np.stack(pdf["vec"][pdf["p"] == p].to_numpy()).astype(np.float64)) for p in (a, b))
        c = one @ two.T
        return pd.DataFrame({"project_a": [a], "project_b": [b], "n_a": [len(one)], "n_b": [len(two)], "mean": [round(c.mean(), 6)], "std": [round(c.std(), 6)], "median": [round(float(np.median(c)), 6)]})

    return both.groupBy("project_a", "project_b").applyInPandas(run, f"project_a {kind}, project_b {kind}, n_a long, n_b long, mean double, std double, median double")


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights (last: bias) of a ridge logistic regression by gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(x) + ridge * w)
    return w


def domain_gap(vectors: DataFrame, project: str, key: str, limit: int = 400, test: float = 0.2, seed: int = 7) -> DataFrame:
    """(project_a, project_b, n_a, n_b, domain_gap_accuracy): how well a linear classifier tells the held-out vectors of two
    projects apart. A share ``test`` of the rows, by hash, is held out, and all of it is scored; the fit takes at most
    ``limit`` other rows of each project, by hash. One small fit for each pair; a project without vectors has no pair."""
    rows = vectors.select(F.col(project).alias("p"), F.col(key).alias("_key"), "vec").where("vec is not null").withColumn("_held", F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1000)) < int(1000 * test))
    sample = hashed_sample(rows.where("not _held"), ["p"], "_key", limit, seed).select("p", "vec")
    names = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: names.select(F.col("p").alias(f"project_{s}"), F.col("n").alias(f"n_{s}"))
    pairs = side("a").join(side("b"), F.col("project_a") < F.col("project_b"))
    each = F.explode(F.array("project_a", "project_b"))
    kind = rows.schema["p"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["project_a"].iloc[0], pdf["project_b"].iloc[0]
        x, y = np.stack(pdf["vec"].to_numpy()).astype(float), (pdf["p"] == b).to_numpy(float)
        mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
        w = _logistic((x - mean) / std, y)
        slope = w[:-1] / std
        return pd.DataFrame({"project_a": [a], "project_b": [b], "_slope": [slope.tolist()], "_base": [float(w[-1] - slope @ mean)]})

    fits = pairs.select("project_a", "project_b", each.alias("p")).join(sample, "p").groupBy("project_a", "project_b").applyInPandas(fit, f"project_a {kind}, project_b {kind}, _slope array<double>, _base double")
    asked = stored(pairs.join(fits, ["project_a", "project_b"], "left"), "gap-fits")
    scored = asked.select("project_a", "project_b", "_slope", "_base", each.alias("p")).join(rows.where("_held").select("p", "vec"), "p")
    right = (V.dot(F.col("vec"), F.col("_slope")) + F.col("_base") > 0) == (F.col("p") == F.col("project_b"))
    accuracy = scored.groupBy("project_a", "project_b").agg(F.avg(right.cast("int")).alias("domain_gap_accuracy"))
    return asked.drop("_slope", "_base").join(accuracy, ["project_a", "project_b"], "left").select("project_a", "project_b", "n_a", "n_b", "domain_gap_accuracy")


def word_vector_pool(tokens: DataFrame, table: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, vec): mean of word vectors of ``tokens`` (id, token); a word without a vector takes the mean of its parts',
    without any it is zeros. ``table``: word, vec."""
    words = tokens.select(F.col(id_col).alias("id"), "token")
    exact = words.join(table.select(F.col("word").alias("token"), F.col("vec").alias("_exact")), "token", "left")
    unknown = exact.where(F.col("_exact").isNull()).select("token").distinct()
    parts = unknown.select("token", F.explode(X.subtokens(F.col("token"))).alias("word")).join(table, "word")
    partial = V.vec_mean(parts, ["token"], "vec", "_parts")
    dim = table.agg(F.max(F.size("vec")).alias("_dim"))
    zeros = F.transform(F.sequence(F.lit(1), F.col("_dim")), lambda _: F.lit(0.0))
    filled = attach(exact.join(partial, "token", "left"), dim).select("id", F.coalesce(F.col("_exact").cast("array<double>"), F.col("_parts").cast("array<double>"), zeros).alias("vec"))
    return V.vec_mean(filled, ["id"], "vec")


def similarity_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, cosine) of every pair of two stated sets, in long form; the number of pairs is the result's."""
    left, right = a.select(F.col("id").alias("id_a"), F.col("vec").alias("_a")), b.select(F.col("id").alias("id_b"), F.col("vec").alias("_b"))
    return left.crossJoin(right).select("id_a", "id_b", V.cosine(F.col("_a"), F.col("_b"), guard=1e-10).alias("cosine"))


