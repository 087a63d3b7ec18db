"""Filter interaction audit: what each quality filter takes away alone, after others, and in every order.

A document fails some of the five filters A to E. Of the 32 subsets of filters it survives those that hold none of the
filters it fails; these make one 32-bit truth-table word, whose bit s says whether subset s lets the document through.
Counting the ones at each of the 32 places, over all words of a part and label, gives the survivors of every subset, and
from those 32 numbers follow all 120 orders: what step k removes is the difference between the survivors of the first
k - 1 filters and of the first k. Places are counted with carry-save adders: three words become a word of sums and a word
of carries, over and over, so that a word is looked at bit by bit only when few are left.

Filters (words: maximal runs without ASCII white space, case kept): A fewer than 100 words; B fewer than 80 percent of the
words distinct; C more than 10 percent of the code points are A-Z; D one of ``#$%&*|``; E the same text as a row of a
smaller id, anywhere in the table, whether a filter removes that row or not.

Defined cases: a null text is empty; a null language and an empty one are the part ''; rows that repeat an id are documents
of their own and repeat each other only if another id is smaller; a row without id fails no E and lets no other fail; a document
is good or toxic if any label row of its id says so, null labels say nothing, labels of unknown ids are not read; an empty
table gives no rows; other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlab.llm.shared import stored

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
SUBSETS = 1 << len(FILTERS)
#: Bit s of ``WORDS[f]`` is set if a document that fails the filters f survives the subset s.
WORDS = [sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)]
#: Label classes that are counted: all documents, good ones, toxic ones.
CLASSES = ("all", "good", "toxic")
#: Parts whose counts one task holds before it gives them out.
HELD_PARTS = 1024

_WORD = r"[^ \t\n\x0B\f\r]+"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, sha) of every row: bits 0 to 3 of ``fails`` say that the text fails A, B, C, D."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("_text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text)
    words = slim.withColumn("_words", F.regexp_extract_all("_text", F.lit(_WORD), 0))
    conditions = [
        F.size("_words") < MIN_WORDS,
        100 * F.size(F.array_distinct("_words")) < MIN_DISTINCT_PERCENT * F.size("_words"),
        100 * (F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]", ""))) > MAX_CAPITAL_PERCENT * F.length("_text"),
        F.rlike("_text", F.lit("[#$%&*|]")),
    ]
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))
    return words.select("doc_id", "part", bits.alias("fails"), F.unhex(F.sha2("_text", 256)).alias("sha"))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set (32 numbers), by carry-save addition."""
    total = np.zeros(32, dtype=np.int64)
    level, weight = [words.astype(np.uint32)], 1
    while level:
        now, carries = np.concatenate(level), []
        while len(now) > 2:
            third = len(now) // 3
            a, b, c, rest = now[:third], now[third : 2 * third], now[2 * third : 3 * third], now[3 * third :]
            either = a ^ b
            carries.append((a & b) | (either & c))
            now = np.concatenate((either ^ c, rest))
        for word in now.tolist():
            total += weight * ((word >> np.arange(32)) & 1)
        level, weight = carries, 2 * weight
    return total


_COUNTS = "part string, class int, survivors array<long>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], np.ndarray] = {}

    def out() -> pa.RecordBatch:
        rows = [[k[0] for k in held], pa.array([k[1] for k in held], pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *rows[1:]], names=["part", "class", "survivors"])

    for batch in batches:
        part = batch.column("part").dictionary_encode()
        codes, names = part.indices.to_numpy(), part.dictionary.to_pylist()
        words = batch.column("word").to_numpy().astype(np.uint32)
        flags = [np.ones(len(words), bool), *(batch.column(c).to_numpy(zero_copy_only=False) for c in CLASSES[1:])]
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(names) + 1))
        for k, name in enumerate(names):
            rows = order[bounds[k] : bounds[k + 1]]
            for c, flag in enumerate(flags):
                held[name, c] = held.get((name, c), 0) + positional_counts(words[rows[flag[rows]]])
        if len(held) > HELD_PARTS * len(CLASSES):
            yield out()
            held.clear()
    yield out()


def words_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, good, toxic, fails, word) of every row of ``docs``: the filters it fails and its truth-table word."""
    slim = stored(failures(docs), "failures")
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # only texts of several rows are joined; what a hot one is joined to is a written table, so that Spark can split its rows
    first = stored(slim.groupBy("sha").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "first-ids")
    flagged = slim.join(first, "sha", "left").join(said, "doc_id", "left")
    fails = (F.col("fails") + F.when(F.col("doc_id") > F.col("_first"), 16).otherwise(0)).cast("int")
    word = F.element_at(F.array(*(F.lit(w) for w in WORDS)), fails + 1)
    return flagged.select("doc_id", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), fails.alias("fails"), word.cast("long").alias("word"))


def survivors(words: DataFrame) -> DataFrame:
    """(part, class, subset, n): documents of each part and label class that survive each subset of filters."""
    counts = words.select("part", "good", "toxic", "word").mapInArrow(_count, _COUNTS)
    spread = counts.select("part", "class", F.posexplode("survivors").alias("subset", "n"))
    return spread.groupBy("part", "class", "subset").agg(F.sum("n").alias("n"))


_AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows of each part, from its 32 counts of each class."""
    orders = list(permutations(range(len(FILTERS))))
    full = SUBSETS - 1
    for batch in batches:
        for row in batch.to_pylist():
            n = np.array([row[c] for c in CLASSES], dtype=np.int64)
            rows = []
            shapley = np.zeros(len(FILTERS), dtype=np.int64)
            for order in orders:
                before = 0
                for step, f in enumerate(order, 1):
                    after = before | 1 << f
                    lost = n[:, before] - n[:, after]
                    shapley[f] += lost[0]
                    redundant = n[0, 0] - n[0, 1 << f] - lost[0]
                    unique = n[0, full ^ 1 << f] - n[0, full]
                    rows.append(("".join(FILTERS[k] for k in order), step, f, n[0, after], lost[0], redundant, unique, lost[1], lost[2]))
                    before = after
            columns = [pa.array([row["part"]] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())]
            columns += [pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(3, 9)] + [pa.array([int(shapley[r[2]]) for r in rows], pa.int64())]
            names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step."""
    counted = survivors(words_of(docs, labels))
    by_class = [F.array(*(F.sum(F.when((F.col("class") == c) & (F.col("subset") == s), F.col("n")).otherwise(0)) for s in range(SUBSETS))).alias(name) for c, name in enumerate(CLASSES)]
    return counted.groupBy("part").agg(*by_class).mapInArrow(_orders, _AUDIT)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents
), f AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, e
  FROM d
), t AS (
  SELECT part, [a, b, c, d, e] AS fails, coalesce(l.quality, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS quality, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM t GROUP BY ALL
), o AS (
  SELECT [a, b, c, d, e] AS o FROM range(1, 6) x(a), range(1, 6) y(b), range(1, 6) z(c), range(1, 6) u(d), range(1, 6) v(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5
), s AS (
  SELECT o, unnest(range(1, 6)) AS step FROM o
), r AS (
  SELECT part, o, step, o[step] AS x,
         sum(n) FILTER (NOT list_has_any([true], list_transform(o[1 : step], lambda k: fails[k]))) AS kept,
         sum(n) FILTER (fails[o[step]] AND NOT list_has_any([true], list_transform(o[1 : step - 1], lambda k: fails[k]))) AS removed,
         sum(n) FILTER (fails[o[step]] AND list_has_any([true], list_transform(o[1 : step - 1], lambda k: fails[k]))) AS redundant,
         sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda v: v)) = 1) AS unique_fails,
         sum(good) FILTER (fails[o[step]] AND NOT list_has_any([true], list_transform(o[1 : step - 1], lambda k: fails[k]))) AS good_lost,
         sum(toxic) FILTER (fails[o[step]] AND NOT list_has_any([true], list_transform(o[1 : step - 1], lambda k: fails[k]))) AS toxic_lost
  FROM g CROSS JOIN s GROUP BY part, o, step
)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
