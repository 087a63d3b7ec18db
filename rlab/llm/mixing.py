"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent between 0 (uniform) and 1 (as it is) and normalised. The
exponent is bisected: the largest that gives at least the target entropy, raised where a source would be repeated more
than the repetition limit allows. The weights are realised as budgeted block permutations: a source's quota is its
weight times the token budget; its documents are laid out in seeded permutations, one whole block after another, and
the last block is cut where the next document would exceed the quota. Each take has its block and its place there.

Tokens are counted once, into a slim table. Places and running sums come from earlier hash buckets of the block (a small
table) plus a window inside one bucket, so a source with a third of all rows is spread over many tasks. The driver sees
one row for each distinct token count of a source, of which there are at most the square root of twice all tokens.

Defined cases: a null source is a source of its own; a null or empty text has no tokens and costs nothing; a source
without tokens keeps one block; repeated rows are rows of their own; an empty table gives no rows; extra columns of any
name and type are kept by ``mix``. Rows that share id, source and text are taken evenly in one task, as a stream.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlab.llm.shared import stored

TARGET_ENTROPY = 0.95
MAX_REPEATS = 4.0
SEED = 23
BUCKET_ROWS = 10_000


def _largest(holds, low: float, high: float) -> float:
    """The largest exponent in [low, high] for which ``holds`` is true; it is true at and below some point."""
    if holds(high):
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def exponent_for(sizes: list[tuple[int, int]], budget: float, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> tuple[float, float]:
    """The exponent and the sum of all raised shares, from (tokens of a source, number of such sources).
    ``target_entropy`` is a share of the largest entropy possible. The repetition limit wins where both cannot be met; it
    is met at exponent 1 unless the budget itself exceeds it."""
    found = [(t, k) for t, k in sorted(sizes) if t > 0]
    total = sum(t * k for t, k in found)
    if not total:
        return 1.0, 1.0
    shares = [(t / total, k) for t, k in found]
    norm = lambda x: sum(k * s**x for s, k in shares)

    def entropy(x: float) -> float:
        z = norm(x)
        return -sum(k * (s**x / z) * math.log(s**x / z) for s, k in shares)

    goal = target_entropy * math.log(sum(k for _, k in shares))
    even = _largest(lambda x: entropy(x) >= goal - 1e-12, 0.0, 1.0)
    repeats = lambda x: max(s**x / norm(x) * budget / (s * total) for s, _ in (shares[0], shares[-1]))
    mirrored = _largest(lambda y: repeats(1.0 - y) <= max_repeats + 1e-9, 0.0, 1.0)
    exponent = max(even, 1.0 - mirrored)
    return exponent, norm(exponent)


def temperature(tokens: dict[str, int], budget: float, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> tuple[float, dict[str, float]]:
    """The exponent and the weight of every source (see ``exponent_for``)."""
    total = sum(tokens.values())
    exponent, norm = exponent_for(list(Counter(tokens.values()).items()), budget, target_entropy, max_repeats)
    return exponent, {n: (t / total) ** exponent / norm if t else 0.0 for n, t in tokens.items()}


def n_tokens(text: Column) -> Column:
    """Tokens of a text: its runs of anything but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def plan(docs: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(_src, _n, _total, _weight, _whole, _rest) of every source: rows, tokens, weight, whole blocks and tokens of the cut
    block; ``docs`` has _src, _tokens."""
    sources = stored(docs.groupBy("_src").agg(F.count(F.lit(1)).alias("_n"), F.sum("_tokens").alias("_total")), "sources")
    sizes = [(r["_total"], r["k"]) for r in sources.groupBy("_total").agg(F.count(F.lit(1)).alias("k")).collect()]
    total = sum(t * k for t, k in sizes)
    budget = total if budget is None else budget
    exponent, norm = exponent_for(sizes, budget, target_entropy, max_repeats)
    some = F.col("_total") > 0
    weight = F.when(some, F.pow(F.col("_total") / F.lit(float(max(1, total))), F.lit(exponent)) / F.lit(norm)).otherwise(F.lit(0.0))
    planned = sources.withColumn("_weight", weight).withColumn("_quota", F.floor(F.col("_weight") * F.lit(float(budget))).cast("long"))
    whole, rest = F.when(some, F.expr("_quota div _total")).otherwise(F.lit(1)), F.when(some, F.col("_quota") % F.col("_total")).otherwise(F.lit(0))
    return planned.select("_src", "_n", "_total", "_weight", whole.cast("long").alias("_whole"), rest.cast("long").alias("_rest"))


def mix_rows(docs: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """``docs`` (_src, _tokens, _text, _id and others; a written table) with a row for each time that a row is taken: adds
    _block (0-based), _place (0-based rank in the block's permutation) and _weight."""
    sources = plan(docs, budget, target_entropy, max_repeats)
    rows = docs.join(sources, "_src").withColumn("_last", F.col("_whole") - (F.col("_rest") == 0).cast("long")).where("_last >= 0")
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "_block", "_id", "_text"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_n") / BUCKET_ROWS))
    rows = rows.withColumn("_b", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * buckets).cast("long"))
    key = ["_src", "_block", "_b"]
    sums = rows.groupBy(*key).agg(F.sum("_tokens").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_src", "_block").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    ahead = sums.select(*key, before("_sum").alias("_ahead"), before("_rows").alias("_first"))
    order = Window.partitionBy(*key).orderBy("_h", "_id", "_text")
    upto = F.sum("_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_upto", upto).withColumn("_in", F.row_number().over(order)).join(ahead, key)
    inside = (F.col("_block") < F.col("_whole")) | (F.col("_ahead") + F.col("_upto") <= F.col("_rest"))
    return placed.where(inside).select(*docs.columns, "_block", (F.col("_first") + F.col("_in") - 1).alias("_place"), "_weight")


def _key(docs: DataFrame) -> list[Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit("\x00null"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return [number.alias("_id"), source.alias("_src"), F.xxhash64("text").alias("_text")]


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mixture, all columns; a document taken k times stands in k rows. The texts are joined to
    the plan once, at the end. Rows that share id, source and text share their takes evenly."""
    key = ["_id", "_src", "_text"]
    slim = stored(docs.select(*_key(docs), n_tokens(F.col("text")).alias("_tokens")), "tokens")
    taken = mix_rows(slim, **how).groupBy(*key).agg(F.count(F.lit(1)).alias("_taken"))
    rows = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    joined = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *_key(docs)).join(taken.join(rows, key), key)
    spare = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))) <= F.col("_taken") % F.col("_rows")
    each = joined.withColumn("_each", F.floor(F.col("_taken") / F.col("_rows")).cast("long") + spare.cast("long")).where(F.col("_each") > 0)
    return each.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_each")))).select("_row.*")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, n_tokens, block, block_order, weight): every take of every document; block_order is its 0-based
    place in the permutation of the block."""
    slim = stored(docs.select("doc_id", "source", *_key(docs), n_tokens(F.col("text")).alias("_tokens")), "tokens")
    taken = mix_rows(slim, **how)
    return taken.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_block").alias("block"), F.col("_place").alias("block_order"), F.col("_weight").alias("weight"))
