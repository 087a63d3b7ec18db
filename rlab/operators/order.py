"""Order statistics of groups of any size: positions with ties, exact quantiles, average ranks, inversions.

A group is reduced to its distinct values and their counts before anything is ordered. Where these are many, Spark's range
partitioning cuts them into ranges of about ``PART_ROWS``; a running sum inside a range and the totals of the ranges before it
give every value's place, so no window, buffer or task holds a large group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlab.sources.io import stored

#: Distinct values that one window or task orders.
PART_ROWS = 1_000_000


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls of the keys are equal; keys are those of the left side."""
    there = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(Column.__and__, [left[k].eqNullSafe(there[f"_right_{k}"]) for k in keys]) if keys else F.lit(True)
    return left.join(there, same, how).drop(*[f"_right_{k}" for k in keys])


def positions(df: DataFrame, value: str, by: list[str], *more: Column, part_rows: int | None = None) -> DataFrame:
    """(by, value, n, before, total, more) of the distinct values of each group: how many rows have the value, how many a
    smaller one, how many rows the group has. ``more``: named aggregates over the rows of a value. Nulls take no part."""
    most = PART_ROWS if part_rows is None else part_rows
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *more)
    return _placed(stored(counts, "value-counts"), value, by, most)


def _placed(counts: DataFrame, value: str, by: list[str], most: int) -> DataFrame:
    keys = [F.col(k) for k in by] or [F.lit(0)]
    rows = counts.count()
    earlier = lambda *part: Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    if rows <= most:
        placed = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier(*keys)), F.lit(0)))
        return placed.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    ranged = counts.repartitionByRange(-(-rows // most), *by, value).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "value-ranges")  # written once: a range stays what it is if a task runs again
    sums = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).withColumn("total", F.sum("_sum").over(Window.partitionBy(*keys)))
    joined = join_on(ranged, sums.drop("_sum"), [*by, "_range"])
    inside = F.coalesce(F.sum("n").over(earlier(*by, "_range")), F.lit(0))
    return joined.withColumn("before", F.col("_ahead") + inside).drop("_range", "_ahead")


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float], name: str = "quantiles", part_rows: int | None = None) -> DataFrame:
    """(by, name): the exact quantiles of each group with linear interpolation, an array in the order of ``shares``, as
    Spark's ``percentile`` gives them. Groups without a value are missing. Only the values beside a quantile's place are
    picked out."""
    placed = positions(df.select(*by, F.col(value).cast("double").alias("_v")), "_v", by, part_rows=part_rows)
    at = F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("total") - 1).cast("double") * F.lit(float(q))).alias("at")) for k, q in enumerate(shares)])
    holds = lambda place: (place >= F.col("before")) & (place < F.col("before") + F.col("n"))
    picked = placed.select(*by, "_v", "before", "n", F.explode(F.filter(at, lambda s: holds(F.floor(s["at"])) | holds(F.ceil(s["at"])))).alias("_s"))
    low, high = F.floor("_s.at"), F.ceil("_s.at")
    ends = picked.groupBy(*by, "_s.k", "_s.at").agg(F.max(F.when(holds(low), F.col("_v"))).alias("_low"), F.max(F.when(holds(high), F.col("_v"))).alias("_high"))
    between = F.col("_low") * (F.ceil("at") - F.col("at")) + F.col("_high") * (F.col("at") - F.floor("at"))
    found = ends.select(*by, "k", F.when((F.floor("at") == F.ceil("at")) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise(between).alias("_q"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "_q"))), lambda s: s["_q"]).alias(name))


def average_ranks(df: DataFrame, value: str, by: list[str], name: str = "rank", part_rows: int | None = None) -> DataFrame:
    """(by, value, name): the mean rank of the rows of each distinct value, from 1, ascending."""
    placed = positions(df.select(*by, value), value, by, part_rows=part_rows)
    return placed.select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))


def rank_correlation(df: DataFrame, x: str, y: str, by: list[str], part_rows: int | None = None) -> DataFrame:
    """(by, n, rho): Pearson's correlation of average ranks, null where one side is constant. Equal pairs of values are one
    weighted row; sums are of whole numbers."""
    pairs = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w")), "value-pairs")
    for side in ("_x", "_y"):
        sums = stored(pairs.groupBy(*by, side).agg(F.sum("_w").alias("n")), "value-counts")
        placed = stored(_placed(sums, side, by, PART_ROWS if part_rows is None else part_rows).select(*by, side, (2 * F.col("before") + F.col("n") + 1).alias(f"{side}2")), "ranks")
        pairs = join_on(pairs, placed, [*by, side])
    whole = lambda *parts: F.sum(_product(*parts))
    sums = pairs.groupBy(*by).agg(F.sum("_w").alias("n"), whole("_w", "_x2").alias("a"), whole("_w", "_y2").alias("b"), whole("_w", "_x2", "_x2").alias("aa"), whole("_w", "_y2", "_y2").alias("bb"), whole("_w", "_x2", "_y2").alias("ab"))
    n, f = F.col("n").cast("double"), lambda c: F.col(c).cast("double")
    spread = lambda s, q: f(q) - f(s) * f(s) / n
    size = F.sqrt(spread("a", "aa") * spread("b", "bb"))
    return sums.select(*by, "n", F.when(size > 0, (f("ab") - f("a") * f("b") / n) / size).alias("rho"))


def _product(*names: str) -> Column:
    out = F.col(names[0]).cast("decimal(19,0)")
    for name in names[1:]:
        out = (out * F.col(name).cast("decimal(19,0)")).cast("decimal(38,0)")
    return out


def inversions(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> int:
    """The weight of pairs where the first value is smaller and the second larger, both strictly: each round merges sorted runs
    of twice the length and counts, for each row of the right half, what is larger in the left one."""
    order = np.lexsort((second, first))
    rank = np.unique(second[order], return_inverse=True)[1].astype(np.int64)
    weight = weight[order].astype(np.int64)
    n, total, size = len(rank), 0, 1
    base = int(rank.max()) + 1 if n else 1
    place = np.arange(n)
    while size < n:
        run = place // (2 * size)
        keys = run * base + rank
        left = (place // size) % 2 == 0
        left_keys, left_sums = keys[left], np.concatenate(([0], np.cumsum(weight[left])))
        ends = np.searchsorted(run[left], run[~left], side="right")
        above = np.searchsorted(left_keys, keys[~left], side="right")
        total += int(((left_sums[ends] - left_sums[above]) * weight[~left]).sum())
        merged = np.argsort(keys, kind="stable")
        rank, weight = rank[merged], weight[merged]
        size *= 2
    return total


def _count_inversions(first: str, second: str):
    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in (first, second, "_w")]
        return pa.table({"group": table.column("group")[:1], "discordant": pa.array([inversions(*columns)], pa.int64())})

    return run


def _block_inversions(pdf: pd.DataFrame) -> pd.DataFrame:
    cells = pdf[["_xb", "_yb", "_w"]].to_numpy()
    return pd.DataFrame({"group": pdf["group"].iloc[:1], "discordant": [inversions(cells[:, 0], cells[:, 1], cells[:, 2])]})


def concordance(df: DataFrame, x: str, y: str, by: list[str], part_rows: int | None = None) -> DataFrame:
    """(by, n, pairs, tied_x, tied_y, tied_both, discordant): numbers of pairs of rows of each group. Discordant pairs are
    counted in three parts: rows of one block of y by merging; rows of one block of x but several of y by merging the blocks'
    numbers; all others from the counts of (block of x, block of y). Blocks hold about ``part_rows`` rows, and a value of more
    rows is a block of its own, in which no pair is discordant. Each row moves twice."""
    most = PART_ROWS if part_rows is None else part_rows
    group = F.to_json(F.struct(*[F.col(k) for k in by], F.lit(0).alias("_"))).alias("group")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pairs = stored(rows.groupBy("group", "_x", "_y").agg(F.count(F.lit(1)).alias("_w")), "value-pairs")
    half = lambda c: F.col(c).cast("decimal(19,0)") * (F.col(c) - 1).cast("decimal(19,0)") / 2
    ties = pairs.groupBy("group").agg(F.sum("_w").alias("n"), F.sum(half("_w")).alias("tied_both"))
    for side in ("_x", "_y"):
        sums = stored(pairs.groupBy("group", side).agg(F.sum("_w").alias("n")), "value-counts")
        placed = stored(_placed(sums, side, ["group"], most), "positions")
        hot = (F.col("n") >= most).cast("long")
        block = placed.select("group", side, (2 * F.floor(F.col("before") / most) + hot).alias(f"{side}b"))
        pairs = pairs.join(block, ["group", side])
        ties = ties.join(placed.groupBy("group").agg(F.sum(half("n")).alias(f"tied{side}")), "group")
    pairs = stored(pairs, "value-blocks")
    schema = "group string, discordant long"
    odd = lambda c: F.col(c) % 2 == 1
    inside = pairs.where(~odd("_yb")).groupBy("group", "_yb").applyInArrow(_count_inversions("_x", "_y"), schema)
    across = pairs.where(~odd("_xb")).groupBy("group", "_xb", "_x", "_yb").agg(F.sum("_w").alias("_w")).groupBy("group", "_xb").applyInArrow(_count_inversions("_x", "_yb"), schema)
    cells = pairs.groupBy("group", "_xb", "_yb").agg(F.sum("_w").alias("_w")).groupBy("group").applyInPandas(_block_inversions, schema)
    discordant = inside.union(across).union(cells).groupBy("group").agg(F.sum("discordant").alias("discordant"))
    named = df.select(group, *by).distinct()
    out = ties.join(discordant, "group", "left").join(named, "group")
    n = F.col("n").cast("decimal(19,0)")
    return out.select(*by, "n", (n * (n - 1) / 2).alias("pairs"), F.col("tied_x"), F.col("tied_y"), "tied_both", F.coalesce("discordant", F.lit(0)).alias("discordant"))

