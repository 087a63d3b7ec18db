"""Bootstrap of groups of any size: how often each row is drawn comes down a tree, no row is drawn by itself.

A group is reduced to its distinct values with their counts. A resample of n rows draws each value a number of times that is
multinomial, with the values' shares. Values are dealt by hash into leaves of about ``LEAF`` values; a node of the binary tree
above them hands its draws to its two sides by a binomial of their shares. Draws are seeded by group and node and made for all
resamples at once, so every leaf finds its own number of draws by walking down from the root, with the masses beside its path:
nothing but (leaf, sums) leaves a task, and no task holds more than a leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlab.operators.order import join_on
from rlab.sources.io import stored

#: Distinct values of a leaf, about.
LEAF = 2048
#: Counts (resamples x values) that a task draws at once.
_CELLS = 1 << 20


def leaf_draws(seed: int, path: list[tuple[int, int, bool]], n: int, n_boot: int) -> np.ndarray:
    """Draws that reach a leaf in each resample. ``path``: mass of a node, of its left side, and whether the leaf is on the
    right, from the root down."""
    draws, node = np.full(n_boot, n, dtype=np.int64), 1
    for mass, left, right in path:
        taken = np.random.default_rng((seed, node)).binomial(draws, left / mass if mass else 0.0)
        draws = draws - taken if right else taken
        node = 2 * node + right
    return draws


def leaf_counts(seed: int, leaf: int, draws: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of (first resample, times each value is drawn)."""
    rng = np.random.default_rng((seed, 0, leaf))
    shares = counts / counts.sum()
    each = max(1, _CELLS // len(counts))
    for at in range(0, len(draws), each):
        yield at, rng.multinomial(draws[at : at + each], shares)


def _resample(n_boot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, counts = np.array(row["values"]), np.array(row["counts"])
                right = [bool(row["leaf"] >> k & 1) for k in range(len(row["path"]) - 1, -1, -1)]
                path = [(p["mass"], p["left"], r) for p, r in zip(row["path"], right, strict=True)]
                seed = row["seed"] & (1 << 63) - 1
                draws, sums, squares = leaf_draws(seed, path, row["n"], n_boot), np.zeros(n_boot), np.zeros(n_boot)
                for at, drawn in leaf_counts(seed, row["leaf"], draws, counts):
                    sums[at : at + len(drawn)], squares[at : at + len(drawn)] = drawn @ values, drawn @ values**2
                columns = [pa.array(np.full(n_boot, row["group"])), pa.array(np.arange(n_boot)), pa.array(draws), pa.array(sums), pa.array(squares)]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "boot", "drawn", "s", "q"])

    return run


def resampled_sums(df: DataFrame, value: str, by: list[str], n_boot: int, seed: int, leaf: int | None = None) -> DataFrame:
    """(by, n, boot, drawn, s, q): of each resample of a group its rows (drawn, always n), their sum and sum of squares. Leaves
    are added up as decimals of 12 places, so that results do not hang on their order."""
    each = LEAF if leaf is None else leaf
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = stored(counts, "value-counts")
    groups = stored(counts.groupBy(*by).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("_values")).withColumn("group", F.monotonically_increasing_id()), "groups")
    most = groups.agg(F.max("_values")).first()[0] or 0
    depth = max(0, -(-most // each) - 1).bit_length()
    dealt = join_on(counts, groups.select(*by, "group"), by).withColumn("leaf", F.shiftrightunsigned(F.xxhash64("_v"), 64 - depth).cast("long") if depth else F.lit(0).cast("long"))
    leaves = dealt.groupBy("group", "leaf").agg(F.array_sort(F.collect_list(F.struct("_v", "_n"))).alias("_all"), F.sum("_n").alias("_mass"))
    leaves = stored(leaves, "leaves").withColumn("path", F.array().cast("array<struct<mass:long,left:long>>"))
    masses = stored(leaves.select("group", "leaf", "_mass"), "leaf-masses")
    for level in range(depth):  # the root's split first
        node = F.shiftright("leaf", depth - level)
        on_left = F.shiftright("leaf", depth - level - 1) % 2 == 0
        sides = masses.groupBy("group", node.alias("_node")).agg(F.sum("_mass").alias("mass"), F.coalesce(F.sum(F.when(on_left, F.col("_mass"))), F.lit(0)).alias("left"))
        leaves = leaves.withColumn("_node", node).join(sides, ["group", "_node"]).withColumn("path", F.concat("path", F.array(F.struct("mass", "left")))).drop("_node", "mass", "left")
    named = join_on(groups.select("group", "n", F.xxhash64(F.lit(seed), *by).alias("seed")), leaves, ["group"])
    rows = named.select("group", "n", "seed", "leaf", "path", F.col("_all._v").alias("values"), F.col("_all._n").alias("counts"))
    sums = rows.repartition("group", "leaf").mapInArrow(_resample(n_boot), "group long, boot long, drawn long, s double, q double")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,12)")).cast("double").alias(c)
    total = sums.groupBy("group", "boot").agg(F.sum("drawn").alias("drawn"), whole("s"), whole("q"))
    return total.join(groups.select("group", "n", *by), "group").select(*by, "n", "boot", "drawn", "s", "q")
