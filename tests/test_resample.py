"""Bootstrap by counts down a tree against plain draws."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rlab.operators import resample as B
from rlab.operators import stats as T


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(2)
    return {"a": rng.normal(0.2, 1, 400).round(3).tolist(), "b": [1.0, 2.0, 2.0, 5.0], None: rng.normal(0, 1, 30).tolist(), "one": [3.0]}


@pytest.fixture(scope="module")
def frame(spark, values):
    return spark.createDataFrame([(g, v) for g, own in values.items() for v in own] + [("b", None)], "g string, delta double").repartition(4).cache()


@pytest.mark.parametrize("leaf", [16, None])
def test_every_resample_has_all_rows_of_its_group(frame, values, leaf):
    got = B.resampled_sums(frame, "delta", ["g"], 300, 5, leaf).collect()
    assert len(got) == 300 * len(values)
    for r in got:
        own = values[r.g]
        assert r.drawn == r.n == len(own) and min(own) * r.n - 1e-6 <= r.s <= max(own) * r.n + 1e-6
    for g, own in values.items():
        sums = np.array([r.s for r in got if r.g == g]) / len(own)
        error = np.std(own) / np.sqrt(len(own))
        assert abs(sums.mean() - np.mean(own)) <= 5 * error / np.sqrt(300) and abs(sums.std() - error) <= 0.25 * error


def test_draws_do_not_depend_on_partitions(frame):
    one, two = (sorted(map(str, B.resampled_sums(f, "delta", ["g"], 50, 5, 16).collect())) for f in (frame.coalesce(1), frame.repartition(7)))
    assert one == two


def test_leaves_of_a_tree_share_out_all_draws():
    masses = np.array([5, 0, 3, 7, 1, 1, 8, 2])
    mass = lambda level, node: int(masses[node << 3 - level : node + 1 << 3 - level].sum())
    drawn = []
    for leaf in range(8):
        path = [(mass(level, leaf >> 3 - level), mass(level + 1, leaf >> 3 - level << 1), bool(leaf >> 2 - level & 1)) for level in range(3)]
        drawn.append(B.leaf_draws(9, path, 27, 4000))
    drawn = np.array(drawn)
    assert (drawn.sum(axis=0) == 27).all() and not drawn[1].any()
    assert np.abs(drawn.mean(axis=1) - masses).max() < 0.25
    variance = masses * (1 - masses / 27)
    assert np.abs(drawn.var(axis=1) - variance).max() < 0.1 * variance.max()


def test_interval_is_that_of_plain_resampling(frame, values):
    got = {r.g: (r.low, r.high, r.n_boot) for r in T.bootstrap_ci(frame, ["g"], 4000).collect()}
    rng = np.random.default_rng(7)
    own = np.array(values["a"])
    drawn = own[rng.integers(0, len(own), (4000, len(own)))]
    dz = drawn.mean(axis=1) / drawn.std(axis=1, ddof=1)
    assert got["a"][:2] == pytest.approx(np.quantile(dz, [0.025, 0.975]), abs=0.02) and got["a"][2] == 4000
    assert got["one"] == (None, None, 0) and abs(got["b"][2] - 4000 * (1 - 1 / 16 - 2 / 256)) < 60  # the others have no spread


def test_large_groups_are_cut_into_leaves(spark):
    df = spark.range(20_000).select(F.lit("x").alias("g"), (F.rand(3) - 0.4).alias("delta"))
    rows = B.resampled_sums(df, "delta", ["g"], 20, 1, leaf=512).collect()
    assert all(r.drawn == 20_000 for r in rows) and abs(np.mean([r.s for r in rows]) / 20_000 - 0.1) < 0.01
