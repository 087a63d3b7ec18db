"""Order statistics against plain versions, with windows of a few values and groups of all rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rlab.operators import order as O
from rlab.operators import rank as K
from rlab.operators import stats as T

SMALL = 7


@pytest.fixture(scope="module")
def data():
    """A group of two thirds of the rows, small ones, a null group, ties, a value of very many rows, nulls."""
    rng = random.Random(6)
    rows = [("big", rng.choice([0.5, 0.5, 0.5, float(rng.randrange(40)), rng.random()]), float(rng.randrange(25))) for _ in range(300)]
    rows += [(g, rng.choice([None, float(rng.randrange(4)), -0.0]), rng.choice([None, 1.0, rng.random()])) for g in ("a", "b", None) for _ in range(12)]
    return [*rows, ("one", 3.0, 3.0), ("same", 2.0, 1.0), ("same", 2.0, 4.0), ("none", None, None)]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "g string, x double, y double").repartition(5).cache()


def grouped(data):
    out = {}
    for g, x, y in data:
        out.setdefault(g, []).append((x, y))
    return out


@pytest.mark.parametrize("part_rows", [SMALL, None])
def test_positions(frame, data, part_rows):
    got = {(r.g, r.x): (r.n, r.before, r.total) for r in O.positions(frame, "x", ["g"], part_rows=part_rows).collect()}
    want = {}
    for g, rows in grouped(data).items():
        own = [x + 0.0 for x, _ in rows if x is not None]
        want |= {(g, x): (own.count(x), sum(v < x for v in own), len(own)) for x in own}
    assert got == want


@pytest.mark.parametrize("part_rows", [SMALL, None])
def test_quantiles_are_those_of_percentile(frame, part_rows):
    shares = [0.0, 0.1, 1.0 / 3, 0.5, 0.75, 0.95, 1.0]
    got = {r.g: r.q for r in O.quantiles(frame, "x", ["g"], shares, "q", part_rows).collect()}
    want = {r.g: r.q for r in frame.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).where("q is not null").collect()}
    assert got == want
    assert O.quantiles(frame, "x", [], [0.5], "q", part_rows).first().q == [frame.agg(F.percentile("x", F.lit(0.5))).first()[0]]
    assert O.quantiles(frame.where("false"), "x", ["g"], [0.5], "q", part_rows).collect() == []


def test_windows_stay_below_their_bound(frame):
    placed = O.positions(frame, "x", ["g"], part_rows=SMALL)
    ranged = frame.where("x is not null").groupBy("g", "x").count()
    parts = -(-ranged.count() // SMALL)
    assert parts > 8 and placed.where("g = 'big'").count() > SMALL
    assert placed.where("g = 'big' and n > 50").count() == 1  # a value of very many rows is one row


@pytest.mark.parametrize("part_rows", [SMALL, None])
def test_average_ranks(frame, data, part_rows):
    got = {(r.g, r.x): r["rank"] for r in O.average_ranks(frame, "x", ["g"], part_rows=part_rows).collect()}
    for g, rows in grouped(data).items():
        own = sorted(x for x, _ in rows if x is not None)
        for x in set(own):
            assert got[g, x + 0.0] == np.mean([k for k, v in enumerate(own, 1) if v == x])
    ranked = K.avg_rank(frame, "x", ["g"])
    assert ranked.count() == len(data) and all((r["x"] is None) == (r["rank"] is None) for r in ranked.collect())


def plain_ranks(values):
    own = sorted(values)
    return [np.mean([k for k, v in enumerate(own) if v == x]) for x in values]


@pytest.mark.parametrize("part_rows", [SMALL, None])
def test_rank_correlation(frame, data, part_rows):
    got = {r.g: (r.n, r.rho) for r in O.rank_correlation(frame, "x", "y", ["g"], part_rows).collect()}
    for g, rows in grouped(data).items():
        pairs = [(x, y) for x, y in rows if x is not None and y is not None]
        if not pairs:
            assert g not in got
            continue
        a, b = (np.array(plain_ranks(side)) for side in zip(*pairs, strict=True))
        assert got[g][0] == len(pairs)
        assert got[g][1] == (pytest.approx(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else None)


@pytest.mark.parametrize("part_rows", [1, SMALL, None])
def test_concordance_by_all_pairs(frame, data, part_rows):
    got = {r.g: tuple(map(int, r[1:])) for r in O.concordance(frame, "x", "y", ["g"], part_rows).collect()}
    for g, rows in grouped(data).items():
        pairs = [(x, y) for x, y in rows if x is not None and y is not None]
        if not pairs:
            assert g not in got
            continue
        want = [len(pairs), 0, 0, 0, 0, 0]
        for (a, b), (c, d) in itertools.combinations(pairs, 2):
            want = [want[0], want[1] + 1, want[2] + (a == c), want[3] + (b == d), want[4] + (a == c and b == d), want[5] + ((a - c) * (b - d) < 0)]
        assert got[g] == tuple(want)


def test_tau_by_all_pairs(frame, data):
    got = {r.g: (r.n, r.tau) for r in T.kendall_tau(frame, "x", "y", ["g"]).collect()}
    for g, rows in grouped(data).items():
        pairs = [(x, y) for x, y in rows if x is not None and y is not None]
        if len(pairs) < 2:
            assert g not in got
            continue
        sign = [(np.sign(a - c), np.sign(b - d)) for (a, b), (c, d) in itertools.combinations(pairs, 2)]
        size = np.sqrt(sum(abs(s) for s, _ in sign) * sum(abs(t) for _, t in sign))
        assert got[g] == (len(pairs), pytest.approx(sum(s * t for s, t in sign) / size) if size else None)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 64, 301])
def test_weighted_inversions(n):
    rng = np.random.default_rng(n)
    a, b, w = rng.integers(0, 20, n), rng.integers(0, 9, n), rng.integers(1, 5, n)
    assert O.inversions(a, b, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if a[i] < a[j] and b[i] > b[j])
