"""Learned weights against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rlab.operators import weighting as G

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    """a tells the label, b tells it half, c is noise."""
    rng = random.Random(3)
    rows = []
    for q in range(24):
        for i in range(20):
            label = int(rng.random() < 0.2)
            rows.append((q, i, label, round(5 * label + rng.random() * 4, 3), round(label * rng.randint(0, 1) + rng.random(), 3), round(rng.random(), 3)))
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "query_id int, item_id int, label int, a double, b double, c double").repartition(4).cache()


def test_scaling_takes_the_range_of_the_training_rows(frame, data):
    got = {(r.query_id, r.item_id): r.a for r in G.scaled(frame, F.col("query_id") % 2 == 1, ["a"]).collect()}
    own = [r[3] for r in data if r[0] % 2 == 1]
    for q, i, _, a, *_ in data:
        assert got[q, i] == pytest.approx(min(1, max(0, (a - min(own)) / (max(own) - min(own)))), abs=1e-8)


def test_chi_squared_and_information_by_counting(frame, data):
    rows = G.scaled(frame, F.lit(True), FEATURES)
    table = np.array([[r.label, r.a, r.b, r.c] for r in rows.collect()])
    y, x = table[:, 0], table[:, 1:]
    chi, info = [], []
    for k in range(3):
        want = [x[:, k].sum() * (y == v).mean() for v in (0, 1)]
        chi.append(sum((x[y == v, k].sum() - w) ** 2 / w for v, w in zip((0, 1), want, strict=True)))
        bins = np.minimum(9, np.floor(x[:, k] * 10))
        info.append(sum(p * np.log(p / (bins == b).mean() / (y == v).mean()) for b in set(bins) for v in (0, 1) if (p := ((bins == b) & (y == v)).mean())))
    assert G.chi_squared(rows, FEATURES) == pytest.approx(chi) and G.mutual_information(rows, FEATURES) == pytest.approx(info)
    assert G.weighting(rows, FEATURES, "chi2") == pytest.approx(np.array(chi) / sum(chi))
    assert G.weighting(rows.where("label = 0"), FEATURES, "chi2") == pytest.approx([1 / 3] * 3)


@pytest.mark.parametrize("kind", G.REGRESSORS)
def test_lines_solve_their_problem(frame, kind):
    rows = G.scaled(frame, F.lit(True), FEATURES)
    table = np.array([[r.a, r.b, r.c, 1.0, r.label] for r in rows.collect()])
    x, y, n = table[:, :4], 0.3 * table[:, 0] + table[:, 4], len(table)
    w = np.array(G.regression(rows, FEATURES, F.col("a") * 0.3 + F.col("label"), kind))
    slopes, off = np.array([1, 1, 1, 0]), x @ w - y
    if kind == "huber":
        weight = np.minimum(1, 1.35 * np.abs(off).mean() / np.maximum(np.abs(off), 1e-12))
        other = np.linalg.solve(x.T @ (x * weight[:, None]) + G.RIDGE * weight.sum() * np.diag(slopes), x.T @ (weight * y))
        assert w == pytest.approx(other, abs=1e-3)
    elif kind == "bayesian_ridge":
        plain = np.linalg.lstsq(x, y, rcond=None)[0]
        assert w == pytest.approx(plain, abs=0.05) and (off**2).mean() == pytest.approx(((x @ plain - y) ** 2).mean(), rel=1e-2)
    else:
        squares, sizes = {"linear": (1e-9, 0), "ridge": (G.RIDGE, 0), "lasso": (0, G.LASSO), "elastic_net": (G.RIDGE / 2, G.LASSO / 2)}[kind]
        loss = lambda v: 0.5 * ((x @ v - y) ** 2).sum() + n * (0.5 * squares * (v**2 * slopes).sum() + sizes * (np.abs(v) * slopes).sum())
        rng = np.random.default_rng(1)
        assert all(loss(w) <= loss(w + rng.normal(0, s, 4)) + 1e-9 for s in (0.3, 0.01, 1e-4) for _ in range(50))


def test_average_precision_by_hand(frame, data):
    got = {(r.method, r.n_queries): r.map for r in G.mean_average_precision(frame, {"up": F.col("a"), "down": -F.col("a"), "flat": F.lit(1.0)}, []).collect()}
    for method, key in {"up": lambda r: (-r[3], r[1]), "down": lambda r: (r[3], r[1]), "flat": lambda r: r[1]}.items():
        found = []
        for q in {r[0] for r in data}:
            order = sorted((r for r in data if r[0] == q), key=key)
            places = [k for k, r in enumerate(order, 1) if r[2]]
            if places:
                found.append(np.mean([h / k for h, k in enumerate(places, 1)]))
        assert got[method, len(found)] == pytest.approx(np.mean(found))


def test_the_telling_feature_wins_and_folds_are_apart(frame):
    rows = G.adaptive_weights(frame, FEATURES, F.col("query_id") % 2).collect()
    assert len(rows) == 2 * (len(G.WEIGHTINGS) + len(G.REGRESSORS))
    for k in range(2):
        own = {r.method: r for r in rows if r.fold == k}
        for method in ("chi2", "mutual_information", "forest", "boosting", "ridge", "huber"):
            assert np.argmax(own[method].weights) == 0
        for method in G.WEIGHTINGS:
            assert sum(own[method].weights) == pytest.approx(1)
        chosen = [r for r in own.values() if r.chosen]
        assert len(chosen) == 1 and chosen[0].map_train == max(round(r.map_train, 9) for r in own.values()) and chosen[0].map_test > 0.9 > own["constant"].map_test - 0.1
    # a fold's weights come from the other fold alone
    one = {r.method: r.weights for r in rows if r.fold == 0}
    changed = frame.withColumn("a", F.when(F.col("query_id") % 2 == 0, F.rand(1)).otherwise(F.col("a")))
    again = {r.method: r.weights for r in G.adaptive_weights(changed, FEATURES, F.col("query_id") % 2, weightings=("chi2",), regressors=()).collect() if r.fold == 0}
    assert again["chi2"] == pytest.approx(one["chi2"])


def test_no_relevant_rows_no_weights(frame):
    assert G.adaptive_weights(frame.withColumn("label", F.lit(0)), FEATURES, F.col("query_id") % 2).collect() == []
