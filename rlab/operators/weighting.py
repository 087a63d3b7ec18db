"""Learned weights of ranking features, from aggregates.

Candidates of queries carry features and a label. Queries fall into folds; each fold is judged with weights that were
learned on the others. Weightings are importances of features (of a forest, of boosted trees, chi-squared, mutual information,
all alike); a weighting's score is the weighted sum of the features, scaled to 0..1. Regressors then fit a line to the score of
the best weighting, raised by its largest size where a row is relevant. The best weighting is that of the largest mean average
precision on the queries it was learned on, and a regressor takes its place only where it does at least as well there.

Everything comes from sums over rows (sums by label, counts of bins, sums of products) and so grows with features, not rows;
only the trees, which are Spark's own, read the rows themselves. No group holds the rows of a fold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlab.sources.io import stored

BINS = 10
WEIGHTINGS = ("boosting", "chi2", "constant", "forest", "mutual_information")
REGRESSORS = ("bayesian_ridge", "elastic_net", "huber", "lasso", "linear", "ridge")
#: Strength of the penalty on squares (ridge, elastic net) and on sizes (lasso, elastic net), for each row.
RIDGE, LASSO = 0.01, 0.001
PLACES = 9


def scaled(rows: DataFrame, train: Column, features: list[str]) -> DataFrame:
    """Features scaled to 0..1 by their range on the rows of ``train``; what lies beyond it is cut, a constant one is 0."""
    bounds = rows.where(train).agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for k, c in enumerate(features):
        low, high = bounds[f"lo{k}"], bounds[f"hi{k}"]
        value = F.lit(0.0) if low is None or high <= low else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - float(low)) / (float(high) - float(low))))
        rows = rows.withColumn(c, F.round(value, PLACES))
    return rows


def _sum(value: Column) -> Column:
    """A sum of doubles over whole units of 1e-9, which does not hang on the order of rows."""
    return F.sum(F.round(1e9 * value).cast("decimal(38,0)")).cast("double") / 1e9


def chi_squared(rows: DataFrame, features: list[str]) -> list[float]:
    """Of each feature: how far its sums over relevant and other rows are from their shares of all rows."""
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[_sum(F.col(c)).alias(f"s{k}") for k, c in enumerate(features)]).collect()
    total, out = sum(r.n for r in sums), []
    for k in range(len(features)):
        whole = sum(r[f"s{k}"] for r in sums)
        out.append(sum((r[f"s{k}"] - whole * r.n / total) ** 2 / (whole * r.n / total) for r in sums) if whole else 0.0)
    return out


def mutual_information(rows: DataFrame, features: list[str], bins: int = BINS) -> list[float]:
    """Of each feature, cut into equal bins: nats that it tells of the label."""
    bin_of = F.least(F.lit(bins - 1), F.floor(F.col("value") * bins))
    tall = rows.select("label", *features).unpivot(["label"], features, "feature", "value")
    counts = tall.groupBy("feature", "label", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = []
    for c in features:
        own = [r for r in counts if r.feature == c]
        total = sum(r.n for r in own)
        side = lambda key, value: sum(r.n for r in own if r[key] == value)  # noqa: B023, E731
        out.append(max(0.0, sum(r.n / total * np.log(r.n * total / side("label", r.label) / side("bin", r.bin)) for r in own)) if total else 0.0)
    return out


def tree_importances(rows: DataFrame, features: list[str], kind: str, seed: int = 5) -> list[float]:
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    table = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.select(*features, F.col("label").cast("double").alias("_y")))
    make = {"forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed), "boosting": lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=seed)}[kind]
    model = make().setFeaturesCol("_x").setLabelCol("_y").fit(table)
    return model.featureImportances.toArray().tolist()


def weighting(rows: DataFrame, features: list[str], kind: str) -> list[float]:
    """Weights of one kind, which add up to 1; all alike where nothing tells features apart."""
    if kind in ("forest", "boosting"):
        found = tree_importances(rows, features, kind) if rows.select("label").distinct().count() > 1 else [0.0] * len(features)
    else:
        found = {"constant": lambda: [1.0] * len(features), "chi2": lambda: chi_squared(rows, features), "mutual_information": lambda: mutual_information(rows, features)}[kind]()
    total = sum(found)
    return [w / total for w in found] if total > 0 else [1 / len(features)] * len(features)


def linear(features: list[str], weights: list[float]) -> Column:
    """A weighted sum; a further weight is the constant."""
    constant = weights[len(features)] if len(weights) > len(features) else 0.0
    return sum((F.col(c) * float(w) for c, w in zip(features, weights, strict=False)), F.lit(float(constant)))


def gram(rows: DataFrame, features: list[str], target: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Sums of products of features and the constant, of these with the target, of the squared target, and of weights."""
    w = F.lit(1.0) if weight is None else weight
    x = [*[F.col(c) for c in features], F.lit(1.0)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = rows.agg(*[_sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs], *[_sum(w * c * target).alias(f"t{i}") for i, c in enumerate(x)], _sum(w * target * target).alias("yy"), _sum(w).alias("n")).first()
    g = np.zeros((len(x), len(x)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, np.array([row[f"t{i}"] or 0.0 for i in range(len(x))]), row["yy"] or 0.0, row["n"] or 0.0


def _penalised(g: np.ndarray, t: np.ndarray, each: float) -> np.ndarray:
    """The line of least squares with a penalty on the squares of its slopes, not of its constant."""
    penalty = each * np.eye(len(t))
    penalty[-1, -1] = 0.0
    return np.linalg.lstsq(g + penalty, t, rcond=None)[0]


def _descent(g: np.ndarray, t: np.ndarray, squares: float, sizes: float, rounds: int = 2000) -> np.ndarray:
    """Coordinate descent on sums of products with penalties on squares and sizes of slopes."""
    w = np.zeros(len(t))
    for _ in range(rounds):
        before = w.copy()
        for k in range(len(t)):
            slope = k < len(t) - 1
            left = t[k] - g[k] @ w + g[k, k] * w[k]
            cut = np.sign(left) * max(0.0, abs(left) - sizes * slope)
            size = g[k, k] + squares * slope
            w[k] = cut / size if size else 0.0
        if np.abs(w - before).max() < 1e-12:
            break
    return w


def _evidence(g: np.ndarray, t: np.ndarray, yy: float, n: float, rounds: int = 300) -> np.ndarray:
    """Bayesian ridge on centred sums: the penalty is found from the data, as a ratio of precisions."""
    mean, total = g[-1, :-1] / n, t[-1] / n
    c, b, rest = g[:-1, :-1] - n * np.outer(mean, mean), t[:-1] - n * mean * total, max(0.0, yy - n * total**2)
    values, vectors = np.linalg.eigh(c)
    values = np.maximum(values, 0)
    noise, prior = 1.0 / max(rest / n, 1e-12), 1.0
    w = np.zeros(len(b))
    for _ in range(rounds):
        before = w
        w = vectors @ ((vectors.T @ b) / (values + prior / noise))
        free = float((noise * values / (prior + noise * values)).sum())
        error = max(rest - 2 * b @ w + w @ c @ w, 1e-12)
        prior, noise = (free + 1e-6) / (w @ w + 1e-6), (n - free + 1e-6) / (error + 1e-6)
        if np.abs(w - before).max() < 1e-12:
            break
    return np.append(w, total - mean @ w)


def huber(rows: DataFrame, features: list[str], target: Column, rounds: int = 10, bend: float = 1.35) -> np.ndarray:
    """Least squares in which rows far from the line count less, reweighted ``rounds`` times; each round is one aggregate. The
    scale is the mean size of residuals of the round before."""
    g, t, _, n = gram(rows, features, target)
    w = _penalised(g, t, RIDGE * n)
    for _ in range(rounds):
        off = F.abs(target - linear(features, w.tolist()))
        scale = rows.agg(_sum(off) / F.count(F.lit(1))).first()[0] or 0.0
        if scale * bend < 1e-9:
            break
        g, t, _, n = gram(rows, features, target, F.least(F.lit(1.0), F.lit(bend * scale) / F.greatest(off, F.lit(1e-12))))
        w = _penalised(g, t, RIDGE * n)
    return w


def regression(rows: DataFrame, features: list[str], target: Column, kind: str) -> list[float]:
    """Slopes and constant of one kind of line."""
    if kind == "huber":
        return huber(rows, features, target).tolist()
    g, t, yy, n = gram(rows, features, target)
    fits: dict[str, Callable[[], np.ndarray]] = {
        "linear": lambda: _penalised(g, t, 1e-9 * n),
        "ridge": lambda: _penalised(g, t, RIDGE * n),
        "lasso": lambda: _descent(g, t, 0.0, LASSO * n),
        "elastic_net": lambda: _descent(g, t, RIDGE * n / 2, LASSO * n / 2),
        "bayesian_ridge": lambda: _evidence(g, t, yy, n),
    }
    return fits[kind]().tolist()


def mean_average_precision(rows: DataFrame, scores: dict[str, Column], by: list[str]) -> DataFrame:
    """(method, by, n_queries, map) of every score of the candidates of each query, over the queries with a relevant candidate,
    ties by item. Scores are rounded before they rank."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), F.round(v, PLACES).alias("score")) for k, v in scores.items()]))
    known = rows.where("label = 1").select("query_id").distinct()
    tall = rows.join(known, "query_id", "left_semi").select(*by, "query_id", "item_id", "label", each.alias("m")).select(*by, "query_id", "item_id", "label", "m.*")
    place = F.row_number().over(Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "item_id"))
    ranked = tall.withColumn("rank", place).where("label = 1")
    hits = F.row_number().over(Window.partitionBy("method", "query_id").orderBy("rank"))
    own = ranked.withColumn("precision", hits / F.col("rank")).groupBy("method", *by, "query_id").agg(F.avg("precision").alias("ap"))
    return own.groupBy("method", *by).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("ap").alias("map"))


def adaptive_weights(rows: DataFrame, features: list[str], fold: Column, n_folds: int = 2, weightings: tuple[str, ...] = WEIGHTINGS, regressors: tuple[str, ...] = REGRESSORS) -> DataFrame:
    """(fold, method, kind, weights, constant, map_train, map_test, chosen) of candidates (query_id, item_id, label 0 or 1 and
    ``features``). ``fold``: from 0, by query. A fold's methods are learned on the rows of all other folds; map_test is on its
    own. One method of each fold is chosen. Folds whose other rows hold no relevant one are left out."""
    base = stored(rows.select("query_id", "item_id", F.col("label").cast("int").alias("label"), fold.cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in features]), "candidates")
    spark, out = rows.sparkSession, []
    for k in range(n_folds):
        train = F.col("fold") != k
        if base.where(train & (F.col("label") == 1)).isEmpty():
            continue
        table = stored(scaled(base, train, features).withColumn("part", F.when(train, "train").otherwise("test")), "scaled")
        learned = table.where("part = 'train'")
        found = {kind: ("weighting", weighting(learned, features, kind)) for kind in weightings}
        judge = lambda methods: {(r.method, r.part): r["map"] for r in mean_average_precision(table, {m: linear(features, w) for m, (_, w) in methods.items()}, ["part"]).collect()}  # noqa: B023, E731
        maps = judge(found)
        top = min(found, key=lambda m: (-round(maps.get((m, "train"), 0.0), PLACES), m))
        score = F.round(linear(features, found[top][1]), PLACES)
        most = learned.agg(F.max(F.abs(score))).first()[0] or 0.0
        target = score + F.col("label") * float(most)
        lines = {kind: ("regressor", regression(learned, features, target, kind)) for kind in regressors}
        maps |= judge(lines) if lines else {}
        best = min(lines, key=lambda m: (-round(maps.get((m, "train"), 0.0), PLACES), m), default=None)
        at = lambda m: round(maps.get((m, "train"), 0.0), PLACES)  # noqa: B023, E731
        chosen = best if best is not None and at(best) >= at(top) else top
        for method, (kind, w) in (found | lines).items():
            weights, constant = [float(x) for x in w[: len(features)]], float(w[len(features)]) if kind == "regressor" else 0.0
            out.append((k, method, kind, weights, constant, maps.get((method, "train")), maps.get((method, "test")), method == chosen))
    return spark.createDataFrame(out, "fold int, method string, kind string, weights array<double>, constant double, map_train double, map_test double, chosen boolean")
