"""Paired statistics: rank tests, effect sizes, correlations, bootstrap, source selection."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rlab.functions.classify import agreement, direction, mean, stars
from rlab.operators.joins import paired_delta, reps_wide
from rlab.operators.order import concordance, positions, rank_correlation
from rlab.operators.resample import resampled_sums


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z)"""
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x or 1e-300) + b * math.log(max(1 - x, 1e-300)))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if math.isnan(a) or b <= 0 else t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def signed_ranks(deltas: DataFrame, by: list[str], zero: str = "wilcox") -> DataFrame:
    """(by, n, n_zero, w_plus, w_minus, z) of the signed-rank statistic of a ``delta`` column. ``wilcox`` drops zeros;
    ``zsplit`` ranks them and gives half their ranks to each side. z: normal approximation with tie correction."""
    rows = deltas.where(F.col("delta").isNotNull())
    rows = rows if zero == "zsplit" else rows.where("delta <> 0")
    d, signs = F.col("delta"), {"_plus": F.col("delta") > 0, "_minus": F.col("delta") < 0, "_zero": F.col("delta") == 0}
    counts = [F.count(F.when(c, 1)).alias(k) for k, c in signs.items()]
    placed = positions(rows.select(*by, "delta", F.round(F.abs(d), 12).alias("_abs")), "_abs", by, *counts)
    rank, t = F.col("before") + (F.col("n") + 1) / 2, F.col("n").cast("double")
    side = lambda c: F.coalesce(F.sum(rank * (F.col(c) + F.col("_zero") / 2)), F.lit(0.0))
    sums = placed.groupBy(*by).agg(F.sum("n").alias("_rows"), F.sum("_zero").alias("n_zero"), side("_plus").alias("w_plus"), side("_minus").alias("w_minus"), F.sum(t * (t * t - 1)).alias("_ties"))
    sums = sums.select(*by, F.coalesce("_rows", F.lit(0)).alias("n"), F.coalesce("n_zero", F.lit(0)).alias("n_zero"), "w_plus", "w_minus", "_ties")
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.when(variance > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance))
    return sums.withColumn("z", z).drop("_ties")


def wilcoxon(deltas: DataFrame, by: list[str], alternative: str = "greater", zero: str = "zsplit", least: int = 5) -> DataFrame:
    """Signed-rank test; p is null below ``least`` pairs. The law is normal."""
    z = F.col("z")
    out = signed_ranks(deltas, by, zero)
    p = {"greater": normal_tail(z), "less": normal_tail(-z), "two-sided": F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))}[alternative]
    return out.withColumn("p", F.when(F.col("n") >= least, p)).withColumn("method", F.lit("normal"))


def scenario_tests(results: DataFrame, comparisons: list[tuple[str, str, str]], metric: str = "MRR") -> DataFrame:
    """Tests of (first, second, alternative) scenario comparisons by model."""
    out = None
    for first, second, alternative in comparisons:
        part = wilcoxon(paired_delta(results, first, second, metric), ["model_name"], alternative).withColumn("comparison", F.lit(f"{first} vs {second}"))
        out = part if out is None else out.unionByName(part)
    return out


def rank_biserial(deltas: DataFrame, by: list[str]) -> DataFrame:
    """(W+ - W-) / (W+ + W-), zeros dropped."""
    sums = signed_ranks(deltas, by, "wilcox")
    total = F.col("w_plus") + F.col("w_minus")
    return sums.select(*by, "n", "w_plus", "w_minus", F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / total).alias("rank_biserial"))


def tost(deltas: DataFrame, by: list[str], margin: float = 0.05) -> DataFrame:
    """Equivalence within a margin: the larger of the two one-sided p values."""
    low = wilcoxon(deltas.withColumn("delta", F.col("delta") + margin), by, "greater", "wilcox").select(*by, "n", F.col("p").alias("p_low"))
    high = wilcoxon(deltas.withColumn("delta", F.col("delta") - margin), by, "less", "wilcox").select(*by, F.col("p").alias("p_high"))
    return low.join(high, by).withColumn("p", F.greatest("p_low", "p_high")).withColumn("equivalent", F.col("p") < 0.05)


def cohens_dz(deltas: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("delta")
    out = deltas.groupBy(*by).agg(F.count(d).alias("n"), mean(d).alias("mean"), F.stddev_samp(d).alias("std"))
    return out.withColumn("dz", F.when((F.col("n") >= 2) & (F.col("std") > 0), F.col("mean") / F.col("std")))


def bootstrap_ci(deltas: DataFrame, by: list[str], n_boot: int = 10_000, level: float = 0.95, seed: int = 11) -> DataFrame:
    """(by, low, high, n_boot): percentile interval of dz by resampling the rows of a group; resamples without spread have no
    dz and are not counted. See ``resample``: draws are counts of distinct values, so a group may be of any size."""
    sums = resampled_sums(deltas, "delta", by, n_boot, seed)
    n = F.col("n").cast("double")
    variance = (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)
    dz = F.when((n > 1) & (variance > 1e-18), F.col("s") / n / F.sqrt(variance))
    tail = (1 - level) / 2
    return sums.groupBy(*by).agg(F.percentile(dz, F.lit(tail)).alias("low"), F.percentile(dz, F.lit(1 - tail)).alias("high"), F.count(dz).alias("n_boot"))


def spearman(df: DataFrame, x: str, y: str, by: list[str], least: int = 5) -> DataFrame:
    """(by, n, rho, p): rank correlation of rows where both are there; null below ``least`` pairs. p by Student's t."""
    out = rank_correlation(df, x, y, by)
    out = out.select(*by, "n", F.when(F.col("n") >= least, F.col("rho")).alias("rho"))
    df_ = (F.col("n") - 2).cast("double")
    t = F.col("rho") * F.sqrt(df_ / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-15)))
    return out.withColumn("p", F.when(F.col("rho").isNotNull(), t_tail(F.coalesce(t, F.lit(0.0)), df_)))


def kendall_tau(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, tau): tau-b of two columns over the rows of a group, positive where they agree; null where a column is
    constant. Groups of one row are left out. Discordant pairs are counted by merging blocks, so no pair is a row."""
    c = concordance(df, x, y, by).where("n > 1")
    n = lambda k: F.col(k).cast("double")
    agree = F.col("pairs") - F.col("tied_x") - F.col("tied_y") + F.col("tied_both") - 2 * F.col("discordant")
    size = F.sqrt((F.col("pairs") - F.col("tied_x")).cast("double") * (n("pairs") - n("tied_y")))
    return c.select(*by, "n", F.when(size > 0, agree.cast("double") / size).alias("tau"))


def ols_line(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.corr(a, b).alias("r"))


def min_max_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 over the whole table; a constant column is 0. The bounds are one aggregate row."""
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))
    for c in columns:
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(c, F.when(F.col(c).isNull(), None).when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def rank_sources(rows: DataFrame, by: list[str], outcome: str, bugs: str, loc: str, gap: str, least: int = 3) -> DataFrame:
    """(by, n_sources, oracle, random, and for each heuristic its pick's outcome, hit@1, share of the oracle and tau).
    Heuristics: most reports, most lines, smallest gap, and a composite (half reports, a quarter lines, a quarter 1 - gap,
    each scaled to 0..1). The random baseline is the exact mean. Groups of fewer than ``least`` sources are left out."""
    scaled = min_max_scale(rows.withColumns({"_b": F.col(bugs).cast("double"), "_l": F.col(loc).cast("double"), "_g": F.col(gap).cast("double")}), ["_b", "_l", "_g"])
    scored = scaled.withColumns({"most_bugs": F.col("_b"), "most_loc": F.col("_l"), "small_gap": 1 - F.col("_g")}).withColumn("composite", 0.5 * F.col("most_bugs") + 0.25 * F.col("most_loc") + 0.25 * F.col("small_gap"))
    names = ["most_bugs", "most_loc", "small_gap", "composite"]
    best = lambda c: F.max_by(F.struct(outcome, "source_project"), F.struct(F.coalesce(c, F.lit(-1.0)), "_tie"))
    keyed = scored.where(F.col(outcome).isNotNull()).withColumn("_tie", -F.dense_rank().over(Window.partitionBy(*by).orderBy("source_project")))
    out = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sources"), best(F.col(outcome)).alias("_o"), mean(F.col(outcome)).alias("random"), *[best(F.col(h)).alias(f"_{h}_pick") for h in names])
    out = out.where(F.col("n_sources") >= least).withColumn("oracle", F.col(f"_o.{outcome}"))
    for h in names:
        pick = F.col(f"_{h}_pick")
        out = out.withColumns({f"{h}_score": pick[outcome], f"{h}_hit": pick["source_project"] == F.col("_o.source_project"), f"{h}_of_oracle": F.try_divide(pick[outcome], F.col("oracle"))})
    tall = keyed.select(*by, F.col(outcome).alias("_y"), *[F.col(h).cast("double").alias(h) for h in names]).unpivot([*by, "_y"], names, "_h", "_x")
    taus = kendall_tau(tall, "_x", "_y", [*by, "_h"]).groupBy(*by).agg(*[F.max(F.when(F.col("_h") == h, F.col("tau"))).alias(f"{h}_tau") for h in names])
    return out.drop("_o", *[f"_{h}_pick" for h in names]).join(taus, by, "left")


def source_ranking_means(ranked: DataFrame) -> DataFrame:
    """Overall means of ``rank_sources``."""
    names = ["most_bugs", "most_loc", "small_gap", "composite"]
    return ranked.agg(F.count(F.lit(1)).alias("targets"), mean(F.col("oracle")).alias("oracle"), mean(F.col("random")).alias("random"), *[mean(F.col(f"{h}_{k}").cast("double")).alias(f"{h}_{k}") for h in names for k in ("score", "hit", "of_oracle", "tau")])


def model_pairs(deltas: DataFrame) -> DataFrame:
    """Deltas of two models side by side, by pair of projects; every unordered pair of models once."""
    one = deltas.select("source_project", "target_project", F.col("model_name").alias("model_a"), F.col("delta").alias("delta_a"))
    two = deltas.select("source_project", "target_project", F.col("model_name").alias("model_b"), F.col("delta").alias("delta_b"))
    return one.join(two, ["source_project", "target_project"]).where("model_a < model_b")


def model_agreement(deltas: DataFrame) -> DataFrame:
    """Share of pairs of projects at which two models agree in direction, and their rank correlation."""
    both = model_pairs(deltas)
    rate = both.groupBy("model_a", "model_b").agg(F.avg(agreement(F.col("delta_a"), F.col("delta_b"))["same_direction"].cast("double")).alias("agreement"))
    return rate.join(spearman(both, "delta_a", "delta_b", ["model_a", "model_b"]), ["model_a", "model_b"])


def disagreements(deltas: DataFrame) -> DataFrame:
    return model_pairs(deltas).where(direction(F.col("delta_a")) != direction(F.col("delta_b")))


def random_intercept(deltas: DataFrame, group: str, by: list[str]) -> DataFrame:
    """One-way variance components of ``delta`` in closed form from group moments: between and within variance (not below
    0), intraclass correlation and mean."""
    d = F.col("delta")
    groups = deltas.where(d.isNotNull()).groupBy(*by, group).agg(F.count(d).cast("double").alias("_n"), F.sum(d).alias("_s"), F.sum(d * d).alias("_q"))
    n, s = F.col("_n"), F.col("_s")
    sums = groups.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_k"), F.sum(n).alias("_N"), F.sum(n * n).alias("_nn"), F.sum(s).alias("_S"), F.sum(s * s / n).alias("_ss"), F.sum("_q").alias("_Q"))
    k, total = F.col("_k"), F.col("_N")
    within = F.try_divide(F.col("_Q") - F.col("_ss"), total - k)
    between = F.try_divide(F.col("_ss") - F.col("_S") * F.col("_S") / total, k - 1)
    size = F.try_divide(total - F.col("_nn") / total, k - 1)
    out = sums.select(*by, k.cast("long").alias("n_groups"), total.cast("long").alias("n"), (F.col("_S") / total).alias("mean"), within.alias("var_within"), F.greatest(F.try_divide(between - within, size), F.lit(0.0)).alias("var_between"))
    return out.withColumn("icc", F.try_divide(F.col("var_between"), F.col("var_between") + F.col("var_within")))


def target_level_test(deltas: DataFrame, by: list[str]) -> DataFrame:
    """The signed-rank test on the mean delta of each target, with the number of positive targets."""
    means = deltas.groupBy(*by, "target_project").agg(mean(F.col("delta")).alias("delta"))
    positive = means.groupBy(*by).agg(F.count(F.when(F.col("delta") > 0, 1)).alias("n_positive"), mean(F.col("delta")).alias("mean"))
    return wilcoxon(means, by, "two-sided", "wilcox").join(positive, by)


def rep_sensitivity(transfer: DataFrame, reps: DataFrame, metric: str, numbers: list[int]) -> DataFrame:
    """Test, effect size and share of wins when each single repetition is the baseline."""
    wide, out = transfer.join(reps_wide(reps, metric, numbers), ["model_name", "target_project"]), None
    for r in numbers:
        deltas = wide.withColumn("delta", F.col(metric) - F.col(f"{metric}_rep{r}"))
        wins = deltas.groupBy("model_name").agg((100 * F.avg(F.when(F.col("delta") > 0, 1.0).otherwise(0.0))).alias("pct_wins"))
        part = wilcoxon(deltas, ["model_name"], "two-sided", "wilcox").join(rank_biserial(deltas, ["model_name"]).select("model_name", "rank_biserial"), "model_name", "left").join(wins, "model_name").withColumn("rep", F.lit(r))
        out = part if out is None else out.unionByName(part)
    return out


def feature_screen(df: DataFrame, features: list[str], outcome: str, k: int) -> DataFrame:
    """The k features of largest absolute rank correlation with an outcome."""
    tall = df.unpivot([outcome], features, "feature", "value")
    return spearman(tall, "value", outcome, ["feature"]).where(F.col("rho").isNotNull()).orderBy(F.desc(F.round(F.abs("rho"), 9)), "feature").limit(k)


def effect_grid(results: DataFrame, comparisons: list[tuple[str, str]], metrics: list[str]) -> DataFrame:
    """Comparison x metric matrix of effect sizes with significance stars, by model."""
    rows = None
    for first, second in comparisons:
        for m in metrics:
            deltas = paired_delta(results, first, second, m)
            part = cohens_dz(deltas, ["model_name"]).join(wilcoxon(deltas, ["model_name"], "two-sided").select("model_name", "p"), "model_name")
            cell = F.concat(F.format_number("dz", 2), F.lit(" "), stars(F.col("p")))
            part = part.select("model_name", F.lit(f"{first} vs {second}").alias("comparison"), F.lit(m).alias("metric"), cell.alias("cell"))
            rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("model_name", "comparison").pivot("metric", metrics).agg(F.first("cell"))


def round_columns(df: DataFrame, places: int = 6) -> DataFrame:
    """Double columns rounded, for comparison across engines; -0 becomes 0."""
    shape = lambda c: (F.round(c, places) + F.lit(0.0)).alias
    return df.select(*[shape(F.col(f"`{f.name}`"))(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])
