"""Comparisons over a results grid (model, source, target, scenario): means, gains, noise bands, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlab.functions.classify import VIABLE, direction, domain_type, mean
from rlab.operators.joins import SCENARIOS, paired_delta, reps_wide, reverse_pairs
from rlab.operators.order import quantiles
from rlab.operators.rank import quartile_bins

METRICS = ["MRR", "MAP", "top_10"]


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(keys, metrics, "metric", "value")


def scenario_means(results: DataFrame, metrics: list[str] = METRICS, scenarios: list[str] = SCENARIOS) -> DataFrame:
    """Mean, median and sample deviation of every metric by model and scenario; absent cells stay with n = 0."""
    tall = unpivot(results, ["model_name", "scenario"], metrics)
    found = tall.groupBy("model_name", "scenario", "metric").agg(F.count("value").alias("n"), mean(F.col("value")).alias("mean"), F.stddev_samp("value").alias("std"))
    found = found.join(quantiles(tall, "value", ["model_name", "scenario", "metric"], [0.5], "_q"), ["model_name", "scenario", "metric"], "left").withColumn("median", F.col("_q")[0]).drop("_q")
    grid = results.select("model_name").distinct().withColumn("scenario", F.explode(F.array(*map(F.lit, scenarios)))).withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    return grid.join(found, ["model_name", "scenario", "metric"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def gain_summary(deltas: DataFrame, by: list[str], cutoff: float = 0.0) -> DataFrame:
    """Wins, losses, win rate, mean and median delta, median win and loss, and their asymmetry, of a ``delta`` column."""
    d = F.col("delta")
    median = lambda c: F.percentile(F.when(c, d), F.lit(0.5))
    out = deltas.groupBy(*by).agg(
        F.count(d).alias("n"), F.count(F.when(d > cutoff, 1)).alias("wins"), F.count(F.when(d < -cutoff, 1)).alias("losses"), mean(d).alias("mean_delta"),
        F.percentile(d, F.lit(0.5)).alias("median_delta"), median(d > cutoff).alias("median_win"), median(d < -cutoff).alias("median_loss"),
    )
    return out.withColumn("win_rate", F.col("wins") / F.col("n")).withColumn("asymmetry", F.abs("median_win") / F.when(F.col("median_loss") != 0, F.abs("median_loss")))


def stratified_means(results: DataFrame, size: str, metric: str) -> DataFrame:
    """(model, scenario, size, n, mean): by size class and over all of them (`All`), in one pass of grouping sets."""
    sets = results.groupingSets([["model_name", "scenario"], ["model_name", "scenario", size]], "model_name", "scenario", size)
    out = sets.agg(F.count(metric).alias("n"), mean(F.col(metric)).alias("mean"), F.grouping(size).alias("_all"))
    return out.select("model_name", "scenario", F.when(F.col("_all") == 1, "All").otherwise(F.col(size)).alias("size"), "n", "mean")


def rep_summary(reps: DataFrame, metrics: list[str], by: tuple[str, ...] = ("model_name", "target_project")) -> DataFrame:
    """Median, least, largest, mean and sample deviation of every metric over repetitions."""
    aggs = [f.alias(f"{m}_{n}") for m in metrics for n, f in (("median", F.percentile(m, F.lit(0.5))), ("min", F.min(m)), ("max", F.max(m)), ("mean", mean(F.col(m))), ("std", F.stddev_samp(m)))]
    return reps.groupBy(*by).agg(F.count(F.lit(1)).alias("n_reps"), *aggs)


def cross_domain_breakdown(deltas: DataFrame, group: list[str]) -> DataFrame:
    kinds = deltas.withColumn("domain_type", domain_type(F.col("source_project"), F.col("target_project"), group))
    return gain_summary(kinds, ["model_name", "domain_type"]).select("model_name", "domain_type", "n", "mean_delta", "median_delta", "win_rate")


def transfer_summary(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Cases by direction and the range of deltas."""
    kind = direction(F.col("delta"))
    counts = [F.count(F.when(kind == k, 1)).alias(k) for k in ("positive", "negative", "neutral")]
    return deltas.groupBy(*by).agg(*counts, F.min("delta").alias("least"), F.max("delta").alias("most"), mean(F.col("delta")).alias("mean"), F.percentile("delta", F.lit(0.5)).alias("median"))


def negative_cases(deltas: DataFrame) -> DataFrame:
    return deltas.where(direction(F.col("delta")) == "negative").orderBy("delta", "model_name", "source_project", "target_project")


def noise_bands(deltas: DataFrame, reps: DataFrame, metric: str) -> DataFrame:
    """By model: cases that are negative, and how many stay so outside half, the whole and sqrt(2) times the spread of the
    target's repetitions."""
    spread = reps.groupBy("model_name", "target_project").agg((F.max(metric) - F.min(metric)).alias("spread"))
    joined = deltas.join(spread, ["model_name", "target_project"])
    d = F.col("delta")
    band = lambda k: F.count(F.when(d < -k * F.col("spread"), 1))
    return joined.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(d < 0, 1)).alias("negative"), band(0.5).alias("beyond_half"), band(1.0).alias("beyond_full"), band(2**0.5).alias("beyond_sqrt2"), mean(F.col("spread")).alias("mean_spread"))


def relabel_counts(transfer: DataFrame, reps: DataFrame, metric: str, numbers: list[int]) -> DataFrame:
    """By model: negative cases when each single repetition stands for the small-budget score."""
    wide = transfer.join(reps_wide(reps, metric, numbers), ["model_name", "target_project"])
    return wide.groupBy("model_name").agg(*[F.count(F.when(F.col(metric) - F.col(f"{metric}_rep{r}") < -0.01, 1)).alias(f"negative_rep{r}") for r in numbers])


def noise_spread(reps: DataFrame, metric: str) -> DataFrame:
    spread = reps.groupBy("model_name", "target_project").agg((F.max(metric) - F.min(metric)).alias("_s"))
    return spread.groupBy("model_name").agg(F.count(F.lit(1)).alias("targets"), mean(F.col("_s")).alias("mean_spread"), F.max("_s").alias("max_spread"))


def target_profile(wide: DataFrame) -> DataFrame:
    """By target over ``scenario_wide``: mean score, size and reports, mean gain and share of wins."""
    return wide.groupBy("target_project").agg(mean(F.col("cp_transfer")).alias("mean_mrr"), F.max("tgt_LoC").alias("LoC"), F.max("tgt_n_bugs").alias("n_bugs"), mean(F.col("gain")).alias("mean_gain"), F.avg(F.col("win").cast("double")).alias("win_share"))


def desirability_evidence(wide: DataFrame, close: float = 0.02) -> DataFrame:
    """(evidence, value) over ``scenario_wide`` with recall_ceiling and gap columns: E1 share of wins; E2 shares within
    ``close`` of, and at least, the large budget; E3 cold start and model against the ceiling; E4 mean gain of targets
    with few and with many reports; E5 wins at low and at high gap."""
    halves = wide.agg(F.percentile(F.col("tgt_n_bugs").cast("double"), F.lit(0.5)).alias("_bugs"), F.percentile("gap", F.lit(0.5)).alias("_gap"))
    x = wide.crossJoin(F.broadcast(halves))
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    only = lambda c, v: mean(F.when(c, v))
    few, low, win = F.col("tgt_n_bugs") <= F.col("_bugs"), F.col("gap") <= F.col("_gap"), F.col("win").cast("double")
    values = {
        "E1_win_share": rate(F.col("win")),
        "E2_close_to_large": rate(F.col("wp_large") - F.col("cp_transfer") <= close),
        "E2_at_least_large": rate(F.col("cp_transfer") >= F.col("wp_large")),
        "E3_cold_to_ceiling": mean(F.try_divide(F.col("cold_start"), F.col("recall_ceiling"))),
        "E3_model_to_ceiling": mean(F.try_divide(F.col("cp_transfer"), F.col("recall_ceiling"))),
        "E4_gain_few_bugs": only(few, F.col("gain")),
        "E4_gain_many_bugs": only(~few, F.col("gain")),
        "E5_wins_low_gap": only(low, win),
        "E5_wins_high_gap": only(~low, win),
    }
    row = x.agg(*[v.alias(k) for k, v in values.items()])
    return row.unpivot([], list(values), "evidence", "value")


def asymmetry(results: DataFrame, metric: str = "MRR", top: int = 10) -> DataFrame:
    """The pairs whose two directions differ most, over all scenarios and models."""
    pairs = reverse_pairs(results, metric).groupBy("project_a", "project_b").agg(mean(F.col("asymmetry")).alias("mean_asymmetry"), F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(F.desc("mean_asymmetry"), "project_a", "project_b").limit(top)


def pivot_scores(results: DataFrame, metric: str = "MRR", scenarios: list[str] = SCENARIOS) -> DataFrame:
    """Pair x scenario means with their row mean."""
    cells = results.groupBy("source_project", "target_project").pivot("scenario", scenarios).agg(mean(F.col(metric)))
    have = [F.col(f"`{s}`") for s in scenarios]
    total, n = F.lit(0.0), F.lit(0)
    for c in have:
        total, n = total + F.coalesce(c, F.lit(0.0)), n + c.isNotNull().cast("int")
    return cells.withColumn("row_mean", total / F.when(n > 0, n)).orderBy(F.desc("row_mean"), "source_project", "target_project")


def quartile_grid(results: DataFrame, x: str, y: str, metric: str) -> DataFrame:
    """Mean and count by quartile of one column and quartile of another."""
    both = quartile_bins(quartile_bins(results, x, "x_quartile"), y, "y_quartile")
    return both.groupBy("x_quartile", "y_quartile").agg(mean(F.col(metric)).alias("mean"), F.count(metric).alias("n"))


def median_threshold_profile(results: DataFrame, loc: str, metrics: dict[str, float] = VIABLE) -> DataFrame:
    """By metric: share of viable rows, the largest size that is still viable, and median sizes of viable and other rows."""
    tall = unpivot(results, [loc], list(metrics)).withColumn("ok", F.coalesce(F.col("value") >= F.element_at(F.create_map(*[F.lit(x) for kv in metrics.items() for x in kv]), F.col("metric")), F.lit(False)))
    size = F.col(loc).cast("double")
    return tall.groupBy("metric").agg(F.avg(F.col("ok").cast("double")).alias("viable_share"), F.max(F.when(F.col("ok"), F.col(loc))).alias("largest_viable"), F.percentile(F.when(F.col("ok"), size), F.lit(0.5)).alias("median_viable"), F.percentile(F.when(~F.col("ok"), size), F.lit(0.5)).alias("median_other"))


def quality_extremes(rows: DataFrame, n: int = 3) -> DataFrame:
    """The n sources of best and of worst quality, one row each, with their mean delta."""
    means = rows.groupBy("source_project").agg(F.max("source_quality").alias("quality"), mean(F.col("delta")).alias("mean_delta"))
    means = means.where(F.col("quality").isNotNull())
    best = means.orderBy(F.desc("quality"), "source_project").limit(n).withColumn("end", F.lit("best"))
    worst = means.orderBy("quality", "source_project").limit(n).withColumn("end", F.lit("worst"))
    return best.unionByName(worst.join(best.select("source_project"), "source_project", "left_anti")).select("source_project", "quality", "mean_delta", "end")


def scenario_profile(summaries: DataFrame, shares: list[str]) -> DataFrame:
    """Mean shares by scenario and over all."""
    out = summaries.groupingSets([["scenario"], []], "scenario").agg(*[mean(F.col(s)).alias(s) for s in shares], F.count(F.lit(1)).alias("n"), F.grouping("scenario").alias("_all"))
    return out.withColumn("scenario", F.when(F.col("_all") == 1, "All").otherwise(F.col("scenario"))).drop("_all")


def size_group_means(results: DataFrame, sizes: DataFrame, metric: str) -> DataFrame:
    large = results.where(F.col("scenario") == "WP-large")
    return large.join(sizes.select("target_project", "size"), "target_project").groupBy("model_name", "size").agg(mean(F.col(metric)).alias("mean"), F.count(metric).alias("n"))


def win_rates(results: DataFrame, first: str, second: str, metrics: list[str] = METRICS) -> DataFrame:
    """Share of pairs at which the first scenario beats the second, by model and metric."""
    rows = None
    for m in metrics:
        part = paired_delta(results, first, second, m).groupBy("model_name").agg(F.avg(F.when(F.col("delta") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.count(F.lit(1)).alias("n")).withColumn("metric", F.lit(m))
        rows = part if rows is None else rows.unionByName(part)
    return rows


