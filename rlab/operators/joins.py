"""Joins: metadata, symmetric lookups, paired results, ground truth, as-of and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rlab.functions.classify import mean, pair_key, safe_ratio

#: The scenarios of the results table, in their order.
SCENARIOS = ["WP-small", "WP-large", "CP-cold-start", "CP-transfer"]


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def with_metadata(results: DataFrame, projects: DataFrame, key: str = "repo_name") -> DataFrame:
    """The project table twice, with ``src_`` and ``tgt_`` columns. Projects are a small dimension; Spark broadcasts it
    when its size allows."""
    out = results
    for prefix, column in (("src_", "source_project"), ("tgt_", "target_project")):
        side = prefixed(projects, prefix)
        out = out.join(side, F.col(column) == side[prefix + key], "left").drop(prefix + key)
    return out


def with_pair_value(results: DataFrame, values: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """A value of an unordered pair: of (a, b) or of (b, a), the mean if both are there."""
    table = values.groupBy(pair_key(F.col(a), F.col(b)).alias("_pair")).agg(mean(F.col(value)).alias(value))
    keyed = results.withColumn("_pair", pair_key(F.col("source_project"), F.col("target_project")))
    return keyed.join(table, "_pair", "left").drop("_pair")


symmetric_similarity = with_pair_value


def paired_delta(results: DataFrame, first: str, second: str, metric: str = "MRR") -> DataFrame:
    """first - second of a metric by (model, source, target), where both scenarios are there. One aggregate, no
    self-join."""
    value = lambda s: F.max(F.when(F.col("scenario") == s, F.col(metric)))
    both = results.where(F.col("scenario").isin(first, second)).groupBy("model_name", "source_project", "target_project")
    paired = both.agg(value(first).alias("first_value"), value(second).alias("second_value"))
    return paired.dropna(subset=["first_value", "second_value"]).withColumn("delta", F.col("first_value") - F.col("second_value"))


def scenario_wide(results: DataFrame, projects: DataFrame, metric: str = "MRR") -> DataFrame:
    """Transfer rows with the other scenarios beside them, gain and win flags and the ratio of reports."""
    value = lambda s: F.max(F.when(F.col("scenario") == s, F.col(metric)))
    wide = results.groupBy("model_name", "source_project", "target_project").agg(
        value("CP-transfer").alias("cp_transfer"), value("WP-small").alias("wp_small"), value("WP-large").alias("wp_large"), value("CP-cold-start").alias("cold_start")
    )
    wide = with_metadata(wide.where(F.col("cp_transfer").isNotNull()), projects)
    gain = F.col("cp_transfer") - F.col("wp_small")
    return wide.withColumns({"gain": gain, "win": gain > 0, "beats_large": F.col("cp_transfer") > F.col("wp_large"), "bug_ratio": safe_ratio(F.col("src_n_bugs"), F.col("tgt_n_bugs"))})


def reverse_pairs(results: DataFrame, metric: str = "MRR", loc: DataFrame | None = None) -> DataFrame:
    """Both directions of every unordered pair in one row (source < target), with their difference. With ``loc``
    (repo_name, LoC): whether the smaller project gains more as target; null where a size is unknown."""
    low, high = F.least("source_project", "target_project"), F.greatest("source_project", "target_project")
    keyed = results.where("source_project <> target_project").select("model_name", "scenario", low.alias("project_a"), high.alias("project_b"), (F.col("source_project") == low).alias("forward"), metric)
    both = keyed.groupBy("model_name", "scenario", "project_a", "project_b").agg(F.max(F.when(F.col("forward"), F.col(metric))).alias("a_to_b"), F.max(F.when(~F.col("forward"), F.col(metric))).alias("b_to_a"))
    out = both.dropna(subset=["a_to_b", "b_to_a"]).withColumn("asymmetry", F.abs(F.col("a_to_b") - F.col("b_to_a")))
    if loc is None:
        return out
    for side in "ab":
        out = out.join(loc.select(F.col("repo_name").alias(f"project_{side}"), F.col("LoC").alias(f"loc_{side}")), f"project_{side}", "left")
    smaller_gains = F.when(F.col("loc_b") < F.col("loc_a"), F.col("a_to_b") > F.col("b_to_a")).otherwise(F.col("b_to_a") > F.col("a_to_b"))
    return out.withColumn("smaller_gains", F.when(F.col("loc_a").isNotNull() & F.col("loc_b").isNotNull(), smaller_gains))


def match_ground_truth(truth: DataFrame, snapshots: DataFrame, mode: str = "all", loose: bool = False) -> DataFrame:
    """truth (.., commit_sha, gt) with the paths of the snapshot that end with it. The match is at a path boundary, which
    makes it an equi-join on commit and base name; ``loose`` takes any suffix, by an equi-join on the hash of a path's last n
    characters for each length n that a ground-truth path of the commit has, and verifies. ``first`` keeps the least path of
    each."""
    base = lambda c: F.substring_index(c, "/", -1)
    if loose:
        lengths = truth.where(F.col("gt").isNotNull()).groupBy("commit_sha").agg(F.collect_set(F.length("gt")).alias("_lengths"))
        fits = F.filter("_lengths", lambda n: n <= F.length("path"))
        ends = snapshots.join(lengths, "commit_sha").withColumn("_n", F.explode(fits)).drop("_lengths")
        ends = ends.withColumn("_end", F.xxhash64(F.substring("path", F.length("path") - F.col("_n") + 1, F.col("_n")))).drop("_n")
        found = truth.withColumn("_end", F.xxhash64("gt")).join(ends, ["commit_sha", "_end"]).where(F.endswith("path", F.col("gt"))).drop("_end")
    else:
        keyed = snapshots.withColumn("_base", base("path"))
        found = truth.withColumn("_base", base("gt")).join(keyed, ["commit_sha", "_base"])
        found = found.where((F.col("path") == F.col("gt")) | F.endswith("path", F.concat(F.lit("/"), "gt"))).drop("_base")
    if mode == "all":
        return found
    rank = F.row_number().over(Window.partitionBy(*truth.columns).orderBy("path"))
    return found.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def asof_latest(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, unit: str = "month") -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time, by key. Both sides are stacked and a running last
    value is taken inside one calendar unit of a key, so nothing is multiplied and a key of many rows is many windows; the
    last value of earlier units is carried by a table of one row for each key and unit. At one time, the right side comes
    first."""
    bucketed = right.withColumn("_unit", F.date_trunc(unit, right_time))
    lasts = bucketed.groupBy(by, "_unit").agg(F.max(F.struct(F.col(right_time).alias("t"), F.col(value).alias("v"))).alias("_m"))
    units = lasts.select(by, "_unit", "_m").unionByName(left.select(by, F.date_trunc(unit, left_time).alias("_unit")).distinct().withColumn("_m", F.lit(None)))
    units = units.groupBy(by, "_unit").agg(F.max("_m").alias("_m"))
    before = Window.partitionBy(by).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    carried = units.withColumn("_before", F.last("_m", ignorenulls=True).over(before)).select(by, "_unit", "_before")
    stacked = left.select(by, F.date_trunc(unit, left_time).alias("_unit"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_v"), F.struct(*left.columns).alias("_row")).unionByName(
        bucketed.select(by, "_unit", F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"), F.lit(None).alias("_row"))
    )
    order = Window.partitionBy(by, "_unit").orderBy("_t", "_side", F.col("_v.v")).rowsBetween(Window.unboundedPreceding, 0)
    latest = stacked.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return latest.join(carried, [by, "_unit"], "left").select("_row.*", F.coalesce(F.col("_last.v"), F.col("_before.v")).alias(value))


def parent_sha(reports: DataFrame, commits: DataFrame) -> DataFrame:
    """Reports with the first parent of their fix commit; unresolved ones are dropped."""
    parents = commits.where(F.col("parent_sha").isNotNull()).select(F.col("commit_sha").alias("fix_commit_sha"), F.col("parent_sha").alias("pre_fix_commit_sha"))
    return reports.drop("pre_fix_commit_sha").join(parents, "fix_commit_sha")


def missing_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return expected.join(actual.select(key).distinct(), key, "left_anti")


def reconcile_counts(expected: DataFrame, actual: DataFrame, key: str, count: str = "expected") -> DataFrame:
    """Expected and actual rows of every expected key, and their difference."""
    found = actual.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    out = expected.select(key, count).join(found, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return out.withColumn("difference", F.col("actual") - F.col(count))


def project_pairs(projects: DataFrame, kind: str = "combinations", key: str = "repo_name", design: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of a table of projects: unordered, ordered, or a designed list that both sides must be in. The number of
    pairs is the result's, so the join is by inequality."""
    a, b = projects.select(F.col(key).alias("project_a")), projects.select(F.col(key).alias("project_b"))
    if kind == "designed":
        wanted = projects.sparkSession.createDataFrame(design or [], "project_a string, project_b string")
        return wanted.join(a, "project_a").join(b, "project_b").select("project_a", "project_b")
    return a.join(b, F.col("project_a") < F.col("project_b") if kind == "combinations" else F.col("project_a") != F.col("project_b"))


def snapshot_vectors(reports: DataFrame, snapshots: DataFrame, vectors: DataFrame) -> DataFrame:
    """(bug_id, commit_sha, path, blob_sha, vec): what can be searched for each report. Blobs without a vector drop out."""
    keyed = reports.select("bug_id", F.col("pre_fix_commit_sha").alias("commit_sha"))
    return keyed.join(snapshots, "commit_sha").join(vectors, "blob_sha").select("bug_id", "commit_sha", "path", "blob_sha", "vec")


def recall_compare(first: DataFrame, second: DataFrame, keys: list[str], ks: list[int] | None = None) -> DataFrame:
    """Two recall tables side by side with their difference; keys of one side stay."""
    one, two = first.select(*keys, F.col("recall").alias("recall_1")), second.select(*keys, F.col("recall").alias("recall_2"))
    out = one.join(two, keys, "full").withColumn("delta", F.col("recall_1") - F.col("recall_2"))
    return out.where(F.col("k").isin(ks)) if ks else out


def reps_wide(reps: DataFrame, metric: str, numbers: list[int]) -> DataFrame:
    """One column for each repetition."""
    value = lambda r: F.max(F.when(F.col("rep") == r, F.col(metric))).alias(f"{metric}_rep{r}")
    return reps.groupBy("model_name", "target_project").agg(*[value(r) for r in numbers])


def with_source_quality(results: DataFrame, metric: str = "MRR") -> DataFrame:
    """Each row with the mean large-budget score that its source reaches as a target."""
    quality = results.where(F.col("scenario") == "WP-large").groupBy("model_name", F.col("target_project").alias("source_project")).agg(mean(F.col(metric)).alias("source_quality"))
    return results.join(quality, ["model_name", "source_project"], "left")
