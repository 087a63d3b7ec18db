"""Evaluation of rankings: hit shares, reciprocal ranks, average precision, displacement, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlab.operators.joins import with_metadata, with_pair_value
from rlab.operators.rank import first_hit_rank, rank_candidates, restrict_to_pool, running_precision
from rlab.operators.retrieve import mark_relevant

KS = (1, 5, 10)


def ranking_metrics(ranked: DataFrame, truth: DataFrame, queries: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = KS, skip_no_gt: bool = False, places: int | None = None) -> DataFrame:
    """(by, n_queries, n_with_gt, top_k.., mrr, map). ``ranked``: query_id, item_id, rank; ``queries``: query_id and
    ``by``. Every query counts, one without ground truth or hit with 0; with ``skip_no_gt``, queries without ground
    truth are left out of MRR and MAP, but not of the hit shares. MAP is the mean precision at relevant rows found."""
    by = by or []
    marked = mark_relevant(ranked, truth)
    first = first_hit_rank(marked)
    precision = running_precision(marked).groupBy("query_id").agg(F.avg("precision").alias("ap"))
    known = truth.select("query_id").distinct().withColumn("_gt", F.lit(True))
    rows = queries.select("query_id", *by).distinct().join(known, "query_id", "left").join(first, "query_id", "left").join(precision, "query_id", "left")
    score = lambda x: F.when(F.col("_gt").isNotNull(), F.coalesce(x, F.lit(0.0))) if skip_no_gt else F.coalesce(x, F.lit(0.0))
    shape = (lambda c: F.round(c, places)) if places is not None else (lambda c: c)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count("_gt").alias("n_with_gt"),
        *[shape(F.avg(F.when(F.col("first_hit") <= k, 1.0).otherwise(0.0))).alias(f"top_{k}") for k in ks],
        shape(F.avg(score(1.0 / F.col("first_hit")))).alias("mrr"),
        shape(F.avg(score(F.col("ap")))).alias("map"),
    )


def dual_eval(ranked: DataFrame, pool: DataFrame, truth: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """The metrics on the full ranking and inside a pool, one row for each ``scope``, with the ground truth in the pool."""
    inside = pool.select("query_id", "item_id").distinct().join(truth.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi").agg(F.count(F.lit(1)).alias("gt_in_pool"))
    full = ranking_metrics(ranked, truth, queries, **how).withColumn("scope", F.lit("full"))
    part = ranking_metrics(restrict_to_pool(ranked, pool), truth, queries, **how).withColumn("scope", F.lit("pool"))
    return full.unionByName(part).crossJoin(F.broadcast(inside))


def rank_diagnostics(baseline: DataFrame, model: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each (query, relevant item): both ranks and scores, displacement (null where either is missing) and
    the candidates ranked by the model. Missing ranks are null."""
    relevant = truth.select("query_id", "item_id").distinct()
    one = baseline.select("query_id", "item_id", F.col("rank").alias("baseline_rank"), F.col("score").alias("baseline_score"))
    two = model.select("query_id", "item_id", F.col("rank").alias("model_rank"), F.col("score").alias("model_score"))
    counts = model.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    out = relevant.join(one, ["query_id", "item_id"], "left").join(two, ["query_id", "item_id"], "left").join(counts, "query_id", "left")
    return out.withColumn("displacement", F.col("baseline_rank") - F.col("model_rank")).withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def rerank(candidates: DataFrame, reranker, columns: list[str]) -> DataFrame:
    """New scores by a plug-in: a function from batches of ``columns`` (pandas) to scores, loaded once in each task;
    (query_id, item_id, score, rank)."""

    def run(batches):
        for batch in batches:
            yield batch[["query_id", "item_id"]].assign(score=reranker(batch[columns]))

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    scored = candidates.select("query_id", "item_id", *[c for c in columns if c not in ("query_id", "item_id")]).mapInPandas(run, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")
    return rank_candidates(scored)


def rank_summary(diagnostics: DataFrame, by: list[str], prefix: str = "model", ks: tuple[int, ...] = KS) -> DataFrame:
    """(by, n_rows, n_queries, top-k shares, MRR, mean and median rank) of one side's ranks; a missing rank has
    reciprocal 0 and is in no mean."""
    rank = F.col(f"{prefix}_rank")
    shares = [F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias(f"{prefix}_top_{k}") for k in ks]
    return diagnostics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("query_id").alias("n_queries"), *shares,
        F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias(f"{prefix}_mrr"), F.avg(rank.cast("double")).alias(f"{prefix}_mean_rank"), F.percentile(rank.cast("double"), F.lit(0.5)).alias(f"{prefix}_median_rank"),
    )


def ceiling(diagnostics: DataFrame, by: list[str], k: int, top: int = 10) -> DataFrame:
    """Shares of ground truth that the baseline cannot reach within k, that is reached and hit or missed in the model's
    top, that the baseline has in its own top, that moved up or down, and the mean and median displacement."""
    base, model, moved = F.col("baseline_rank"), F.col("model_rank"), F.col("displacement")
    reach, hit = F.coalesce(base <= k, F.lit(False)), F.coalesce(model <= top, F.lit(False))
    share = lambda c, name: F.avg(F.when(c, 1.0).otherwise(0.0)).alias(name)
    return diagnostics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), share(~reach, "share_unreachable"), share(reach & hit, "share_reachable_hit"), share(reach & ~hit, "share_reachable_miss"),
        share(base <= top, "share_baseline_top"), share(moved > 0, "share_improved"), share(moved < 0, "share_hurt"),
        F.avg(moved.cast("double")).alias("mean_displacement"), F.percentile(moved.cast("double"), F.lit(0.5)).alias("median_displacement"),
    )


def run_summary(diagnostics: DataFrame, projects: DataFrame, gaps: DataFrame, k: int) -> DataFrame:
    """One row for each (source, target, scenario): both rank summaries, the ceiling, the gap of the pair, both sides'
    metadata, and whether the domains agree (false where one is unknown)."""
    keys = ["source_project", "target_project", "scenario"]
    out = ceiling(diagnostics, keys, k).join(rank_summary(diagnostics, keys, "model").drop("n_rows"), keys).join(rank_summary(diagnostics, keys, "baseline").drop("n_rows", "n_queries"), keys)
    out = with_metadata(with_pair_value(out, gaps, "project_A", "project_B", "domain_gap_accuracy"), projects)
    return out.withColumn("same_domain", F.coalesce(F.col("src_domain") == F.col("tgt_domain"), F.lit(False)))


def displacement_stats(diagnostics: DataFrame, by: list[str]) -> DataFrame:
    """Where both ranks are there: n, share improved, mean, min, max and quartiles of the displacement."""
    d = F.col("displacement").cast("double")
    q = [F.percentile(d, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return diagnostics.where(F.col("displacement").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(d > 0, 1.0).otherwise(0.0)).alias("share_improved"), F.avg(d).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"), *q)


def pair_report(results: DataFrame, baseline: DataFrame, one: str, two: str, scenarios: list[str]) -> DataFrame:
    """All rows of both directions of a pair in scenario order, with the target's baseline MRR."""
    both = results.where(F.col("source_project").isin(one, two) & F.col("target_project").isin(one, two))
    position = F.array_position(F.array(*map(F.lit, scenarios)), F.col("scenario"))
    joined = both.join(baseline.select("target_project", F.col("mrr").alias("baseline_mrr")), "target_project", "left")
    return joined.withColumn("scenario_ord", position).orderBy("source_project", "target_project", "scenario_ord", "model_name")
