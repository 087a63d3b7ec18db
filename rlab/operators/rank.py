"""Windows, ranking, top-k and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlab.operators.order import average_ranks, join_on, quantiles
from rlab.sources.io import stored


def rank_candidates(scores: DataFrame, query: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """1-based rank of every candidate of a query, best first, ties by item."""
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(order))


def topk_per_query(scores: DataFrame, k: int, query: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """The k best of each query. Spark cuts each task's candidates to k before the shuffle."""
    return rank_candidates(scores, query, item, score).where(F.col("rank") <= k)


def first_hit_rank(ranked: DataFrame, query: str = "query_id") -> DataFrame:
    return ranked.groupBy(query).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_hit"))


def running_precision(ranked: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits so far by rank, at the relevant rows. Only these rows are windowed."""
    order = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.where("relevant").withColumn("precision", F.count(F.lit(1)).over(order) / F.col("rank"))


def avg_rank(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the rank of a value in its group, from 1, ascending; ties share the mean of their ranks, nulls have none.
    Ranks come from the counts of distinct values, so no window holds a group."""
    ranks = stored(average_ranks(df, value, by, "_rank"), "ranks")
    return join_on(df, ranks, [*by, value], "left").withColumnRenamed("_rank", name)


def quartile_bins(df: DataFrame, value: str, name: str = "quartile") -> DataFrame:
    """Quartile of a value by edges pooled over the whole table; bins are right-closed, the least value is in the first,
    and edges that coincide make one bin."""
    found = quantiles(df, value, [], [0.0, 0.25, 0.5, 0.75, 1.0]).agg(F.first("quantiles").alias("_all"))
    edges = found.select(F.array_distinct("_all").alias("_edges"))
    inner = F.filter(F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0))), lambda e: e < F.col(value).cast("double"))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.size(inner) + 1)).drop("_edges")


def restrict_to_pool(ranked: DataFrame, pool: DataFrame, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """A ranking inside a pool of (query, item): the order stays, the ranks close up."""
    inside = ranked.join(pool.select(query, item).distinct(), [query, item], "left_semi")
    return inside.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank")))


def rank_displacement(baseline: DataFrame, model: DataFrame, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """Baseline rank - model rank where both are there: positive where the model is better."""
    one = baseline.select(query, item, F.col("rank").alias("baseline_rank"))
    two = model.select(query, item, F.col("rank").alias("model_rank"))
    return one.join(two, [query, item]).withColumn("displacement", F.col("baseline_rank") - F.col("model_rank"))


def extreme_pairs(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The n largest and the n smallest rows."""
    top = df.orderBy(F.desc(value), *ties).limit(n).withColumn("end", F.lit("largest"))
    return top.unionByName(df.orderBy(F.asc(value), *ties).limit(n).withColumn("end", F.lit("smallest")))


def best_by(df: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """The item of the largest value in each group; ties go to the least item."""
    ranked = df.where(F.col(value).isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), item)))
    return ranked.where("_rank = 1").select(*by, F.col(item).alias(f"best_{item}"), F.col(value).alias(f"best_{value}"))


def shared_pairs(results: DataFrame, model: str, keys: tuple[str, ...] = ("source_project", "target_project")) -> DataFrame:
    """All models' rows on the pairs that one model has."""
    pairs = results.where(F.col("model_name") == model).select(*keys).distinct()
    return results.join(pairs, list(keys), "left_semi")


def common_pairs(*frames: DataFrame, keys: tuple[str, ...] = ("source_project", "target_project")) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [f.select(*keys) for f in frames])


def missing_pairs(first: DataFrame, second: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return first.select(*keys).exceptAll(second.select(*keys)).distinct()
