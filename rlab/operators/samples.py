"""Training tables: splits, scenarios, labelled samples, contrastive samples, triplets, folder trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rlab.functions import text as X
from rlab.operators.profile import encode_tokens

LEAST_IDS = 10


def split_ids(ids: DataFrame, key: str, test: float = 0.2, seed: int = 42, validation: float = 0.0) -> DataFrame:
    """(key, split): the first ceil(test * n) ids by seeded digest are `test`, of the rest the same with ``validation``,
    which stays empty if that would take them all; others are `train`. Fewer than ten ids are an error. Ranks come from
    counts of digest prefixes, so no task orders all ids."""
    rows = ids.select(key).distinct().withColumn("_h", X.seeded(seed, F.col(key)))
    n = rows.count()
    if n < LEAST_IDS:
        raise ValueError(f"{n} ids; at least {LEAST_IDS} are needed")
    n_test = -int(-n * test // 1)
    n_valid = -int(-(n - n_test) * validation // 1)
    n_valid = n_valid if n_valid < n - n_test else 0
    ranked = prefix_rank(rows, "_h", key)
    split = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_valid, "validation").otherwise("train")
    return ranked.select(key, split.alias("split"), "_rank")


def prefix_rank(rows: DataFrame, digest: str, tie: str, chars: int = 3) -> DataFrame:
    """``rows`` with their 1-based ``_rank`` by a hexadecimal digest: rows in earlier prefixes plus the rank within one."""
    keyed = rows.withColumn("_p", F.substring(digest, 1, chars))
    counts = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(digest, tie))
    return keyed.withColumn("_in", within).join(F.broadcast(ahead), "_p").withColumn("_rank", (F.col("_ahead") + F.col("_in")).cast("long")).drop("_p", "_in", "_ahead")


def scenarios(source: DataFrame, target_split: DataFrame, key: str, share: float = 0.25) -> DataFrame:
    """(scenario, role, side, key): training and test ids of the four scenarios. The small budget is the first
    floor(share * pool) ids of the target's pool; all four share the target's test ids."""
    pool = target_split.where("split <> 'test'")
    first = pool.agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    small = pool.crossJoin(F.broadcast(first)).where(F.col("_rank") - F.col("_first") < F.floor(F.col("_n") * share)).select(key)
    test = target_split.where("split = 'test'").select(key)
    parts = {
        "WP-small": [("train", "target", small)],
        "WP-large": [("train", "target", pool.select(key))],
        "CP-cold-start": [("train", "source", source.select(key))],
        "CP-transfer": [("train", "source", source.select(key)), ("train", "target", small)],
    }
    out = None
    for name, rows in parts.items():
        for role, side, ids in [*rows, ("test", "target", test)]:
            part = ids.select(F.lit(name).alias("scenario"), F.lit(role).alias("role"), F.lit(side).alias("side"), key)
            out = part if out is None else out.unionByName(part)
    return out


def labeled_samples(topk: DataFrame, truth: DataFrame, force_gt: bool = True, project_type: str = "target") -> DataFrame:
    """(query_id, item_id, label, project_type, retrieval_score): top candidates, and with ``force_gt`` all ground truth,
    whose score is -1 where it was not retrieved."""
    found = topk.select("query_id", "item_id", F.lit(0).alias("label"), F.col("score"))
    relevant = truth.select("query_id", "item_id", F.lit(1).alias("label"), F.lit(None).cast("double").alias("score"))
    if not force_gt:
        relevant = relevant.join(topk.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi")
    rows = found.unionByName(relevant).groupBy("query_id", "item_id").agg(F.max("label").alias("label"), F.coalesce(F.max("score"), F.lit(-1.0)).alias("retrieval_score"))
    return rows.withColumn("project_type", F.lit(project_type))


def contrastive_samples(reports: DataFrame, files: DataFrame, seed: int = 3, lines: int = 60) -> DataFrame:
    """(report_no, query_id, item_id, report, chunk): one chunk of each ground-truth file, by digest; reports are numbered
    densely from 0. reports: query_id, text; files: query_id, item_id, text."""
    chunks = files.select("query_id", "item_id", F.posexplode(X.line_chunks(F.col("text"), lines)).alias("chunk_no", "chunk"))
    order = Window.partitionBy("query_id", "item_id").orderBy(X.seeded(seed, F.col("query_id"), F.col("item_id"), F.col("chunk_no")), "chunk_no")
    picked = chunks.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    numbers = prefix_number(picked.select("query_id").distinct())
    return picked.join(numbers, "query_id").join(reports.select("query_id", F.col("text").alias("report")), "query_id").select("report_no", "query_id", "item_id", "report", "chunk_no", "chunk")


def prefix_number(ids: DataFrame, buckets: int = 1024) -> DataFrame:
    """(query_id, report_no): ids numbered from 0 in order, by range buckets and counts, with no global window."""
    bounds = ids.agg(F.min("query_id").alias("_lo"), F.max("query_id").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / buckets + 1
    keyed = ids.crossJoin(F.broadcast(bounds)).withColumn("_b", F.floor((F.col("query_id") - F.col("_lo")) / width)).drop("_lo", "_hi")
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy("query_id"))
    return keyed.withColumn("_in", within).join(F.broadcast(ahead), "_b").select("query_id", (F.col("_ahead") + F.col("_in") - 1).cast("long").alias("report_no"))


def triplets(positives: DataFrame, negatives: DataFrame, most: int = 10, seed: int = 5) -> DataFrame:
    """(query_id, pos, neg): up to ``most`` triplets of each report, over all of its positives. Both sides are cut to
    ``most`` by digest before they are paired, which loses none that could be chosen."""

    def first(df: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(X.seeded(seed, F.col("query_id"), F.col("item_id")), "item_id")
        return df.withColumn(f"_{name}", F.row_number().over(order)).where(F.col(f"_{name}") <= most).select("query_id", F.col("item_id").alias(name), f"_{name}")

    pairs = first(positives, "pos").join(first(negatives, "neg"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("_pos") + F.col("_neg"), "_pos")
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("query_id", "pos", "neg")


def finetune_pairs(positives: DataFrame, negatives: DataFrame, functions: DataFrame, n_pos: int = 5, n_files: int = 15, n_neg: int = 3, seed: int = 9) -> DataFrame:
    """(query_id, item_id, fn_no, label): up to ``n_pos`` functions of each ground-truth file, and up to ``n_neg`` of each
    of ``n_files`` negative files, all by digest."""
    by_query = Window.partitionBy("query_id").orderBy(X.seeded(seed, F.col("query_id"), F.col("item_id")), "item_id")
    files = negatives.select("query_id", "item_id").distinct().withColumn("_f", F.row_number().over(by_query)).where(F.col("_f") <= n_files).drop("_f")
    rows = positives.select("query_id", "item_id", F.lit(1).alias("label")).distinct().unionByName(files.withColumn("label", F.lit(0)))
    by_file = Window.partitionBy("query_id", "item_id").orderBy(X.seeded(seed, F.col("query_id"), F.col("item_id"), F.col("fn_no")), "fn_no")
    picked = rows.join(functions.select("item_id", "fn_no"), "item_id").withColumn("_k", F.row_number().over(by_file))
    return picked.where(F.col("_k") <= F.when(F.col("label") == 1, n_pos).otherwise(n_neg)).select("query_id", "item_id", "fn_no", "label")


def token_grid(blobs: DataFrame, table: DataFrame, max_lines: int, max_len: int) -> DataFrame:
    """(id, line_no, ids): the first lines of every blob as padded token ids, a blob once."""
    lines = blobs.dropDuplicates(["id"]).select("id", F.posexplode(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, max_lines)).alias("line_no", "line"))
    keyed = lines.select(F.struct("id", "line_no").alias("id"), X.text_tokens(F.col("line")).alias("tokens"))
    return encode_tokens(keyed, table, max_len).select("id.id", "id.line_no", "ids")


def stratified_projects(projects: DataFrame, strata: list[str], n: int = 1, seed: int = 1, key: str = "repo_name") -> DataFrame:
    """n projects of each stratum by digest."""
    order = Window.partitionBy(*strata).orderBy(X.seeded(seed, F.col(key)), key)
    return projects.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def dir_tree(paths: DataFrame, max_files: int = 1000) -> DataFrame:
    """(commit_sha, path, parent, depth, is_leaf): every file and all its folders, for the first ``max_files`` paths of a
    commit; the root is the empty path."""
    first = paths.withColumn("_r", F.row_number().over(Window.partitionBy("commit_sha").orderBy("path"))).where(F.col("_r") <= max_files)
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), F.array_join(F.slice(parts, 1, k - 1), "/").alias("parent"), k.alias("depth"), (k == F.size(parts)).alias("is_leaf")))
    nodes = first.select("commit_sha", F.explode(steps).alias("n")).select("commit_sha", "n.*")
    return nodes.groupBy("commit_sha", "path").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("is_leaf").alias("is_leaf"))


def children(tree: DataFrame) -> DataFrame:
    """(commit_sha, path, children): sorted children of every folder; a commit's tree is bounded by ``max_files``."""
    return tree.groupBy("commit_sha", F.col("parent").alias("path")).agg(F.sort_array(F.collect_list(F.col("path"))).alias("children"))


def report_sequences(reports: DataFrame, table: DataFrame, max_len: int) -> DataFrame:
    """(query_id, ids, length, commit_sha) of every report, labelled or not."""
    tokens = reports.select(F.col("query_id").alias("id"), X.text_tokens(F.col("text")).alias("tokens"))
    return encode_tokens(tokens, table, max_len).withColumnRenamed("id", "query_id").join(reports.select("query_id", "commit_sha"), "query_id")
