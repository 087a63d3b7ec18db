"""Consolidation of report corpora: five raw shapes into one table, and ordered deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlab.functions import text as X
from rlab.schemas import REPORTS, fields


def to_utc(value: Column, kind: str) -> Column:
    """Epoch milliseconds or ISO text as a timestamp; what does not parse is null."""
    return F.timestamp_millis(value.cast("long")) if kind == "epoch_ms" else F.try_to_timestamp(value.cast("string"))


def _reports(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The canonical columns; those not given are null."""
    columns["source_dataset"] = F.lit(source)
    return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields(REPORTS)])


def canonicalise_ye(raw: DataFrame) -> DataFrame:
    return _reports(
        raw, "ye", repo_name=X.std_repo_name(F.col("repo_name")), bug_id=F.col("bug_id"), bug_report_text=X.join_text(F.col("summary"), F.col("description")),
        ground_truth_files=X.parse_file_list(F.col("files")), creation_date=to_utc(F.col("report_timestamp"), "epoch_ms"), fix_date=to_utc(F.col("commit_timestamp"), "epoch_ms"),
        pre_fix_commit_sha=F.col("before_fix_sha"), fix_commit_sha=F.col("after_fix_sha"), language=F.col("language"),
    )


def canonicalise_lca(raw: DataFrame) -> DataFrame:
    return _reports(
        raw, "lca", repo_name=X.std_repo_name(F.concat_ws("/", "repo_owner", "repo_name")), bug_id=F.col("id"), bug_report_text=X.join_text(F.col("issue_title"), F.col("issue_body")),
        ground_truth_files=X.parse_file_list(F.col("changed_files")), fix_date=to_utc(F.col("pull_create_at"), "iso"), pre_fix_commit_sha=F.col("base_sha"),
        fix_commit_sha=F.col("head_sha"), language=F.col("repo_language"), bug_report_url=F.col("issue_url"), fix_url=F.col("pull_url"),
    )


def canonicalise_beetle(raw: DataFrame) -> DataFrame:
    return _reports(
        raw, "beetle", repo_name=X.std_repo_name(F.col("repo_name")), bug_id=F.col("issue_id"), bug_report_text=X.join_text(F.col("title"), F.col("body")),
        ground_truth_files=X.parse_file_list(F.col("updated_files")), creation_date=to_utc(F.col("report_datetime"), "iso"), fix_date=to_utc(F.col("commit_datetime"), "iso"),
        pre_fix_commit_sha=F.col("before_fix_sha"), fix_commit_sha=F.col("after_fix_sha"), language=F.col("language"), bug_report_url=F.col("issue_url"), fix_url=F.col("pull_url"),
    )


def canonicalise_b4bl(raw: DataFrame) -> DataFrame:
    return _reports(
        raw, "b4bl", repo_name=X.std_repo_name(F.col("repo_name")), bug_id=F.col("bug_id"), bug_report_text=F.col("bug_report"), ground_truth_files=F.coalesce("fixed_files", X.empty()),
        creation_date=to_utc(F.col("report_date"), "iso"), fix_date=to_utc(F.col("fix_date"), "iso"), pre_fix_commit_sha=F.col("before_fix_sha"), language=F.col("language"),
    )


def canonicalise_swe(raw: DataFrame) -> DataFrame:
    return _reports(
        raw, "swe", repo_name=X.std_repo_name(F.col("repo")), bug_id=F.col("instance_id"), bug_report_text=X.join_text(F.col("problem_statement"), F.col("hints_text")),
        ground_truth_files=X.patch_paths(F.col("patch")), creation_date=to_utc(F.col("created_at"), "iso"), pre_fix_commit_sha=F.col("base_commit"), language=F.lit("python"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows, by column name; what a source lacks is null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def keep_projects(df: DataFrame, projects: DataFrame, key: str = "repo_name") -> DataFrame:
    return df.join(projects.select(key).distinct(), key, "left_semi")


def recode(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    return df.replace(mapping, subset=[column])


def one_project(df: DataFrame, repo: str, key: str = "repo_name") -> DataFrame:
    return df.where(F.col(key) == repo)


def keep_first(df: DataFrame, keys: list[str], order: list[Column], only_keyed: bool = False) -> DataFrame:
    """The first row of each key in the given order. Nulls are equal keys, or, with ``only_keyed``, rows with a null key
    are all kept. Ranking to 1 is pre-aggregated before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if not only_keyed:
        return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    firsts = df.where(keyed).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return firsts.unionByName(df.where(~keyed))


def dedupe_hierarchical(reports: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Four levels: fix URL, then (repo, fix commit), (repo, id), (repo, text). The first three only touch rows that have
    the key. A level puts the rows that have its key first, so a later level prefers rows with more of the earlier
    keys, and then the earliest arrival. ``arrival`` tells rows apart; levels move keys and digests, texts only once."""
    url, sha, number = (F.col(c).isNull() for c in ("fix_url", "fix_commit_sha", "bug_id"))
    at = F.col(arrival)
    text = F.unhex(F.sha2("bug_report_text", 256)).alias("_sha")
    out = keep_first(reports.select(arrival, "repo_name", "fix_url", "fix_commit_sha", "bug_id", text), ["fix_url"], [at], only_keyed=True)
    out = keep_first(out, ["repo_name", "fix_commit_sha"], [url, at], only_keyed=True)
    out = keep_first(out, ["repo_name", "bug_id"], [sha, url, at], only_keyed=True)
    return reports.join(keep_first(out, ["repo_name", "_sha"], [number, sha, url, at]).select(arrival), arrival, "left_semi")


def content_dedupe(df: DataFrame, content: str, order: str) -> DataFrame:
    """One row for each content, that of the least ``order`` (of equal ones all). Rows without an order come after all
    others, and stay where a content has no other. Contents are compared by digest."""
    keyed = df.withColumn("_sha", F.unhex(F.sha2(F.coalesce(F.col(content), F.lit("")), 256)))
    firsts = keyed.groupBy("_sha").agg(F.min(order).alias("_first"))
    same = (keyed["_sha"] == firsts["_sha"]) & keyed[order].eqNullSafe(firsts["_first"])
    return keyed.join(firsts, same, "left_semi").drop("_sha")


def distinct_ids(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return keep_first(df, [key], order)
