"""The given tables in the shapes of this library, and the same shapes as SQL common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlab.functions import text as X
from rlab.operators.joins import SCENARIOS
from rlab.sources.io import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found


def rounded(sql: str, keep: str, doubles: str = "", places: int = 6) -> str:
    """Named columns of a query, doubles rounded as ``stats.round_columns`` does."""
    shaped = [f"round(CAST({c} AS DOUBLE), {places}) + 0.0 AS {c}" for c in doubles.split()]
    return f"SELECT {', '.join([*keep.split(), *shaped])} FROM ({sql})"


def rounded_means(sql: str, keep: str, doubles: str = "", places: int = 6) -> str:
    return rounded(exact_means(sql), keep, doubles, places)


def _closed(sql: str, at: int) -> int:
    """The place behind the bracket that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(sql)):
        depth += (sql[k] == "(") - (sql[k] == ")")
        if not depth:
            return k + 1
    raise ValueError("open bracket")


def exact_means(sql: str) -> str:
    """The query with every mean over whole numbers of 1e-9, as ``compare.mean`` takes it."""
    out, at = "", 0
    for found in re.finditer(r"\bavg\(", sql):
        if found.start() < at:
            continue
        end = _closed(sql, found.end() - 1)
        value, rest = sql[found.end() : end - 1], re.match(r" FILTER (?=\()", sql[end:])
        stop = _closed(sql, end + rest.end()) if rest else end
        only = sql[end:stop]
        out += sql[at : found.start()] + f"(CAST(sum(CAST(round(CAST({value} AS DOUBLE) * 1e9::DOUBLE) AS HUGEINT)){only} AS DOUBLE) / count({value}){only} / 1e9::DOUBLE)"
        at = stop
    return out + sql[at:]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results grid: line items by flag, supplier, part and line number. Sums are of whole numbers, so both engines
    get the same means."""
    n = F.count(F.lit(1)).cast("double")
    total = lambda c, k: F.sum(F.round(F.col(c) * k).cast("long")).cast("double")
    scenario = F.element_at(F.array(*map(F.lit, SCENARIOS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    keyed = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model_name"), (F.col("l_suppkey") % 10).alias("source_project"), (F.col("l_partkey") % 13).alias("target_project"), scenario.alias("scenario"), "l_discount", "l_tax", "l_quantity")
    return keyed.groupBy("model_name", "source_project", "target_project", "scenario").agg(
        F.round(total("l_discount", 100) / (10 * n), 4).alias("MRR"), F.round(total("l_tax", 100) / (10 * n), 4).alias("MAP"), F.round(total("l_quantity", 1) / (50 * n), 4).alias("top_10")
    )


GRID = """grid AS (
  SELECT l_returnflag AS model_name, l_suppkey % 10 AS source_project, l_partkey % 13 AS target_project,
         CASE l_linenumber % 4 WHEN 0 THEN 'WP-small' WHEN 1 THEN 'WP-large' WHEN 2 THEN 'CP-cold-start' ELSE 'CP-transfer' END AS scenario,
         round(CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (10 * CAST(count(*) AS DOUBLE)), 4) AS MRR,
         round(CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / (10 * CAST(count(*) AS DOUBLE)), 4) AS MAP,
         round(CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) / (50 * CAST(count(*) AS DOUBLE)), 4) AS top_10
  FROM lineitem GROUP BY ALL)"""


def reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetitions of the small budget: line items by flag, part and supplier modulo 3."""
    n = F.count(F.lit(1)).cast("double")
    keyed = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model_name"), (F.col("l_partkey") % 13).alias("target_project"), (F.col("l_suppkey") % 3 + 1).alias("rep"), "l_discount")
    return keyed.groupBy("model_name", "target_project", "rep").agg(F.round(F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double") / (10 * n), 4).alias("MRR"))


REPS = """reps AS (
  SELECT l_returnflag AS model_name, l_partkey % 13 AS target_project, l_suppkey % 3 + 1 AS rep,
         round(CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (10 * CAST(count(*) AS DOUBLE)), 4) AS MRR
  FROM lineitem GROUP BY ALL)"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13 projects: lines and reports from parts."""
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 13).alias("repo_name")).agg((F.sum("p_size") * 1000).cast("long").alias("LoC"), F.count(F.lit(1)).alias("n_bugs"))


PROJECTS = "projects AS (SELECT p_partkey % 13 AS repo_name, CAST(sum(p_size) * 1000 AS BIGINT) AS LoC, count(*) AS n_bugs FROM part GROUP BY ALL)"

DELTAS = """deltas AS (
  SELECT model_name, source_project, target_project,
         max(MRR) FILTER (scenario = 'CP-transfer') AS first_value, max(MRR) FILTER (scenario = 'WP-small') AS second_value,
         max(MRR) FILTER (scenario = 'CP-transfer') - max(MRR) FILTER (scenario = 'WP-small') AS delta
  FROM grid GROUP BY ALL HAVING first_value IS NOT NULL AND second_value IS NOT NULL)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as searchable items with code tokens."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", X.code_tokens(F.col("text")).alias("tokens"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", X.code_tokens(F.col("text")).alias("tokens"))


_TOKENS = r"list_transform(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^a-zA-Z0-9]+'), lambda t: t <> ''), lambda t: lower(t))"
TOKENS = f"corpus AS (SELECT doc_id AS item_id, text, {_TOKENS} AS tokens FROM documents), queries AS (SELECT item_id AS query_id, text, {_TOKENS} AS tokens FROM benchmark)"

TRUTH = "truth AS (SELECT q.query_id, c.item_id FROM queries q, corpus c WHERE length(q.text) > 0 AND contains(c.text, q.text))"


def bm25_sql(name: str, k: int, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> str:
    """A ranked top-k as CTEs that end in ``name`` (query_id, item_id, score, rank)."""
    return f"""{name}_n AS (SELECT count(*) AS n_docs, avg(CAST(len(tokens) AS DOUBLE)) AS avgdl FROM corpus),
{name}_p AS (SELECT item_id, len(tokens) AS dl, unnest(tokens) AS term FROM corpus),
{name}_tf AS (SELECT item_id, dl, term, count(*) AS tf FROM {name}_p GROUP BY ALL),
{name}_df AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf FROM {name}_tf, {name}_n GROUP BY term, n_docs),
{name}_idf AS (SELECT term, CASE WHEN raw_idf < 0 THEN {eps} * (SELECT avg(raw_idf) FROM {name}_df) ELSE raw_idf END AS idf FROM {name}_df),
{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM queries) GROUP BY ALL),
{name}_s AS (
  SELECT query_id, item_id, round(sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 9) AS score
  FROM {name}_tf JOIN {name}_q USING (term) JOIN {name}_idf USING (term), {name}_n GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")


#: Vectors whose id is a multiple of this are the stated query set.
QUERY_EVERY = 20


def cosine_sql(name: str, k: int) -> str:
    return f"""{name}_v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{name}_s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(list_cosine_similarity(q.v, d.v), 9) AS score
  FROM {name}_v q, {name}_v d WHERE q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> d.vec_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of snapshots: the host is the commit, the path of the URL the file."""
    clean = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(clean, "//([^/]*)/", 1).alias("commit_sha"), F.regexp_extract(clean, "//[^/]*/(.*)$", 1).alias("path"))


PATHS = r"paths AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '//([^/]*)/', 1) AS commit_sha, regexp_extract(regexp_replace(url, '[?#].*$', ''), '//[^/]*/(.*)$', 1) AS path FROM pages)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports whose keys are partly missing, as in merged corpora."""
    d, n = F.col("doc_id"), F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        F.when(d % 3 != 0, F.concat(F.lit("https://host/"), F.col("source"), F.lit("/pull/"), (n % 400).cast("string"))).alias("fix_url"),
        F.when(d % 4 != 0, F.md5("text")).alias("fix_commit_sha"), F.when(d % 5 != 0, (n % 900).cast("string")).alias("bug_id"),
        F.col("source").alias("repo_name"), F.col("text").alias("bug_report_text"), F.col("lang").alias("language"), d.alias("arrival"),
    )


REPORTS = """reports AS (
  SELECT CASE WHEN doc_id % 3 <> 0 THEN 'https://host/' || source || '/pull/' || CAST(n_chars % 400 AS VARCHAR) END AS fix_url,
         CASE WHEN doc_id % 4 <> 0 THEN md5(text) END AS fix_commit_sha, CASE WHEN doc_id % 5 <> 0 THEN CAST(n_chars % 900 AS VARCHAR) END AS bug_id,
         source AS repo_name, text AS bug_report_text, lang AS language, doc_id AS arrival FROM documents)"""
