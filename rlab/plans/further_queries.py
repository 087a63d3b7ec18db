"""Further queries: audits, code size, pools of samples, run summaries and streams that are run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlab.functions import text as X
from rlab.functions import vectors as V
from rlab.operators import clean as L
from rlab.operators import compare as C2
from rlab.operators import joins as J
from rlab.operators import metrics as M
from rlab.operators import profile as P
from rlab.operators import rank as K
from rlab.operators import retrieve as R
from rlab.operators import samples as S
from rlab.operators import stats as T
from rlab.operators.stats import round_columns
from rlab.plans import adapters as A
from rlab.plans import retrieval_queries as RQ
from rlab.plans.corpus_queries import LENGTH, VOCABULARY
from rlab.sources.io import scratch_dir
from rlab.streaming import streams


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source is the project, lang the language, and lines are counted."""
    name = F.when(F.col("doc_id") % 10 == 0, "pom.xml").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".x")))
    return A.table(spark, sf_dir, "documents").select(F.col("source").alias("repo_name"), F.when(F.col("lang") == "fr", "java").otherwise(F.col("lang")).alias("language"), name.alias("path"), X.line_count(F.col("text")).cast("long").alias("loc"))


_FILES = "files AS (SELECT source AS repo_name, CASE WHEN lang = 'fr' THEN 'java' ELSE lang END AS language, CASE WHEN doc_id % 10 = 0 THEN 'pom.xml' ELSE 'f' || doc_id || '.x' END AS path, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS loc FROM documents)"


def loc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(P.loc_profile(_files(spark, sf_dir)))


def dependency_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dependency_loc(_files(spark, sf_dir))


def distinct_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distinct_profile(A.table(spark, sf_dir, "documents"), ["doc_id", "lang", "source", "text"])


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_counts(A.table(spark, sf_dir, "orders"), "o_orderpriority")


def grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.grand_totals(P.dup_profile(A.table(spark, sf_dir, "documents"), "text", ["source", "lang"]))


def ext_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.paths(spark, sf_dir).where("path <> ''").select("commit_sha", F.array("path").alias("files"))
    return P.ext_set(files, "files", ["commit_sha"]).select("commit_sha", F.array_join("exts", " ").alias("exts"))


def ext_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions of stringified maps, by host."""
    ext = X.file_ext(F.col("path"))
    literal = F.concat(F.lit("{'"), ext, F.lit("': 1, '.z"), (F.col("page_id") % 3).cast("string"), F.lit("': 2}"))
    return P.ext_keys(A.paths(spark, sf_dir).where("path <> ''").select("commit_sha", literal.alias("m")), "m", ["commit_sha"])


def project_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.project_pairs(A.projects(spark, sf_dir), "permutations")


def keep_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers of one market segment, recoded."""
    chosen = A.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    kept = L.keep_projects(A.table(spark, sf_dir, "orders"), chosen, "o_custkey")
    return L.recode(kept, "o_orderstatus", {"O": "open"}).select("o_orderkey", "o_custkey", "o_orderstatus")


def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    events = A.table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return L.distinct_ids(events, "key", [F.col("ts"), F.col("event_id")]).select("key", "event_id")


def snapshot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that can be searched for each page, by host; two of three paths have one."""
    files = A.paths(spark, sf_dir).where("path <> ''")
    snapshots = files.select("commit_sha", "path", F.col("path").alias("blob_sha")).distinct()
    vectors = snapshots.where(F.length("path") % 3 != 0).select("blob_sha", F.array(F.lit(1.0)).alias("vec")).distinct()
    reports = files.select(F.col("page_id").alias("bug_id"), F.col("commit_sha").alias("pre_fix_commit_sha"))
    return J.snapshot_vectors(reports, snapshots, vectors).groupBy("bug_id").agg(F.count(F.lit(1)).alias("n"))


def retrieval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.paths(spark, sf_dir)
    snapshots = files.where("path <> '' and length(commit_sha) % 5 <> 0").select("commit_sha", "path", F.col("path").alias("blob_sha")).distinct()
    vectors = snapshots.where(F.length("path") % 3 != 0).select("blob_sha")
    reports = files.select(F.col("page_id").alias("bug_id"), F.col("commit_sha").alias("pre_fix_commit_sha"))
    own = files.where("page_id % 7 <> 0").select(F.col("page_id").alias("bug_id"))
    return R.retrieval_failures(reports, snapshots, vectors, own)


def rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, model = RQ._two_rankings(spark, sf_dir)
    return round_columns(M.rank_summary(M.rank_diagnostics(base, model, RQ._truth(spark, sf_dir)), []))


def rank_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, model = RQ._two_rankings(spark, sf_dir)
    return round_columns(M.rank_diagnostics(base, model, RQ._truth(spark, sf_dir)))


def displacement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, model = RQ._two_rankings(spark, sf_dir)
    return round_columns(M.displacement_stats(K.rank_displacement(base, model), []))


def running_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, truth, _ = RQ._dense(spark, sf_dir)
    return round_columns(K.running_precision(R.mark_relevant(ranked, truth)).select("query_id", "item_id", "rank", "precision"))


def skip_no_gt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(M.ranking_metrics(RQ._bm25(spark, sf_dir), RQ._truth(spark, sf_dir), A.queries(spark, sf_dir), skip_no_gt=True).select("n_queries", "n_with_gt", "mrr", "map"))


def reranked_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plug-in score (text length) over the lexical candidates."""
    found = RQ._bm25(spark, sf_dir, 20).select("query_id", "item_id")
    sized = found.join(A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "n_chars"), "item_id")
    return M.rerank(sized, lambda batch: -batch["n_chars"].astype(float), ["n_chars"]).select("query_id", "item_id", "rank")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank summaries and ceilings by pair and scenario, with metadata: line items as diagnostics."""
    li = A.table(spark, sf_dir, "lineitem")
    scenario = F.element_at(F.array(*map(F.lit, J.SCENARIOS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    base, model = (F.col("l_quantity") * 3).cast("int"), F.when(F.col("l_suppkey") % 5 != 0, (F.col("l_quantity") * 2 + F.col("l_linenumber")).cast("int"))
    rows = li.select((F.col("l_suppkey") % 10).alias("source_project"), (F.col("l_partkey") % 13).alias("target_project"), scenario.alias("scenario"), F.col("l_orderkey").alias("query_id"), base.alias("baseline_rank"), model.alias("model_rank"), (base - model).alias("displacement"))
    projects = A.projects(spark, sf_dir).withColumn("domain", F.when(F.col("repo_name") != 3, F.col("repo_name") % 4))
    gaps = projects.select(F.col("repo_name").alias("project_A"), ((F.col("repo_name") + 1) % 13).alias("project_B"), (F.col("n_bugs") / 1000).alias("domain_gap_accuracy"))
    out = M.run_summary(rows, projects, gaps, 100)
    return round_columns(out.select("source_project", "target_project", "scenario", "n_rows", "n_queries", "share_unreachable", "share_improved", "mean_displacement", "model_mrr", "baseline_top_10", "domain_gap_accuracy", "src_LoC", "tgt_LoC", "same_domain"))


def scenario_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.scenario_profile(A.grid(spark, sf_dir), ["MRR", "MAP", "top_10"]))


def size_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = A.projects(spark, sf_dir).select(F.col("repo_name").alias("target_project"), F.when(F.col("repo_name") < 6, "small").otherwise("large").alias("size"))
    return round_columns(C2.size_group_means(A.grid(spark, sf_dir), sizes, "MRR"))


def quality_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.with_source_quality(A.grid(spark, sf_dir)).where("scenario = 'CP-transfer'").withColumn("delta", F.col("MRR") - F.col("MAP"))
    return round_columns(C2.quality_extremes(rows))


def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = J.paired_delta(A.grid(spark, sf_dir), "CP-transfer", "WP-small")
    return round_columns(T.disagreements(deltas))


def common_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs on which every model gains."""
    gains = J.paired_delta(A.grid(spark, sf_dir), "CP-transfer", "WP-small").where("delta > 0")
    return K.common_pairs(*[gains.where(F.col("model_name") == m) for m in ("A", "N", "R")])


def missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gains = J.paired_delta(A.grid(spark, sf_dir), "CP-transfer", "WP-small")
    return K.missing_pairs(gains.where("model_name = 'A'"), gains.where("model_name = 'N' and delta > 0"), ("source_project", "target_project"))


def pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline = A.reps(spark, sf_dir).where("model_name = 'A' and rep = 1").select("target_project", F.col("MRR").alias("mrr"))
    return round_columns(M.pair_report(A.grid(spark, sf_dir), baseline, 2, 5, J.SCENARIOS).select("model_name", "source_project", "target_project", "scenario", F.col("scenario_ord").cast("long").alias("scenario_ord"), "MRR", "baseline_mrr"))


def finetune_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as files of their language's report, lines as functions."""
    rows = A.table(spark, sf_dir, "labels").join(A.table(spark, sf_dir, "documents"), "doc_id").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item_id"), "quality", "text")
    functions = rows.select("item_id", F.posexplode(F.split("text", "\n")).alias("fn_no", "body"))
    out = S.finetune_pairs(rows.where("quality = 1"), rows.where("quality = 0"), functions)
    return out.select("query_id", "item_id", F.col("fn_no").cast("long").alias("fn_no"), F.col("label").cast("long").alias("label"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.line_chunks(F.col("text"), 3)).alias("chunk_no", "c"))
    return chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("c").alias("chunk_md5"))


def report_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as token sequences over the documents' vocabulary."""
    tokens = A.table(spark, sf_dir, "documents").select(F.explode(X.text_tokens(F.col("text"))).alias("token"))
    reports = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.md5("text").alias("commit_sha"))
    out = S.report_sequences(reports, P.vocab(tokens, VOCABULARY, 2), LENGTH)
    return out.select("query_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), F.col("length").cast("long").alias("length"), "commit_sha")


def word_vector_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean word vector of every passage; words have two-place vectors by their length."""
    words = A.table(spark, sf_dir, "documents").select(F.explode(X.word_tokens(F.col("text"))).alias("word")).distinct()
    table = words.select("word", F.array(F.length("word").cast("double"), (F.length("word") % 3).cast("double")).alias("vec"))
    tokens = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(X.word_tokens(F.col("text"))).alias("token"))
    out = R.word_vector_pool(tokens, table)
    return round_columns(out.select(F.col("id").alias("item_id"), F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")))


def vec_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of every label, one row for each place."""
    out = V.vec_mean(A.vectors(spark, sf_dir), ["label"], "vec")
    return round_columns(out.select("label", F.posexplode("vec").alias("place", "x")).select("label", F.col("place").cast("long").alias("place"), "x"))


def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of the mean vectors of all labels."""
    means = V.vec_mean(A.vectors(spark, sf_dir), ["label"], "vec").withColumnRenamed("label", "id")
    return round_columns(R.similarity_matrix(means, means))


def cosine_topk_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 5 inside the query's own label."""
    vectors = A.vectors(spark, sf_dir)
    asked = vectors.where(F.col("item_id") % A.QUERY_EVERY == 0).select(F.col("item_id").alias("query_id"), "vec", "label")
    return round_columns(R.cosine_topk_by(asked, vectors, "label", 5)).select("query_id", "item_id", "score", "rank")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; a pattern takes a single file as well as a folder."""
    return streams.read_stream(spark, f"{sf_dir}/events.parque[t]", A.table(spark, sf_dir, "events").schema)


def stream_results_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream itself, run over all events: of each user and day the event of least time, then least id."""
    rows = _events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = scratch_dir(spark, "stream-results")
    streams.stream_results(rows, ["user_id", "day"], "ts", f"{out}/rows", f"{out}/checkpoint", ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("user_id", "day", "event_id", "event_type", F.unix_micros("ts").alias("ts_us"))


def stream_scores_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream itself, run over all events: daily means by type of all days that the watermark closed."""
    rows = _events(spark, sf_dir)
    out = scratch_dir(spark, "stream-scores")
    scores = streams.run_available(streams.stream_scores(rows, "ts", "value", ["event_type"]), f"{out}/rows", f"{out}/checkpoint")
    return round_columns(scores.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "mean", "n"))


QUERIES = {f.__name__: f for f in (loc_profile, dependency_loc, distinct_profile, value_counts, grand_totals, ext_sets, ext_keys, project_pairs, keep_projects, distinct_ids, snapshot_vectors, retrieval_failures, rank_summary, rank_diagnostics, displacement_stats, running_precision, skip_no_gt_metrics, reranked_metrics, run_summary, scenario_profile, size_group_means, quality_extremes, disagreements, common_pairs, missing_pairs, pair_report, finetune_pairs, line_chunks, report_sequences, word_vector_pool, vec_mean, similarity_matrix, cosine_topk_by_label, stream_results_run, stream_scores_run)}

_EXT = r"CASE WHEN regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^./][^/]*(\.[^./]*)$', 1) IN ('', '.') THEN 'no_extension' ELSE lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^./][^/]*(\.[^./]*)$', 1)) END"
_D = f"WITH {A.GRID}, {A.DELTAS}"
_DIR = "CASE WHEN {x} > 0.01 THEN 'positive' WHEN {x} < -0.01 THEN 'negative' ELSE 'neutral' END"
_DIAG = f"""{RQ._TWO}, d AS (SELECT t.query_id, t.item_id, b.rank AS baseline_rank, b.score AS baseline_score, m.rank AS model_rank, m.score AS model_score, b.rank - m.rank AS displacement, coalesce(c.n, 0) AS n_candidates
FROM (SELECT DISTINCT query_id, item_id FROM truth) t LEFT JOIN base b USING (query_id, item_id) LEFT JOIN model m USING (query_id, item_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM model GROUP BY query_id) c USING (query_id))"""
_SCENARIO = "CASE l_linenumber % 4 WHEN 0 THEN 'WP-small' WHEN 1 THEN 'WP-large' WHEN 2 THEN 'CP-cold-start' ELSE 'CP-transfer' END"

ORACLES = {
    "loc_profile": A.rounded(
        f"""WITH {_FILES}, l AS (SELECT repo_name, language, sum(loc) AS loc FROM files GROUP BY ALL)
SELECT repo_name, CAST(sum(loc) AS BIGINT) AS loc, arg_max(language, (loc, language)) AS primary_language, CAST(max(loc) AS BIGINT) AS primary_loc, coalesce(max(loc) / nullif(CAST(sum(loc) AS DOUBLE), 0), 0) AS polyglot_index FROM l GROUP BY repo_name""",
        "repo_name loc primary_language primary_loc",
        "polyglot_index",
    ),
    "dependency_loc": f"WITH {_FILES} SELECT repo_name, language, CAST(sum(loc) AS BIGINT) AS dependency_loc FROM files WHERE language = 'java' AND path = 'pom.xml' GROUP BY ALL",
    "distinct_profile": "SELECT count(DISTINCT doc_id) AS distinct_doc_id, count(DISTINCT lang) AS distinct_lang, count(DISTINCT source) AS distinct_source, count(DISTINCT text) AS distinct_text FROM documents",
    "value_counts": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "grand_totals": "SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS reports, CAST(sum(u) AS BIGINT) AS unique_reports FROM (SELECT source, lang, count(*) AS n, count(DISTINCT text) AS u FROM documents GROUP BY ALL)",
    "ext_sets": f"WITH {A.PATHS} SELECT commit_sha, string_agg(DISTINCT ext, ' ' ORDER BY ext) AS exts FROM (SELECT commit_sha, {_EXT} AS ext FROM paths WHERE path <> '') GROUP BY commit_sha",
    "ext_keys": f"WITH {A.PATHS} SELECT DISTINCT commit_sha, unnest([{_EXT}, '.z' || page_id % 3]) AS ext FROM paths WHERE path <> ''",
    "project_pairs": f"WITH {A.PROJECTS} SELECT a.repo_name AS project_a, b.repo_name AS project_b FROM projects a, projects b WHERE a.repo_name <> b.repo_name",
    "keep_projects": "SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "distinct_ids": "SELECT key, event_id FROM (SELECT user_id || ':' || event_type AS key, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "snapshot_vectors": f"WITH {A.PATHS}, s AS (SELECT DISTINCT commit_sha, path FROM paths WHERE path <> '' AND length(path) % 3 <> 0) SELECT page_id AS bug_id, count(*) AS n FROM paths p JOIN s USING (commit_sha) WHERE p.path <> '' GROUP BY ALL",
    "retrieval_failures": f"""WITH {A.PATHS}, s AS (SELECT DISTINCT commit_sha, path FROM paths WHERE path <> '' AND length(commit_sha) % 5 <> 0),
r AS (SELECT CASE WHEN commit_sha NOT IN (SELECT commit_sha FROM s) THEN 'no_commit' WHEN commit_sha NOT IN (SELECT commit_sha FROM s WHERE path IN (SELECT path FROM s WHERE length(path) % 3 <> 0)) THEN 'no_snapshot_vectors' WHEN page_id % 7 = 0 THEN 'no_query_vector' ELSE 'ok' END AS reason FROM paths)
SELECT reason, count(*) AS n FROM r GROUP BY reason""",
    "rank_summary": A.rounded(
        f"""WITH {_DIAG} SELECT count(*) AS n_rows, count(DISTINCT query_id) AS n_queries, avg(CASE WHEN model_rank <= 1 THEN 1.0 ELSE 0 END) AS model_top_1, avg(CASE WHEN model_rank <= 5 THEN 1.0 ELSE 0 END) AS model_top_5, avg(CASE WHEN model_rank <= 10 THEN 1.0 ELSE 0 END) AS model_top_10,
avg(coalesce(1.0 / model_rank, 0)) AS model_mrr, avg(model_rank) AS model_mean_rank, quantile_cont(CAST(model_rank AS DOUBLE), 0.5) AS model_median_rank FROM d""",
        "n_rows n_queries",
        "model_top_1 model_top_5 model_top_10 model_mrr model_mean_rank model_median_rank",
    ),
    "rank_diagnostics": A.rounded(f"WITH {_DIAG} SELECT * FROM d", "query_id item_id baseline_rank model_rank displacement n_candidates", "baseline_score model_score"),
    "displacement_stats": A.rounded(
        f"WITH {RQ._TWO}, d AS (SELECT CAST(b.rank - m.rank AS DOUBLE) AS x FROM base b JOIN model m USING (query_id, item_id)) SELECT count(*) AS n, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END) AS share_improved, avg(x) AS mean, min(x) AS least, max(x) AS most, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM d",
        "n",
        "share_improved mean least most q1 median q3",
    ),
    "running_precision": A.rounded(f"WITH {RQ._DENSE} SELECT query_id, item_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) / CAST(rank AS DOUBLE) AS precision FROM ranked JOIN truth USING (query_id, item_id)", "query_id item_id rank", "precision"),
    "skip_no_gt_metrics": A.rounded(
        f"""WITH {A.TOKENS}, {A.TRUTH}, {A.bm25_sql("ranked", RQ.TOP)}, f AS (SELECT r.query_id, min(rank) AS first_hit, avg(hits / CAST(rank AS DOUBLE)) AS ap FROM (SELECT r.query_id, r.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS hits FROM ranked r JOIN truth t ON r.query_id = t.query_id AND r.item_id = t.item_id) r GROUP BY r.query_id)
SELECT count(*) AS n_queries, count(gt) AS n_with_gt, avg(coalesce(1.0 / first_hit, 0)) FILTER (gt = 1) AS mrr, avg(coalesce(ap, 0)) FILTER (gt = 1) AS map FROM (SELECT DISTINCT query_id FROM queries) LEFT JOIN (SELECT DISTINCT query_id, 1 AS gt FROM truth) USING (query_id) LEFT JOIN f USING (query_id)""",
        "n_queries n_with_gt",
        "mrr map",
    ),
    "reranked_metrics": f"WITH {A.TOKENS}, {A.bm25_sql('ranked', 20)} SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, item_id) AS rank FROM ranked JOIN documents ON doc_id = item_id",
    "run_summary": A.rounded(
        f"""WITH {A.PROJECTS}, p AS (SELECT *, CASE WHEN repo_name <> 3 THEN repo_name % 4 END AS domain FROM projects), g AS (SELECT least(repo_name, (repo_name + 1) % 13) AS a, greatest(repo_name, (repo_name + 1) % 13) AS b, n_bugs / 1000.0::DOUBLE AS gap FROM projects),
d AS (SELECT l_suppkey % 10 AS source_project, l_partkey % 13 AS target_project, {_SCENARIO} AS scenario, l_orderkey AS q, CAST(l_quantity * 3 AS INT) AS br, CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_quantity * 2 + l_linenumber AS INT) END AS mr FROM lineitem),
s AS (SELECT source_project, target_project, scenario, count(*) AS n_rows, count(DISTINCT q) AS n_queries, avg(CASE WHEN br <= 100 THEN 0.0 ELSE 1 END) AS share_unreachable, avg(CASE WHEN br - mr > 0 THEN 1.0 ELSE 0 END) AS share_improved, avg(br - mr) AS mean_displacement,
avg(coalesce(1.0::DOUBLE / mr, 0)) AS model_mrr, avg(CASE WHEN br <= 10 THEN 1.0 ELSE 0 END) AS baseline_top_10 FROM d GROUP BY ALL)
SELECT s.*, gap AS domain_gap_accuracy, x.LoC AS src_LoC, y.LoC AS tgt_LoC, coalesce(x.domain = y.domain, false) AS same_domain FROM s LEFT JOIN g ON a = least(source_project, target_project) AND b = greatest(source_project, target_project) LEFT JOIN p x ON x.repo_name = source_project LEFT JOIN p y ON y.repo_name = target_project""",
        "source_project target_project scenario n_rows n_queries src_LoC tgt_LoC same_domain",
        "share_unreachable share_improved mean_displacement model_mrr baseline_top_10 domain_gap_accuracy",
    ),
    "scenario_profile": A.rounded_means(f"WITH {A.GRID} SELECT CASE WHEN GROUPING(scenario) = 1 THEN 'All' ELSE scenario END AS scenario, avg(MRR) AS MRR, avg(MAP) AS MAP, avg(top_10) AS top_10, count(*) AS n FROM grid GROUP BY GROUPING SETS ((scenario), ())", "scenario n", "MRR MAP top_10"),
    "size_group_means": A.rounded_means(f"WITH {A.GRID} SELECT model_name, CASE WHEN target_project < 6 THEN 'small' ELSE 'large' END AS size, avg(MRR) AS mean, count(MRR) AS n FROM grid WHERE scenario = 'WP-large' GROUP BY ALL", "model_name size n", "mean"),
    "quality_extremes": A.rounded_means(
        f"""WITH {A.GRID}, q AS (SELECT model_name, target_project AS source_project, avg(MRR) AS sq FROM grid WHERE scenario = 'WP-large' GROUP BY ALL), m AS (SELECT source_project, max(sq) AS quality, avg(MRR - MAP) AS mean_delta FROM grid LEFT JOIN q USING (model_name, source_project) WHERE scenario = 'CP-transfer' GROUP BY source_project),
r AS (SELECT *, row_number() OVER (ORDER BY quality DESC, source_project) AS b, row_number() OVER (ORDER BY quality, source_project) AS w FROM m WHERE quality IS NOT NULL) SELECT source_project, quality, mean_delta, CASE WHEN b <= 3 THEN 'best' ELSE 'worst' END AS "end" FROM r WHERE b <= 3 OR w <= 3""",
        'source_project "end"',
        "quality mean_delta",
    ),
    "disagreements": A.rounded(f"{_D} SELECT source_project, target_project, a.model_name AS model_a, a.delta AS delta_a, b.model_name AS model_b, b.delta AS delta_b FROM deltas a JOIN deltas b USING (source_project, target_project) WHERE a.model_name < b.model_name AND {_DIR.format(x='a.delta')} <> {_DIR.format(x='b.delta')}", "source_project target_project model_a model_b", "delta_a delta_b"),
    "common_pairs": f"{_D} SELECT source_project, target_project FROM deltas WHERE delta > 0 GROUP BY ALL HAVING count(DISTINCT model_name) = 3",
    "missing_pairs": f"{_D} SELECT source_project, target_project FROM deltas WHERE model_name = 'A' EXCEPT SELECT source_project, target_project FROM deltas WHERE model_name = 'N' AND delta > 0",
    "pair_report": A.rounded(
        f"""WITH {A.GRID}, {A.REPS} SELECT g.model_name, source_project, target_project, scenario, CAST(list_position(['WP-small', 'WP-large', 'CP-cold-start', 'CP-transfer'], scenario) AS BIGINT) AS scenario_ord, g.MRR, r.MRR AS baseline_mrr
FROM grid g LEFT JOIN (SELECT * FROM reps WHERE model_name = 'A' AND rep = 1) r USING (target_project) WHERE source_project IN (2, 5) AND target_project IN (2, 5)""",
        "model_name source_project target_project scenario scenario_ord",
        "MRR baseline_mrr",
    ),
    "finetune_pairs": """WITH r AS (SELECT lang AS query_id, doc_id AS item_id, quality, string_split(text, chr(10)) AS fns, row_number() OVER (PARTITION BY lang, quality ORDER BY md5('9:' || lang || ':' || doc_id), doc_id) AS f FROM labels JOIN documents USING (doc_id)),
k AS (SELECT *, unnest(range(0, len(fns))) AS fn_no FROM r WHERE quality = 1 OR f <= 15), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY md5('9:' || query_id || ':' || item_id || ':' || fn_no), fn_no) AS c FROM k)
SELECT query_id, item_id, fn_no, CAST(quality AS BIGINT) AS label FROM n WHERE c <= CASE WHEN quality = 1 THEN 5 ELSE 3 END""",
    "line_chunks": r"""WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), c AS (SELECT doc_id, k, array_to_string(lines[k : k + 2], chr(10)) AS c FROM (SELECT *, unnest(range(1, len(lines) + 1, 3)) AS k FROM l)),
f AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_no FROM c WHERE trim(replace(c, chr(10), '')) <> '') SELECT doc_id, chunk_no, md5(c) AS chunk_md5 FROM f
UNION ALL SELECT doc_id, 0, md5(substring(coalesce(text, ''), 1, 2000)) FROM l WHERE trim(replace(coalesce(text, ''), chr(10), '')) = ''""",
    "report_sequences": r"""WITH tok AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+')) AS token FROM documents), usual AS (SELECT token, count(*) AS n FROM tok GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 49998),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM usual), b AS (SELECT item_id AS query_id, md5(text) AS commit_sha, regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+')[1:256] AS t FROM benchmark),
p AS (SELECT query_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS k FROM b), c AS (SELECT query_id, list(CAST(coalesce(id, 1) AS VARCHAR) ORDER BY k) AS ids FROM p LEFT JOIN v USING (token) GROUP BY query_id)
SELECT query_id, array_to_string(list_concat(coalesce(ids, []), list_transform(range(256), lambda x: '0'))[1:256], ' ') AS ids, CAST(greatest(len(t), 1) AS BIGINT) AS length, commit_sha FROM b LEFT JOIN c USING (query_id)""",
    "word_vector_pool": A.rounded(
        """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+')) AS word FROM documents), t AS (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+')) AS token FROM benchmark),
u AS (SELECT DISTINCT token FROM t WHERE token NOT IN (SELECT word FROM w)), p AS (SELECT token, avg(CAST(length(word) AS DOUBLE)) AS x, avg(CAST(length(word) % 3 AS DOUBLE)) AS y FROM (SELECT token, lower(unnest(regexp_extract_all(token, '[A-Z][a-z]*|[a-z]+'))) AS word FROM u) JOIN w USING (word) GROUP BY token)
SELECT item_id, avg(CASE WHEN word IS NOT NULL THEN CAST(length(token) AS DOUBLE) ELSE coalesce(x, 0) END) AS x, avg(CASE WHEN word IS NOT NULL THEN CAST(length(token) % 3 AS DOUBLE) ELSE coalesce(y, 0) END) AS y
FROM t LEFT JOIN w ON word = token LEFT JOIN p USING (token) GROUP BY item_id""",
        "item_id",
        "x y",
    ),
    "vec_mean": A.rounded("SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL", "label place", "x"),
    "similarity_matrix": A.rounded(
        """WITH m AS (SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL), v AS (SELECT label AS id, list(x ORDER BY place) AS v FROM m GROUP BY label)
SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.v, b.v) AS cosine FROM v a, v b""",
        "id_a id_b",
        "cosine",
    ),
    "cosine_topk_by_label": A.rounded(
        f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM v q JOIN v d USING (label) WHERE q.vec_id % {A.QUERY_EVERY} = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 5""",
        "query_id item_id rank",
        "score",
    ),
    "stream_results_run": """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type, epoch_us(ts) AS ts_us FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) = 1""",
    "stream_scores_run": A.rounded("WITH w AS (SELECT CAST(ts AS DATE) AS d, event_type, avg(value) AS mean, count(value) AS n FROM events GROUP BY ALL) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, mean, n FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)", "day event_type n", "mean"),
}
