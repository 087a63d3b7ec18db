"""Queries on retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlab.functions import vectors as V
from rlab.functions.text import line_chunks, split_report
from rlab.operators import joins as J
from rlab.operators import metrics as M
from rlab.operators import profile as P
from rlab.operators import rank as K
from rlab.operators import retrieve as R
from rlab.operators.stats import round_columns
from rlab.plans import adapters as A
from rlab.sources.io import stored

TOP, POOL, KS = R.RECALL_KS[-1], 300, R.RECALL_KS
#: Vectors of one project that are compared with those of another.
SAMPLE = 1000


def _bm25(spark: SparkSession, sf_dir: str, k: int = TOP, **how) -> DataFrame:
    corpus = A.corpus(spark, sf_dir)
    if "shared" not in how:
        how["posted"] = R.postings(corpus, text="text")
    return R.bm25_topk(A.queries(spark, sf_dir), corpus, k, **how)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.containing(A.queries(spark, sf_dir), A.corpus(spark, sf_dir))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_bm25(spark, sf_dir, 10)).select("query_id", "item_id", "score", "rank")


def bm25_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(R.recall_at_k(_bm25(spark, sf_dir), _truth(spark, sf_dir), A.queries(spark, sf_dir), KS))


def bm25_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(M.ranking_metrics(_bm25(spark, sf_dir), _truth(spark, sf_dir), A.queries(spark, sf_dir)))


def _metrics_sql(ranked: str) -> str:
    return f"""
SELECT count(*) AS n_queries, count(gt) AS n_with_gt, avg(CASE WHEN first_hit <= 1 THEN 1.0 ELSE 0 END) AS top_1, avg(CASE WHEN first_hit <= 5 THEN 1.0 ELSE 0 END) AS top_5,
       avg(CASE WHEN first_hit <= 10 THEN 1.0 ELSE 0 END) AS top_10, avg(coalesce(1.0 / first_hit, 0)) AS mrr, avg(coalesce(ap, 0)) AS map
FROM (SELECT DISTINCT query_id FROM queries)
LEFT JOIN (SELECT DISTINCT query_id, 1 AS gt FROM truth) USING (query_id)
LEFT JOIN (SELECT query_id, min(rank) AS first_hit, avg(hits / CAST(rank AS DOUBLE)) AS ap
           FROM (SELECT r.query_id, r.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS hits FROM {ranked} r JOIN truth t ON r.query_id = t.query_id AND r.item_id = t.item_id)
           GROUP BY query_id) USING (query_id)"""


def _recall_sql(ranked: str) -> str:
    return f"""
SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (first_hit <= k) AS hits, count(*) AS valid, count(*) FILTER (first_hit <= k) / CAST(count(*) AS DOUBLE) AS recall
FROM (SELECT DISTINCT query_id FROM truth) LEFT JOIN
     (SELECT r.query_id, min(r.rank) AS first_hit FROM {ranked} r JOIN truth t ON r.query_id = t.query_id AND r.item_id = t.item_id GROUP BY ALL) USING (query_id),
     (SELECT unnest({KS}) AS k) GROUP BY k"""


def _dense(spark: SparkSession, sf_dir: str, k: int = TOP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranking, relevance and queries; items of the query's label are relevant. Labels are compared on the ranked rows, and a
    query that has other items of its label stands once more without an item."""
    vectors = A.vectors(spark, sf_dir)
    asked = vectors.where(F.col("item_id") % A.QUERY_EVERY == 0).select(F.col("item_id").alias("query_id"), "vec", "label")
    ranked = stored(R.cosine_topk(asked, vectors, k, exclude_self=True), "ranked")
    labels = vectors.select("item_id", F.col("label").alias("_item_label"))
    hits = ranked.select("query_id", "item_id").join(asked.select("query_id", "label"), "query_id").join(labels, "item_id").where("label = _item_label").select("query_id", "item_id")
    shared = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    known = asked.select("query_id", "label").join(shared, "label").select("query_id", F.lit(None).cast("long").alias("item_id"))
    return ranked, hits.union(known), asked


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_dense(spark, sf_dir, 10)[0]).select("query_id", "item_id", "score", "rank")


def cosine_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(R.recall_at_k(*_dense(spark, sf_dir), KS))


def cosine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(M.ranking_metrics(*_dense(spark, sf_dir)))


_DENSE = f"""{A.cosine_sql("ranked", TOP)}, queries AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % {A.QUERY_EVERY} = 0),
truth AS (SELECT query_id, vec_id AS item_id FROM queries q JOIN embeddings e ON e.label = q.label WHERE query_id <> vec_id)"""


def _two_rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A baseline, and as the model the same scorer with other constants, over the same postings of query terms."""
    corpus = A.corpus(spark, sf_dir)
    shared = R.query_postings(A.queries(spark, sf_dir), corpus, posted=R.postings(corpus, text="text"))
    return _bm25(spark, sf_dir, shared=shared), _bm25(spark, sf_dir, k1=0.9, b=0.4, shared=shared)


_TWO = f"{A.TOKENS}, {A.TRUTH}, {A.bm25_sql('base', TOP)}, {A.bm25_sql('model', TOP, 0.9, 0.4)}"


def pool_restricted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, model = _two_rankings(spark, sf_dir)
    pool = base.where(F.col("rank") <= POOL)
    return round_columns(M.dual_eval(model, pool, _truth(spark, sf_dir), A.queries(spark, sf_dir)))


def rank_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, model = _two_rankings(spark, sf_dir)
    return K.rank_displacement(base, model)


def ceiling_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, model = _two_rankings(spark, sf_dir)
    return round_columns(M.ceiling(M.rank_diagnostics(base, model, _truth(spark, sf_dir)), [], POOL))


def recall_compare_dense_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = R.recall_at_k(_bm25(spark, sf_dir), _truth(spark, sf_dir), A.queries(spark, sf_dir), KS)
    return round_columns(J.recall_compare(R.recall_at_k(*_dense(spark, sf_dir), KS), lexical, ["k"]))


def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pair_similarity(A.vectors(spark, sf_dir), "label", "item_id", limit=SAMPLE)


def domain_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.domain_gap(A.vectors(spark, sf_dir), "label", "item_id")


def encode_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    return R.chunk_encode_pool(docs, V.HashEncoder(), 512, 462, "document ", "doc_id").withColumnRenamed("id", "doc_id")


def chunk_max_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents with the best chunk for every passage."""
    chunks = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.explode(line_chunks(F.col("text"), 10)).alias("text"))
    asked = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    enc = V.HashEncoder()
    return round_columns(R.chunk_max_sim(V.encode(asked, "text", enc), V.encode(chunks, "text", enc), 20))


def rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f1..f4 of the lexical candidates of every passage, from all chunks of their texts."""
    enc = V.HashEncoder()
    parts = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), split_report(F.col("text")).alias("r")).select("query_id", "r.summary", "r.description")
    asked = V.encode(V.encode(parts, "summary", enc, "summary_vec"), "description", enc, "description_vec")
    pairs = _bm25(spark, sf_dir, 50).select("query_id", "item_id")
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text").join(pairs.select("item_id").distinct(), "item_id", "left_semi")
    functions = V.encode(docs.select("item_id", F.explode(line_chunks(F.col("text"), 5)).alias("text")), "text", enc, keep_text=False)
    return R.function_features(asked, functions, pairs, most=None)


def ground_truth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names of every page as ground truth in its host's snapshot."""
    files = A.paths(spark, sf_dir).where("path <> ''")
    truth = files.select(F.col("page_id").alias("bug_id"), "commit_sha", F.substring_index("path", "/", -1).alias("gt")).where("gt <> ''")
    return J.match_ground_truth(truth, files.select("commit_sha", "path").distinct()).select("bug_id", "commit_sha", "gt", "path")


_MATCH = f"""{A.PATHS}, files AS (SELECT DISTINCT commit_sha, path FROM paths WHERE path <> ''),
gts AS (SELECT page_id AS bug_id, commit_sha, regexp_extract(path, '([^/]*)$', 1) AS gt FROM paths WHERE path <> '' AND regexp_extract(path, '([^/]*)$', 1) <> ''),
matches AS (SELECT bug_id, commit_sha, gt, path FROM gts JOIN files USING (commit_sha) WHERE path = gt OR ends_with(path, '/' || gt))"""


def ground_truth_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages' files are in their snapshot and have a vector; two of three paths do, by their length."""
    files = A.paths(spark, sf_dir).where("path <> ''")
    truth = files.select(F.col("page_id").alias("bug_id"), "commit_sha", F.substring_index("path", "/", -1).alias("gt")).where("gt <> ''")
    snapshots = files.select("commit_sha", "path", F.col("path").alias("blob_sha")).distinct()
    vectors = snapshots.where(F.length("path") % 3 != 0).select("blob_sha")
    commits = snapshots.where(F.length("commit_sha") % 5 != 0)
    audit = P.ground_truth_audit(J.match_ground_truth(truth, snapshots), truth, commits, vectors)
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_found").alias("n_found"), F.sum("n_vectors").alias("n_vectors"))


def ext_recall_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by extension of page paths, ranked by id within their host."""
    files = A.paths(spark, sf_dir).where("path <> ''").select("page_id", "commit_sha", "path")
    ranked = K.rank_candidates(files.select(F.col("commit_sha").alias("query_id"), F.col("page_id").alias("item_id"), F.length("path").alias("score"), "path"))
    return round_columns(R.ext_recall(ranked, [], [1, 5, 10]))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_recall_at_k, bm25_ranking_metrics, cosine_topk, cosine_recall_at_k, cosine_metrics, pool_restricted_metrics, rank_displacement, ceiling_split, recall_compare_dense_lexical, pair_similarity, domain_gap, encode_pool, chunk_max_sim, rank_features, ground_truth_match, ground_truth_audit, ext_recall_pivot)}

_METRIC_COLUMNS = ("n_queries n_with_gt", "top_1 top_5 top_10 mrr map")

ORACLES = {
    "bm25_topk": A.rounded(f"WITH {A.TOKENS}, {A.bm25_sql('ranked', 10)} SELECT * FROM ranked", "query_id item_id rank", "score"),
    "bm25_recall_at_k": A.rounded(f"WITH {A.TOKENS}, {A.TRUTH}, {A.bm25_sql('ranked', TOP)} {_recall_sql('ranked')}", "k hits valid", "recall"),
    "bm25_ranking_metrics": A.rounded(f"WITH {A.TOKENS}, {A.TRUTH}, {A.bm25_sql('ranked', TOP)} {_metrics_sql('ranked')}", *_METRIC_COLUMNS),
    "cosine_topk": A.rounded(f"WITH {A.cosine_sql('ranked', 10)} SELECT * FROM ranked", "query_id item_id rank", "score"),
    "cosine_recall_at_k": A.rounded(f"WITH {_DENSE} {_recall_sql('ranked')}", "k hits valid", "recall"),
    "cosine_metrics": A.rounded(f"WITH {_DENSE} {_metrics_sql('ranked')}", *_METRIC_COLUMNS),
    "pool_restricted_metrics": A.rounded(
        f"""WITH {_TWO}, pool AS (SELECT query_id, item_id FROM base WHERE rank <= {POOL}),
inside AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM model JOIN pool USING (query_id, item_id)),
g AS (SELECT count(*) AS gt_in_pool FROM pool JOIN truth USING (query_id, item_id))
SELECT *, 'full' AS scope FROM ({_metrics_sql("model")}), g UNION ALL SELECT *, 'pool' AS scope FROM ({_metrics_sql("inside")}), g""",
        _METRIC_COLUMNS[0] + " scope gt_in_pool",
        _METRIC_COLUMNS[1],
    ),
    "rank_displacement": f"WITH {_TWO} SELECT query_id, item_id, b.rank AS baseline_rank, m.rank AS model_rank, b.rank - m.rank AS displacement FROM base b JOIN model m USING (query_id, item_id)",
    "ceiling_split": A.rounded(
        f"""WITH {_TWO}, d AS (SELECT t.query_id, t.item_id, b.rank AS br, m.rank AS mr, b.rank - m.rank AS moved FROM truth t LEFT JOIN base b USING (query_id, item_id) LEFT JOIN model m USING (query_id, item_id)),
e AS (SELECT *, coalesce(br <= {POOL}, false) AS reach, coalesce(mr <= 10, false) AS hit FROM d)
SELECT count(*) AS n_rows, avg(CASE WHEN NOT reach THEN 1.0 ELSE 0 END) AS share_unreachable, avg(CASE WHEN reach AND hit THEN 1.0 ELSE 0 END) AS share_reachable_hit,
       avg(CASE WHEN reach AND NOT hit THEN 1.0 ELSE 0 END) AS share_reachable_miss, avg(CASE WHEN br <= 10 THEN 1.0 ELSE 0 END) AS share_baseline_top,
       avg(CASE WHEN moved > 0 THEN 1.0 ELSE 0 END) AS share_improved, avg(CASE WHEN moved < 0 THEN 1.0 ELSE 0 END) AS share_hurt,
       avg(moved) AS mean_displacement, quantile_cont(moved, 0.5) AS median_displacement FROM e""",
        "n_rows",
        "share_unreachable share_reachable_hit share_reachable_miss share_baseline_top share_improved share_hurt mean_displacement median_displacement",
    ),
    "recall_compare_dense_lexical": A.rounded(
        f"""WITH {A.TOKENS}, lex_truth AS (SELECT q.query_id, c.item_id FROM queries q, corpus c WHERE contains(c.text, q.text)), {A.bm25_sql("lex", TOP)},
one AS (WITH {_DENSE} {_recall_sql("ranked")}), two AS (WITH truth AS (SELECT * FROM lex_truth) {_recall_sql("lex")})
SELECT k, one.recall AS recall_1, two.recall AS recall_2, one.recall - two.recall AS delta FROM one FULL JOIN two USING (k)""",
        "k",
        "recall_1 recall_2 delta",
    ),
    "pair_similarity": A.rounded(
        f"""WITH s AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings),
n AS (SELECT label, count(*) AS n FROM s WHERE r <= {SAMPLE} GROUP BY label),
c AS (SELECT a.label AS project_a, b.label AS project_b, list_cosine_similarity(a.v, b.v) AS c FROM s a JOIN s b ON a.label < b.label WHERE a.r <= {SAMPLE} AND b.r <= {SAMPLE})
SELECT project_a, project_b, x.n AS n_a, y.n AS n_b, mean, std, median FROM (SELECT project_a, project_b, avg(c) AS mean, stddev_pop(c) AS std, quantile_cont(c, 0.5) AS median FROM c GROUP BY ALL)
JOIN n x ON x.label = project_a JOIN n y ON y.label = project_b""",
        "project_a project_b n_a n_b",
        "mean std median",
    ),
    "ground_truth_match": f"WITH {_MATCH} SELECT * FROM matches",
    "ground_truth_audit": f"""WITH {_MATCH}, known AS (SELECT DISTINCT commit_sha FROM files WHERE length(commit_sha) % 5 <> 0),
per_gt AS (SELECT bug_id, gt, max(CASE WHEN length(path) % 3 <> 0 THEN 1 ELSE 0 END) AS v FROM matches GROUP BY ALL),
per_bug AS (SELECT bug_id, count(*) AS n_found, sum(v) AS n_vectors FROM per_gt GROUP BY ALL),
base AS (SELECT bug_id, commit_sha, count(DISTINCT gt) AS n_gt FROM gts GROUP BY ALL),
rows AS (SELECT n_gt, coalesce(n_found, 0) AS n_found, coalesce(n_vectors, 0) AS n_vectors, commit_sha IN (SELECT commit_sha FROM known) AS ok FROM base LEFT JOIN per_bug USING (bug_id))
SELECT CASE WHEN NOT ok THEN 'invalid_commit' WHEN n_found = 0 THEN 'missing' WHEN n_vectors = 0 THEN 'invalid_embedding' WHEN n_vectors = n_gt THEN 'full' ELSE 'partial' END AS status,
       count(*) AS n, CAST(sum(n_found) AS BIGINT) AS n_found, CAST(sum(n_vectors) AS BIGINT) AS n_vectors FROM rows GROUP BY status""",
    "ext_recall_pivot": A.rounded(
        rf"""WITH {A.PATHS}, r AS (SELECT path, row_number() OVER (PARTITION BY commit_sha ORDER BY length(path) DESC, page_id) AS rank FROM paths WHERE path <> ''),
e AS (SELECT rank, CASE WHEN regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^./][^/]*(\.[^./]*)$', 1) IN ('', '.') THEN 'no_extension' ELSE lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^./][^/]*(\.[^./]*)$', 1)) END AS ext FROM r)
SELECT ext, count(*) AS n, avg(1.0 / rank) AS mrr, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS recall_1, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS recall_5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS recall_10 FROM e GROUP BY ext""",
        "ext n",
        "mrr recall_1 recall_5 recall_10",
    ),
}
