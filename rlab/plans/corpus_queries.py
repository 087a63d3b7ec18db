"""Queries on consolidation, profiling, joins of commits and projects, and training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlab.functions import classify as C
from rlab.functions import text as X
from rlab.operators import clean as L
from rlab.operators import joins as J
from rlab.operators import profile as P
from rlab.operators import rank as K
from rlab.operators import retrieve as R
from rlab.operators import samples as S
from rlab.operators.stats import round_columns
from rlab.plans import adapters as A
from rlab.plans.retrieval_queries import POOL, TOP
from rlab.streaming import streams

#: Tokens of a vocabulary and of a sequence over it.
VOCABULARY, LENGTH = 50_000, 256


def hierarchical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = L.dedupe_hierarchical(A.reports(spark, sf_dir))
    return kept.select("arrival", "repo_name", "bug_id", "fix_url", "fix_commit_sha")


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.content_dedupe(A.table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "lang", "source")


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and conversations in the canonical report table."""
    docs = A.table(spark, sf_dir, "documents").select(F.col("source").alias("repo_name"), F.col("doc_id").alias("bug_id"), F.col("text").alias("summary"), F.lit(None).cast("string").alias("description"), F.lit("['a.py', 'b.py']").alias("files"), (F.col("doc_id") * 86_400_000).alias("report_timestamp"), F.lit(None).cast("long").alias("commit_timestamp"), F.md5("text").alias("before_fix_sha"), F.lit(None).cast("string").alias("after_fix_sha"), F.col("lang").alias("language"))
    pages = A.table(spark, sf_dir, "pages").select(F.lit(" Web/Crawl ").alias("repo_name"), F.col("page_id").alias("issue_id"), F.col("url").alias("issue_url"), F.lit(None).cast("string").alias("pull_url"), F.col("html").alias("title"), F.lit(None).cast("string").alias("body"), F.lit("x.html y.html").alias("updated_files"), F.lit("2024-01-02 03:04:05").alias("report_datetime"), F.lit("not a date").alias("commit_datetime"), F.lit(None).cast("string").alias("before_fix_sha"), F.lit(None).cast("string").alias("after_fix_sha"), F.lit("html").alias("language"))
    turns = A.table(spark, sf_dir, "conversations").select(F.lit("chat").alias("repo"), F.col("conv_id").alias("instance_id"), F.col("text").alias("problem_statement"), F.lit("hint").alias("hints_text"), F.lit("--- a/one.py\n+++ b/two.py\n").alias("patch"), F.lit("2024-05-06T07:08:09").alias("created_at"), F.lit("abc").alias("base_commit"))
    both = L.union_sources(L.canonicalise_ye(docs), L.canonicalise_beetle(pages), L.canonicalise_swe(turns))
    return both.select("source_dataset", "repo_name", "bug_id", F.md5("bug_report_text").alias("text_md5"), F.array_join("ground_truth_files", ",").alias("files"), F.unix_timestamp("creation_date").alias("created"), F.unix_timestamp("fix_date").alias("fixed"), "language", "bug_report_url")


def file_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File lists in all the shapes that corpora have, made from page paths."""
    p = A.paths(spark, sf_dir)
    literal = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("['"), "path", F.lit("', 'b.py']"))).when(F.col("page_id") % 4 == 1, F.concat("path", F.lit(" c.java"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("x"), F.col("path")))
    files = X.parse_file_list(literal)
    return p.select("page_id", F.size(files).cast("long").alias("n_files"), F.array_join(files, "|").alias("files"))


def repo_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", X.repo_link(F.col("url")).alias("link"))


def file_ext_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return A.paths(spark, sf_dir).select("page_id", *[X.file_ext(p, m).alias(f"ext_{m}") for m in ("basename", "path", "last_dot")])


_EXT = r"CASE WHEN {x} IN ('', '.') THEN 'no_extension' ELSE lower({x}) END"
_BASE = r"regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^./][^/]*(\.[^./]*)$', 1)"
_WHOLE = r"regexp_extract(path, '[^/](\.[^./]*)$', 1)"


def patch_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = F.concat(F.lit("diff\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\t\n@@\n--- a/old "), F.col("page_id").cast("string"), F.lit("\n+++ /dev/null\n"))
    return A.paths(spark, sf_dir).where("path <> ''").select("page_id", F.array_join(X.patch_paths(patch), "|").alias("files"))


def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paths(spark, sf_dir).select("page_id", F.array_join(X.path_tokens(F.col("path")), " ").alias("tokens"))


def dup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    return P.dup_profile(docs, "text", ["lang"], ("source",), "doc_id").select("lang", "total", "distinct_keys", "duplicates", "first_source")


def split_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    return P.split_profile(docs, "text", "split", ["lang"]).select("split", "lang", "total", "distinct_keys", "duplicates")


def date_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.date_profile(A.table(spark, sf_dir, "events"), "ts")
    return out.select(F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"), F.round("median_epoch", 6).alias("median_epoch"), "in_1970", "missing")


def year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.year_counts(A.table(spark, sf_dir, "orders"), "o_orderdate")


def loss_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events").withColumn("needed", F.when(F.col("value") > 10, F.col("value")))
    return P.loss_profile(events, ["event_type"], "needed")


def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' expected orders (by key) and their actual ones."""
    expected = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), (F.col("c_custkey") % 20).alias("expected"))
    return J.reconcile_counts(expected, A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return J.missing_keys(customers, A.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey")), "custkey")


def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order with the total of their last order at least 30 days older."""
    orders = A.table(spark, sf_dir, "orders")
    left = orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_orderdate")
    right = orders.select(F.col("o_custkey").alias("custkey"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("known_at"), F.col("o_orderkey").alias("earlier_order"))
    return J.asof_latest(left, right, "custkey", "o_orderdate", "known_at", "earlier_order", "year").select("o_orderkey", "earlier_order")


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.latest_snapshot(A.table(spark, sf_dir, "events"), ["user_id"], "event_id", "ts")
    return out.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


def first_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as commits, whose parent is the turn before; first turns have none and are dropped."""
    turns = A.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("sha"), F.when(F.col("turn") > 0, F.concat_ws(":", "conv_id", F.col("turn") - 1)).alias("parent"), "role")
    fixes = turns.select(F.col("sha").alias("fix_commit_sha"), "role", F.lit(None).alias("pre_fix_commit_sha"))
    return J.parent_sha(fixes, turns.select(F.col("sha").alias("commit_sha"), F.col("parent").alias("parent_sha")))


def project_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select(F.col("source").alias("repo_name"), F.col("doc_id").alias("bug_id"), F.col("text").alias("bug_report_text"), F.timestamp_seconds(F.col("doc_id") * 86_400).alias("creation_date"))
    users = A.table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("repo"), F.col("event_id").cast("string").alias("commit_sha"), F.col("user_id").cast("string").alias("author_email"), F.col("ts").alias("committed_at"))
    loc = A.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo_name")).agg(F.sum("n_chars").alias("LoC"))
    return round_columns(P.project_metrics(docs, users, loc))


def terciles_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.terciles(A.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", ["lang"]).select("doc_id", "lang", "n_chars", "tercile")


def impute_group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = A.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("grp"), F.when(F.col("p_size") > 40, 0).otherwise(F.col("p_size")).alias("p_size"))
    return round_columns(P.impute_zero_with_group_median(parts, "p_size", ["grp"]))


def quartile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.quartile_bins(A.table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("price")), "price").select("o_orderkey", F.col("quartile").cast("long").alias("quartile"))


def ext_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.paths(spark, sf_dir).where("path <> ''").select("commit_sha", F.array("path").alias("files"))
    return P.ext_counts(files, "files", ["commit_sha"])


def fix_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of fixes by host; a page's files are its path and a fixed second file."""
    rows = A.paths(spark, sf_dir).where("path <> ''").select("commit_sha", "page_id", F.when(F.col("page_id") % 3 == 0, F.array("path")).otherwise(F.array("path", F.lit("a.py"))).alias("files"), F.lit(".html").alias("primary"))
    out = P.fix_type_counts(rows, ["commit_sha"], "page_id", "files", "primary")
    return out.select("commit_sha", "bugs", "mono_fix", "poly_fix", "mono_fix_all", "multi_ext", "single_ext")


def size_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-wise classes over orders: size bin, direction, project age and pair key."""
    o = A.table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", C.size_bin(F.floor("o_totalprice"), 100_000, 200_000).alias("size"), C.direction(F.col("o_totalprice") - 150_000, 50_000, -50_000).alias("direction"),
        C.project_age(F.year("o_orderdate"), 1995).alias("age"), C.pair_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("pair"), C.stars(F.col("o_orderkey") % 100 / 1000).alias("stars"),
    )


def split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_ids(A.table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


def scenario_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and test sizes of the four scenarios, with French documents as target and German ones as source."""
    docs = A.table(spark, sf_dir, "documents")
    split = S.split_ids(docs.where("lang = 'fr'").select("doc_id"), "doc_id")
    rows = S.scenarios(docs.where("lang = 'de'").select("doc_id"), split, "doc_id")
    return rows.groupBy("scenario", "role", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


def labeled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = A.corpus(spark, sf_dir)
    ranked = R.bm25_topk(A.queries(spark, sf_dir), corpus, POOL, posted=R.postings(corpus, text="text"))
    return round_columns(S.labeled_samples(ranked, R.containing(A.queries(spark, sf_dir), corpus)))


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as reports: good documents against bad ones."""
    rows = A.table(spark, sf_dir, "labels").join(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item_id"), "quality")
    return S.triplets(rows.where("quality = 1"), rows.where("quality = 0"))


def contrastive_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("item_id"), "text")
    out = S.contrastive_samples(docs, docs, lines=3)
    return out.select(F.col("report_no"), F.col("query_id").alias("doc_id"), F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk").alias("chunk_md5"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_projects(A.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 2, key="doc_id")


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = A.table(spark, sf_dir, "documents").select(F.explode(X.text_tokens(F.col("text"))).alias("token"))
    return P.vocab(tokens, VOCABULARY, 2, ("zzz", "aaa"))


def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.text_tokens(F.col("text")).alias("tokens"))
    out = P.encode_tokens(docs, vocab(spark, sf_dir), LENGTH)
    return out.select(F.col("id").alias("doc_id"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), F.col("length").cast("long").alias("length"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    digest = lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("chunk_md5"))
    windows = F.transform(X.overlap_windows(tokens, 512, 462), digest)  # digests are exploded, not windows
    chunks = A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(windows).alias("chunk_no", "w"))
    return chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "w.n_tokens", "w.chunk_md5")


def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.length_report(A.table(spark, sf_dir, "documents"), "n_chars", "lang")
    return out.select("lang", F.col("percent").cast("long").alias("percent"), "value")


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.token_stats(A.table(spark, sf_dir, "documents"), X.word_count(F.col("text")), "source", "lang").select("level", "name", "n", "mean", "std", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"), "p50", "p90", "p99", "pct_le_1024", F.col("recommended").cast("long").alias("recommended"))


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.split_report(F.col("text"))
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(r["summary"]).alias("summary_md5"), F.md5(r["description"]).alias("description_md5"))


def dir_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.paths(spark, sf_dir).where("path <> '' and path not like '%/'").select("commit_sha", "path").distinct()
    return S.dir_tree(files).select("commit_sha", "path", "parent", F.col("depth").cast("long").alias("depth"), "is_leaf")


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of events by type: the batch answer of ``streams.stream_scores``."""
    out = streams.window_scores(A.table(spark, sf_dir, "events"), "ts", "value", ["event_type"])
    return round_columns(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "mean", "n"))


QUERIES = {f.__name__: f for f in (hierarchical_dedup, content_dedup, source_union, file_list_parse, repo_link, file_ext_modes, patch_paths, path_tokens, dup_profile, split_profile, date_profile, year_counts, loss_profile, reconcile_counts, missing_keys, asof_latest, latest_snapshot, first_parent, project_metrics, terciles_by_group, impute_group_median, quartile_bins, ext_counts, fix_types, size_classes, split_ids, scenario_budgets, labeled_samples, triplets, contrastive_samples, stratified_sample, vocab, encode_tokens, chunk_windows, length_percentiles, token_stats, split_report, dir_tree, stream_scores)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda t: t <> '')"
_VOCAB = r"""tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+') AS t FROM documents),
usual AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM tok) WHERE token NOT IN ('aaa', 'zzz') GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 49996),
vocab AS (SELECT '<PAD>' AS token, 0 AS id, NULL::BIGINT AS n UNION ALL SELECT '<UNK>', 1, NULL UNION ALL SELECT 'aaa', 2, NULL UNION ALL SELECT 'zzz', 3, NULL
          UNION ALL SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER), n FROM usual)"""
_LINES = r"string_split(coalesce(text, ''), chr(10))"

ORACLES = {
    "hierarchical_dedup": f"""WITH {A.REPORTS},
l1 AS (SELECT *, row_number() OVER (PARTITION BY fix_url ORDER BY arrival) AS r1 FROM reports),
k1 AS (SELECT * FROM l1 WHERE fix_url IS NULL OR r1 = 1),
l2 AS (SELECT *, row_number() OVER (PARTITION BY repo_name, fix_commit_sha ORDER BY fix_url IS NULL, arrival) AS r2 FROM k1),
k2 AS (SELECT * FROM l2 WHERE fix_commit_sha IS NULL OR repo_name IS NULL OR r2 = 1),
l3 AS (SELECT *, row_number() OVER (PARTITION BY repo_name, bug_id ORDER BY fix_commit_sha IS NULL, fix_url IS NULL, arrival) AS r3 FROM k2),
k3 AS (SELECT * FROM l3 WHERE bug_id IS NULL OR repo_name IS NULL OR r3 = 1),
l4 AS (SELECT *, row_number() OVER (PARTITION BY repo_name, bug_report_text ORDER BY bug_id IS NULL, fix_commit_sha IS NULL, fix_url IS NULL, arrival) AS r4 FROM k3)
SELECT arrival, repo_name, bug_id, fix_url, fix_commit_sha FROM l4 WHERE r4 = 1""",
    "content_dedup": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY coalesce(text, ''))",
    "source_union": """SELECT 'ye' AS source_dataset, lower(trim(source)) AS repo_name, CAST(doc_id AS VARCHAR) AS bug_id, md5(coalesce(text, '') || chr(10)) AS text_md5, 'a.py,b.py' AS files, doc_id * 86400 AS created, NULL::BIGINT AS fixed, lang AS language, NULL::VARCHAR AS bug_report_url FROM documents
UNION ALL SELECT 'beetle', 'web/crawl', CAST(page_id AS VARCHAR), md5(coalesce(html, '') || chr(10)), 'x.html,y.html', 1704164645, NULL, 'html', url FROM pages
UNION ALL SELECT 'swe', 'chat', CAST(conv_id AS VARCHAR), md5(coalesce(text, '') || chr(10) || 'hint'), 'one.py,two.py', 1714979289, NULL, 'python', NULL FROM conversations""",
    "file_list_parse": f"""WITH {A.PATHS}, f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN [path, 'b.py'] WHEN 1 THEN list_filter([path, 'c.java'], lambda x: x <> '') WHEN 2 THEN ['x' || path] ELSE [] END AS files FROM paths)
SELECT page_id, CAST(len(files) AS BIGINT) AS n_files, array_to_string(files, '|') AS files FROM f""",
    "repo_link": "SELECT page_id, coalesce(array_to_string(string_split(url, '/')[1:5], '/'), '') AS link FROM pages",
    "file_ext_modes": f"WITH {A.PATHS} SELECT page_id, {_EXT.format(x=_BASE)} AS ext_basename, {_EXT.format(x=_WHOLE)} AS ext_path, CASE WHEN contains(path, '.') THEN regexp_extract(path, '([^.]*)$', 1) END AS ext_last_dot FROM paths",
    "patch_paths": f"WITH {A.PATHS} SELECT page_id, path || '|old ' || CAST(page_id AS VARCHAR) AS files FROM paths WHERE path <> ''",
    "path_tokens": rf"WITH {A.PATHS} SELECT page_id, array_to_string(flatten(list_transform(string_split_regex(path, '[/\\.\-_]'), lambda p: regexp_extract_all(lower(p), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+'))), ' ') AS tokens FROM paths",
    "dup_profile": "SELECT lang, count(*) AS total, count(DISTINCT text) AS distinct_keys, count(*) - count(DISTINCT text) AS duplicates, arg_min(source, doc_id) AS first_source FROM documents GROUP BY lang",
    "split_profile": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, lang, count(*) AS total, count(DISTINCT text) AS distinct_keys, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY ALL",
    "date_profile": "SELECT epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, round(quantile_cont(CAST(epoch_us(ts) // 1000000 AS DOUBLE), 0.5), 6) AS median_epoch, count(*) FILTER (year(ts) = 1970) AS in_1970, count(*) FILTER (ts IS NULL) AS missing FROM events",
    "year_counts": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL ORDER BY year DESC LIMIT 15",
    "loss_profile": "SELECT event_type, count(*) AS original, count(*) FILTER (value > 10) AS remaining, count(*) - count(*) FILTER (value > 10) AS lost, round(100.0 * (count(*) - count(*) FILTER (value > 10)) / CAST(count(*) AS DOUBLE), 6) AS pct_lost FROM events GROUP BY event_type",
    "reconcile_counts": "SELECT c_custkey AS custkey, c_custkey % 20 AS expected, coalesce(n, 0) AS actual, coalesce(n, 0) - c_custkey % 20 AS difference FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey",
    "missing_keys": "SELECT c_custkey AS custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "asof_latest": """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders)
SELECT l.o_orderkey, (SELECT r.o_orderkey FROM o r WHERE r.o_custkey = l.o_custkey AND r.o_orderdate + INTERVAL 30 DAY <= l.o_orderdate ORDER BY r.o_orderdate DESC, r.o_orderkey DESC LIMIT 1) AS earlier_order FROM o l""",
    "latest_snapshot": "SELECT user_id, event_id, epoch_us(ts) AS ts_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "first_parent": "SELECT conv_id || ':' || turn AS fix_commit_sha, role, conv_id || ':' || (turn - 1) AS pre_fix_commit_sha FROM conversations WHERE turn > 0",
    "project_metrics": A.rounded(
        r"""WITH r AS (SELECT source AS repo_name, quantile_cont(CAST(year(make_timestamp(doc_id * 86400000000)) AS DOUBLE), 0.5) AS median_bug_year, avg(CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE)) AS verbosity, count(DISTINCT doc_id) AS unique_bugs, CAST(sum(n_chars) AS BIGINT) AS LoC FROM documents GROUP BY source),
c AS (SELECT 'src' || (user_id % 20) AS repo_name, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) / 365.25 AS age_years, count(DISTINCT event_id) AS num_commits, count(DISTINCT user_id) AS num_authors FROM events GROUP BY ALL)
SELECT *, LoC / 1000.0 / unique_bugs AS kloc_per_bug FROM r LEFT JOIN c USING (repo_name)""",
        "repo_name unique_bugs num_commits num_authors LoC",
        "median_bug_year verbosity age_years kloc_per_bug",
    ),
    "terciles_by_group": "WITH b AS (SELECT lang, quantile_cont(CAST(n_chars AS DOUBLE), 1.0::DOUBLE / 3) AS low, quantile_cont(CAST(n_chars AS DOUBLE), 2.0::DOUBLE / 3) AS high FROM documents GROUP BY lang) SELECT doc_id, lang, n_chars, CASE WHEN n_chars <= low THEN 'small' WHEN n_chars <= high THEN 'medium' ELSE 'high' END AS tercile FROM documents JOIN b USING (lang)",
    "impute_group_median": "WITH p AS (SELECT p_partkey, p_partkey % 7 AS grp, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size FROM part) SELECT p_partkey, grp, CASE WHEN p_size = 0 THEN m ELSE CAST(p_size AS DOUBLE) END AS p_size FROM p JOIN (SELECT grp, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS m FROM p GROUP BY grp) USING (grp)",
    "quartile_bins": "WITH p AS (SELECT o_orderkey, floor(o_totalprice) AS price FROM orders), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b, quantile_cont(price, 0.75) AS c FROM p) SELECT o_orderkey, CAST(1 + CAST(price > a AS INT) + CAST(price > b AS INT) + CAST(price > c AS INT) AS BIGINT) AS quartile FROM p, q",
    "ext_counts": f"WITH {A.PATHS} SELECT commit_sha, {_EXT.format(x=_BASE)} AS ext, count(*) AS n FROM paths WHERE path <> '' GROUP BY ALL",
    "fix_types": f"""WITH {A.PATHS}, e AS (SELECT commit_sha, page_id, list_distinct(list_filter(CASE WHEN page_id % 3 = 0 THEN [x] ELSE [x, '.py'] END, lambda y: y <> 'no_extension')) AS exts FROM (SELECT *, {_EXT.format(x=_BASE)} AS x FROM paths WHERE path <> '')),
k AS (SELECT *, CASE WHEN len(exts) = 0 THEN 'invalid' WHEN len(exts) = 1 AND list_contains(exts, '.html') THEN 'mono_fix' WHEN list_contains(exts, '.html') THEN 'poly_fix' ELSE 'other' END AS kind FROM e)
SELECT commit_sha, count(DISTINCT page_id) AS bugs, count(DISTINCT page_id) FILTER (kind = 'mono_fix') AS mono_fix, count(DISTINCT page_id) FILTER (kind = 'poly_fix') AS poly_fix, count(DISTINCT page_id) FILTER (kind IN ('mono_fix', 'poly_fix')) AS mono_fix_all,
       count(DISTINCT page_id) FILTER (len(exts) > 1) AS multi_ext, count(DISTINCT page_id) FILTER (len(exts) <= 1) AS single_ext FROM k GROUP BY commit_sha""",
    "size_classes": """SELECT o_orderkey, CASE WHEN floor(o_totalprice) <= 0 THEN NULL WHEN floor(o_totalprice) <= 100000 THEN 'small' WHEN floor(o_totalprice) <= 200000 THEN 'medium' ELSE 'large' END AS size,
CASE WHEN o_totalprice - 150000 > 50000 THEN 'positive' WHEN o_totalprice - 150000 < -50000 THEN 'negative' ELSE 'neutral' END AS direction, CASE WHEN year(o_orderdate) >= 1995 THEN 'new' ELSE 'mid-era' END AS age,
least(o_orderstatus, o_orderpriority) || '||' || greatest(o_orderstatus, o_orderpriority) AS pair, CASE WHEN o_orderkey % 100 < 1 THEN '***' WHEN o_orderkey % 100 < 10 THEN '**' WHEN o_orderkey % 100 < 50 THEN '*' ELSE 'ns' END AS stars FROM orders""",
    "split_ids": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents)) SELECT doc_id, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r",
    "scenario_budgets": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER () AS n FROM documents WHERE lang = 'fr'),
test AS (SELECT doc_id FROM r WHERE r <= ceil(n * 0.2)), pool AS (SELECT doc_id, r - ceil(n * 0.2) AS k, n - ceil(n * 0.2) AS m FROM r WHERE r > ceil(n * 0.2)), small AS (SELECT doc_id FROM pool WHERE k <= floor(m * 0.25)), src AS (SELECT doc_id FROM documents WHERE lang = 'de'),
rows AS (SELECT 'WP-small' AS scenario, 'train' AS role, 'target' AS side, doc_id FROM small UNION ALL SELECT 'WP-large', 'train', 'target', doc_id FROM pool UNION ALL SELECT 'CP-cold-start', 'train', 'source', doc_id FROM src
UNION ALL SELECT 'CP-transfer', 'train', 'source', doc_id FROM src UNION ALL SELECT 'CP-transfer', 'train', 'target', doc_id FROM small UNION ALL SELECT s, 'test', 'target', doc_id FROM test, (SELECT unnest(['WP-small', 'WP-large', 'CP-cold-start', 'CP-transfer']) AS s))
SELECT scenario, role, side, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM rows GROUP BY ALL""",
    "labeled_samples": A.rounded(
        f"""WITH {A.TOKENS}, {A.TRUTH}, {A.bm25_sql("ranked", POOL)} SELECT query_id, item_id, CASE WHEN t.gt = 1 THEN 1 ELSE 0 END AS label, coalesce(score, -1) AS retrieval_score, 'target' AS project_type
FROM ranked FULL JOIN (SELECT DISTINCT query_id, item_id, 1 AS gt FROM truth) t USING (query_id, item_id)""",
        "query_id item_id label project_type",
        "retrieval_score",
    ),
    "triplets": """WITH r AS (SELECT lang AS query_id, doc_id AS item_id, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY md5('5:' || lang || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM labels JOIN documents USING (doc_id)),
p AS (SELECT a.query_id, a.item_id AS pos, b.item_id AS neg, row_number() OVER (PARTITION BY a.query_id ORDER BY a.k + b.k, a.k) AS r FROM r a JOIN r b USING (query_id) WHERE a.quality = 1 AND b.quality = 0 AND a.k <= 10 AND b.k <= 10)
SELECT query_id, pos, neg FROM p WHERE r <= 10""",
    "contrastive_samples": rf"""WITH l AS (SELECT doc_id, text, {_LINES} AS lines FROM documents), s AS (SELECT *, unnest(range(1, len(lines) + 1, 3)) AS k FROM l), c AS (SELECT doc_id, k, array_to_string(lines[k : k + 2], chr(10)) AS chunk FROM s),
f AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_no FROM c WHERE trim(replace(chunk, chr(10), '')) <> '' UNION ALL SELECT doc_id, substring(coalesce(text, ''), 1, 2000), 0 FROM l WHERE trim(replace(coalesce(text, ''), chr(10), '')) = ''),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('3:' || doc_id || ':' || doc_id || ':' || chunk_no), chunk_no) AS r FROM f)
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS report_no, doc_id, chunk_no, md5(chunk) AS chunk_md5 FROM p WHERE r = 1""",
    "stratified_sample": "SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('1:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 2",
    "vocab": f"WITH {_VOCAB} SELECT * FROM vocab",
    "encode_tokens": f"""WITH {_VOCAB}, p AS (SELECT doc_id, unnest(t[1:256]) AS token, unnest(range(1, len(t[1:256]) + 1)) AS k FROM tok), c AS (SELECT doc_id, list(CAST(coalesce(id, 1) AS VARCHAR) ORDER BY k) AS ids FROM p LEFT JOIN vocab USING (token) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(ids, []) AS ids FROM documents LEFT JOIN c USING (doc_id)) SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(256), lambda x: '0'))[1:256], ' ') AS ids, CAST(greatest(len(ids), 1) AS BIGINT) AS length FROM d""",
    "chunk_windows": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, CASE WHEN len(w) <= 512 THEN [0] ELSE range(0, len(w), 462) END AS starts FROM w WHERE len(w) > 0), c AS (SELECT doc_id, w, unnest(starts) AS s FROM s)
SELECT doc_id, s // 462 AS chunk_no, CAST(len(w[s + 1 : s + 512]) AS BIGINT) AS n_tokens, md5(array_to_string(w[s + 1 : s + 512], ' ')) AS chunk_md5 FROM c""",
    "length_percentiles": """WITH b AS (SELECT lang, CAST(n_chars AS DOUBLE) AS v FROM documents UNION ALL SELECT 'all', n_chars FROM documents), q AS (SELECT lang, quantile_cont(v, list_transform(range(50, 97, 2), lambda p: p / 100.0::DOUBLE)) AS q FROM b GROUP BY lang)
SELECT lang, unnest(range(50, 97, 2)) AS percent, CAST(floor(round(unnest(q), 6)) AS BIGINT) AS value FROM q""".replace("quantile_cont(v, list_transform(range(50, 97, 2), lambda p: p / 100.0::DOUBLE))", f"quantile_cont(v, {[p / 100 for p in range(50, 97, 2)]})"),
    "token_stats": r"""WITH n AS (SELECT source, lang, CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE) AS n FROM documents), g AS (SELECT 'overall' AS level, 'all' AS name, n FROM n UNION ALL SELECT 'project', source, n FROM n UNION ALL SELECT 'language', lang, n FROM n)
SELECT level, name, count(*) AS n, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99,
round(100.0 * avg(CASE WHEN n <= 1024 THEN 1.0 ELSE 0 END), 6) AS pct_le_1024, CAST(trunc(quantile_cont(n, 0.9)) AS BIGINT) AS recommended FROM g GROUP BY level, name""",
    "split_report": rf"""WITH l AS (SELECT conv_id, turn, coalesce(text, '') AS text, list_filter({_LINES}, lambda x: trim(x) <> '') AS lines FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN len(lines) = 0 THEN substring(text, 1, 300) ELSE trim(lines[1]) END) AS summary_md5, md5(CASE WHEN len(lines) <= 1 THEN text ELSE array_to_string(lines[2:], chr(10)) END) AS description_md5 FROM l""",
    "dir_tree": f"""WITH {A.PATHS}, f AS (SELECT DISTINCT commit_sha, path FROM paths WHERE path <> '' AND path NOT LIKE '%/'), r AS (SELECT *, row_number() OVER (PARTITION BY commit_sha ORDER BY path) AS r FROM f), s AS (SELECT commit_sha, string_split(path, '/') AS p FROM r WHERE r <= 1000),
n AS (SELECT commit_sha, p, unnest(range(1, len(p) + 1)) AS k FROM s) SELECT commit_sha, array_to_string(p[1:k], '/') AS path, min(array_to_string(p[1 : k - 1], '/')) AS parent, min(k) AS depth, bool_and(k = len(p)) AS is_leaf FROM n GROUP BY commit_sha, path""",
    "stream_scores": A.rounded("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, avg(value) AS mean, count(value) AS n FROM events GROUP BY ALL", "day event_type n", "mean"),
}
