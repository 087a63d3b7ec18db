"""Queries on readers, sinks and further row rules. Each writes tables or files made from the given tables to the shared
folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlab.functions import classify as C
from rlab.functions import text as X
from rlab.functions import vectors as V
from rlab.operators import clean as L
from rlab.operators import joins as J
from rlab.operators import profile as P
from rlab.operators import retrieve as R
from rlab.operators import samples as S
from rlab.operators.stats import round_columns
from rlab.plans import adapters as A
from rlab.plans import retrieval_queries as RQ
from rlab.plans.corpus_queries import VOCABULARY
from rlab.sources import io
from rlab.streaming import streams


def read_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = io.read_tables(spark, f"{sf_dir}/orders.parquet", "o_orderkey long, o_orderstatus string")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def read_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as two splits, and read as one table."""
    docs, at = A.table(spark, sf_dir, "documents"), io.scratch_dir(spark, "splits")
    test = F.col("doc_id") % 5 == 0
    io.write_parquet(docs.where(test), f"{at}/test")
    io.write_parquet(docs.where(~test), f"{at}/train")
    rows = io.read_splits(spark, {name: f"{at}/{name}" for name in ("train", "test")})
    return rows.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


def read_results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results grid through its text format."""
    at = io.scratch_dir(spark, "results")
    name = lambda c: F.concat(F.lit("p/"), F.col(c).cast("string")).alias(c)
    absent = [F.lit(None).cast("double").alias(c) for c in ("top-1", "top-5")]
    io.write_csv(A.grid(spark, sf_dir).select("model_name", name("source_project"), name("target_project"), "scenario", *absent, F.col("top_10").alias("top-10"), "MAP", "MRR"), at)
    out = io.read_results_csv(spark, at).select("model_name", "source_project", "target_project", "scenario", F.col("`top-1`").alias("top_1"), F.col("`top-10`").alias("top_10"), "MAP", "MRR")
    return round_columns(out)


def read_keyed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of results for each model, whose name says which."""
    at, rows = io.scratch_dir(spark, "keyed"), A.grid(spark, sf_dir)
    for model in "ANR":
        io.one_file(rows.where(F.col("model_name") == model).select("scenario", "MRR"), f"{at}/model_{model}_grid.csv", "csv", header=True)
    out = io.read_keyed_files(spark, f"{at}/*_grid.csv", "scenario string, MRR double", r"^model_(.*)_grid\.csv$", "model_name")
    return round_columns(out.groupBy("model_name", "scenario").agg(F.count(F.lit(1)).alias("n"), C.mean(F.col("MRR")).alias("mean")))


def read_xml_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as bug reports in XML, with their whole texts, and some in a folder that is to be left out. The format cannot
    hold control characters, and reading takes the blanks around a text away."""
    at = io.scratch_dir(spark, "xml")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x1F\x7F]", " ")
    info = F.struct(text.alias("summary"), F.lit("d").alias("description"), F.lit("1").alias("version"), F.lit("2").alias("fixedVersion"))
    key = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    bugs = A.table(spark, sf_dir, "conversations").select(key.alias("_id"), F.lit("2020-01-02 03:04:05").alias("_opendate"), F.lit("x").alias("_fixdate"), F.lit("Fixed").alias("_resolution"), info.alias("buginformation"), F.struct(F.array(F.lit("A.java"), F.concat("role", F.lit(".java"))).alias("file")).alias("fixedFiles"), "turn")
    for folder, some in (("now", bugs), ("Previous", bugs.where("turn % 2 = 0"))):
        some.drop("turn").write.format("xml").option("rootTag", "bugs").option("rowTag", "bug").save(f"{at}/{folder}")
    out = io.read_xml_reports(spark, f"{at}/*", "CHAT")
    return out.select("repo_name", "bug_id", F.length("summary").cast("long").alias("n_chars"), F.md5("summary").alias("text_md5"), F.array_join("fixed_files", ",").alias("files"), F.unix_timestamp("report_date").alias("opened"), F.col("fix_date").isNull().alias("unfixed"), "status", "fixed_version")


def read_commented_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order priorities of each status as a commented list of its own file."""
    at = io.scratch_dir(spark, "json")
    orders = A.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()
    for status in "FOP":
        listed = orders.where(F.col("o_orderstatus") == status).agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))), ", # one more\n ").alias("x"))
        io.one_file(listed.select(F.concat(F.lit("# priorities\n["), "x", F.lit("]")).alias("value")), f"{at}/{status}.json", "text")
    return io.read_commented_json(spark, f"{at}/*.json").select("file", F.col("n").cast("long").alias("n"))


_PAIRS = [("a/b", "c_d/e"), ("c_d/e", "a/b")]


def read_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as diagnostics of two pairs of projects whose names have underscores, in the file name format."""
    at, li = io.scratch_dir(spark, "diagnostics"), A.table(spark, sf_dir, "lineitem")
    base, model = (F.col("l_quantity") * 3).cast("int"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_linenumber").cast("int"))
    rows = li.select(F.col("l_orderkey").cast("string").alias("bug_id"), F.col("l_partkey").cast("string").alias("gt_blob_sha"), base.alias("faiss_rank"), model.alias("model_rank"), (base - model).alias("rank_displacement"), F.lit(0.5).alias("faiss_score"), F.lit(0.25).alias("model_score"), (F.col("l_partkey") % 2).alias("_pair"), (F.col("l_linenumber") % 4).alias("_scenario"))
    names = [F.when((F.col("_pair") == k) & (F.col("_scenario") == s), f"{source}_{target}_{scenario}_diagnostics.csv".replace("/", "_")) for k, (source, target) in enumerate(_PAIRS) for s, scenario in enumerate(J.SCENARIOS)]
    io.named_folders(io.diagnostics_sink(rows.withColumn("name", F.coalesce(*names)).where("name is not null").drop("_pair", "_scenario")), at, "name", "csv", header=True)
    projects = spark.createDataFrame([(p,) for p in _PAIRS[0]], "repo_name string")
    out = io.read_diagnostics(spark, at, projects, J.SCENARIOS)
    return out.groupBy("source_project", "target_project", "scenario").agg(F.count(F.lit(1)).alias("n"), F.count("model_rank").alias("n_ranked"), F.sum("faiss_rank").alias("rank_sum"))


def read_recall_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of small quantities by flag as recall tables of one project each."""
    at, li = io.scratch_dir(spark, "recall"), A.table(spark, sf_dir, "lineitem")
    for flag in "ANR":
        share = lambda k: (F.count(F.when(F.col("l_quantity") <= k, 1)) / F.count(F.lit(1))).alias(f"Recall@{k}")
        io.one_file(li.where(F.col("l_returnflag") == flag).agg(share(10), share(30)), f"{at}/bm25_own_{flag}_x_recall_results.csv", "csv", header=True)
    return round_columns(io.read_recall_dir(spark, f"{at}/*.csv", 30))


def read_corpus_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of all documents in text files; files of other extensions are not read."""
    at, docs = io.scratch_dir(spark, "corpus"), A.table(spark, sf_dir, "documents")
    docs.select(F.coalesce("text", F.lit("")).alias("value")).write.option("maxRecordsPerFile", 1_000).text(f"{at}/text")
    docs.select("doc_id").write.json(f"{at}/other")
    out = io.read_corpus_dir(spark, at, [".txt"])
    return out.agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.length("text").cast("long")).alias("n_chars"), F.sum(X.line_count(F.col("text")).cast("long")).alias("n_lines"), F.sum(X.word_count(F.col("text")).cast("long")).alias("n_words"))


def write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents partitioned by language, read back."""
    at = io.scratch_dir(spark, "partitioned")
    io.write_parquet(A.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), at, ["lang"])
    return spark.read.parquet(at).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended in three overlapping batches, and once by a second writer that did not see the first ones."""
    at = io.scratch_dir(spark, "appended")
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    for k in (2, 3, 2):
        io.append_new(orders.where(F.col("o_orderkey") % k == 0), at, ["o_orderkey"])
    orders.where("o_orderkey % 4 = 0").write.mode("append").parquet(at)
    return io.read_appended(spark, at, ["o_orderkey"])


def patch_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small-budget scores of a stored table replaced by the means of the repetitions, twice; rows without a summary keep
    theirs."""
    summary = A.reps(spark, sf_dir).where("target_project <> 5").groupBy("model_name", "target_project").agg(F.max("MRR").alias("MRR"))
    small, path = F.col("scenario") == "WP-small", io.scratch_dir(spark, "results")
    A.grid(spark, sf_dir).write.parquet(path)
    unmatched = [io.patch_table(spark, path, summary, ["model_name", "target_project"], ["MRR"], small) for _ in range(2)]
    return round_columns(spark.read.parquet(path).select("model_name", "source_project", "target_project", "scenario", "MRR", F.lit(max(unmatched)).alias("unmatched")))


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored in two steps that overlap; a vector stays once."""
    store = io.VectorStore(spark, io.scratch_dir(spark, "vectors"))
    vectors = A.vectors(spark, sf_dir).select(F.col("item_id").alias("blob_sha"), F.col("label").alias("project"), "vec")
    store.write(vectors.where("blob_sha % 2 = 0"))
    store.write(vectors.where("blob_sha % 3 = 0"))
    lacking = store.missing(vectors.select("blob_sha")).agg(F.count(F.lit(1)).alias("n_missing"))
    return store.read().groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum("blob_sha").alias("ids")).crossJoin(F.broadcast(lacking))


def training_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as samples whose blob is the document of the conversation's id; each blob is stored once."""
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_sha"), "text")
    samples = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("bug_id"), F.col("conv_id").alias("blob_sha"))
    return round_columns(io.write_training_cache(samples, docs, io.scratch_dir(spark, "cache")))


def row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, indexability and safe name of page paths; every third path ends like a source file."""
    tail = F.element_at(F.array(*map(F.lit, (".py", ".tsx", ".html"))), (F.col("page_id") % 3 + 1).cast("int"))
    p = A.paths(spark, sf_dir).withColumn("path", F.concat("path", tail))
    language = C.file_language(F.col("path"), F.when(F.col("page_id") % 2 == 0, "java"))
    size = F.length("path") * 30_000
    return p.select("page_id", language.alias("language"), C.is_indexable(F.col("path"), size, F.lit("python")).alias("indexable"), X.safe_name(F.col("path")).alias("name"))


def joint_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the joint direction of two metrics' gains."""
    one, two = (J.paired_delta(A.grid(spark, sf_dir), "CP-transfer", "WP-small", m).select("model_name", "source_project", "target_project", F.col("delta").alias(m)) for m in ("MRR", "MAP"))
    both = one.join(two, ["model_name", "source_project", "target_project"])
    return both.groupBy("model_name", C.joint_direction(F.round("MRR", 4), F.round("MAP", 4)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def one_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of one source from a year on; ten days lie between ids."""
    docs = A.table(spark, sf_dir, "documents").withColumn("at", F.timestamp_seconds(F.col("doc_id") * 864_000))
    return L.one_project(docs, "src1", "source").where(C.commit_year_from(F.col("at"), 1971)).select("doc_id", "source")


def token_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 lines of every passage as 30 token ids over the documents' vocabulary."""
    tokens = A.table(spark, sf_dir, "documents").select(F.explode(X.text_tokens(F.col("text"))).alias("token"))
    blobs = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    out = S.token_grid(blobs, P.vocab(tokens, VOCABULARY, 2), 20, 30)
    return out.select(F.col("id").alias("item_id"), F.col("line_no").cast("long").alias("line_no"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def stream_encode_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of documents run to its end twice into a vector store, and whether each vector is that of a plain run."""
    store, at = io.VectorStore(spark, io.scratch_dir(spark, "encoded")), io.scratch_dir(spark, "encode-checkpoint")
    docs = A.table(spark, sf_dir, "documents")
    for run in range(2):
        rows = streams.read_stream(spark, f"{sf_dir}/documents.parque[t]", docs.schema).select(F.col("doc_id").alias("blob_sha"), F.col("source").alias("project"), "text")
        streams.stream_encode(rows, V.HashEncoder(), store, f"{at}/{run}").awaitTermination()
    plain = V.encode(docs.select("doc_id", "text"), "text", V.HashEncoder(), "plain", keep_text=False)
    kept = store.read().select(F.col("blob_sha").alias("doc_id"), "vec")
    return kept.join(plain, "doc_id", "full").select("doc_id", F.size("vec").cast("long").alias("dim"), F.coalesce(F.col("vec") == F.col("plain"), F.lit(False)).alias("same"))


def raw_report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages in two more raw shapes, in the canonical report table."""
    none = F.lit(None).cast("string")
    lca = A.table(spark, sf_dir, "documents").select(
        F.lit("Owner").alias("repo_owner"), F.col("source").alias("repo_name"), F.col("doc_id").alias("id"), F.lit("https://h/i").alias("issue_url"), none.alias("pull_url"), F.col("text").alias("issue_title"),
        F.lit("body").alias("issue_body"), F.lit("['x.py']").alias("changed_files"), F.lit("2024-05-06 07:08:09").alias("pull_create_at"), F.md5("text").alias("base_sha"), none.alias("head_sha"), F.col("lang").alias("repo_language"),
    )
    b4bl = A.table(spark, sf_dir, "pages").select(
        F.lit("Apache/X").alias("repo_name"), F.col("page_id").alias("bug_id"), F.col("html").alias("bug_report"), F.when(F.col("page_id") % 2 == 0, F.array(F.lit("A.java"), F.lit("B.java"))).alias("fixed_files"),
        F.lit("2020-01-02 03:04:05").alias("report_date"), F.lit("never").alias("fix_date"), F.lit("abc").alias("before_fix_sha"), F.lit("java").alias("language"),
    )
    both = L.union_sources(L.canonicalise_lca(lca), L.canonicalise_b4bl(b4bl))
    return both.select("source_dataset", "repo_name", "bug_id", F.md5("bug_report_text").alias("text_md5"), F.array_join("ground_truth_files", ",").alias("files"), F.unix_timestamp("creation_date").alias("created"), F.unix_timestamp("fix_date").alias("fixed"), "language", "bug_report_url")


def bm25_recall_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall with every query in the denominator, those without ground truth too."""
    return round_columns(R.recall_at_k(RQ._bm25(spark, sf_dir), RQ._truth(spark, sf_dir), A.queries(spark, sf_dir), RQ.KS, denominator="all"))


def bm25_topk_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage against the documents of one language, as its snapshot: that of the document of the same id."""
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("snapshot"))
    corpus = A.corpus(spark, sf_dir).join(docs, "item_id")
    asked = A.queries(spark, sf_dir).join(docs.withColumnRenamed("item_id", "query_id"), "query_id")
    return round_columns(R.bm25_topk(asked, corpus, 20, ["snapshot"]).select("query_id", "snapshot", "item_id", "score", "rank"))


QUERIES = {f.__name__: f for f in (read_tables, read_splits, read_results_csv, read_keyed_files, read_xml_reports, read_commented_json, read_diagnostics, read_recall_dir, read_corpus_dir, write_parquet, append_new, patch_column, vector_store, training_cache, row_rules, joint_direction, one_project, token_grid, stream_encode_run, raw_report_union, bm25_recall_of_all, bm25_topk_by_snapshot)}

_SCENARIO = "CASE l_linenumber % 4 WHEN 0 THEN 'WP-small' WHEN 1 THEN 'WP-large' WHEN 2 THEN 'CP-cold-start' ELSE 'CP-transfer' END"
_JOINT = "CASE WHEN {x} < -0.01 OR {y} < -0.01 THEN 'negative' WHEN {x} > 0.01 AND {y} > 0.01 THEN 'positive' ELSE 'mixed' END"
_GAIN = "round(max({m}) FILTER (scenario = 'CP-transfer') - max({m}) FILTER (scenario = 'WP-small'), 4)"
_SNAPSHOT = """docs AS (SELECT c.*, lang AS snapshot FROM corpus c JOIN documents ON doc_id = item_id WHERE lang IS NOT NULL), asked AS (SELECT q.*, lang AS snapshot FROM queries q JOIN documents ON doc_id = query_id WHERE lang IS NOT NULL),
n AS (SELECT snapshot, count(*) AS n_docs, avg(CAST(len(tokens) AS DOUBLE)) AS avgdl FROM docs GROUP BY snapshot),
tf AS (SELECT snapshot, item_id, dl, term, count(*) AS tf FROM (SELECT snapshot, item_id, len(tokens) AS dl, unnest(tokens) AS term FROM docs) GROUP BY ALL),
df AS (SELECT snapshot, term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf FROM tf JOIN n USING (snapshot) GROUP BY snapshot, term, n_docs),
idf AS (SELECT snapshot, term, CASE WHEN raw_idf < 0 THEN 0.25 * m ELSE raw_idf END AS idf FROM df JOIN (SELECT snapshot, avg(raw_idf) AS m FROM df GROUP BY snapshot) USING (snapshot)),
qt AS (SELECT snapshot, query_id, term, count(*) AS qtf FROM (SELECT snapshot, query_id, unnest(tokens) AS term FROM asked) GROUP BY ALL),
s AS (SELECT snapshot, query_id, item_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN qt USING (snapshot, term) JOIN idf USING (snapshot, term) JOIN n USING (snapshot) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 20"""

ORACLES = {
    "read_tables": "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL",
    "read_splits": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY ALL",
    "read_results_csv": A.rounded(f"WITH {A.GRID} SELECT model_name, 'p/' || source_project AS source_project, 'p/' || target_project AS target_project, scenario, NULL AS top_1, top_10, MAP, MRR FROM grid", "model_name source_project target_project scenario", "top_1 top_10 MAP MRR"),
    "read_keyed_files": A.rounded_means(f"WITH {A.GRID} SELECT model_name, scenario, count(*) AS n, avg(MRR) AS mean FROM grid GROUP BY ALL", "model_name scenario n", "mean"),
    "read_xml_reports": r"""SELECT 'CHAT' AS repo_name, 'CHAT-' || conv_id || '.' || turn AS bug_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5, 'A.java,' || role || '.java' AS files, 1577934245 AS opened, true AS unfixed, 'Fixed' AS status, '2' AS fixed_version
FROM (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[\x00-\x1F\x7F]', ' ', 'g'), ' ') AS text FROM conversations)""",
    "read_commented_json": "SELECT o_orderstatus || '.json' AS file, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_orderstatus",
    "read_diagnostics": f"""SELECT CASE l_partkey % 2 WHEN 0 THEN 'a/b' ELSE 'c_d/e' END AS source_project, CASE l_partkey % 2 WHEN 0 THEN 'c_d/e' ELSE 'a/b' END AS target_project, {_SCENARIO} AS scenario,
count(*) AS n, count(*) FILTER (l_suppkey % 5 <> 0) AS n_ranked, CAST(sum(CAST(l_quantity * 3 AS INT)) AS BIGINT) AS rank_sum FROM lineitem GROUP BY ALL""",
    "read_recall_dir": A.rounded("SELECT 'own/' || l_returnflag || '_x' AS project, count(*) FILTER (l_quantity <= 30) / CAST(count(*) AS DOUBLE) AS recall_30 FROM lineitem GROUP BY l_returnflag", "project", "recall_30"),
    "read_corpus_dir": r"""SELECT CAST(sum(strlen(t) + 1) AS BIGINT) AS n_bytes, CAST(sum(length(t) + 1) AS BIGINT) AS n_chars, CAST(sum(length(t) - length(replace(t, chr(10), '')) + 1) AS BIGINT) AS n_lines,
CAST(sum(len(regexp_extract_all(t, '\S+'))) AS BIGINT) AS n_words FROM (SELECT coalesce(text, '') AS t FROM documents)""",
    "write_parquet": "SELECT lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY lang",
    "append_new": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "patch_column": A.rounded(
        f"""WITH {A.GRID}, {A.REPS}, r AS (SELECT model_name, target_project, max(MRR) AS m FROM reps WHERE target_project <> 5 GROUP BY ALL), g AS (SELECT g.*, m FROM grid g LEFT JOIN r USING (model_name, target_project))
SELECT model_name, source_project, target_project, scenario, CASE WHEN scenario = 'WP-small' THEN coalesce(m, MRR) ELSE MRR END AS MRR, (SELECT count(*) FROM g WHERE scenario = 'WP-small' AND m IS NULL) AS unmatched FROM g""",
        "model_name source_project target_project scenario unmatched",
        "MRR",
    ),
    "vector_store": """SELECT label AS project, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, (SELECT count(*) FROM embeddings WHERE vec_id % 2 <> 0 AND vec_id % 3 <> 0) AS n_missing
FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0 GROUP BY label""",
    "training_cache": A.rounded("SELECT n_samples, n_blobs, n_samples / CAST(n_blobs AS DOUBLE) AS dedup_ratio FROM (SELECT count(*) AS n_samples FROM conversations), (SELECT count(*) AS n_blobs FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations))", "n_samples n_blobs", "dedup_ratio"),
    "stream_encode_run": f"SELECT doc_id, CAST({V.HashEncoder().dim} AS BIGINT) AS dim, true AS same FROM documents",
    "row_rules": f"""WITH {A.PATHS}, p AS (SELECT page_id, path || (['.py', '.tsx', '.html'])[page_id % 3 + 1] AS path FROM paths)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE CASE WHEN page_id % 2 = 0 THEN 'java' ELSE 'python' END END AS language, page_id % 3 = 0 AND length(path) * 30000 <= 2000000 AS indexable, replace(path, '/', '_') AS name FROM p""",
    "joint_direction": f"""WITH {A.GRID}, d AS (SELECT model_name, source_project, target_project, {_GAIN.format(m="MRR")} AS x, {_GAIN.format(m="MAP")} AS y FROM grid GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL)
SELECT model_name, {_JOINT.format(x="x", y="y")} AS kind, count(*) AS n FROM d GROUP BY ALL""",
    "one_project": "SELECT doc_id, source FROM documents WHERE source = 'src1' AND year(make_timestamp(doc_id * 864000000000)) >= 1971",
    "token_grid": r"""WITH tok AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+')) AS token FROM documents), usual AS (SELECT token, count(*) AS n FROM tok GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 49998),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM usual), l AS (SELECT item_id, string_split(coalesce(text, ''), chr(10))[1:20] AS lines FROM benchmark),
b AS (SELECT item_id, unnest(range(0, len(lines))) AS line_no, regexp_extract_all(lower(unnest(lines)), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+')[1:30] AS t FROM l),
p AS (SELECT item_id, line_no, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS k FROM b), c AS (SELECT item_id, line_no, list(CAST(coalesce(id, 1) AS VARCHAR) ORDER BY k) AS ids FROM p LEFT JOIN v USING (token) GROUP BY ALL)
SELECT item_id, line_no, array_to_string(list_concat(coalesce(ids, []), list_transform(range(30), lambda x: '0'))[1:30], ' ') AS ids FROM b LEFT JOIN c USING (item_id, line_no)""",
    "raw_report_union": """SELECT 'lca' AS source_dataset, 'owner/' || lower(trim(source)) AS repo_name, CAST(doc_id AS VARCHAR) AS bug_id, md5(coalesce(text, '') || chr(10) || 'body') AS text_md5, 'x.py' AS files, NULL::BIGINT AS created, 1714979289 AS fixed, lang AS language, 'https://h/i' AS bug_report_url FROM documents
UNION ALL SELECT 'b4bl', 'apache/x', CAST(page_id AS VARCHAR), md5(html), CASE WHEN page_id % 2 = 0 THEN 'A.java,B.java' ELSE '' END, 1577934245, NULL, 'java', NULL FROM pages""",
    "bm25_recall_of_all": A.rounded(
        f"""WITH {A.TOKENS}, {A.TRUTH}, {A.bm25_sql('ranked', RQ.TOP)} SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (first_hit <= k) AS hits, count(*) AS valid, count(*) FILTER (first_hit <= k) / CAST(count(*) AS DOUBLE) AS recall
FROM (SELECT DISTINCT query_id FROM queries) LEFT JOIN (SELECT r.query_id, min(r.rank) AS first_hit FROM ranked r JOIN truth t ON r.query_id = t.query_id AND r.item_id = t.item_id GROUP BY ALL) USING (query_id), (SELECT unnest({RQ.KS}) AS k) GROUP BY k""",
        "k hits valid",
        "recall",
    ),
    "bm25_topk_by_snapshot": A.rounded(f"WITH {A.TOKENS}, {_SNAPSHOT}", "query_id snapshot item_id rank", "score"),
}
