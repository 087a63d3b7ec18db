"""Queries on learned weights of ranking features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlab.operators import retrieve as R
from rlab.operators import weighting as G
from rlab.operators.stats import round_columns
from rlab.plans import adapters as A

FEATURES = ["lexical", "shared", "coverage", "place"]
#: Candidates of each passage.
POOL = 50


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical candidates of every passage with their features, and whether they hold it."""
    asked, corpus = A.queries(spark, sf_dir), A.corpus(spark, sf_dir)
    terms = asked.select("query_id", F.size(F.array_distinct("tokens")).alias("_terms"))
    found = R.mark_relevant(R.bm25_topk(asked, corpus, POOL, posted=R.postings(corpus, text="text")), R.containing(asked, corpus)).join(terms, "query_id")
    return found.select(
        "query_id", "item_id", F.col("relevant").cast("int").alias("label"), F.round("score", 6).alias("lexical"), F.col("n_terms").cast("double").alias("shared"),
        F.round(F.col("n_terms") / F.col("_terms"), 6).alias("coverage"), F.round(1.0 / F.col("rank"), 6).alias("place"),
    )


def _learned(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    found = G.adaptive_weights(candidates(spark, sf_dir), FEATURES, F.col("query_id") % 2, **how)
    return round_columns(found.select("fold", "method", "kind", *[F.col("weights")[k].alias(f"w_{c}") for k, c in enumerate(FEATURES)], "constant", "map_train", "map_test", "chosen"))


def adaptive_ltr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weightings by counts and a ridge line, learned on one half of the passages and judged on the other."""
    return _learned(spark, sf_dir, weightings=("chi2", "constant", "mutual_information"), regressors=("ridge",))


def adaptive_ltr_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five weightings and all six lines."""
    return _learned(spark, sf_dir)


QUERIES = {f.__name__: f for f in (adaptive_ltr, adaptive_ltr_trees)}


def _map_sql(scores: str, name: str) -> str:
    """Mean average precision of every method, fold and part, from (method, fold, part, query_id, item_id, label, score)."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY method, fold, query_id ORDER BY score DESC, item_id) AS rk FROM {scores}),
{name}_h AS (SELECT *, row_number() OVER (PARTITION BY method, fold, query_id ORDER BY rk) AS hits FROM {name}_r WHERE label = 1),
{name}_q AS (SELECT method, fold, part, query_id, avg(hits / CAST(rk AS DOUBLE)) AS ap FROM {name}_h GROUP BY ALL),
{name} AS (SELECT method, fold, part, avg(ap) AS map FROM {name}_q GROUP BY ALL)"""


_N = len(FEATURES)
ORACLES = {
    "adaptive_ltr": A.rounded(
        f"""WITH RECURSIVE {A.TOKENS}, {A.TRUTH}, {A.bm25_sql("ranked", POOL)},
shared AS (SELECT query_id, item_id, count(*) AS n_terms FROM ranked JOIN ranked_tf USING (item_id) JOIN ranked_q USING (query_id, term) GROUP BY ALL),
asked AS (SELECT query_id, count(*) AS n FROM ranked_q GROUP BY query_id),
found AS (
  SELECT query_id, item_id, [round(score, 6), n_terms, round(n_terms / n, 6), round(1.0::DOUBLE / rank, 6)] AS f,
         CASE WHEN (query_id, item_id) IN (SELECT (query_id, item_id) FROM truth) THEN 1 ELSE 0 END AS label
  FROM ranked JOIN shared USING (query_id, item_id) JOIN asked USING (query_id)),
raw AS (
  SELECT fold, CASE WHEN query_id % 2 = fold THEN 'test' ELSE 'train' END AS part, query_id, item_id, label, k, f[k] AS x
  FROM found, (SELECT unnest([0, 1]) AS fold), (SELECT unnest(range(1, {_N + 1})) AS k)),
bounds AS (SELECT fold, k, min(x) AS lo, max(x) AS hi FROM raw WHERE part = 'train' GROUP BY ALL),
v AS (SELECT fold, part, query_id, item_id, label, k, round(CASE WHEN hi > lo THEN greatest(0, least(1, (x - lo) / (hi - lo))) ELSE 0 END, 9) AS v FROM raw JOIN bounds USING (fold, k)),
train AS (SELECT * FROM v WHERE part = 'train'),
sums AS (SELECT fold, k, label, sum(v) AS s, count(*) AS n FROM train GROUP BY ALL),
whole AS (SELECT fold, k, sum(s) AS w, sum(n) AS m FROM sums GROUP BY ALL),
chi AS (SELECT fold, k, coalesce(sum(CASE WHEN w > 0 THEN (s - w * n / m) ** 2 / (w * n / m) END), 0) AS w FROM sums JOIN whole USING (fold, k) GROUP BY ALL),
bins AS (SELECT fold, k, label, least({G.BINS - 1}, floor(v * {G.BINS})) AS bin, count(*) AS n FROM train GROUP BY ALL),
shares AS (SELECT fold, k, n, sum(n) OVER (PARTITION BY fold, k) AS m, sum(n) OVER (PARTITION BY fold, k, label) AS by_label, sum(n) OVER (PARTITION BY fold, k, bin) AS by_bin FROM bins),
info AS (SELECT fold, k, greatest(0, sum(n / m * ln(n * m / (by_label * by_bin)))) AS w FROM shares GROUP BY ALL),
plain AS (SELECT 'chi2' AS method, fold, k, w FROM chi UNION ALL SELECT 'mutual_information', fold, k, w FROM info UNION ALL SELECT 'constant', fold, k, 1.0::DOUBLE FROM chi),
w AS (SELECT method, fold, k, CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p ELSE 1.0::DOUBLE / {_N} END AS w FROM plain WINDOW p AS (PARTITION BY method, fold)),
scores AS (SELECT method, fold, part, query_id, item_id, label, round(sum(w * v), 9) AS score FROM v JOIN w USING (fold, k) GROUP BY ALL),
{_map_sql("scores", "judged")},
top AS (SELECT fold, method FROM judged WHERE part = 'train' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(map, 9) DESC, method) = 1),
best AS (SELECT * FROM scores JOIN top USING (fold, method) WHERE part = 'train'),
target AS (SELECT fold, query_id, item_id, score + label * max(abs(score)) OVER (PARTITION BY fold) AS y, count(*) OVER (PARTITION BY fold) AS n FROM best),
x AS (SELECT fold, query_id, item_id, k, v FROM train UNION ALL SELECT fold, query_id, item_id, {_N + 1}, 1 FROM target),
products AS (SELECT a.fold, a.k AS i, b.k AS j, sum(a.v * b.v) AS g FROM x a JOIN x b USING (fold, query_id, item_id) GROUP BY ALL),
penalised AS (SELECT fold, i, list(g + CASE WHEN i = j AND i <= {_N} THEN {G.RIDGE} * n ELSE 0 END ORDER BY j) AS g FROM products JOIN (SELECT DISTINCT fold, n FROM target) USING (fold) GROUP BY ALL),
matrix AS (SELECT fold, list(g ORDER BY i) AS g FROM penalised GROUP BY fold),
with_target AS (SELECT fold, k, sum(v * y) AS t FROM x JOIN target USING (fold, query_id, item_id) GROUP BY ALL),
sides AS (SELECT fold, list(t ORDER BY k) AS t FROM with_target GROUP BY fold),
descent AS (  -- conjugate gradients
  SELECT fold, g, 0 AS step, list_transform(t, lambda e: 0.0::DOUBLE) AS w, t AS r, t AS p FROM matrix JOIN sides USING (fold)
  UNION ALL
  SELECT fold, g, step + 1, w2, r2, list_transform(range(1, {_N + 2}), lambda e: r2[e] + list_inner_product(r2, r2) / rr * p[e])
  FROM (SELECT *, list_transform(range(1, {_N + 2}), lambda e: w[e] + a * p[e]) AS w2, list_transform(range(1, {_N + 2}), lambda e: r[e] - a * gp[e]) AS r2
        FROM (SELECT *, rr / list_inner_product(p, gp) AS a
              FROM (SELECT *, list_transform(g, lambda row: list_inner_product(row, p)) AS gp, list_inner_product(r, r) AS rr FROM descent WHERE step < 60)
              WHERE rr > 1e-24))),
ridge AS (SELECT fold, arg_max(w, step) AS w FROM descent GROUP BY fold),
lines AS (SELECT 'ridge' AS method, fold, part, query_id, item_id, label, round(sum(w[k] * v) + any_value(w[{_N + 1}]), 9) AS score FROM v JOIN ridge USING (fold) GROUP BY ALL),
{_map_sql("lines", "ridged")},
maps AS (SELECT method, fold, max(map) FILTER (part = 'train') AS map_train, max(map) FILTER (part = 'test') AS map_test FROM (SELECT * FROM judged UNION ALL SELECT * FROM ridged) GROUP BY ALL),
weights AS (
  SELECT method, fold, 'weighting' AS kind, list(w ORDER BY k) AS w FROM w GROUP BY ALL
  UNION ALL SELECT 'ridge', fold, 'regressor', w FROM ridge)
SELECT CAST(fold AS INTEGER) AS fold, method, kind, {", ".join(f"w[{k}] AS w_{c}" for k, c in enumerate(FEATURES, 1))}, coalesce(w[{_N + 1}], 0) AS constant, map_train, map_test,
       row_number() OVER (PARTITION BY fold ORDER BY round(map_train, 9) DESC, kind, method) = 1 AS chosen
FROM weights JOIN maps USING (method, fold)""",
        "fold method kind chosen",
        " ".join([*(f"w_{c}" for c in FEATURES), "constant", "map_train", "map_test"]),
    ),
}
