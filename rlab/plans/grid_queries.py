"""Queries on the grid of experiment results: paired comparisons, rank statistics, effect sizes, source selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlab.functions import classify as C
from rlab.operators import compare as C2
from rlab.operators import joins as J
from rlab.operators import rank as K
from rlab.operators import stats as S
from rlab.operators.stats import round_columns
from rlab.plans import adapters as A

GROUP = [0, 1, 2, 3]
TESTS = [("CP-transfer", "WP-small"), ("WP-large", "CP-transfer")]


def _deltas(spark: SparkSession, sf_dir: str, metric: str = "MRR") -> DataFrame:
    return J.paired_delta(A.grid(spark, sf_dir), "CP-transfer", "WP-small", metric)


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap of every unordered pair of projects from suppliers' balances."""
    s = A.table(spark, sf_dir, "supplier")
    return s.groupBy((F.col("s_suppkey") % 10).alias("project_a"), (F.col("s_nationkey") % 13).alias("project_b")).agg((F.sum(F.floor(F.col("s_acctbal")).cast("long") % 1000) / F.count(F.lit(1)) / 1000.0).alias("gap"))


_GAPS = "gaps AS (SELECT s_suppkey % 10 AS project_a, s_nationkey % 13 AS project_b, CAST(sum(CAST(floor(s_acctbal) AS BIGINT) % 1000) AS DOUBLE) / count(*) / 1000.0::DOUBLE AS gap FROM supplier GROUP BY ALL)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = J.scenario_wide(A.grid(spark, sf_dir), A.projects(spark, sf_dir))
    gap = (F.col("source_project") * 13 + F.col("target_project")) % 17 / 17.0
    return wide.withColumn("gap", gap).withColumn("recall_ceiling", 0.5 + gap / 2)


_WIDE = f"""{A.GRID}, {A.PROJECTS}, wide AS (
  SELECT w.*, s.LoC AS src_LoC, s.n_bugs AS src_n_bugs, t.LoC AS tgt_LoC, t.n_bugs AS tgt_n_bugs, cp_transfer - wp_small AS gain, cp_transfer - wp_small > 0 AS win, cp_transfer > wp_large AS beats_large,
         s.n_bugs / (t.n_bugs + 1e-9::DOUBLE) AS bug_ratio, (source_project * 13 + target_project) % 17 / 17.0::DOUBLE AS gap, 0.5::DOUBLE + (source_project * 13 + target_project) % 17 / 17.0::DOUBLE / 2 AS recall_ceiling
  FROM (SELECT model_name, source_project, target_project, max(MRR) FILTER (scenario = 'CP-transfer') AS cp_transfer, max(MRR) FILTER (scenario = 'WP-small') AS wp_small,
               max(MRR) FILTER (scenario = 'WP-large') AS wp_large, max(MRR) FILTER (scenario = 'CP-cold-start') AS cold_start FROM grid GROUP BY ALL HAVING cp_transfer IS NOT NULL) w
  LEFT JOIN projects s ON s.repo_name = source_project LEFT JOIN projects t ON t.repo_name = target_project)"""


def scenario_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.scenario_means(A.grid(spark, sf_dir)))


def stratified_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = J.with_metadata(A.grid(spark, sf_dir), A.projects(spark, sf_dir)).withColumn("size", C.size_bin(F.col("tgt_LoC"), 3_750_000, 4_000_000))
    return round_columns(C2.stratified_means(sized, "size", "MRR"))


def gain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.gain_summary(_deltas(spark, sf_dir), ["model_name"]))


_GAIN = """count(delta) AS n, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, avg(delta) AS mean_delta, quantile_cont(delta, 0.5) AS median_delta,
quantile_cont(delta, 0.5) FILTER (delta > 0) AS median_win, quantile_cont(delta, 0.5) FILTER (delta < 0) AS median_loss, count(*) FILTER (delta > 0) / CAST(count(delta) AS DOUBLE) AS win_rate"""


def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.win_rates(A.grid(spark, sf_dir), "CP-transfer", "WP-small"))


def rep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.rep_summary(A.reps(spark, sf_dir), ["MRR"]))


def noise_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.noise_bands(_deltas(spark, sf_dir), A.reps(spark, sf_dir), "MRR"))


def noise_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.noise_spread(A.reps(spark, sf_dir), "MRR"))


def reps_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.reps_wide(A.reps(spark, sf_dir), "MRR", [1, 2, 3])


def relabel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C2.relabel_counts(A.grid(spark, sf_dir).where("scenario = 'CP-transfer'"), A.reps(spark, sf_dir), "MRR", [1, 2, 3])


def cross_domain_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.cross_domain_breakdown(_deltas(spark, sf_dir), GROUP))


def transfer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.transfer_summary(_deltas(spark, sf_dir), ["model_name"]))


def negative_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.negative_cases(_deltas(spark, sf_dir)))


def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_deltas(spark, sf_dir))


def reverse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(J.reverse_pairs(A.grid(spark, sf_dir), "MRR", A.projects(spark, sf_dir)))


_REVERSE = """both_ways AS (SELECT model_name, scenario, least(source_project, target_project) AS project_a, greatest(source_project, target_project) AS project_b,
max(MRR) FILTER (source_project < target_project) AS a_to_b, max(MRR) FILTER (source_project > target_project) AS b_to_a FROM grid WHERE source_project <> target_project GROUP BY ALL HAVING a_to_b IS NOT NULL AND b_to_a IS NOT NULL)"""


def asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.asymmetry(A.grid(spark, sf_dir)))


def symmetric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(J.with_pair_value(_deltas(spark, sf_dir), _gaps(spark, sf_dir), "project_a", "project_b", "gap"))


def direction_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    agree = C.agreement(F.col("delta_a"), F.col("delta_b"))
    return S.model_pairs(_deltas(spark, sf_dir)).select("source_project", "target_project", "model_a", "model_b", agree["same_direction"].alias("same_direction"), agree["same_sign"].alias("same_sign"), agree["colour"].alias("colour"))


def pivot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.pivot_scores(A.grid(spark, sf_dir)))


def quartile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.with_metadata(A.grid(spark, sf_dir), A.projects(spark, sf_dir))
    return round_columns(C2.quartile_grid(rows, "src_LoC", "tgt_n_bugs", "MRR")).select(F.col("x_quartile").cast("long").alias("x_quartile"), F.col("y_quartile").cast("long").alias("y_quartile"), "mean", "n")


def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.with_source_quality(A.grid(spark, sf_dir), "MRR").where("scenario = 'CP-transfer'")
    return round_columns(rows.select("model_name", "source_project", "target_project", "source_quality", "MRR"))


def target_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.target_profile(_wide(spark, sf_dir)))


def scenario_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_wide(spark, sf_dir).drop("gap", "recall_ceiling"))


def desirability_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C2.desirability_evidence(_wide(spark, sf_dir)))


def median_threshold_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.with_metadata(A.grid(spark, sf_dir).where("scenario = 'CP-cold-start'"), A.projects(spark, sf_dir))
    return round_columns(C2.median_threshold_profile(rows, "tgt_LoC", {"MRR": 0.5, "MAP": 0.4, "top_10": 0.51}))


def wilcoxon_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank sums and z of the signed-rank test, zeros split; p values are left out of the comparison."""
    return round_columns(S.signed_ranks(_deltas(spark, sf_dir), ["model_name"], "zsplit"))


def rank_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(S.rank_biserial(_deltas(spark, sf_dir), ["model_name"]))


def _ranks_sql(keep: str) -> str:
    return f"""r AS (SELECT model_name, delta, rank() OVER (PARTITION BY model_name ORDER BY round(abs(delta), 12)) + (count(*) OVER (PARTITION BY model_name, round(abs(delta), 12)) - 1) / 2.0 AS r,
count(*) OVER (PARTITION BY model_name, round(abs(delta), 12)) AS t FROM deltas {keep})"""


def cohens_dz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(S.cohens_dz(_deltas(spark, sf_dir), ["model_name"]))


def wilcoxon_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scenario comparisons with p values, stars and equivalence."""
    tests = S.scenario_tests(A.grid(spark, sf_dir), [(a, b, "greater") for a, b in TESTS])
    return round_columns(tests.withColumn("stars", C.stars(F.col("p"))))


def equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(S.tost(_deltas(spark, sf_dir), ["model_name"]))


def effect_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.effect_grid(A.grid(spark, sf_dir), TESTS, ["MRR", "MAP"])


def rep_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(S.rep_sensitivity(A.grid(spark, sf_dir).where("scenario = 'CP-transfer'"), A.reps(spark, sf_dir), "MRR", [1, 2, 3]))


def target_level_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(S.target_level_test(_deltas(spark, sf_dir), ["model_name"]))


def avg_rank_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the target's reports with the gain."""
    return round_columns(S.spearman(_wide(spark, sf_dir), "tgt_n_bugs", "gain", ["model_name"]).drop("p"))


def feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    cast = wide.select("gain", *[F.col(c).cast("double").alias(c) for c in ("tgt_n_bugs", "tgt_LoC", "src_LoC", "gap", "bug_ratio")])
    return round_columns(S.feature_screen(cast, ["tgt_n_bugs", "tgt_LoC", "src_LoC", "gap", "bug_ratio"], "gain", 3).drop("p"))


def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By model and target: agreement of the source's size with its transfer score."""
    return round_columns(S.kendall_tau(_wide(spark, sf_dir), "src_LoC", "cp_transfer", ["model_name", "target_project"]))


def ols_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(S.ols_line(_wide(spark, sf_dir), "gap", "gain", ["model_name"]))


def minmax_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.projects(spark, sf_dir).select("repo_name", F.col("LoC").cast("double").alias("LoC"), F.col("n_bugs").cast("double").alias("n_bugs"))
    scaled = S.min_max_scale(p, ["LoC", "n_bugs"])
    return round_columns(scaled.withColumn("composite", 0.5 * F.col("n_bugs") + 0.25 * F.col("LoC")))


def rank_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = S.rank_sources(_wide(spark, sf_dir), ["model_name", "target_project"], "cp_transfer", "src_n_bugs", "src_LoC", "gap")
    return round_columns(ranked.select("model_name", "target_project", "n_sources", "oracle", "random", *[f"{h}_{k}" for h in ("most_bugs", "small_gap", "composite") for k in ("score", "hit", "tau")]))


def source_ranking_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(S.source_ranking_means(S.rank_sources(_wide(spark, sf_dir), ["model_name", "target_project"], "cp_transfer", "src_n_bugs", "src_LoC", "gap")))


def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(S.model_agreement(_deltas(spark, sf_dir)).drop("p"))


def icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(S.random_intercept(_deltas(spark, sf_dir), "target_project", ["model_name"]))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(S.bootstrap_ci(_deltas(spark, sf_dir), ["model_name"]))


def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.best_by(A.grid(spark, sf_dir).where("scenario = 'CP-transfer'"), ["model_name", "target_project"], "source_project", "MRR")


def extreme_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(K.extreme_pairs(_deltas(spark, sf_dir), "delta", 5, "model_name", "source_project", "target_project"))


def shared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all models on the pairs on which model A gains."""
    rows = _deltas(spark, sf_dir)
    gained = rows.where("model_name <> 'A' or delta > 0")
    return round_columns(K.shared_pairs(gained, "A").select("model_name", "source_project", "target_project", "delta"))


QUERIES = {f.__name__: f for f in (scenario_means, stratified_grouping_sets, gain_summary, win_rates, rep_summary, noise_bands, noise_spread, reps_wide, relabel_counts, cross_domain_breakdown, transfer_summary, negative_cases, paired_delta, reverse_pairs, asymmetry, symmetric_lookup, direction_agreement, pivot_scores, quartile_grid, source_quality, target_profile, scenario_wide, desirability_evidence, median_threshold_profile, wilcoxon_w, rank_biserial, cohens_dz, wilcoxon_tests, equivalence, effect_grid, rep_sensitivity, target_level_test, avg_rank_spearman, feature_screen, kendall_tau, ols_line, minmax_composite, rank_sources, source_ranking_means, model_agreement, icc, bootstrap_ci, best_source, extreme_pairs, shared_pairs)}

_D = f"WITH {A.GRID}, {A.DELTAS}"
_DIR = "CASE WHEN {x} > 0.01 THEN 'positive' WHEN {x} < -0.01 THEN 'negative' ELSE 'neutral' END"


def _spearman_sql(x: str, y: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {{by}} ORDER BY {c}) + (count(*) OVER (PARTITION BY {{by}}, {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT {{by}}, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT {{by}}, {rank(x)} AS rx, {rank(y)} AS ry FROM {{rows}} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY ALL"


def _tail(z: str) -> str:
    """P(Z > z) of the normal law: its power series around 0."""
    series = f"list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5::DOUBLE) + 0.5::DOUBLE * ln(pi()))))"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE - sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {series} END)"


_P = {"greater": _tail("z"), "less": _tail("(-z)"), "two-sided": f"least(1.0::DOUBLE, 2 * {_tail('abs(z)')})"}
_STARS = "CASE WHEN p IS NULL THEN NULL WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END"


def _signed_rank_sql(name: str, rows: str, alternative: str, zeros: bool) -> str:
    """CTEs that end in ``name``: the signed-rank test of ``delta`` in the CTE ``rows``, by model."""
    part = lambda sign: f"coalesce(sum(r) FILTER (delta {sign} 0), 0) + coalesce(sum(r) FILTER (delta = 0), 0) / 2"
    return f"""{name}_a AS (SELECT *, round(abs(delta), 12) AS m FROM {rows} WHERE delta IS NOT NULL{"" if zeros else " AND delta <> 0"}),
{name}_r AS (SELECT *, rank() OVER (PARTITION BY model_name ORDER BY m) + (count(*) OVER (PARTITION BY model_name, m) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY model_name, m) AS t FROM {name}_a),
{name}_s AS (SELECT model_name, count(*) AS n, count(*) FILTER (delta = 0) AS n_zero, {part(">")} AS w_plus, {part("<")} AS w_minus, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM {name}_r GROUP BY model_name),
{name}_z AS (SELECT *, (w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM {name}_s),
{name} AS (SELECT *, CASE WHEN n >= 5 THEN {_P[alternative]} END AS p FROM {name}_z)"""


def _paired_sql(name: str, first: str, second: str, metric: str = "MRR") -> str:
    value = lambda s: f"max({metric}) FILTER (scenario = '{s}')"
    return f"{name} AS (SELECT model_name, source_project, target_project, {value(first)} - {value(second)} AS delta FROM grid GROUP BY ALL HAVING delta IS NOT NULL)"


def _tests_sql() -> str:
    ctes = [f"{_paired_sql(f'd{k}', a, b)}, {_signed_rank_sql(f't{k}', f'd{k}', 'greater', True)}" for k, (a, b) in enumerate(TESTS)]
    rows = [f"SELECT model_name, n, n_zero, w_plus, w_minus, z, p, 'normal' AS method, '{a} vs {b}' AS comparison, {_STARS} AS stars FROM t{k}" for k, (a, b) in enumerate(TESTS)]
    return f"WITH {A.GRID}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


def _effects_sql() -> str:
    ctes, rows = [], []
    for k, (a, b) in enumerate(TESTS):
        for m in ("MRR", "MAP"):
            ctes.append(f"{_paired_sql(f'd{k}{m}', a, b, m)}, {_signed_rank_sql(f't{k}{m}', f'd{k}{m}', 'two-sided', True)}, e{k}{m} AS (SELECT model_name, avg(delta) / stddev_samp(delta) AS dz FROM d{k}{m} GROUP BY model_name)")
        cell = lambda m: f"(SELECT format('{{:.2f}}', dz) || ' ' || {_STARS} FROM e{k}{m} JOIN t{k}{m} USING (model_name) WHERE model_name = x.model_name) AS {m}"  # noqa: B023, E731
        rows.append(f"SELECT model_name, '{a} vs {b}' AS comparison, {cell('MRR')}, {cell('MAP')} FROM (SELECT DISTINCT model_name FROM d{k}MRR) x")
    return A.exact_means(f"WITH {A.GRID}, {', '.join(ctes)} {' UNION ALL '.join(rows)}")


def _reps_sql() -> str:
    ctes, rows = [f"transfer AS (SELECT * FROM grid WHERE scenario = 'CP-transfer')"], []
    for r in (1, 2, 3):
        ctes.append(f"d{r} AS (SELECT t.model_name, t.MRR - r.MRR AS delta FROM transfer t JOIN (SELECT DISTINCT model_name, target_project FROM reps) USING (model_name, target_project) LEFT JOIN (SELECT * FROM reps WHERE rep = {r}) r USING (model_name, target_project)), {_signed_rank_sql(f't{r}', f'd{r}', 'two-sided', False)}")
        rows.append(f"SELECT t.model_name, t.n, t.n_zero, w_plus, w_minus, z, p, 'normal' AS method, (w_plus - w_minus) / (w_plus + w_minus) AS rank_biserial, pct_wins, {r} AS rep FROM t{r} t JOIN (SELECT model_name, 100 * avg(CASE WHEN delta > 0 THEN 1.0::DOUBLE ELSE 0 END) AS pct_wins FROM d{r} GROUP BY model_name) USING (model_name)")
    return f"WITH {A.GRID}, {A.REPS}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


HEURISTICS = ["most_bugs", "most_loc", "small_gap", "composite"]


def _ranked_sources_sql() -> str:
    """CTEs that end in ``ranked``: what ``rank_sources`` gives by model and target."""
    scaled = lambda c: f"coalesce((CAST({c} AS DOUBLE) - min(CAST({c} AS DOUBLE)) OVER ()) / nullif(max(CAST({c} AS DOUBLE)) OVER () - min(CAST({c} AS DOUBLE)) OVER (), 0), 0)"
    best = lambda c, of: f"arg_max({of}, (coalesce({c}, -1), -source_project))"
    picks = ", ".join(f"{best(h, 'o')} AS {h}_score, {best(h, 'source_project')} AS {h}_pick" for h in HEURISTICS)
    taus = [
        f"{h}_t AS (SELECT a.model_name, a.target_project, sum(sign(a.{h} - b.{h}) * sign(a.o - b.o)) / nullif(sqrt(CAST(sum(abs(sign(a.{h} - b.{h}))) AS DOUBLE) * CAST(sum(abs(sign(a.o - b.o))) AS DOUBLE)), 0) AS {h}_tau FROM keyed a JOIN keyed b ON a.model_name = b.model_name AND a.target_project = b.target_project AND a.source_project < b.source_project WHERE a.{h} IS NOT NULL AND b.{h} IS NOT NULL GROUP BY ALL)"
        for h in HEURISTICS
    ]
    hits = ", ".join(f"{h}_score, {h}_pick = oracle_pick AS {h}_hit, {h}_score / nullif(oracle, 0) AS {h}_of_oracle, {h}_tau" for h in HEURISTICS)
    joins = " ".join(f"LEFT JOIN {h}_t USING (model_name, target_project)" for h in HEURISTICS)
    return f"""{_WIDE}, scaled AS (SELECT model_name, target_project, source_project, cp_transfer AS o, {scaled("src_n_bugs")} AS most_bugs, {scaled("src_LoC")} AS most_loc, 1 - {scaled("gap")} AS small_gap FROM wide),
keyed AS (SELECT *, 0.5::DOUBLE * most_bugs + 0.25::DOUBLE * most_loc + 0.25::DOUBLE * small_gap AS composite FROM scaled WHERE o IS NOT NULL),
picked AS (SELECT model_name, target_project, count(*) AS n_sources, {best("o", "o")} AS oracle, {best("o", "source_project")} AS oracle_pick, avg(o) AS random, {picks} FROM keyed GROUP BY ALL HAVING count(*) >= 3),
{", ".join(taus)}, ranked AS (SELECT model_name, target_project, n_sources, oracle, random, {hits} FROM picked {joins})"""


ORACLES = {
    "scenario_means": A.rounded_means(
        f"""WITH {A.GRID}, tall AS (UNPIVOT grid ON MRR, MAP, top_10 INTO NAME metric VALUE value),
cells AS (SELECT * FROM (SELECT DISTINCT model_name FROM grid), (SELECT unnest(['WP-small', 'WP-large', 'CP-cold-start', 'CP-transfer']) AS scenario), (SELECT unnest(['MRR', 'MAP', 'top_10']) AS metric))
SELECT model_name, scenario, metric, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std FROM cells LEFT JOIN tall USING (model_name, scenario, metric) GROUP BY ALL""",
        "model_name scenario metric n",
        "mean median std",
    ),
    "stratified_grouping_sets": A.rounded_means(
        f"""WITH {A.GRID}, {A.PROJECTS}, s AS (SELECT g.*, CASE WHEN LoC <= 3750000 THEN 'small' WHEN LoC <= 4000000 THEN 'medium' ELSE 'large' END AS size FROM grid g LEFT JOIN projects ON repo_name = target_project)
SELECT model_name, scenario, CASE WHEN GROUPING(size) = 1 THEN 'All' ELSE size END AS size, count(MRR) AS n, avg(MRR) AS mean FROM s GROUP BY GROUPING SETS ((model_name, scenario), (model_name, scenario, size))""",
        "model_name scenario size n",
        "mean",
    ),
    "gain_summary": A.rounded_means(f"{_D} SELECT *, abs(median_win) / abs(median_loss) AS asymmetry FROM (SELECT model_name, {_GAIN} FROM deltas GROUP BY model_name)", "model_name n wins losses", "mean_delta median_delta median_win median_loss win_rate asymmetry"),
    "win_rates": A.rounded_means(
        f"""WITH {A.GRID}, tall AS (UNPIVOT grid ON MRR, MAP, top_10 INTO NAME metric VALUE value),
d AS (SELECT model_name, metric, max(value) FILTER (scenario = 'CP-transfer') - max(value) FILTER (scenario = 'WP-small') AS delta FROM tall GROUP BY model_name, metric, source_project, target_project)
SELECT model_name, metric, avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END) AS win_rate, count(*) AS n FROM d WHERE delta IS NOT NULL GROUP BY ALL""",
        "model_name metric n",
        "win_rate",
    ),
    "rep_summary": A.rounded_means(f"WITH {A.REPS} SELECT model_name, target_project, count(*) AS n_reps, quantile_cont(MRR, 0.5) AS MRR_median, min(MRR) AS MRR_min, max(MRR) AS MRR_max, avg(MRR) AS MRR_mean, stddev_samp(MRR) AS MRR_std FROM reps GROUP BY ALL", "model_name target_project n_reps", "MRR_median MRR_min MRR_max MRR_mean MRR_std"),
    "noise_bands": A.rounded_means(
        f"""WITH {A.GRID}, {A.DELTAS}, {A.REPS}, s AS (SELECT model_name, target_project, max(MRR) - min(MRR) AS spread FROM reps GROUP BY ALL)
SELECT model_name, count(*) AS n, count(*) FILTER (delta < 0) AS negative, count(*) FILTER (delta < -0.5::DOUBLE * spread) AS beyond_half, count(*) FILTER (delta < -spread) AS beyond_full, count(*) FILTER (delta < -sqrt(2.0::DOUBLE) * spread) AS beyond_sqrt2, avg(spread) AS mean_spread
FROM deltas JOIN s USING (model_name, target_project) GROUP BY model_name""",
        "model_name n negative beyond_half beyond_full beyond_sqrt2",
        "mean_spread",
    ),
    "noise_spread": A.rounded_means(f"WITH {A.REPS} SELECT model_name, count(*) AS targets, avg(s) AS mean_spread, max(s) AS max_spread FROM (SELECT model_name, target_project, max(MRR) - min(MRR) AS s FROM reps GROUP BY ALL) GROUP BY model_name", "model_name targets", "mean_spread max_spread"),
    "reps_wide": f"WITH {A.REPS} SELECT model_name, target_project, max(MRR) FILTER (rep = 1) AS MRR_rep1, max(MRR) FILTER (rep = 2) AS MRR_rep2, max(MRR) FILTER (rep = 3) AS MRR_rep3 FROM reps GROUP BY ALL",
    "relabel_counts": f"""WITH {A.GRID}, {A.REPS}, w AS (SELECT model_name, target_project, max(MRR) FILTER (rep = 1) AS r1, max(MRR) FILTER (rep = 2) AS r2, max(MRR) FILTER (rep = 3) AS r3 FROM reps GROUP BY ALL)
SELECT model_name, count(*) FILTER (MRR - r1 < -0.01) AS negative_rep1, count(*) FILTER (MRR - r2 < -0.01) AS negative_rep2, count(*) FILTER (MRR - r3 < -0.01) AS negative_rep3 FROM grid JOIN w USING (model_name, target_project) WHERE scenario = 'CP-transfer' GROUP BY model_name""",
    "cross_domain_breakdown": A.rounded_means(f"{_D} SELECT model_name, CASE WHEN source_project IN (0, 1, 2, 3) AND target_project IN (0, 1, 2, 3) THEN 'within' ELSE 'cross' END AS domain_type, {_GAIN} FROM deltas GROUP BY ALL", "model_name domain_type n", "mean_delta median_delta win_rate"),
    "transfer_summary": A.rounded_means(f"{_D} SELECT model_name, count(*) FILTER (delta > 0.01) AS positive, count(*) FILTER (delta < -0.01) AS negative, count(*) FILTER (delta BETWEEN -0.01 AND 0.01) AS neutral, min(delta) AS least, max(delta) AS most, avg(delta) AS mean, quantile_cont(delta, 0.5) AS median FROM deltas GROUP BY model_name", "model_name positive negative neutral", "least most mean median"),
    "negative_cases": A.rounded_means(f"{_D} SELECT * FROM deltas WHERE delta < -0.01", "model_name source_project target_project", "first_value second_value delta"),
    "paired_delta": A.rounded_means(f"{_D} SELECT * FROM deltas", "model_name source_project target_project", "first_value second_value delta"),
    "reverse_pairs": A.rounded_means(
        f"""WITH {A.GRID}, {A.PROJECTS}, {_REVERSE} SELECT b.*, abs(a_to_b - b_to_a) AS asymmetry, x.LoC AS loc_a, y.LoC AS loc_b,
CASE WHEN x.LoC IS NULL OR y.LoC IS NULL THEN NULL WHEN y.LoC < x.LoC THEN a_to_b > b_to_a ELSE b_to_a > a_to_b END AS smaller_gains FROM both_ways b LEFT JOIN projects x ON x.repo_name = project_a LEFT JOIN projects y ON y.repo_name = project_b""",
        "model_name scenario project_a project_b loc_a loc_b smaller_gains",
        "a_to_b b_to_a asymmetry",
    ),
    "asymmetry": A.rounded_means(f"WITH {A.GRID}, {_REVERSE} SELECT project_a, project_b, avg(abs(a_to_b - b_to_a)) AS mean_asymmetry, count(*) AS n FROM both_ways GROUP BY ALL ORDER BY mean_asymmetry DESC, project_a, project_b LIMIT 10", "project_a project_b n", "mean_asymmetry"),
    "symmetric_lookup": A.rounded_means(
        f"""WITH {A.GRID}, {A.DELTAS}, {_GAPS}, g AS (SELECT least(project_a, project_b) AS a, greatest(project_a, project_b) AS b, avg(gap) AS gap FROM gaps GROUP BY ALL)
SELECT d.*, gap FROM deltas d LEFT JOIN g ON a = least(source_project, target_project) AND b = greatest(source_project, target_project)""",
        "model_name source_project target_project",
        "first_value second_value delta gap",
    ),
    "direction_agreement": f"""{_D} SELECT source_project, target_project, a.model_name AS model_a, b.model_name AS model_b, {_DIR.format(x="a.delta")} = {_DIR.format(x="b.delta")} AS same_direction,
sign(a.delta) = sign(b.delta) AND sign(a.delta) <> 0 AS same_sign, CASE WHEN a.delta > 0 AND b.delta > 0 THEN 'both_gain' WHEN a.delta < 0 AND b.delta < 0 THEN 'both_loss' ELSE 'disagree' END AS colour
FROM deltas a JOIN deltas b USING (source_project, target_project) WHERE a.model_name < b.model_name""",
    "pivot_scores": "SELECT source_project, target_project, "
    + ", ".join(f'round("{s}", 6) + 0.0 AS "{s}"' for s in J.SCENARIOS)
    + ", round((coalesce(\"WP-small\", 0) + coalesce(\"WP-large\", 0) + coalesce(\"CP-cold-start\", 0) + coalesce(\"CP-transfer\", 0)) / nullif(CAST(n AS DOUBLE), 0), 6) + 0.0 AS row_mean FROM (WITH "
    + A.GRID
    + " SELECT source_project, target_project, "
    + ", ".join(f"avg(MRR) FILTER (scenario = '{s}') AS \"{s}\"" for s in J.SCENARIOS)
    + ", count(DISTINCT scenario) AS n FROM grid GROUP BY ALL)",
    "quartile_grid": A.rounded_means(
        f"""WITH {A.GRID}, {A.PROJECTS}, r AS (SELECT MRR, CAST(s.LoC AS DOUBLE) AS x, CAST(t.n_bugs AS DOUBLE) AS y FROM grid LEFT JOIN projects s ON s.repo_name = source_project LEFT JOIN projects t ON t.repo_name = target_project),
q AS (SELECT list_distinct([quantile_cont(x, 0.0), quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75), quantile_cont(x, 1.0)]) AS xs, list_distinct([quantile_cont(y, 0.0), quantile_cont(y, 0.25), quantile_cont(y, 0.5), quantile_cont(y, 0.75), quantile_cont(y, 1.0)]) AS ys FROM r),
e AS (SELECT list_sort(xs) AS xs, list_sort(ys) AS ys FROM q)
SELECT len(list_filter(xs[2 : len(xs) - 1], lambda v: v < x)) + 1 AS x_quartile, len(list_filter(ys[2 : len(ys) - 1], lambda v: v < y)) + 1 AS y_quartile, avg(MRR) AS mean, count(MRR) AS n FROM r, e GROUP BY ALL""",
        "x_quartile y_quartile n",
        "mean",
    ),
    "source_quality": A.rounded_means(f"WITH {A.GRID}, q AS (SELECT model_name, target_project AS p, avg(MRR) AS source_quality FROM grid WHERE scenario = 'WP-large' GROUP BY ALL) SELECT g.model_name, source_project, target_project, source_quality, MRR FROM grid g LEFT JOIN q ON q.model_name = g.model_name AND p = source_project WHERE scenario = 'CP-transfer'", "model_name source_project target_project", "source_quality MRR"),
    "target_profile": A.rounded_means(f"WITH {_WIDE} SELECT target_project, avg(cp_transfer) AS mean_mrr, max(tgt_LoC) AS LoC, max(tgt_n_bugs) AS n_bugs, avg(gain) AS mean_gain, avg(CAST(win AS DOUBLE)) AS win_share FROM wide GROUP BY target_project", "target_project LoC n_bugs", "mean_mrr mean_gain win_share"),
    "scenario_wide": A.rounded_means(f"WITH {_WIDE} SELECT * FROM wide", "model_name source_project target_project src_LoC src_n_bugs tgt_LoC tgt_n_bugs win beats_large", "cp_transfer wp_small wp_large cold_start gain bug_ratio"),
    "desirability_evidence": A.rounded_means(
        f"""WITH {_WIDE}, h AS (SELECT quantile_cont(CAST(tgt_n_bugs AS DOUBLE), 0.5) AS b, quantile_cont(gap, 0.5) AS g FROM wide), e AS (
SELECT avg(CASE WHEN win THEN 1.0 ELSE 0 END)::DOUBLE AS E1_win_share, avg(CASE WHEN wp_large - cp_transfer <= 0.02 THEN 1.0 ELSE 0 END)::DOUBLE AS E2_close_to_large, avg(CASE WHEN cp_transfer >= wp_large THEN 1.0 ELSE 0 END)::DOUBLE AS E2_at_least_large,
       avg(cold_start / recall_ceiling) AS E3_cold_to_ceiling, avg(cp_transfer / recall_ceiling) AS E3_model_to_ceiling, avg(gain) FILTER (tgt_n_bugs <= b) AS E4_gain_few_bugs, avg(gain) FILTER (tgt_n_bugs > b) AS E4_gain_many_bugs,
       avg(CAST(win AS DOUBLE)) FILTER (gap <= g) AS E5_wins_low_gap, avg(CAST(win AS DOUBLE)) FILTER (gap > g) AS E5_wins_high_gap FROM wide, h) SELECT evidence, value FROM e UNPIVOT INCLUDE NULLS (value FOR evidence IN (COLUMNS(*)))""",
        "evidence",
        "value",
    ),
    "median_threshold_profile": A.rounded_means(
        f"""WITH {A.GRID}, {A.PROJECTS}, r AS (SELECT LoC, MRR, MAP, top_10 FROM grid LEFT JOIN projects ON repo_name = target_project WHERE scenario = 'CP-cold-start'), tall AS (UNPIVOT r ON MRR, MAP, top_10 INTO NAME metric VALUE value),
o AS (SELECT metric, LoC, value >= CASE metric WHEN 'MRR' THEN 0.5 WHEN 'MAP' THEN 0.4 ELSE 0.51 END AS ok FROM tall)
SELECT metric, avg(CAST(ok AS DOUBLE)) AS viable_share, max(LoC) FILTER (ok) AS largest_viable, quantile_cont(CAST(LoC AS DOUBLE), 0.5) FILTER (ok) AS median_viable, quantile_cont(CAST(LoC AS DOUBLE), 0.5) FILTER (NOT ok) AS median_other FROM o GROUP BY metric""",
        "metric largest_viable",
        "viable_share median_viable median_other",
    ),
    "wilcoxon_tests": A.rounded(_tests_sql(), "model_name n n_zero method comparison stars", "w_plus w_minus z p"),
    "rank_sources": A.rounded_means(
        f"WITH {_ranked_sources_sql()} SELECT * FROM ranked",
        "model_name target_project n_sources most_bugs_hit small_gap_hit composite_hit",
        "oracle random most_bugs_score most_bugs_tau small_gap_score small_gap_tau composite_score composite_tau",
    ),
    "source_ranking_means": A.rounded_means(
        f"WITH {_ranked_sources_sql()} SELECT count(*) AS targets, avg(oracle) AS oracle, avg(random) AS random, " + ", ".join(f"avg(CAST({h}_{k} AS DOUBLE)) AS {h}_{k}" for h in HEURISTICS for k in ("score", "hit", "of_oracle", "tau")) + " FROM ranked",
        "targets",
        "oracle random " + " ".join(f"{h}_{k}" for h in HEURISTICS for k in ("score", "hit", "of_oracle", "tau")),
    ),
    "equivalence": A.rounded(
        f"""{_D}, low_d AS (SELECT model_name, delta + 0.05::DOUBLE AS delta FROM deltas), high_d AS (SELECT model_name, delta - 0.05::DOUBLE AS delta FROM deltas), {_signed_rank_sql("low", "low_d", "greater", False)}, {_signed_rank_sql("high", "high_d", "less", False)}
SELECT model_name, low.n AS n, low.p AS p_low, high.p AS p_high, greatest(low.p, high.p) AS p, greatest(low.p, high.p) < 0.05 AS equivalent FROM low JOIN high USING (model_name)""",
        "model_name n equivalent",
        "p_low p_high p",
    ),
    "effect_grid": _effects_sql(),
    "rep_sensitivity": A.rounded(_reps_sql(), "model_name n n_zero method rep", "w_plus w_minus z p rank_biserial pct_wins"),
    "target_level_test": A.rounded_means(
        f"""{_D}, m AS (SELECT model_name, target_project, avg(delta) AS delta FROM deltas GROUP BY ALL), {_signed_rank_sql("t", "m", "two-sided", False)}
SELECT model_name, n, n_zero, w_plus, w_minus, z, p, 'normal' AS method, n_positive, mean FROM t JOIN (SELECT model_name, count(*) FILTER (delta > 0) AS n_positive, avg(delta) AS mean FROM m GROUP BY model_name) USING (model_name)""",
        "model_name n n_zero method n_positive",
        "w_plus w_minus z p mean",
    ),
    "wilcoxon_w": A.rounded_means(
        f"""{_D}, {_ranks_sql("")}, s AS (SELECT model_name, count(*) AS n, count(*) FILTER (delta = 0) AS n_zero, coalesce(sum(r) FILTER (delta > 0), 0) + coalesce(sum(r) FILTER (delta = 0), 0) / 2 AS w_plus,
coalesce(sum(r) FILTER (delta < 0), 0) + coalesce(sum(r) FILTER (delta = 0), 0) / 2 AS w_minus, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY model_name)
SELECT *, (w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s""",
        "model_name n n_zero",
        "w_plus w_minus z",
    ),
    "rank_biserial": A.rounded_means(
        f"""{_D}, {_ranks_sql("WHERE delta <> 0")}, s AS (SELECT model_name, count(*) AS n, coalesce(sum(r) FILTER (delta > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (delta < 0), 0)::DOUBLE AS w_minus FROM r GROUP BY model_name)
SELECT *, (w_plus - w_minus) / (w_plus + w_minus) AS rank_biserial FROM s""",
        "model_name n",
        "w_plus w_minus rank_biserial",
    ),
    "cohens_dz": A.rounded_means(f"{_D} SELECT model_name, count(delta) AS n, avg(delta) AS mean, stddev_samp(delta) AS std, avg(delta) / stddev_samp(delta) AS dz FROM deltas GROUP BY model_name", "model_name n", "mean std dz"),
    "avg_rank_spearman": A.rounded_means(f"WITH {_WIDE} {_spearman_sql('tgt_n_bugs', 'gain').format(by='model_name', rows='wide')}", "model_name n", "rho"),
    "feature_screen": A.rounded_means(
        f"""WITH {_WIDE}, f AS (SELECT gain, CAST(tgt_n_bugs AS DOUBLE) AS tgt_n_bugs, CAST(tgt_LoC AS DOUBLE) AS tgt_LoC, CAST(src_LoC AS DOUBLE) AS src_LoC, gap, bug_ratio FROM wide),
tall AS (UNPIVOT f ON tgt_n_bugs, tgt_LoC, src_LoC, gap, bug_ratio INTO NAME feature VALUE value) SELECT * FROM ({_spearman_sql("value", "gain").format(by="feature", rows="tall")}) ORDER BY round(abs(rho), 9) DESC, feature LIMIT 3""",
        "feature n",
        "rho",
    ),
    "kendall_tau": A.rounded_means(
        f"""WITH {_WIDE}, p AS (SELECT a.model_name, a.target_project, a.source_project, sign(a.src_LoC - b.src_LoC) AS x, sign(a.cp_transfer - b.cp_transfer) AS y FROM wide a JOIN wide b ON a.model_name = b.model_name AND a.target_project = b.target_project AND a.source_project < b.source_project
WHERE a.src_LoC IS NOT NULL AND b.src_LoC IS NOT NULL)
SELECT model_name, target_project, count(DISTINCT source_project) + 1 AS n, sum(x * y) / nullif(sqrt(CAST(sum(abs(x)) AS DOUBLE) * CAST(sum(abs(y)) AS DOUBLE)), 0) AS tau FROM p GROUP BY ALL""",
        "model_name target_project n",
        "tau",
    ),
    "ols_line": A.rounded_means(f"WITH {_WIDE} SELECT model_name, count(*) AS n, regr_slope(gain, gap) AS slope, regr_intercept(gain, gap) AS intercept, corr(gap, gain) AS r FROM wide WHERE gain IS NOT NULL GROUP BY model_name", "model_name n", "slope intercept r"),
    "minmax_composite": A.rounded_means(
        f"""WITH {A.PROJECTS}, b AS (SELECT min(LoC) AS l0, max(LoC) AS l1, min(n_bugs) AS b0, max(n_bugs) AS b1 FROM projects), s AS (SELECT repo_name, coalesce((LoC - l0) / nullif(CAST(l1 - l0 AS DOUBLE), 0), 0) AS LoC, coalesce((n_bugs - b0) / nullif(CAST(b1 - b0 AS DOUBLE), 0), 0) AS n_bugs FROM projects, b)
SELECT *, 0.5::DOUBLE * n_bugs + 0.25::DOUBLE * LoC AS composite FROM s""",
        "repo_name",
        "LoC n_bugs composite",
    ),
    "model_agreement": A.rounded_means(
        f"""{_D}, p AS (SELECT a.model_name AS model_a, b.model_name AS model_b, a.delta AS x, b.delta AS y FROM deltas a JOIN deltas b USING (source_project, target_project) WHERE a.model_name < b.model_name),
g AS (SELECT model_a, model_b, avg(CASE WHEN {_DIR.format(x="x")} = {_DIR.format(x="y")} THEN 1.0 ELSE 0 END) AS agreement FROM p GROUP BY ALL) SELECT * FROM g JOIN ({_spearman_sql("x", "y").format(by="model_a, model_b", rows="p")}) USING (model_a, model_b)""",
        "model_a model_b n",
        "agreement rho",
    ),
    "icc": A.rounded_means(
        f"""{_D}, g AS (SELECT model_name, target_project, CAST(count(delta) AS DOUBLE) AS n, sum(delta) AS s, sum(delta * delta) AS q FROM deltas GROUP BY ALL),
t AS (SELECT model_name, count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum(s) AS s, sum(s * s / n) AS ss, sum(q) AS q FROM g GROUP BY model_name),
v AS (SELECT model_name, k AS n_groups, CAST(nn AS BIGINT) AS n, s / nn AS mean, (q - ss) / (nn - k) AS var_within, greatest(((ss - s * s / nn) / (k - 1) - (q - ss) / (nn - k)) / ((nn - n2 / nn) / (k - 1)), 0) AS var_between FROM t)
SELECT *, var_between / (var_between + var_within) AS icc FROM v""",
        "model_name n_groups n",
        "mean var_within var_between icc",
    ),
    "best_source": f"WITH {A.GRID} SELECT model_name, target_project, source_project AS best_source_project, MRR AS best_MRR FROM (SELECT *, row_number() OVER (PARTITION BY model_name, target_project ORDER BY MRR DESC, source_project) AS r FROM grid WHERE scenario = 'CP-transfer' AND MRR IS NOT NULL) WHERE r = 1",
    "extreme_pairs": A.rounded_means(
        f"""{_D} SELECT * FROM (SELECT *, 'largest' AS "end" FROM deltas ORDER BY delta DESC, model_name, source_project, target_project LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'smallest' AS "end" FROM deltas ORDER BY delta, model_name, source_project, target_project LIMIT 5)""",
        'model_name source_project target_project "end"',
        "first_value second_value delta",
    ),
    "shared_pairs": A.rounded_means(f"{_D} SELECT model_name, source_project, target_project, delta FROM deltas d WHERE (source_project, target_project) IN (SELECT (source_project, target_project) FROM deltas WHERE model_name = 'A' AND delta > 0) AND (model_name <> 'A' OR delta > 0)", "model_name source_project target_project", "delta"),
}
