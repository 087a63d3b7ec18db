"""Profiles of report corpora, projects, code size and tokens. Every one is a pre-aggregated group-by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlab.functions import classify as C
from rlab.functions import text as X
from rlab.operators.order import join_on, quantiles

PERCENTILES = (50, 75, 80, 85, 90, 95, 99)
CONTEXT_SIZES = (1024, 2048, 4096, 8192, 16384)


def dup_profile(df: DataFrame, key: str, by: list[str] | None = None, firsts: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """(by, total, distinct_keys, duplicates, first_..) of rows with a key; first values are those of the least
    ``order``, nulls left out."""
    at = F.col(order) if order else F.lit(0)
    pick = [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"first_{c}") for c in firsts]
    out = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), F.countDistinct(key).alias("distinct_keys"), *pick)
    return out.withColumn("duplicates", F.col("total") - F.col("distinct_keys"))


def split_profile(df: DataFrame, key: str, split: str, by: list[str] | None = None, **how) -> DataFrame:
    return dup_profile(df, key, [split, *(by or [])], **how)


def grand_totals(profile: DataFrame) -> DataFrame:
    """Groups, rows and distinct rows over a ``dup_profile``."""
    return profile.agg(F.count(F.lit(1)).alias("groups"), F.sum("total").alias("reports"), F.sum("distinct_keys").alias("unique_reports"))


def distinct_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(f"distinct_{c}") for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def ext_counts(df: DataFrame, files: str, by: list[str], mode: str = "basename") -> DataFrame:
    """Files of each extension by group."""
    exts = df.select(*by, F.explode(files).alias("_f")).select(*by, X.file_ext(F.col("_f"), mode).alias("ext"))
    return exts.where(F.col("ext").isNotNull()).groupBy(*by, "ext").agg(F.count(F.lit(1)).alias("n"))


def ext_set(df: DataFrame, files: str, by: list[str], mode: str = "basename") -> DataFrame:
    return ext_counts(df, files, by, mode).groupBy(*by).agg(F.sort_array(F.collect_set("ext")).alias("exts"))


def ext_keys(df: DataFrame, literal: str, by: list[str]) -> DataFrame:
    """Distinct keys of a stringified map of extensions, by group."""
    parsed = F.from_json(F.translate(F.col(literal), "'", '"'), "map<string,int>")
    return df.select(*by, F.explode(F.map_keys(parsed)).alias("ext")).distinct()


def date_profile(df: DataFrame, when: str) -> DataFrame:
    """Least, largest and median time, rows in 1970 and rows without a time."""
    seconds = df.select(F.unix_timestamp(F.col(when).cast("timestamp")).cast("double").alias("_s"))
    median = quantiles(seconds, "_s", [], [0.5]).agg(F.first("quantiles")[0].alias("median_epoch"))
    out = df.agg(F.min(when).alias("first"), F.max(when).alias("last"), F.count(F.when(F.year(when) == 1970, 1)).alias("in_1970"), F.count(F.when(F.col(when).isNull(), 1)).alias("missing"))
    return out.join(F.broadcast(median)).select("first", "last", "median_epoch", "in_1970", "missing")


def year_counts(df: DataFrame, when: str, top: int = 15) -> DataFrame:
    return df.groupBy(F.year(when).alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("year")).limit(top)


def loc_profile(files: DataFrame, project: str = "repo_name") -> DataFrame:
    """(project, loc, primary_language, primary_loc, polyglot_index) of files (project, language, loc); the index is the
    primary language's share of all lines, 0 without lines."""
    lines = files.groupBy(project, "language").agg(F.sum("loc").alias("loc"))
    first = F.max(F.struct(F.col("loc").alias("n"), F.col("language").alias("l")))
    out = lines.groupBy(project).agg(F.sum("loc").alias("loc"), first.alias("_m"))
    share = F.when(F.col("loc") > 0, F.col("_m.n") / F.col("loc")).otherwise(0.0)
    return out.select(project, "loc", F.col("_m.l").alias("primary_language"), F.col("_m.n").alias("primary_loc"), share.alias("polyglot_index"))


#: Manifest files that name a project's dependencies.
MANIFESTS = {"python": ["requirements.txt", "setup.py", "pyproject.toml"], "java": ["pom.xml", "build.gradle"], "javascript": ["package.json"], "go": ["go.mod"]}


def dependency_loc(files: DataFrame, project: str = "repo_name") -> DataFrame:
    """Lines in dependency manifests by project and language."""
    known = files.sparkSession.createDataFrame([(k, f) for k, v in MANIFESTS.items() for f in v], "language string, _name string")
    named = files.withColumn("_name", F.substring_index("path", "/", -1))
    return named.join(F.broadcast(known), ["language", "_name"]).groupBy(project, "language").agg(F.sum("loc").alias("dependency_loc"))


def project_metrics(reports: DataFrame, commits: DataFrame, loc: DataFrame) -> DataFrame:
    """Age, median year of reports, words in a report, unique reports, thousand lines per report, commits and authors by
    project."""
    median_year = F.percentile(F.year("creation_date").cast("double"), F.lit(0.5))
    per_report = reports.groupBy("repo_name").agg(median_year.alias("median_bug_year"), F.avg(X.word_count(F.col("bug_report_text")).cast("double")).alias("verbosity"), F.countDistinct("bug_id").alias("unique_bugs"))
    days = F.date_diff(F.max("committed_at"), F.min("committed_at"))
    per_commit = commits.groupBy(F.col("repo").alias("repo_name")).agg((days / 365.25).alias("age_years"), F.countDistinct("commit_sha").alias("num_commits"), F.countDistinct("author_email").alias("num_authors"))
    out = per_report.join(per_commit, "repo_name", "left").join(loc.select("repo_name", "LoC"), "repo_name", "left")
    return out.withColumn("kloc_per_bug", F.col("LoC") / 1000 / F.col("unique_bugs"))


def latest_snapshot(df: DataFrame, by: list[str], commit: str, when: str) -> DataFrame:
    """The commit of the latest report of each group; ties go to the larger commit."""
    return df.groupBy(*by).agg(F.max(F.struct(F.col(when).alias("t"), F.col(commit).alias("c"))).alias("_m")).select(*by, F.col("_m.c").alias(commit), F.col("_m.t").alias(when))


def tercile_bounds(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, low, high): the thirds of each group; null bounds where a group has no value."""
    cuts = quantiles(df, value, by, [1.0 / 3, 2.0 / 3], "_q")
    return join_on(df.select(*by).distinct(), cuts, by, "left").select(*by, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def terciles(df: DataFrame, value: str, by: list[str], name: str = "tercile") -> DataFrame:
    """small / medium / high by the group's own thirds; a value on a bound belongs below it."""
    v = F.col(value).cast("double")
    size = F.when(v.isNull(), None).when(v <= F.col("low"), "small").when(v <= F.col("high"), "medium").otherwise("high")
    return df.join(tercile_bounds(df, value, by), by).withColumn(name, size).drop("low", "high")


def impute_zero_with_group_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Zeros become the group's median, which is taken before, zeros included."""
    medians = quantiles(df, value, by, [0.5], "_q").select(*by, F.col("_q")[0].alias("_median"))
    return df.join(medians, by, "left").withColumn(value, F.when(F.col(value) == 0, F.col("_median")).otherwise(F.col(value).cast("double"))).drop("_median")


def fix_type_counts(df: DataFrame, by: list[str], bug: str, files: str, primary: str) -> DataFrame:
    """Distinct bugs by group: all, single-language, several languages, with any file of the language; bugs with several
    and single extensions; the sorted extensions of all."""
    exts = F.filter(F.transform(F.col(files), lambda f: X.file_ext(f)), lambda e: e != "no_extension")
    kind = C.fix_type(exts, F.col(primary))
    rows = df.select(*by, bug, kind.alias("_kind"), C.multi_ext_flag(exts).alias("_multi"))
    count = lambda c: F.countDistinct(F.when(c, F.col(bug)))
    sets = df.select(*by, F.explode(exts).alias("_e")).groupBy(*by).agg(F.sort_array(F.collect_set("_e")).alias("exts"))
    out = rows.groupBy(*by).agg(
        F.countDistinct(bug).alias("bugs"), count(F.col("_kind") == "mono_fix").alias("mono_fix"), count(F.col("_kind") == "poly_fix").alias("poly_fix"),
        count(F.col("_kind").isin("mono_fix", "poly_fix")).alias("mono_fix_all"), count(F.col("_multi")).alias("multi_ext"), count(~F.col("_multi")).alias("single_ext"),
    )
    return out.join(sets, by, "left")


def loss_profile(df: DataFrame, by: list[str], needed: str) -> DataFrame:
    """Rows, rows that have a value, rows lost and their percentage."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("original"), F.count(needed).alias("remaining"))
    return out.withColumn("lost", F.col("original") - F.col("remaining")).withColumn("pct_lost", F.round(100.0 * F.col("lost") / F.col("original"), 6))


def ground_truth_audit(matches: DataFrame, truth: DataFrame, commits: DataFrame, vectors: DataFrame) -> DataFrame:
    """(bug_id, n_gt, n_found, n_vectors, status): whether a report's files are in its snapshot and have vectors: full,
    partial, invalid_commit (nothing to look in), invalid_embedding (found, but none has a vector) or missing."""
    found = matches.join(vectors.select("blob_sha").distinct().withColumn("_v", F.lit(1)), "blob_sha", "left")
    per_gt = found.groupBy("bug_id", "gt").agg(F.max(F.coalesce("_v", F.lit(0))).alias("_v"))
    per_bug = per_gt.groupBy("bug_id").agg(F.count(F.lit(1)).alias("n_found"), F.sum("_v").alias("n_vectors"))
    known = commits.select("commit_sha").distinct().withColumn("_known", F.lit(True))
    base = truth.groupBy("bug_id", "commit_sha").agg(F.countDistinct("gt").alias("n_gt")).join(known, "commit_sha", "left").join(per_bug, "bug_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n_found, n_vectors = zero("n_found"), zero("n_vectors")
    status = (
        F.when(F.col("_known").isNull(), "invalid_commit").when(n_found == 0, "missing").when(n_vectors == 0, "invalid_embedding")
        .when(n_vectors == F.col("n_gt"), "full").otherwise("partial")
    )
    return base.select("bug_id", "n_gt", n_found.alias("n_found"), n_vectors.alias("n_vectors"), status.alias("status"))


def length_report(lengths: DataFrame, value: str, by: str, percents: tuple[int, ...] = tuple(range(50, 97, 2))) -> DataFrame:
    """(by, percent, value): whole-number percentiles by category, and over all as category `all`."""
    both = lengths.select(F.col(by).cast("string").alias(by), F.col(value).cast("double").alias("_v")).withColumn("_c", F.explode(F.array(F.col(by), F.lit("all"))))
    cuts = quantiles(both, "_v", ["_c"], [p / 100 for p in percents], "_q")
    spread = cuts.select(F.col("_c").alias(by), F.posexplode("_q").alias("_k", "_x"))
    return spread.select(by, F.element_at(F.array(*map(F.lit, percents)), F.col("_k") + 1).alias("percent"), F.floor(F.round("_x", 6)).cast("long").alias("value"))


def token_stats(df: DataFrame, tokens: Column, project: str, language: str) -> DataFrame:
    """Count, mean, median, population deviation, range, percentiles, a recommended size (the 90th percentile, whole) and
    the share that fits common context sizes: overall, by project and by language. Rows are expanded once, for one aggregate and
    one selection of percentiles."""
    rows = df.select(F.col(project).alias("_p"), F.col(language).alias("_l"), tokens.cast("double").alias("_n"))
    rows = rows.select("_n", F.explode(F.array(F.struct(F.lit("overall").alias("level"), F.lit("all").alias("name")), F.struct(F.lit("project").alias("level"), F.col("_p").alias("name")), F.struct(F.lit("language").alias("level"), F.col("_l").alias("name")))).alias("_g"))
    rows, n = rows.select("_g.level", "_g.name", "_n"), F.col("_n")
    out = rows.groupBy("level", "name").agg(
        F.count(n).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"), F.min(n).alias("least"), F.max(n).alias("most"),
        *[F.round(100.0 * F.avg(F.when(n <= size, 1.0).otherwise(0.0)), 6).alias(f"pct_le_{size}") for size in CONTEXT_SIZES],
    )
    found = quantiles(rows, "_n", ["level", "name"], [p / 100 for p in PERCENTILES], "_q")
    out = join_on(out, found, ["level", "name"], "left")
    cuts = [F.round(F.col("_q")[k], 6).alias(f"p{p}") for k, p in enumerate(PERCENTILES)]
    return out.select("level", "name", "n", "mean", "std", "least", "most", *cuts, F.col("_q")[PERCENTILES.index(90)].cast("int").alias("recommended"), *[f"pct_le_{s}" for s in CONTEXT_SIZES])


def vocab(tokens: DataFrame, most: int = 50_000, min_freq: int = 2, forced: tuple[str, ...] = ()) -> DataFrame:
    """(token, id, n): 0 and 1 are kept for padding and unknown tokens; forced tokens come first, sorted, then the rest
    by count and token. Counting is pre-aggregated and the table is cut to ``most`` before ids are given."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    first = sorted(set(forced))
    free = max(0, most - 2 - len(first))
    usual = counts.where((F.col("n") >= min_freq) & ~F.col("token").isin(first)) if first else counts.where(F.col("n") >= min_freq)
    usual = usual.orderBy(F.desc("n"), "token").limit(free)
    ranked = usual.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1 + len(first)).cast("int"))
    special = [("<PAD>", 0, None), ("<UNK>", 1, None)]
    fixed = tokens.sparkSession.createDataFrame([*special, *[(t, k, None) for k, t in enumerate(first, 2)]], "token string, id int, n long")
    return fixed.unionByName(ranked.select("token", "id", "n"))


#: A vocabulary of at most this many tokens is sent to every task; a larger one is joined.
SENT_TOKENS = 200_000


def encode_tokens(texts: DataFrame, table: DataFrame, max_len: int, id_col: str = "id", tokens_col: str = "tokens", sent_tokens: int = SENT_TOKENS) -> DataFrame:
    """(id, ids, length): token ids of the first ``max_len`` tokens, unknown ones 1, padded with 0; length is at least 1. The
    tokens of a row are looked up where the row is, if the vocabulary, which is counted, has at most ``sent_tokens``; else each
    token is joined to it."""
    short = texts.select(F.col(id_col).alias("id"), F.slice(F.coalesce(F.col(tokens_col), X.empty()), 1, max_len).alias("_t"))
    known = table.where("token is not null").select("token", F.col("id").cast("int").alias("_code"))
    first = known.limit(sent_tokens + 1).toArrow()
    if first.num_rows > sent_tokens:
        places = short.select("id", F.posexplode_outer("_t").alias("_at", "token")).join(known, "token", "left")
        code = F.struct("_at", F.coalesce("_code", F.lit(1)).alias("c"))
        packed = places.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), code))).alias("_all"))  # at most max_len in each
        ids = F.col("_all.c")
        return packed.select("id", X.pad_ids(ids, max_len).alias("ids"), F.greatest(F.size(ids), F.lit(1)).alias("length"))
    shared = texts.sparkSession.sparkContext.broadcast((first.column("token").combine_chunks(), first.column("_code").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, codes = shared.value
        for batch in batches:
            lists = batch.column("_t")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            place = pc.fill_null(pc.index_in(flat.cast(tokens.type), value_set=tokens), -1).to_numpy(zero_copy_only=False)
            ids = np.zeros((len(sizes), max_len), dtype=np.int32)
            row = np.repeat(np.arange(len(sizes)), sizes)
            ids[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(place >= 0, np.append(codes, 1)[place], 1)
            packed = pa.ListArray.from_arrays(np.arange(0, ids.size + 1, max_len, dtype=np.int32), ids.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed, pa.array(np.maximum(sizes, 1).astype(np.int32))], names=["id", "ids", "length"])

    return short.mapInArrow(run, f"id {short.schema['id'].dataType.simpleString()}, ids array<int>, length int")
