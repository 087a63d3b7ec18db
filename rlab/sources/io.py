"""Readers and sinks. Readers take paths of any file system that Spark opens; every schema is declared."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rlab.functions.text import safe_name
from rlab.operators.clean import to_utc
from rlab.schemas import RESULTS

DIAGNOSTICS = "bug_id string, gt_blob_sha string, faiss_rank int, model_rank int, rank_displacement int, faiss_score double, model_score double"


def read_tables(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType | str | None = None) -> DataFrame:
    """The union of named splits with their name in ``split``."""
    out = None
    for name, path in paths.items():
        part = read_tables(spark, path, schema).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=RESULTS)


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_keyed_files(spark: SparkSession, glob: str, schema: T.StructType | str, pattern: str, key: str = "repo_name", fmt: str = "csv") -> DataFrame:
    """Files whose name holds a key: the first group of ``pattern``."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(glob).withColumn(key, F.regexp_extract(file_name(), pattern, 1))


XML_REPORTS = (
    "_id string, _opendate string, _fixdate string, _resolution string, "
    "buginformation struct<summary:string,description:string,version:string,fixedVersion:string>, fixedFiles struct<file:array<string>>"
)


def read_xml_reports(spark: SparkSession, glob: str, repo: str, skip: str = "/Previous/") -> DataFrame:
    """Bug reports in XML, one row for each `bug` element; files below ``skip`` are left out; ids get the repo in front."""
    rows = spark.read.format("xml").option("rowTag", "bug").schema(XML_REPORTS).load(glob).select("*", F.col("_metadata.file_path").alias("_path"))
    info = F.col("buginformation")
    return rows.where(~F.contains("_path", F.lit(skip))).select(
        F.lit(repo).alias("repo_name"), F.concat_ws("-", F.lit(repo), "_id").alias("bug_id"), info["summary"].alias("summary"), info["description"].alias("description"),
        F.coalesce(F.col("fixedFiles.file"), F.array().cast("array<string>")).alias("fixed_files"), to_utc(F.col("_opendate"), "iso").alias("report_date"), to_utc(F.col("_fixdate"), "iso").alias("fix_date"),
        F.col("_resolution").alias("status"), info["version"].alias("version"), info["fixedVersion"].alias("fixed_version"),
    )


def read_commented_json(spark: SparkSession, glob: str) -> DataFrame:
    """(file, n): files of JSON with `#` comments; a list counts its items, an object the items of its first value."""
    text = spark.read.text(glob, wholetext=True).select(file_name().alias("file"), F.regexp_replace("value", r"(?m)#[^\n]*$", "").alias("t"))
    as_list, as_map = F.from_json("t", "array<string>"), F.from_json("t", "map<string,string>")
    first = F.from_json(F.get(F.map_values(as_map), 0), "array<string>")
    is_list = F.startswith(F.ltrim(F.regexp_replace("t", r"^\s+", "")), F.lit("["))
    return text.select("file", F.when(is_list, F.size(as_list)).otherwise(F.size(first)).alias("n"))


def read_diagnostics(spark: SparkSession, directory: str, projects: DataFrame, scenarios: list[str]) -> DataFrame:
    """Diagnostics named source_target_scenario, where names have underscores of their own: the part before the scenario
    is looked up among the joined names of all pairs of known projects, so every split point is tried at once. A name may be
    that of a file or of a folder of files."""
    rows = spark.read.csv(f"{directory}/*_diagnostics.csv", header=True, schema=DIAGNOSTICS)
    # names are taken apart once for each file; rows are looked up by the end of their path
    ends = sorted({"/".join(f.rsplit("/", 2)[1:]) for f in rows.inputFiles()})
    names = [(end, unquote(next(part for part in reversed(end.split("/")) if part.endswith("_diagnostics.csv")))) for end in ends]
    pattern = f"^(.*)_({'|'.join(scenarios)})_diagnostics\\.csv$"
    files = spark.createDataFrame(names, "_end string, _file string").select("_end", F.regexp_extract("_file", pattern, 1).alias("_pair"), F.regexp_extract("_file", pattern, 2).alias("scenario"))
    one = projects.select(F.col("repo_name").alias("source_project")).distinct()
    pairs = one.crossJoin(one.withColumnRenamed("source_project", "target_project")).withColumn("_pair", F.concat_ws("_", safe_name(F.col("source_project")), safe_name(F.col("target_project"))))
    clean = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)  # noqa: E731  -1 stands for absent
    named = F.broadcast(files.join(pairs, "_pair").drop("_pair"))
    joined = rows.withColumn("_end", F.substring_index(F.col("_metadata.file_path"), "/", -2)).join(named, "_end").drop("_end")
    return joined.select(*[clean(c) if c in ("faiss_rank", "model_rank") else F.col(c) for c in joined.columns])


def read_recall_dir(spark: SparkSession, glob: str, k: int) -> DataFrame:
    """(project, recall) at one depth from tables of one project each; the first underscore of the name is its slash."""
    rows = spark.read.csv(glob, header=True, inferSchema=False).select(F.col(f"`Recall@{k}`").cast("double").alias(f"recall_{k}"), file_name().alias("_f"))
    name = F.regexp_extract("_f", r"^(?:semantic_search_|bm25_)?(.*?)(?:_recall)?_results\.csv$", 1)
    return rows.select(F.regexp_replace(name, "^([^_]*)_", "$1/").alias("project"), f"recall_{k}")


def read_corpus_dir(spark: SparkSession, directory: str, extensions: list[str]) -> DataFrame:
    """(path, text) of all files below a directory with one of the extensions; bytes that are not UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(extensions) + "}").load(directory)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Canonical tables. Rows of one partition value are spread by AQE's rebalancing, so a hot one makes several files."""
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def diagnostics_sink(df: DataFrame) -> DataFrame:
    """Null ranks as -1, which the file format wants."""
    return df.fillna(-1, subset=[c for c in df.columns if c.endswith("_rank")])


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``. Where that is unset, a temporary one on a
    local master, which is one machine; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="rlab-")
    return f"{at.rstrip('/')}/rlab-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read from there."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Appends the rows whose key is not stored yet, one for each key; returns them. Idempotent. Writers that run at the same
    time may each store a key; ``read_appended`` gives one row for each key whatever they did."""
    spark = df.sparkSession
    new = df.dropDuplicates(key)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def read_appended(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """What ``append_new`` stored, one row for each key: of several the least by all columns, so every reader sees the same."""
    rows = spark.read.parquet(path)
    order = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min(order).alias("_row")).select("_row.*")


def one_file(df: DataFrame, path: str, fmt: str, **options) -> None:
    """Writes a small table as one file of that very name, as tools that go by file names want it."""
    spark = df.sparkSession
    parts = f"{path}.parts"
    df.coalesce(1).write.format(fmt).options(**options).save(parts)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    written = next(f.getPath() for f in files.listStatus(path_of(parts)) if f.getPath().getName().startswith("part-"))
    if not files.rename(written, path_of(path)):
        raise OSError(f"cannot name the file {path}")
    files.delete(path_of(parts), True)


def named_folders(df: DataFrame, directory: str, name: str, fmt: str, **options) -> None:
    """Writes the rows of each value of the column ``name`` as a folder of that very name. Every task writes its own rows of all
    names, so the rows are read once and none gathers those of a name."""
    spark = df.sparkSession
    staged = f"{directory}.parts"
    df.write.partitionBy(name).format(fmt).options(**options).save(staged)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path_of(directory))
    for folder in (f.getPath() for f in files.listStatus(path_of(staged)) if f.isDirectory()):
        value = unquote(folder.getName().split("=", 1)[1])
        if not files.rename(folder, path_of(path_of(directory), value)):
            raise OSError(f"cannot name the folder {value}")
    files.delete(path_of(staged), True)


def spread(table: DataFrame) -> DataFrame:
    """A table as read from files, dealt to all cores where it has fewer partitions than there are cores: one small file
    would be one task, whatever is done with its texts."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def patch_column(df: DataFrame, summary: DataFrame, keys: list[str], columns: list[str], where: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``columns`` taken from ``summary`` in the rows that match ``where``, and the number of such rows without
    a summary. Applying it twice changes nothing more."""
    side = summary.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_has"))
    joined = df.join(side, keys, "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(where, F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)))
    unmatched = joined.where(where & F.col("_has").isNull()).agg(F.count(F.lit(1)).alias("unmatched"))
    return joined.select(*df.columns), unmatched


class _Folder:
    """Names of one stored table in its file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self.files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, suffix: str = ""):
        return self._path(self.path + suffix)

    def has(self, suffix: str = "") -> bool:
        return self.files.exists(self.at(suffix))

    def move(self, suffix: str, to: str) -> None:
        if not self.files.rename(self.at(suffix), self.at(to)):
            raise OSError(f"cannot move {self.path}{suffix} to {self.path}{to}")

    def drop(self, suffix: str) -> None:
        self.files.delete(self.at(suffix), True)


class TableBusy(RuntimeError):
    """Another writer holds the table."""


def publish(df: DataFrame, path: str, rows: int | None = None) -> None:
    """Replaces the stored table at ``path``, which ``df`` may read, by two renames. The new version is written beside the old
    one and its rows are counted first (against ``rows``, where given); the old one stays until the new one has its place and is
    put back if that fails. A second writer is refused while a first one is at work: the lock is a file that only one can
    create. What a writer that died has left is cleared by ``recover``."""
    spark = df.sparkSession
    table = _Folder(spark, path)
    try:
        table.files.create(table.at(".lock"), False).close()
    except Exception as refused:
        if table.has(".lock"):
            raise TableBusy(f"{path} is being written") from refused
        raise
    try:
        table.drop(".staging")
        df.write.parquet(f"{table.path}.staging")
        written = spark.read.parquet(f"{table.path}.staging").count()
        if rows is not None and written != rows:
            raise ValueError(f"{written} rows were written, {rows} are wanted")
        _swap(table)
    finally:
        table.drop(".staging")
        table.drop(".lock")


def _swap(table: _Folder) -> None:
    old = table.has()
    if old:
        table.drop(".old")
        table.move("", ".old")
    try:
        table.move(".staging", "")
    except Exception:
        if old:
            table.move(".old", "")
        raise
    table.drop(".old")


def recover(spark: SparkSession, path: str) -> None:
    """After a writer died: puts the old version back if the table has none, and clears its lock and staging folder. To be
    called only when no writer is at work."""
    table = _Folder(spark, path)
    if not table.has() and table.has(".old"):
        table.move(".old", "")
    for suffix in (".staging", ".old", ".lock"):
        table.drop(suffix)


def patch_table(spark: SparkSession, path: str, summary: DataFrame, keys: list[str], columns: list[str], where: Column) -> int:
    """``patch_column`` on a stored table, published as a whole; the number of rows that match ``where`` without a summary. A
    summary with a key twice is refused, as it would add rows. Applying it again changes nothing."""
    if not summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        raise ValueError("the summary has a key more than once")
    table = spark.read.parquet(path)
    patched, unmatched = patch_column(table, summary, keys, columns, where)
    missing = unmatched.first()[0]
    publish(patched, path, table.count())
    spark.catalog.refreshByPath(path)
    return missing


class VectorStore:
    """Vectors by project in Parquet; a blob is stored once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def missing(self, blobs: DataFrame, key: str = "blob_sha") -> DataFrame:
        return blobs.join(self.read().select(key), key, "left_anti") if exists(self.spark, self.path) else blobs

    def write(self, vectors: DataFrame, key: str = "blob_sha", project: str = "project") -> None:
        self.missing(vectors.dropDuplicates([key]), key).write.mode("append").partitionBy(project).parquet(self.path)


def write_training_cache(samples: DataFrame, blobs: DataFrame, path: str, key: str = "blob_sha") -> DataFrame:
    """Two tables: samples, and each blob that they use once. Returns (n_samples, n_blobs, dedup_ratio)."""
    used = blobs.join(samples.select(key).distinct(), key, "left_semi").dropDuplicates([key])
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    used.write.mode("overwrite").parquet(f"{path}/blobs")
    spark = samples.sparkSession
    counts = spark.read.parquet(f"{path}/samples").agg(F.count(F.lit(1)).alias("n_samples")).crossJoin(spark.read.parquet(f"{path}/blobs").agg(F.count(F.lit(1)).alias("n_blobs")))
    return counts.withColumn("dedup_ratio", F.try_divide(F.col("n_samples"), F.col("n_blobs")))
