"""Readers, sinks and streams on small files."""

from __future__ import annotations

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rlab.functions.vectors import HashEncoder
from rlab.operators.joins import SCENARIOS
from rlab.sources import io
from rlab.streaming import streams


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_splits_and_results(spark, tmp_path):
    for name, k in (("train", 3), ("test", 2)):
        spark.range(k).write.parquet(str(tmp_path / name))
    out = io.read_splits(spark, {n: str(tmp_path / n) for n in ("train", "test")}, "id long")
    assert {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 3, "test": 2}
    put(tmp_path / "r.csv", "model_name,source_project,target_project,scenario,top-1,top-5,top-10,MAP,MRR\nm,a/b,c,WP-small,0.1,0.2,0.3,0.4,0.5\n")
    assert io.read_results_csv(spark, str(tmp_path / "r.csv")).first().MRR == 0.5


def test_keyed_files(spark, tmp_path):
    put(tmp_path / "proj1_bugs.csv", "id,x\n1,a\n")
    put(tmp_path / "proj2_bugs.csv", "id,x\n2,b\n")
    out = io.read_keyed_files(spark, f"{tmp_path}/*_bugs.csv", "id int, x string", r"^(.*)_bugs\.csv$")
    assert {(r.repo_name, r.id) for r in out.collect()} == {("proj1", 1), ("proj2", 2)}


def test_xml_reports(spark, tmp_path):
    bug = '<bugs><bug id="7" opendate="2020-01-02 03:04:05" fixdate="x" resolution="Fixed"><buginformation><summary>s</summary><description>d</description><version>1</version><fixedVersion>2</fixedVersion></buginformation><fixedFiles><file>A.java</file><file>B.java</file></fixedFiles></bug></bugs>'
    put(tmp_path / "repo" / "r.xml", bug)
    put(tmp_path / "repo" / "Previous" / "old.xml", bug)
    rows = io.read_xml_reports(spark, f"{tmp_path}/repo/{{*.xml,Previous/*.xml}}", "HBASE").collect()
    assert len(rows) == 1 and (rows[0].bug_id, rows[0].fixed_files) == ("HBASE-7", ["A.java", "B.java"])
    assert rows[0].report_date == datetime(2020, 1, 2, 3, 4, 5) and rows[0].fix_date is None


def test_commented_json(spark, tmp_path):
    put(tmp_path / "a.json", '# head\n["x", # one\n "y"]\n')
    put(tmp_path / "b.json", '{"k": ["p", "q", "r"]} # tail\n')
    assert {r.file: r.n for r in io.read_commented_json(spark, f"{tmp_path}/*.json").collect()} == {"a.json": 2, "b.json": 3}


def test_diagnostics_names_are_split_by_known_projects(spark, tmp_path):
    head = "bug_id,gt_blob_sha,faiss_rank,model_rank,rank_displacement,faiss_score,model_score\n"
    put(tmp_path / "google_jax_open-mmlab_mmdetection_CP-transfer_diagnostics.csv", head + "1,s,-1,4,,0.5,0.6\n")
    put(tmp_path / "a_b_a_b_WP-small_diagnostics.csv", head + "2,s,3,1,2,0.5,0.6\n")
    projects = spark.createDataFrame([("google/jax",), ("open-mmlab/mmdetection",), ("a/b",)], "repo_name string")
    got = {(r.source_project, r.target_project, r.scenario, r.faiss_rank, r.model_rank) for r in io.read_diagnostics(spark, str(tmp_path), projects, SCENARIOS).collect()}
    assert got == {("google/jax", "open-mmlab/mmdetection", "CP-transfer", None, 4), ("a/b", "a/b", "WP-small", 3, 1)}
    assert io.diagnostics_sink(spark.createDataFrame([(None,)], "model_rank int")).first().model_rank == -1


def test_diagnostics_in_folders_of_many_files(spark, tmp_path):
    head = "bug_id,gt_blob_sha,faiss_rank,model_rank,rank_displacement,faiss_score,model_score\n"
    put(tmp_path / "one" / "a_b+c d_CP-transfer_diagnostics.csv", head + "1,s,2,4,,0.5,0.6\n")
    rows = spark.range(0, 400, 1, 4).select("id", F.col("id").cast("string").alias("bug_id"), F.lit("s").alias("gt_blob_sha"), *[F.col("id").cast("int").alias(c) for c in ("faiss_rank", "model_rank", "rank_displacement")], F.lit(0.5).alias("faiss_score"), F.lit(0.6).alias("model_score"))
    name = F.when(F.col("id") % 2 == 0, "a_b+c d_CP-transfer_diagnostics.csv").otherwise("b+c d_a_WP-small_diagnostics.csv")
    io.named_folders(rows.withColumn("name", name).drop("id"), str(tmp_path / "many"), "name", "csv", header=True)
    assert [len(list(f.glob("part-*"))) for f in (tmp_path / "many").iterdir() if f.is_dir()] == [4, 4]
    projects = spark.createDataFrame([("a",), ("b+c d",)], "repo_name string")
    got = {folder: sorted((r.source_project, r.scenario, r["count"]) for r in io.read_diagnostics(spark, str(tmp_path / folder), projects, SCENARIOS).groupBy("source_project", "scenario").count().collect()) for folder in ("one", "many")}
    assert got == {"one": [("a", "CP-transfer", 1)], "many": [("a", "CP-transfer", 200), ("b+c d", "WP-small", 200)]}


def test_recall_and_corpus_dirs(spark, tmp_path):
    put(tmp_path / "r" / "semantic_search_numpy_numpy_results.csv", "Recall@30,Recall@300\n0.1,0.6\n")
    assert tuple(io.read_recall_dir(spark, f"{tmp_path}/r/*.csv", 300).first()) == ("numpy/numpy", 0.6)
    put(tmp_path / "c" / "x.py", "print()")
    (tmp_path / "c" / "y.java").write_bytes(b"caf\xe9")
    put(tmp_path / "c" / "z.txt", "no")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in io.read_corpus_dir(spark, str(tmp_path / "c"), [".py", ".java"]).collect()}
    assert got["x.py"] == "print()" and got["y.java"].startswith("caf") and len(got) == 2


def test_append_patch_and_stores(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    at = str(tmp_path / "t")
    io.append_new(rows, at, ["k"])
    io.append_new(rows.unionByName(spark.createDataFrame([(3, "d")], "k int, v string")), at, ["k"])
    assert sorted(r.k for r in spark.read.parquet(at).collect()) == [1, 2, 3]
    rows.write.mode("append").parquet(at)  # a second writer that did not see the first one's rows
    assert sorted(map(tuple, io.read_appended(spark, at, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    res = spark.createDataFrame([("m", "WP-small", 0.1), ("m", "WP-large", 0.2), ("n", "WP-small", 0.3)], "model string, scenario string, MRR double")
    summary = spark.createDataFrame([("m", 0.9)], "model string, MRR double")
    once, unmatched = io.patch_column(res, summary, ["model"], ["MRR"], F.col("scenario") == "WP-small")
    twice, _ = io.patch_column(once, summary, ["model"], ["MRR"], F.col("scenario") == "WP-small")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("m", "WP-large", 0.2), ("m", "WP-small", 0.9), ("n", "WP-small", 0.3)]
    assert unmatched.first()[0] == 1
    store = io.VectorStore(spark, str(tmp_path / "v"))
    vectors = spark.createDataFrame([("b1", "p", [1.0]), ("b2", "q", [2.0])], "blob_sha string, project string, vec array<double>")
    store.write(vectors.limit(1))
    store.write(vectors)
    assert store.read().count() == 2
    samples = spark.createDataFrame([(1, "b1"), (2, "b1"), (3, "b2")], "bug_id int, blob_sha string")
    assert io.write_training_cache(samples, vectors, str(tmp_path / "cache")).first().dedup_ratio == 1.5
    io.write_parquet(vectors, str(tmp_path / "p"), ["project"])
    io.write_csv(samples, str(tmp_path / "csv"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3


@pytest.fixture
def events(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "id int, model string, ts timestamp_ntz, value double"
    one = [(k, "ab"[k % 2], start + timedelta(hours=k), float(k)) for k in range(60)]
    two = [(k, "ab"[k % 2], start + timedelta(hours=k), float(k)) for k in range(50, 150)]
    spark.createDataFrame(one, schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame(two, schema).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    return schema, f"{tmp_path}/in/*"


def test_stream_results_keep_one_row_for_each_key(spark, tmp_path, events):
    schema, path = events
    for _ in range(2):  # the second run finds nothing new
        streams.stream_results(streams.read_stream(spark, path, schema, 1), ["id"], "ts", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(150))


def test_of_rows_of_a_key_the_least_wins(spark, tmp_path):
    schema = "id int, key string, ts timestamp_ntz, value double"
    day = datetime(2024, 1, 1)
    rows = [(4, "a", day + timedelta(hours=2), 1.0), (3, "a", day + timedelta(hours=1), 9.0), (2, "a", day + timedelta(hours=1), 5.0), (2, "a", day + timedelta(hours=1), 4.0), (1, "b", day, None)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(0, "a", day - timedelta(hours=9), 0.0), (7, "c", day, 7.0)], schema).coalesce(1).write.parquet(str(tmp_path / "later"))
    for k, folder in enumerate(("in", "later")):  # an earlier row that comes later does not replace what is stored
        streams.stream_results(streams.read_stream(spark, str(tmp_path / folder), schema), ["key"], "ts", str(tmp_path / "out"), str(tmp_path / f"cp{k}"), ["id"]).awaitTermination()
    assert sorted((r.key, r.id, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2, 4.0), ("b", 1, None), ("c", 7, 7.0)]


def test_stream_scores_equal_the_batch_answer(spark, tmp_path, events):
    schema, path = events
    out = streams.run_available(streams.stream_scores(streams.read_stream(spark, path, schema), "ts", "value", ["model"], "0 seconds"), str(tmp_path / "w"), str(tmp_path / "cp2"))
    batch = streams.window_scores(spark.read.schema(schema).parquet(path), "ts", "value", ["model"])
    closed = batch.where("window_start < '2024-01-07'")  # the last day's window stays open
    assert sorted(map(tuple, out.select(F.col("window_start").cast("string"), "model", "mean", "n").collect())) == sorted(map(tuple, closed.select(F.col("window_start").cast("string"), "model", "mean", "n").collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    """The watermark that drops rows is one batch behind the one that closes windows."""
    schema = "id int, ts timestamp_ntz, value double"
    day = datetime(2024, 1, 1)
    for k, (at, value) in enumerate([(day, 1.0), (day + timedelta(days=9), 2.0), (day + timedelta(days=10), 2.0), (day + timedelta(hours=1), 100.0), (day + timedelta(days=20), 3.0)]):
        spark.createDataFrame([(k, at, value)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    out = streams.run_available(streams.stream_scores(streams.read_stream(spark, f"{tmp_path}/in/*", schema, 1), "ts", "value", [], "1 day"), str(tmp_path / "o"), str(tmp_path / "c"))
    first = out.where("window_start = '2024-01-01'").first()
    assert first.n == 1 and first["mean"] == 1.0


def test_stream_encode_encodes_new_blobs_once(spark, tmp_path):
    schema = "blob_sha string, project string, text string"
    spark.createDataFrame([("x", "p", "one two"), ("x", "p", "one two"), ("y", "p", "three")], schema).write.parquet(str(tmp_path / "in"))
    store = io.VectorStore(spark, str(tmp_path / "store"))
    for n in range(2):
        streams.stream_encode(streams.read_stream(spark, str(tmp_path / "in"), schema), HashEncoder(4), store, str(tmp_path / f"cp{n}")).awaitTermination()
    assert sorted(r.blob_sha for r in store.read().collect()) == ["x", "y"]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        io.scratch_dir(Session, "x")
    Context.master = "local[4]"
    assert io.scratch_dir(Session, "x").startswith(f"file://{tempfile.gettempdir()}")


@pytest.fixture
def results(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    spark.createDataFrame([("a", "s", 1.0), ("a", "t", 2.0), ("b", "s", 3.0), ("c", "s", 4.0)], "model string, scenario string, MRR double").write.parquet(path)
    return path


def stored_rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).collect())


def test_patched_table_is_published_as_a_whole(spark, results, tmp_path):
    summary = spark.createDataFrame([("a", 9.0), ("b", None)], "model string, MRR double")
    for _ in range(2):
        assert io.patch_table(spark, results, summary, ["model"], ["MRR"], F.col("scenario") == "s") == 1
        assert stored_rows(spark, results) == [("a", "s", 9.0), ("a", "t", 2.0), ("b", "s", 3.0), ("c", "s", 4.0)]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("results")] == ["results"]
    with pytest.raises(ValueError, match="more than once"):
        io.patch_table(spark, results, summary.union(summary), ["model"], ["MRR"], F.lit(True))


@pytest.mark.parametrize("fails", ["write", "count", "first rename", "second rename"])
def test_a_failed_patch_leaves_the_old_table(spark, results, tmp_path, monkeypatch, fails):
    before = stored_rows(spark, results)
    move = io._Folder.move

    def broken(self, suffix, to):
        if (fails, suffix) in (("first rename", ""), ("second rename", ".staging")):
            raise OSError("lost")
        move(self, suffix, to)

    monkeypatch.setattr(io._Folder, "move", broken)
    new = spark.createDataFrame([("z", "s", 0.0)], "model string, scenario string, MRR double")
    if fails == "write":
        new = new.withColumn("MRR", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost|wanted"):
        io.publish(new, results, 2 if fails == "count" else None)
    assert stored_rows(spark, results) == before
    monkeypatch.undo()
    io.publish(spark.createDataFrame([("z", "s", 0.0)], "model string, scenario string, MRR double"), results, 1)
    assert stored_rows(spark, results) == [("z", "s", 0.0)]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("results")] == ["results"]


def test_a_second_writer_is_refused_and_a_dead_one_cleared(spark, results):
    folder = io._Folder(spark, results)
    before = stored_rows(spark, results)
    folder.files.create(folder.at(".lock"), False).close()
    with pytest.raises(io.TableBusy):
        io.publish(spark.read.parquet(results), results)
    folder.move("", ".old")  # it died between the renames
    io.recover(spark, results)
    assert stored_rows(spark, results) == before
    io.publish(spark.read.parquet(results).where("model = 'a'"), results, 2)
    assert len(stored_rows(spark, results)) == 2
