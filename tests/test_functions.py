"""Column functions on hand-made cases."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rlab.functions import classify as C
from rlab.functions import text as X
from rlab.functions import vectors as V


def values(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in rows.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


def test_code_tokens(spark):
    got = values(spark, ["getHTTPResponse2Json foo_bar", "", None, "a1B c-D", "éa"], X.code_tokens)
    assert got == [["get", "httpresponse2", "json", "foo", "bar"], [], [], ["a1", "b", "c", "d"], ["a"]]


def test_other_tokens(spark):
    assert values(spark, ["Foo_1 22 x9!", None], X.text_tokens) == [["foo_1", "22", "x9"], []]
    assert values(spark, ["parseXMLFile_now", None], X.subtokens) == [["parse", "x", "m", "l", "file", "now"], []]
    assert values(spark, ["ab1c de"], lambda c: X.word_tokens(c, 2)) == [["ab", "c"]]
    assert values(spark, ["ab1c de"], lambda c: X.word_tokens(c, word_chars=True)) == [["ab1c", "de"]]
    assert values(spark, ["src/my_mod.v2/File-a.py"], X.path_tokens) == [["src", "my", "mod", "v2", "file", "a", "py"]]


def test_split_report(spark):
    got = values(spark, ["Title\n\nbody\nmore", "only", "\n \n", None, "\n first \nsecond"], X.split_report)
    assert [tuple(r) for r in got] == [("Title", "body\nmore"), ("only", "only"), ("\n \n", "\n \n"), ("", ""), ("first", "second")]


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        ("basename", ["no_extension", ".gz", "no_extension", ".py", None, "no_extension"]),
        ("path", ["no_extension", ".gz", "no_extension", ".py", None, "no_extension"]),
        ("last_dot", ["gitignore", "gz", "v2/Makefile", "PY", None, None]),
    ],
)
def test_file_ext(spark, mode, want):
    assert values(spark, [".gitignore", "a.tar.gz", "dir.v2/Makefile", "x.PY", None, "LICENSE"], lambda c: X.file_ext(c, mode)) == want


def test_file_lists(spark):
    cases = ["['a.py', 'b.py']", "[broken]", "a.java b.java", "one", None, "", "[]"]
    assert values(spark, cases, X.parse_file_list) == [["a.py", "b.py"], ["[broken]"], ["a.java", "b.java"], ["one"], [], [], []]


def test_patch_paths(spark):
    patch = "--- a/old x.py\n+++ b/new.py\t\n@@\n--- a/gone.py\n+++ /dev/null\n+++ b/new.py\n"
    assert values(spark, [patch, None], X.patch_paths) == [["old x.py", "new.py", "gone.py"], []]


def test_links_names_counts(spark):
    assert values(spark, ["https://h/o/r/pull/1", None], X.repo_link) == ["https://h/o/r", ""]
    assert values(spark, [" Owner/Repo "], X.std_repo_name) == ["owner/repo"]
    assert values(spark, ["a/b/c"], X.safe_name) == ["a_b_c"]
    assert values(spark, [" a  b\nc", "", None], X.word_count) == [3, 0, 0]
    assert values(spark, ["a\nb\n", None], X.line_count) == [2, 0]


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (1, [1]), (512, [512]), (513, [512, 51]), (924, [512, 462]), (925, [512, 463, 1])])
def test_windows(spark, n, sizes):
    rows = spark.createDataFrame([(["t"] * n,)], "x array<string>")
    assert [len(w) for w in rows.select(X.overlap_windows(F.col("x"), 512, 462)).first()[0]] == sizes


def test_short_tails_are_left_out(spark):
    rows = spark.createDataFrame([(["t"] * 460,)], "x array<string>")
    assert [len(w) for w in rows.select(X.overlap_windows(F.col("x"), 450, 400, 100)).first()[0]] == [450]


def test_line_chunks(spark):
    text = "\n".join(f"l{k}" for k in range(5))
    assert values(spark, [text, " \n ", None], lambda c: X.line_chunks(c, 2)) == [["l0\nl1", "l2\nl3", "l4"], [" \n "], [""]]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a array<float>, z array<float>, b array<float>")
    out = rows.select(V.dot(F.col("a"), F.col("b")), V.l2_normalise(F.col("a")), V.l2_normalise(F.col("z")), V.cosine(F.col("a"), F.col("z")), V.cosine(F.col("a"), F.col("b"))).first()
    assert list(out) == [24.0, [0.6, 0.8], [0.0, 0.0], 0.0, 0.96]


def test_vec_mean_and_encoder(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "id int, vec array<float>")
    assert {r.id: r.vec for r in V.vec_mean(rows, ["id"], "vec").collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}
    texts = spark.createDataFrame([("a b a",), (None,), ("",)], "t string")
    out = [r.vec for r in V.encode(texts, "t", V.HashEncoder(8)).collect()]
    assert abs(sum(x * x for x in out[0]) - 1) < 1e-5 and out[1] == out[2] == [0.0] * 8


def test_classes(spark):
    assert values(spark, [0.02, 0.01, -0.01, -0.011, None], C.direction, "double") == ["positive", "neutral", "neutral", "negative", "unknown"]
    assert values(spark, [0.0, 0.001, 0.01, 0.05, None], C.stars, "double") == ["***", "**", "*", "ns", None]
    assert values(spark, [0, 1, 100_000, 100_001, 300_000, 300_001, None], C.size_bin, "long") == [None, "small", "small", "medium", "medium", "large", None]
    assert values(spark, [2018, 2019, None], C.project_age, "int") == ["mid-era", "new", "unknown"]
    assert values(spark, ["b", "a"], lambda c: C.pair_key(c, F.lit("a"))) == ["a||b", "a||a"]
    assert values(spark, [0.2, 0.19], lambda c: C.viable(F.lit("MRR"), c), "double") == [True, False]
    assert values(spark, [0.02, -0.02, 0.0], lambda c: C.joint_direction(c, F.lit(0.5)), "double") == ["positive", "negative", "mixed"]
    assert values(spark, ["a", "z"], lambda c: C.domain_type(c, F.lit("b"), ["a", "b"])) == ["within", "cross"]
    assert [tuple(r) for r in values(spark, [0.5, -0.5, 0.0], lambda c: C.agreement(c, F.lit(0.3)), "double")] == [(True, True, "both_gain"), (False, False, "disagree"), (False, False, "disagree")]
    assert values(spark, [4.0], lambda c: C.safe_ratio(c, F.lit(2.0)), "double")[0] == pytest.approx(2.0)


def test_fix_types(spark):
    cases = [[], [".py"], [".py", ".py"], [".py", ".c"], [".c"], None]
    assert values(spark, cases, lambda c: C.fix_type(c, F.lit(".py")), "array<string>") == ["invalid", "mono_fix", "mono_fix", "poly_fix", "other", "invalid"]
    assert values(spark, [["a.py", "b.c"]], lambda c: C.mono_fix_all(c, F.lit(".py"), X.file_ext), "array<string>") == [["a.py"]]
    assert values(spark, [[".a", ".a"], [".a", ".b"]], C.multi_ext_flag, "array<string>") == [False, True]


def test_languages_of_files(spark):
    assert values(spark, ["a/b.go", "x.unknown"], C.file_language) == ["go", "python"]
    assert values(spark, ["x.unknown"], lambda c: C.file_language(c, F.lit("java"))) == ["java"]
    assert values(spark, ["x.py", "x.java", "py"], lambda c: C.is_indexable(c, F.lit(10), F.lit("python"))) == [True, False, False]
    assert values(spark, ["x.py"], lambda c: C.is_indexable(c, F.lit(2_000_001), F.lit("python"))) == [False]


def test_code_tokens_by_bytes(spark):
    texts = ["", "fooBar9Baz XMLHttp", "A", "a", "B", "caf\u00e9Bar \u6f22zZ9", "aB\ncD--e", "", "zz"]
    batch = pa.array([*texts, "not Read"])
    for at in range(len(texts)):
        sizes, tokens = X.cut_code_tokens(batch.slice(at, len(texts) - at))
        want = [r.t for r in spark.createDataFrame(list(enumerate(texts[at:])), "k int, s string").select("k", X.code_tokens(F.col("s")).alias("t")).orderBy("k").collect()]
        assert sizes.tolist() == [len(w) for w in want] and tokens.to_pylist() == [w for row in want for w in row]


def test_encoder_gets_few_texts_at_a_time(spark):
    class Sizes:
        def __call__(self, texts):
            return [[len(texts), len(t or "")] for t in texts]

    texts = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") != 5, F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("t"))
    out = V.encode(texts, "t", Sizes(), normalise=False, keep_text=False)
    assert out.columns == ["id", "vec"]
    found = {r.id: r.vec for r in out.collect()}
    assert len(found) == 1000 and max(v[0] for v in found.values()) <= V.ENCODED and all(v[1] == (k if k != 5 else 0) for k, v in found.items())
    assert V.encode(texts, "t", Sizes()).select("t").count() == 1000
