"""Operators on hand-made frames with known answers."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rlab.functions import text as X
from rlab.functions import vectors as V
from rlab.operators import clean as L
from rlab.operators import compare as C
from rlab.operators import joins as J
from rlab.operators import metrics as M
from rlab.operators import profile as P
from rlab.operators import rank as K
from rlab.operators import retrieve as R
from rlab.operators import samples as S
from rlab.operators import stats as T
from rlab.operators.kbest import KBest
from rlab.plans import retrieval_queries


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.fixture
def ranking(spark):
    ranked = spark.createDataFrame([(1, k, 10.0 - k) for k in range(1, 5)] + [(2, 1, 1.0), (2, 2, 1.0), (3, 9, 5.0)], "query_id int, item_id int, score double")
    truth = spark.createDataFrame([(1, 1), (1, 3), (1, 99), (2, 2), (5, 1)], "query_id int, item_id int")
    queries = spark.createDataFrame([(q,) for q in (1, 2, 3, 4, 5)], "query_id int")
    return K.rank_candidates(ranked), truth, queries


def test_scorers_share_the_postings_of_query_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alphaBeta gamma gamma"), (3, "delta"), (4, None)], "item_id long, text string").withColumn("tokens", X.code_tokens(F.col("text")))
    asked = spark.createDataFrame([(7, ["alpha", "gamma", "gamma"]), (8, ["beta", "none"])], "query_id long, tokens array<string>")
    posted = R.postings(docs, text="text")
    assert sorted(map(tuple, posted.collect())) == sorted(map(tuple, R.postings(docs).collect()))
    shared = R.query_postings(asked, docs, posted=posted)
    assert shared[1].select("code").distinct().count() == 3 and shared[1].count() == 5  # delta is no query term
    for how in ({}, {"k1": 0.9, "b": 0.4}):
        assert R.bm25_topk(asked, docs, 3, shared=shared, **how).orderBy("query_id", "rank").collect() == R.bm25_topk(asked, docs, 3, **how).orderBy("query_id", "rank").collect()


def test_ground_truth_is_found_once(spark):
    docs = spark.createDataFrame([(1, "a bc d"), (2, "x a bc d y"), (3, "bc")], "item_id int, text string")
    found = R.containing(spark.createDataFrame([(5, "a bc d"), (6, "bc")], "query_id int, text string"), docs)
    assert sorted(map(tuple, found.collect())) == [(5, 1), (5, 2), (6, 1), (6, 2), (6, 3)]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # each reader would search again


def test_metrics_by_hand(ranking):
    got = M.ranking_metrics(*ranking).first()
    assert (got.n_queries, got.n_with_gt) == (5, 3)
    assert got.top_1 == pytest.approx(1 / 5) and got.top_5 == pytest.approx(2 / 5)
    assert got.mrr == pytest.approx((1 + 1 / 2) / 5)
    assert got.map == pytest.approx(((1 + 2 / 3) / 2 + 1 / 2) / 5)


def test_metrics_that_skip_queries_without_truth(ranking):
    got = M.ranking_metrics(*ranking, skip_no_gt=True).first()
    assert got.mrr == pytest.approx(1.5 / 3) and got.top_1 == pytest.approx(1 / 5)


def test_metrics_do_not_depend_on_partitions_and_keep_their_bound(ranking):
    ranked, truth, queries = ranking
    one, two = (M.ranking_metrics(ranked.repartition(n), truth.repartition(n), queries.repartition(n)).first() for n in (1, 5))
    assert one == two
    assert one.mrr <= one.top_1 + (one.top_5 - one.top_1) / 2 + (one.top_10 - one.top_5) / 6 + (1 - one.top_10) / 11


def test_recall_is_monotone_and_counts_failures(ranking):
    got = {r.k: r for r in R.recall_at_k(*ranking, [1, 2, 10]).collect()}
    assert [got[k].recall for k in (1, 2, 10)] == sorted(got[k].recall for k in (1, 2, 10))
    assert got[10].valid == 3 and got[10].hits == 2
    assert R.recall_at_k(*ranking, [10], denominator="all").first().valid == 5


def test_pool_and_displacement(ranking):
    ranked, truth, queries = ranking
    pool = ranked.where("item_id in (3, 4, 2)")
    assert rows(K.restrict_to_pool(ranked, pool).where("query_id = 1"), "item_id", "rank") == [(2, 1), (3, 2), (4, 3)]
    model = K.rank_candidates(ranked.select("query_id", "item_id", (-F.col("score")).alias("score")))
    assert rows(K.rank_displacement(ranked, model).where("query_id = 1"), "item_id", "displacement") == [(1, -3), (2, -1), (3, 1), (4, 3)]
    diagnostics = M.rank_diagnostics(ranked, model, truth)
    ceiling = M.ceiling(diagnostics, [], 3).first()
    assert ceiling.n_rows == 5 and ceiling.share_unreachable == pytest.approx(2 / 5) and ceiling.mean_displacement == pytest.approx(-2 / 3)
    assert M.rank_summary(diagnostics, []).first().n_queries == 3
    assert M.displacement_stats(diagnostics, []).first().n == 3
    scopes = {r.scope: r for r in M.dual_eval(ranked, pool, truth, queries).collect()}
    assert scopes["pool"].gt_in_pool == 2 and scopes["pool"].map > scopes["full"].map


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["c"]), (4, [])], "item_id int, tokens array<string>")
    asked = spark.createDataFrame([(7, ["a", "a", "x"]), (8, ["c"])], "query_id int, tokens array<string>")
    got = {(r.query_id, r.item_id): r.score for r in R.bm25_topk(asked, docs, 5).collect()}
    idf = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in {"a": 1, "b": 2, "c": 2}.items()}
    weight = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 1.5))
    assert got == pytest.approx({(7, 1): 2 * weight("a", 2, 3), (8, 2): weight("c", 1, 2), (8, 3): weight("c", 1, 1)}, abs=1e-8)


def test_bm25_topk_is_the_top_of_all_scores(spark, monkeypatch):
    import random

    rng = random.Random(9)
    docs = spark.createDataFrame([("su"[k % 2], f"i{k}", rng.choices("abcdefgh", k=rng.randint(0, 30))) for k in range(120)], "snap string, item_id string, tokens array<string>").repartition(6)
    asked = spark.createDataFrame([("su"[k % 2], k, rng.choices("abchxyz", k=rng.randint(0, 5))) for k in range(9)], "snap string, query_id int, tokens array<string>")
    for by in (None, ["snap"]):
        want = {}
        for r in R.bm25_scores(asked, docs, by).collect():
            want.setdefault(r.query_id, []).append((-round(r.score, 9), r.item_id, r.n_terms))
        want = {(q, k): (i, n) for q, rows_ in want.items() for k, (_, i, n) in enumerate(sorted(rows_)[:7], 1)}
        for cells, block in ((4_000_000, 32 << 20), (20, 300)):
            monkeypatch.setattr(R, "BLOCK_BYTES", block)
            monkeypatch.setattr(R, "CELLS", cells)
            assert {(r.query_id, r["rank"]): (r.item_id, r.n_terms) for r in R.bm25_topk(asked, docs, 7, by).collect()} == want


def test_bm25_inside_snapshots_and_negative_idf(spark):
    docs = spark.createDataFrame([("s", k, ["a", f"t{k}"]) for k in range(4)] + [("u", 9, ["a"])], "snap string, item_id int, tokens array<string>")
    asked = spark.createDataFrame([("s", 1, ["a"]), ("u", 2, ["t1"])], "snap string, query_id int, tokens array<string>")
    got = R.bm25_scores(asked, docs, ["snap"]).collect()
    assert {(r.query_id, r.item_id) for r in got} == {(1, k) for k in range(4)}
    mean = (math.log(0.5) - math.log(4.5) + 4 * (math.log(3.5) - math.log(1.5))) / 5
    assert got[0].score == pytest.approx(0.25 * mean)


def test_cosine_topk_both_ways(spark, monkeypatch):
    vectors = spark.createDataFrame([(k, [float(k % 5), 1.0, float(k % 3)], k % 2) for k in range(60)], "item_id int, vec array<float>, snap int").repartition(4)
    asked = vectors.where("item_id < 6").select(F.col("item_id").alias("query_id"), "vec", "snap")
    got = {(r.query_id, r["rank"]): r.item_id for r in R.cosine_topk(asked, vectors, 7).collect()}
    import numpy as np

    data = [(r.item_id, np.array(r.vec)) for r in vectors.collect()]
    for q, v in data:
        if q < 6:
            want = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), i) for i, w in data)[:7]
            assert [got[q, k] for k in range(1, 8)] == [i for _, i in want]
    for sizes in ({}, {"part_rows": 7, "query_rows": 2}):
        inside = {(r.query_id, r["rank"]): r.item_id for r in R.cosine_topk_by(asked, vectors, "snap", 3, **sizes).collect()}
        for q, v in data:
            if q < 6:
                want = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), i) for i, w in data if i % 2 == q % 2)[:3]
                assert [inside[q, k] for k in range(1, 4)] == [i for _, i in want]
    monkeypatch.setattr(R, "BLOCK_BYTES", 50)
    assert {(r.query_id, r["rank"]): r.item_id for r in R.cosine_topk(asked, vectors, 7).collect()} == got
    own = R.cosine_topk(asked, vectors, 7, exclude_self=True).collect()
    assert len(own) == 42 and all(r.query_id != r.item_id for r in own)


def test_passages_are_found_wherever_they_stand(spark):
    texts = ["x the quick brown fox y", "the quick brown fox", "prethe quick brown foxpost", "the quick  brown fox", "quick", "a\tb\nc d", None, "", "the slow brown fox", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[1])], "item_id int, text string").repartition(3)
    asked = ["the quick brown fox", "quick", "uick brow", " quick ", "a\tb\nc", "b", "", None, "  ", "brown fox", "e quick brown f", "nothing of this kind"]
    got = {(r.query_id, r.item_id) for r in R.containing(spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), docs).collect()}
    assert got == {(q, i) for q, p in enumerate(asked) for i, t in enumerate(texts) if p and t and p in t}


def test_best_chunks_in_small_batches(spark):
    import random

    import numpy as np

    rng = random.Random(2)
    data = [(rng.randrange(30), [rng.uniform(-1, 1) for _ in range(4)]) for _ in range(300)]
    chunks = spark.createDataFrame(data, "item_id int, vec array<double>").repartition(8)
    asked = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(5)]
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in R.chunk_max_sim(spark.createDataFrame(asked, "query_id int, vec array<double>"), chunks, 4).collect()}
    for q, v in asked:
        best = {}
        for i, w in data:
            best[i] = max(best.get(i, -2.0), cos(v, w))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert [got[q, k][0] for k in range(1, 5)] == [i for i, _ in want]


def test_gap_and_similarity_of_projects(spark):
    import random

    rng = random.Random(5)
    rows_ = [(k, k % 3, [rng.gauss(3.0 if k % 3 == 2 else 0.0, 1.0), rng.gauss(0, 1)]) for k in range(600)]
    vectors = spark.createDataFrame(rows_, "id int, project int, vec array<double>")
    gaps = {(r.project_a, r.project_b): r for r in R.domain_gap(vectors, "project", "id", limit=100).collect()}
    assert set(gaps) == {(0, 1), (0, 2), (1, 2)} and all((r.n_a, r.n_b) == (200, 200) for r in gaps.values())
    assert gaps[0, 2].domain_gap_accuracy > 0.85 and gaps[1, 2].domain_gap_accuracy > 0.85 and gaps[0, 1].domain_gap_accuracy < 0.7
    pairs = {(r.project_a, r.project_b): (r.n_a, r.n_b) for r in R.pair_similarity(vectors, "project", "id", limit=50).collect()}
    assert pairs == {k: (50, 50) for k in gaps}


def test_retrieval_pieces(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vec array<double>")
    chunks = spark.createDataFrame([(5, [0.0, 1.0]), (5, [1.0, 1.0]), (6, [0.0, 0.0])], "item_id int, vec array<double>")
    assert {r.item_id: round(r.score, 6) for r in R.chunk_max_sim(q, chunks, 2).collect()} == {5: 0.707107, 6: 0.0}
    reports = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0])], "query_id int, summary_vec array<double>, description_vec array<double>")
    functions = spark.createDataFrame([(5, 0, [1.0, 0.0]), (5, 1, [0.0, 1.0]), (5, 99, [9.0, 9.0])], "item_id int, fn_no int, vec array<double>")
    got = {r.item_id: [round(x, 4) for x in (r.f1, r.f2, r.f3, r.f4)] for r in R.function_features(reports, functions, spark.createDataFrame([(1, 5), (1, 6)], "query_id int, item_id int")).collect()}
    assert got == {5: [1.0, 0.5, 1.0, 0.5], 6: [0.0] * 4}
    tokens = spark.createDataFrame([(1, "known"), (1, "fooBar"), (2, "zzz")], "id int, token string")
    table = spark.createDataFrame([("known", [1.0, 1.0]), ("foo", [2.0, 0.0]), ("bar", [0.0, 4.0])], "word string, vec array<double>")
    assert {r.id: r.vec for r in R.word_vector_pool(tokens, table).collect()} == {1: [1.0, 1.5], 2: [0.0, 0.0]}
    ids = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id int, vec array<double>")
    assert R.similarity_matrix(ids, ids).count() == 4


def test_ranking_features_of_whole_texts(spark, tmp_path):
    passage = "needle words\nstand near the end"
    filler = [f"line {k} of many" for k in range(200)]
    texts = {1: [*filler, "stand near the end", *[""] * 4, "needle words"], 2: ["needle words", *filler[:30]], 3: filler[:7], 4: [*filler, " ", "the needle"]}
    spark.createDataFrame([(k, "\n".join(lines)) for k, lines in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    enc = V.HashEncoder()
    asked, want = enc(passage.split("\n")), {}
    for k in (1, 2, 4):
        chunks = enc(["\n".join(texts[k][at : at + 5]) for at in range(0, len(texts[k]), 5)])
        cosines = [chunks @ a / (np.linalg.norm(chunks, axis=1) * np.linalg.norm(a)) for a in asked]
        want[k] = [float(f(c)) for c in cosines for f in (np.max, np.mean)]
    got = {r.item_id: [r.f1, r.f2, r.f3, r.f4] for r in retrieval_queries.rank_features(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert got[1][0] == pytest.approx(1, abs=1e-6) and got[1][2] == pytest.approx(1, abs=1e-6)  # chunks 41 and 42


def test_function_features_of_any_number_of_functions(spark):
    reports = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 0.0])], "query_id int, summary_vec array<double>, description_vec array<double>")
    functions = spark.createDataFrame([(5, [0.0, 1.0])] * 39 + [(5, [2.0, 0.0])], "item_id int, vec array<double>")
    got = R.function_features(reports, functions, spark.createDataFrame([(1, 5), (1, 6)], "query_id int, item_id int"), most=None)
    assert {r.item_id: [round(x, 4) for x in (r.f1, r.f2, r.f3, r.f4)] for r in got.collect()} == {5: [1.0, 0.025, 0.0, 0.0], 6: [0.0] * 4}


def test_ground_truth_matches_at_path_boundaries(spark):
    truth = spark.createDataFrame([("b", "c", "utils.py")], "bug_id string, commit_sha string, gt string")
    snap = spark.createDataFrame([("c", "src/utils.py"), ("c", "xutils.py"), ("c", "a/utils.py"), ("d", "utils.py")], "commit_sha string, path string")
    assert rows(J.match_ground_truth(truth, snap), "path") == [("a/utils.py",), ("src/utils.py",)]
    assert rows(J.match_ground_truth(truth, snap, "first"), "path") == [("a/utils.py",)]
    assert J.match_ground_truth(truth, snap, loose=True).count() == 3


@pytest.mark.parametrize("unit", ["month", "year"])
def test_asof(spark, unit):
    at = lambda d, h=0: datetime(2024, 1 + d // 28, 1 + d % 28, h)
    left = spark.createDataFrame([("r", 1, at(0)), ("r", 2, at(5)), ("r", 3, at(60)), ("q", 4, at(5))], "repo string, id int, t timestamp")
    right = spark.createDataFrame([("r", "a", at(5)), ("r", "b", at(5)), ("r", "c", at(30)), ("r", "d", at(90))], "repo string, sha string, at timestamp")
    assert rows(J.asof_latest(left, right, "repo", "t", "at", "sha", unit), "id", "sha") == [(1, None), (2, "b"), (3, "c"), (4, None)]


def test_dedup_levels(spark):
    data = [
        (1, "u1", "s1", "1", "r", "text a"), (2, "u1", "s2", "2", "r", "text b"), (3, "u2", "s1", "3", "r", "text c"), (4, None, "s9", "1", "r", "text d"),
        (5, "u9", None, "7", "r", "text e"), (6, None, None, "7", "r", "text f"), (7, None, None, None, "r", "text e"), (8, None, None, None, "q", "text e"), (9, None, None, None, "q", "text e"),
    ]
    df = spark.createDataFrame(data, "arrival int, fix_url string, fix_commit_sha string, bug_id string, repo_name string, bug_report_text string")
    assert rows(L.dedupe_hierarchical(df), "arrival") == [(1,), (5,), (8,)]


def test_canonical_sources(spark):
    swe = spark.createDataFrame([("A/B ", "x-1", "problem", None, "--- a/f.py\n+++ b/f.py\n", "2024-01-02", "sha")], "repo string, instance_id string, problem_statement string, hints_text string, patch string, created_at string, base_commit string")
    b4bl = spark.createDataFrame([("r", "1", "text", ["F.java"], "bad date", "2020-01-01", "s", "v", "f", "sha", "java")], "repo_name string, bug_id string, bug_report string, fixed_files array<string>, report_date string, fix_date string, status string, version string, fixed_version string, before_fix_sha string, language string")
    out = {r.source_dataset: r for r in L.union_sources(L.canonicalise_swe(swe), L.canonicalise_b4bl(b4bl)).collect()}
    assert (out["swe"].repo_name, out["swe"].ground_truth_files, out["swe"].bug_report_text) == ("a/b", ["f.py"], "problem\n")
    assert out["b4bl"].creation_date is None and out["b4bl"].fix_date == datetime(2020, 1, 1)
    lca = spark.createDataFrame([("Own", "Rep", "7", None, "p", "t", "b", "['x.py']", "{'.py': 1}", "2024-01-01", "s", "h", "python")], "repo_owner string, repo_name string, id string, issue_url string, pull_url string, issue_title string, issue_body string, changed_files string, changed_files_exts string, pull_create_at string, base_sha string, head_sha string, repo_language string")
    assert L.canonicalise_lca(lca).first().repo_name == "own/rep"
    assert P.ext_keys(lca, "changed_files_exts", ["repo_language"]).first().ext == ".py"


def test_profiles(spark):
    files = spark.createDataFrame([("r", "python", "a.py", 30), ("r", "python", "requirements.txt", 5), ("r", "c", "b.c", 15), ("s", "go", "x.go", 0)], "repo_name string, language string, path string, loc int")
    got = {r.repo_name: r for r in P.loc_profile(files).collect()}
    assert got["r"].primary_language == "python" and got["r"].polyglot_index == pytest.approx(0.7) and got["s"].polyglot_index == 0.0
    assert rows(P.dependency_loc(files)) == [("r", "python", 5)]
    assert P.grand_totals(P.dup_profile(files, "path", ["language"])).first().reports == 4
    assert P.distinct_profile(files, ["repo_name", "language"]).first().asDict() == {"distinct_repo_name": 2, "distinct_language": 3}
    assert [r.n for r in P.value_counts(files, "repo_name").collect()] == [3, 1]
    table = P.vocab(spark.createDataFrame([(t,) for t in "b b a a c".split()], "token string"), 10, 2, ("z",))
    assert rows(table, "token", "id") == [("<PAD>", 0), ("<UNK>", 1), ("a", 3), ("b", 4), ("z", 2)]
    enc = P.encode_tokens(spark.createDataFrame([(1, ["a", "q"]), (2, []), (3, None)], "id int, tokens array<string>"), table, 3)
    assert rows(enc) == [(1, [3, 1, 0], 2), (2, [0, 0, 0], 1), (3, [0, 0, 0], 1)]


def test_training_tables(spark):
    ids = spark.createDataFrame([(k,) for k in range(50)], "id int")
    one, two = (rows(S.split_ids(d, "id", validation=0.2)) for d in (ids, ids.repartition(7)))
    assert one == two and [sum(r[1] == s for r in one) for s in ("test", "validation", "train")] == [10, 8, 32]
    with pytest.raises(ValueError, match="at least"):
        S.split_ids(ids.limit(9), "id")
    pos = spark.createDataFrame([(1, k) for k in range(3)], "query_id int, item_id int")
    neg = spark.createDataFrame([(1, k) for k in range(10, 30)] + [(2, 5)], "query_id int, item_id int")
    got = S.triplets(pos, neg, 10).collect()
    assert len(got) == 10 and {r.pos for r in got} == {0, 1, 2}
    functions = spark.createDataFrame([(k, f) for k in range(30) for f in range(8)], "item_id int, fn_no int")
    pairs = S.finetune_pairs(pos, neg, functions).collect()
    assert sum(r.label for r in pairs) == 15 and len({r.item_id for r in pairs if not r.label and r.query_id == 1}) == 15
    tree = S.dir_tree(spark.createDataFrame([("c", "a/b/x.py"), ("c", "a/y.py")], "commit_sha string, path string"))
    assert rows(tree, "path", "parent", "is_leaf") == [("a", "", False), ("a/b", "a", False), ("a/b/x.py", "a/b", True), ("a/y.py", "a", True)]
    assert rows(S.children(tree), "path", "children") == [("", ["a"]), ("a", ["a/b", "a/y.py"]), ("a/b", ["a/b/x.py"])]
    grid = S.token_grid(spark.createDataFrame([(1, "a b\nc"), (1, "a b\nc")], "id int, text string"), P.vocab(spark.createDataFrame([("a",), ("a",)], "token string")), 5, 2)
    assert rows(grid) == [(1, 0, [2, 1]), (1, 1, [1, 0])]


def deltas(spark, values, model="m"):
    return spark.createDataFrame([(model, k, k % 3, float(v)) for k, v in enumerate(values)], "model_name string, source_project int, target_project int, delta double")


def test_signed_ranks_by_hand(spark):
    df = deltas(spark, [1, -2, 3, 3, 0])
    w = T.signed_ranks(df, ["model_name"], "wilcox").first()
    assert (w.n, w.w_plus, w.w_minus) == (4, 1 + 3.5 * 2, 2)
    z = T.signed_ranks(df, ["model_name"], "zsplit").first()
    assert (z.n, z.n_zero, z.w_plus, z.w_minus) == (5, 1, 2 + 4.5 * 2 + 0.5, 3 + 0.5) and z.w_plus + z.w_minus == 15
    assert T.rank_biserial(df, ["model_name"]).first().rank_biserial == pytest.approx(0.6)
    n = 5
    variance = n * (n + 1) * (2 * n + 1) / 24 - (2**3 - 2) / 48
    p = T.wilcoxon(df, ["model_name"]).first().p
    assert p == pytest.approx(0.5 * math.erfc((11.5 - 7.5) / math.sqrt(variance) / math.sqrt(2)))
    assert T.wilcoxon(deltas(spark, [1, 2, 3]), ["model_name"]).first().p is None
    same = T.tost(deltas(spark, [0.001, -0.002, 0.003, -0.001, 0.002, 0.0015]), ["model_name"]).first()
    assert same.equivalent and same.p < 0.05


def test_effect_sizes_and_correlations(spark):
    assert T.cohens_dz(deltas(spark, [1, 2, 3]), ["model_name"]).first().dz == pytest.approx(2.0)
    assert T.cohens_dz(deltas(spark, [1, 1]), ["model_name"]).first().dz is None
    assert T.cohens_dz(deltas(spark, [1]), ["model_name"]).first().dz is None
    xy = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 1.0, "b"), (3.0, 4.0, "c"), (4.0, 3.0, "d"), (5.0, 5.0, "e"), (None, 9.0, "f")], "x double, y double, i string")
    r = T.spearman(xy, "x", "y", []).first()
    assert (r.n, r.rho) == (5, pytest.approx(0.8)) and r.p == pytest.approx(0.104088, abs=1e-5)
    assert T.kendall_tau(xy, "x", "y", []).first().tau == pytest.approx(0.6)
    line = T.ols_line(xy, "x", "y", []).first()
    assert line.slope == pytest.approx(0.8) and line.intercept == pytest.approx(0.6)
    assert T.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and T.t_two_sided(0.0, 4) == pytest.approx(1.0)
    ci = T.bootstrap_ci(deltas(spark, [1, 2, 3, 2, 1, 2, 3, 2]), ["model_name"], 500).first()
    assert ci.low < 2 / 0.755929 < ci.high


def test_icc_by_hand(spark):
    df = spark.createDataFrame([("m", g, v) for g, vs in enumerate([[1.0, 2.0], [5.0, 6.0], [9.0, 10.0]]) for v in vs], "model_name string, target_project int, delta double")
    r = T.random_intercept(df, "target_project", ["model_name"]).first()
    assert (r.var_within, r.var_between) == (pytest.approx(0.5), pytest.approx((32 - 0.5) / 2)) and r.icc == pytest.approx(15.75 / 16.25)


def test_gain_summary_and_grids(spark):
    g = C.gain_summary(deltas(spark, [0.2, 0.4, -0.1, 0.0]), ["model_name"]).first()
    assert (g.n, g.wins, g.losses, g.win_rate) == (4, 2, 1, 0.5) and g.asymmetry == pytest.approx(3.0)
    res = spark.createDataFrame([("m", s, t, sc, 0.1 * (s + 2 * t + k)) for s in range(3) for t in range(3) for k, sc in enumerate(J.SCENARIOS[:2] + ["CP-transfer"])], "model_name string, source_project int, target_project int, scenario string, MRR double")
    means = C.scenario_means(res, ["MRR"])
    assert means.where("scenario = 'CP-cold-start'").first().n == 0
    back = J.reverse_pairs(res)
    assert back.count() == 9 and back.where("asymmetry < 0.09").count() == 0
    assert J.project_pairs(spark.createDataFrame([(k,) for k in range(4)], "repo_name int")).count() == 6
    ranked = T.rank_sources(res.where("scenario = 'CP-transfer'").withColumns({"b": F.col("source_project"), "l": F.col("source_project"), "g": -F.col("source_project")}), ["target_project"], "MRR", "b", "l", "g")
    assert all(r.composite_hit and r.composite_tau == pytest.approx(1.0) and r.oracle == r.composite_score for r in ranked.collect())
    assert T.source_ranking_means(ranked).first().targets == 3
    assert K.best_by(res, ["target_project"], "source_project", "MRR").where("best_source_project <> 2").count() == 0


def test_quartiles_and_terciles(spark):
    df = spark.createDataFrame([("g", k) for k in range(1, 10)], "grp string, v int")
    assert [r.quartile for r in K.quartile_bins(df, "v").orderBy("v").collect()] == [1, 1, 1, 2, 2, 3, 3, 4, 4]
    flat = spark.createDataFrame([(5,)] * 4 + [(6,)], "v int")
    assert {r.quartile for r in K.quartile_bins(flat, "v").collect()} == {1}
    assert [r.tercile for r in P.terciles(df, "v", ["grp"]).orderBy("v").collect()] == ["small"] * 3 + ["medium"] * 3 + ["high"] * 3
    zeros = spark.createDataFrame([("g", 0.0), ("g", 2.0), ("g", 4.0)], "grp string, v double")
    assert rows(P.impute_zero_with_group_median(zeros, "v", ["grp"]), "v") == [(2.0,), (2.0,), (4.0,)]


@pytest.mark.parametrize("held", [0, 7, 10**6])
@pytest.mark.parametrize("once", [False, True])
def test_running_lists_are_the_best_of_all(held, once):
    import random

    import numpy as np

    rng = random.Random(held)
    offers = [(rng.randrange(6), float(rng.randrange(12)), f"i{rng.randrange(15)}" if once else f"i{k}") for k in range(400)]
    best = KBest(7, 5, once, held)
    for at in range(0, len(offers), 40):
        q, s, i = zip(*offers[at : at + 40], strict=True)
        best.offer(np.array(q), np.array(s), np.array(i, dtype=object))
    got = list(zip(*(c.tolist() for c in best.rows()), strict=True))
    want = []
    for query in range(7):
        own = [(s, i) for q, s, i in offers if q == query]
        if once:
            own = [(max(s for s, j in own if j == i), i) for i in {i for _, i in own}]
        want += [(query, s, i) for s, i in sorted(own, key=lambda x: (-x[0], x[1]))[:5]]
    assert got == want


def test_tiles_of_products_give_the_best_of_all(monkeypatch):
    import numpy as np

    from rlab.operators import kbest

    monkeypatch.setattr(kbest, "TILE", 64)
    rng = np.random.default_rng(3)
    asked, vectors = rng.integers(-2, 3, (9, 3)).astype(float), rng.integers(-2, 3, (100, 3)).astype(float)
    best = KBest(9, 6, held=10)
    for at in range(0, 100, 30):
        kbest.offer_products(best, asked, vectors[at : at + 30], np.arange(at, min(100, at + 30)), np.arange(9))
    want = [(q, s, i) for q in range(9) for s, i in sorted(((float(asked[q] @ vectors[i]), i) for i in range(100) if i != q), key=lambda x: (-x[0], x[1]))[:6]]
    assert list(zip(*(c.tolist() for c in best.rows()), strict=True)) == want


def test_minor_terms_change_no_list():
    """Scores with and without the bounds of terms, many items at a time and one at a time."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    weight = {(i, t): float(w) for i in range(300) for t, w in zip(rng.choice(40, 8, replace=False), rng.normal(1, 1.2, 8), strict=True)}
    terms = pd.DataFrame([(q, f"t{t}", int(rng.integers(1, 3))) for q in range(12) for t in rng.choice(45, 6, replace=False)], columns=["query_id", "_key", "qtf"])
    most = {}
    for (_, t), w in weight.items():
        most[f"t{t}"] = max(most.get(f"t{t}", -9.0), w)
    terms["most"] = terms["_key"].map(most).fillna(0.0)
    tall = pd.DataFrame([(i, f"t{t}", w) for (i, t), w in sorted(weight.items())], columns=["item_id", "_key", "weight"])
    lists, met = [], []
    for step, bounded in ((300, False), (10, True), (1, True)):
        block, best, seen = R._Block(terms, ["query_id"]), KBest(12, 4, held=0), 0
        for at in range(0, 300, step):
            part = tall[(tall.item_id >= at) & (tall.item_id < at + step)]
            found = block.score(part["item_id"].to_numpy(), part["_key"].to_numpy(), part["weight"].to_numpy())
            seen += len(found[0])
            best.offer(*found)
            if bounded and (best.floor > block.floor).any():
                block.split(best.floor)
        lists.append([c.tolist() for c in best.rows()])
        met.append(seen)
    assert lists[0] == lists[1] == lists[2] and met[2] < met[0] / 2
    plain = {}
    for q, key, qtf, _ in terms.itertuples(index=False):
        for (i, t), w in weight.items():
            if f"t{t}" == key:
                plain.setdefault(q, {}).setdefault(i, []).append(w * qtf)
    want = [(q, round(s, 6), i, n) for q in range(12) for s, i, n in sorted(((sum(w), i, len(w)) for i, w in plain[q].items()), key=lambda x: (-round(x[0], 9), x[1]))[:4]]
    assert [(q, round(s, 6), i, n) for q, s, i, n in zip(*lists[0], strict=True)] == want


def test_contents_without_an_order_are_kept(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (3, "y"), (None, "y"), (2, "y"), (None, None)], "at int, text string")
    got = sorted(((r["at"], r["text"]) for r in L.content_dedupe(df, "text", "at").collect()), key=str)
    assert got == sorted([(None, "x"), (None, "x"), (2, "y"), (None, None)], key=str)


@pytest.mark.parametrize("sent", [0, 10])
def test_tokens_are_encoded_where_they_are_or_by_a_join(spark, sent):
    texts = [(1, ["a", "b", "zz", "a", "b", "b"]), (2, []), (3, None), (4, ["c", None, "a"]), (5, ["zz"])]
    df = spark.createDataFrame(texts, "id int, tokens array<string>").repartition(3)
    table = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4), ("<PAD>", 0)], "token string, id int")
    got = {r.id: (list(r.ids), r.length) for r in P.encode_tokens(df, table, 4, sent_tokens=sent).collect()}
    code = {"a": 2, "b": 3, "c": 4}
    want = {i: (([code.get(t, 1) for t in (own or [])] + [0] * 4)[:4], max(1, min(4, len(own or [])))) for i, own in texts}
    assert got == want


def test_memory_of_full_lists_is_bounded():
    import tracemalloc

    import numpy as np

    from rlab.operators import kbest

    n, rng = kbest.LISTED // 700, np.random.default_rng(5)
    best, queries = KBest(n, 700), np.arange(n)
    tracemalloc.start()
    try:
        for at in range(0, 1000, 100):
            best.offer(np.repeat(queries, 100), rng.random(n * 100), np.tile(np.arange(at, at + 100), n))
        found, peak = best.rows(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found[0]) == n * 700 and peak < 250e6
