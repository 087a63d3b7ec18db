"""N-gram join, filter audit and hard negatives against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rlab.llm import audit, negatives, ngramjoin

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def joined_by_hand(pairs, n=4, threshold=85):
    """(id, set size, component) of each (id, text), by all pairs; rows of one id are one."""
    sets = [word_set(t, n) for _, t in pairs]
    parent = {i: i for i, _ in pairs if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, (i, _)), (b, (j, _)) in itertools.combinations(enumerate(pairs), 2):
        if i is None or j is None or not sets[a] or not sets[b]:
            continue
        both = len(sets[a] & sets[b])
        if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(pairs, sets, strict=True)), key=str)


def joined(df, **how):
    return sorted((tuple(r) for r in ngramjoin.join(df, **how).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"fragments": 1}, {"shingle": 2, "threshold": 60, "fragments": 3}])
def test_join(docs, rows, how):
    assert joined(docs, **how) == joined_by_hand([(r[0], r[1]) for r in rows], how.get("shingle", 4), how.get("threshold", 85))


def test_join_of_chains_goes_beyond_the_centres(spark):
    """Windows of one long text, each like its neighbours only: centres see few of them, the blocks must find the rest."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1200)]
    texts = [" ".join(words[k : k + 120]) for k in range(0, 700, 6)]
    del texts[50:75]  # the chain falls into two
    texts += [" ".join(words[k : k + 120 - k % 7]) for k in range(3, 300, 30)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    pairs = [(k, texts[at]) for k, at in enumerate(order)]
    want = joined_by_hand(pairs)
    assert len({c for *_, c in want}) > 1 and max(len(list(g)) for _, g in itertools.groupby(sorted(c for *_, c in want))) > ngramjoin.CENTRES
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    assert joined(df) == want


def test_join_of_odd_rows_with_clashing_columns(spark):
    rng = random.Random(2)
    base = [f"word{rng.randrange(40)}" for _ in range(90)]
    near = base.copy()
    near[44] = "other"
    texts = [" ".join(base), " ".join(base).upper(), " ".join(near), None, "", " \n", "one", "One", "a b c", "a b c", "x " * 3000, "x " * 900, " ".join(base * 30)]
    pairs = [(None if k == 1 else k // 2 * 2, t) for k, t in enumerate(texts)] + [(7, " ".join(near)), (7, "a b c"), (20, " ".join(base)), (20, " ".join(base))]
    df = spark.createDataFrame([(i, t, 1, "x", 2.0, None) for i, t in pairs], "doc_id long, text string, node int, family string, gram double, sha string")
    assert joined(df) == joined_by_hand(pairs)


def test_join_of_nothing(no_docs):
    assert joined(no_docs) == []


def test_join_of_many_copies_and_a_common_passage(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    pairs = [(k, "the same text of a third of all rows " * 5) for k in range(100)]
    pairs += [(100 + k, passage + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(0, 60)))) for k in range(100)]
    base = [f"n{k}" for k in range(200)]
    for k in range(100):
        words = base.copy()
        for _ in range(k % 4):
            words[rng.randrange(200)] = f"e{rng.randrange(10**9)}"
        pairs.append((200 + k, " ".join(words)))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(6)
    assert joined(df) == joined_by_hand(pairs)


# --- filter audit


def audited_by_hand(docs, labels):
    """Every order applied row by row."""
    seen: dict[str, list] = {}
    for i, t, _ in docs:
        if i is not None:
            seen.setdefault(t or "", []).append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > min(seen[text]),
        }
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        of_filter = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone: list = []
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in gone)
                left, gone = [r for r in left if not r[1][f]], gone + here
                unique = sum(r[0] == part and r[1][f] and sum(r[1].values()) == 1 for r in rows)
                out[part, "".join(order), step] = [len(left), len(here), redundant, unique, sum(r[2] for r in here), sum(r[3] for r in here)]
                of_filter[f] += len(here)
        for key in [k for k in out if k[0] == part]:
            out[key].append(of_filter[key[1][key[2] - 1]])
    return sorted((*k, *v) for k, v in out.items())


_AUDITED = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_by_hand(spark):
    rng = random.Random(3)
    docs = []
    for k in range(80):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "delta", "é", f"z{rng.randrange(500)}", f"q{rng.randrange(500)}"]) for _ in range(rng.choice([5, 99, 100, 140]))]
        text = rng.choice([" ", "\n", "\t\r\x0b"]).join(words) + rng.choice(["", "", "#", "|"])
        docs.append((k, text, rng.choice(["en", "fr", None, ""])))
    docs += [(k + 80, docs[k % 5][1], "en") for k in range(12)]
    docs += [(None, docs[0][1], "en"), (3, docs[0][1], None), (3, docs[3][1], "de"), (200, None, None), (201, "", "de"), (202, None, "de"), (203, "word " * 20_000, "fr")]
    labels = [(rng.randrange(100), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1), (9999, 1, 1), (4, 1, 0), (4, 0, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, word string, fails int").repartition(4)
    got = audit.audit(frame, spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int, good int"))
    assert sorted(tuple(r) for r in got.select(*_AUDITED).collect()) == audited_by_hand(docs, labels)


def test_audit_of_nothing(spark, no_docs):
    assert audit.audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 1000, 4099])
def test_positional_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert audit.positional_counts(words).tolist() == [int((words >> np.uint32(k) & np.uint32(1)).sum()) for k in range(32)]


def test_parts_are_given_out_when_many_are_held(spark):
    docs = spark.createDataFrame([(k, "short", f"lang{k % 1500}") for k in range(3000)], "doc_id long, text string, lang string").repartition(2)
    counts = audit.survivors(audit.words_of(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    row = counts.where((F.col("class") == 0) & (F.col("subset") == 0)).agg(F.count("n"), F.sum("n")).first()
    assert tuple(row) == (1500, 3000)


# --- hard negatives


def mined_by_hand(rows, every=5):
    usable = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in usable:
        if i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for j, other, w in usable if j != i and len(w) == len(v)]
        for score, j, _ in sorted(s for s in scores if s[2])[:5]:
            fits = sorted(s for s in scores if not s[2] and 50 * -score <= 100 * -s[0] <= 95 * -score)
            out += [(i, j, rank, k, -score, -n) for rank, (n, k, _) in enumerate(fits[:3], 1)]
    return sorted(out)


def vectors(seed, n, size=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, size))
    x = base[rng.integers(0, 6, n)] * 0.6 + rng.standard_normal((n, size))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


_VECTORS = "vec_id long, label int, embedding array<float>, code string"


@pytest.mark.parametrize("block_bytes", [negatives.BLOCK_BYTES, 4000])
def test_negatives_by_hand(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block_bytes)
    rng = random.Random(1)
    rows = [(k, rng.randrange(4), v) for k, v in enumerate(vectors(1, 240))]
    rows += [(240 + k, rng.randrange(4), rows[k % 3][2]) for k in range(40)]  # ties
    rows += [(300, None, rows[0][2]), (305, 1, None), (310, 1, [float("nan")] * 64), (315, 1, [None] * 64), (320, 2, []), (None, 1, rows[0][2]), (325, 1, [0.0] * 64), (330, 1, [float("inf")] * 64)]
    rows += [(400 + k, k % 2, v) for k, v in enumerate(vectors(2, 30, 70))] + [(500 + k, k % 2, [0.5 - k / 9]) for k in range(20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], _VECTORS).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == mined_by_hand(rows)


def test_negatives_where_rows_repeat_an_id(spark):
    rows = [(k % 7 * 5, k % 3, v) for k, v in enumerate(vectors(4, 30, 16))]
    got = negatives.mine(spark.createDataFrame([(*r, "x") for r in rows], _VECTORS), F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined_by_hand(rows)


def test_negatives_of_nothing(spark):
    assert negatives.mine(spark.createDataFrame([], _VECTORS), F.col("vec_id") % 5 == 0).collect() == []


@pytest.mark.parametrize("size", [1, 3, 64, 100])
def test_intervals_hold_every_score_and_leave_most_out(size):
    rng = np.random.default_rng(size)
    v = rng.integers(-150, 150, (300, size))
    v[:3] = 0
    v[3:20] *= 400
    anchors = negatives.Anchors(v[:40])
    middle, half = anchors.intervals(np.arange(40), *negatives.encode(v))
    scores = v[:40] @ v.T
    assert (np.abs(scores - middle) <= half).all()
    if size == 64:
        plain = v[20:]
        middle, half = negatives.Anchors(plain[:50]).intervals(np.arange(50), *negatives.encode(plain))
        top = np.sort(plain[:50] @ plain.T, axis=1)[:, -6]  # the fifth best besides the anchor
        assert (middle + half >= top[:, None]).mean() < 0.4


def test_best_keeps_ties_by_smaller_id():
    best = negatives.Best(2, 2)
    best.add(np.array([0, 0, 0]), np.array([5, 5, 5]), np.array([9, 3, 7]))
    best.add(np.array([0, 1]), np.array([5, -8]), np.array([4, 1]))
    assert [x.tolist() for x in best.rows()] == [[0, 0, 1], [5, 5, -8], [3, 4, 1]]
