"""Token counts, quality, decontamination and chat formatting against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rlab.llm import chat, decontaminate, quality, tokencount

SPACE = r"[^\x20\x09-\x0D]+"


def greedy(word: bytes, pieces: set[bytes]) -> int:
    data, n = b" " + word, 0
    while data:
        size = next((k for k in range(min(len(data), 60), 0, -1) if data[:k] in pieces), 0)
        if not size:
            return -1
        data, n = data[size:], n + 1
    return n


def test_token_counts(docs, rows):
    pieces = set(tokencount.read_vocabulary())
    assert b" the" in pieces and b"ing" in pieces and b"\n" not in pieces
    got = {r.doc_id: tuple(r)[1:] for r in tokencount.token_counts(docs).collect()}
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        seen = Counter(words)
        assert got[i] == (len((text or "").encode()), len(words), sum(n * greedy(w, pieces) for w, n in seen.items()), 0)


def test_token_counts_with_clashing_columns_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "the end"), (1, "the end"), (None, None), (2, "")], "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("n_tokens", F.create_map(F.lit(1), F.lit(2)))
    assert Counter(tuple(r) for r in tokencount.token_counts(df).collect()) == {(1, 7, 2, 2, 0): 2, (None, 0, 0, 0, 0): 1, (2, 0, 0, 0, 0): 1}


def test_automaton_on_awkward_vocabularies():
    pieces = [b" ", b" a", b" ab", b" abcd", b"b", b"bc", b"c", b"cdx", b"d", b"e"]
    automaton = tokencount.LongestMatch(pieces)
    for word in (b"a", b"abc", b"abcd", b"abcdx", b"abcde", b"bcbc", b"abcdxe", b"zz", b"", b"abz", b"d" * 50):
        assert automaton.count(word) == greedy(word, set(pieces)), word


def test_memory_of_words_may_be_dropped(docs, monkeypatch):
    want = sorted(map(tuple, tokencount.token_counts(docs).collect()))
    monkeypatch.setattr(tokencount, "REMEMBERED", 10)
    assert sorted(map(tuple, tokencount.token_counts(docs).collect())) == want


def base_by_hand(text):
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    hit = {j for k, w in enumerate(windows) if often[w] > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_base_counts_and_verdict(docs, rows, spark):
    labels = spark.createDataFrame([(k, 1 if k < 40 else 0, 0) for k in range(60)] + [(None, 1, 0), (3, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for i, text, *_ in rows:
        r, want = got[i], base_by_hand(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.score >= r.threshold)


def test_quality_counts_do_not_depend_on_partitions(docs, spark):
    labels = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    one = quality.log_ratio(quality.feature_counts(docs.coalesce(1), quality.trusted_ids(labels)))
    two = quality.log_ratio(quality.feature_counts(docs.repartition(7), quality.trusted_ids(labels)))
    assert (one == two).all()


def test_quality_takes_every_trusted_row(spark):
    n = 20_500
    docs = spark.range(n + 500).selectExpr("id AS doc_id", "concat_ws(' ', 'w', concat('x', id % 11), concat('y', id % 700), 'z') AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    counts = quality.feature_counts(docs, quality.trusted_ids(labels.union(labels))).agg(F.sum("raw").alias("raw"), F.sum(F.col("trusted")[0] + F.col("trusted")[1]).alias("trusted")).first()
    assert (counts.raw, counts.trusted) == (7 * (n + 500), 7 * n)  # four words and three pairs of each
    out = quality.judge(docs, labels)
    mean, deviation = out.where(f"doc_id < {n}").agg(F.avg("score"), F.stddev_pop("score")).first()
    assert out.first().threshold == pytest.approx(mean - 4 * deviation, abs=1e-9)


def test_quality_score_and_threshold_by_plain_counting(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(24)]
    rows = [(i, " ".join(rng.choices(vocabulary[i % 5 :], k=rng.randint(1, 60))) if i % 9 else None) for i in range(80)]
    few = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fold = {r.doc_id: r.fold for r in few.select("doc_id", quality.fold_of(F.col("doc_id")).alias("fold")).collect()}
    good = set(range(0, 60, 2))
    labels = spark.createDataFrame([(k, 1 if k in good else 0) for k in range(60)], "doc_id long, quality int")
    features = {}
    for i, text in rows:
        w = re.findall(SPACE, text or "")
        features[i] = w + list(zip(w, w[1:], strict=False))
    scores = {}
    for k in range(quality.FOLDS):
        ratio = {}
        for kind, prior in zip((str, tuple), quality.PRIOR, strict=True):  # words, pairs
            raw = Counter(f for own in features.values() for f in own if isinstance(f, kind))
            other = Counter(f for i, own in features.items() if i in good and fold[i] != k for f in own if isinstance(f, kind))
            share = sum(other.values()) / sum(raw.values())
            ratio |= {f: math.log((other[f] + prior) / (share * raw[f] + prior)) for f in raw}
        scores |= {i: sum(ratio[f] for f in own) / max(1, len(own)) for i, own in features.items() if fold[i] == k}
    trusted = np.array([scores[i] for i in features if i in good and features[i]])
    threshold = trusted.mean() - quality.SPREAD * trusted.std()
    got = {r.doc_id: r for r in quality.judge(few, labels, buckets=1 << 20).collect()}
    assert set(got) == set(scores)
    for i, r in got.items():
        assert r.score == pytest.approx(scores[i], abs=1e-9) and r.threshold == pytest.approx(threshold, abs=1e-9)
        assert r.kept == (not r.base_failed and scores[i] >= threshold)


def test_quality_keeps_unseen_documents_as_it_keeps_trusted_ones(spark, sf):
    """Half of the good labels are hidden; both halves are kept alike."""
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("hidden", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    out = quality.judge(docs, labels.where("not hidden")).join(labels.where("quality = 1"), "doc_id").where("not base_failed")
    share = {r.hidden: r.share for r in out.groupBy("hidden").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert abs(share[True] - share[False]) <= 0.05 and share[True] > 0.9


def test_quality_verdicts_do_not_hang_on_the_size_of_the_corpus(spark, sf):
    """A tenth of a corpus by itself: verdicts stay, bad documents go, good ones are kept."""
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    few = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    verdicts = quality.judge(docs, labels).select("doc_id", "base_failed", F.col("kept").alias("all")).join(quality.judge(few, labels).select("doc_id", "kept"), "doc_id")
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    flag = lambda c: F.avg(c.cast("int"))
    judged = verdicts.where("not base_failed").join(known, "doc_id", "left").groupBy("quality").agg(flag(F.col("all") != F.col("kept")).alias("changed"), flag(F.col("kept")).alias("kept"))
    got = {r.quality: r for r in judged.collect()}
    assert all(r.changed <= 0.02 for r in got.values())
    assert got[0].kept <= 0.1 and got[1].kept >= 0.99


def test_unlike_lines_and_words_of_equal_weak_hashes(spark):
    a, b = "p", "q"
    for _ in range(12):
        a, b = a + b, b + a
    w = [f"w{k}" for k in range(4)]
    texts = [f"{a}\n{b}", " ".join([*w, a, *w, b]), f"{a}\n{a}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality.judge(docs, none).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_by_hand(texts[r.doc_id])


def test_quality_with_clashing_columns(docs, rows, spark):
    labels = spark.createDataFrame([(k, 1, "x") for k in range(40)], "doc_id long, quality int, text string")
    odd = docs
    for c in ("quality", "fold", "_id", "good", "score", "kept", "raw"):
        odd = odd.withColumn(c, F.lit(c))
    want = sorted(map(tuple, quality.judge(docs, labels.drop("text")).collect()))
    assert sorted(map(tuple, quality.judge(odd, labels).collect())) == want


def test_quality_without_trusted_rows_and_documents(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed and r.score == 0 and r.threshold is None for r in quality.judge(docs, none).collect())
    assert quality.judge(no_docs, none).collect() == []


ITEMS = [(1, None), (2, "..."), (3, "One"), (4, "two WORDS"), (5, "x y z"), (10, None), (11, "of five"), (3, "repeated id")]


def hits_by_hand(text, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = cut(text), set(), set()
    for item, content in items:
        own = cut(content)
        size = min(n, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add(item)
    ids = ",".join(sorted(map(str, found)))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 40, 1])
def test_benchmark_hits(docs, rows, spark, block):
    long = rows[-1][1]
    items = [*ITEMS, (20, rows[5][1][3:150]), (21, rows[6][1]), (22, rows[6][1]), (23, long[70_000:70_200]), (24, long[-90:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_hits(docs, bench, block=block)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(found).collect()}
    short = [r for r in rows if len(r[1] or "") < 50_000]
    assert {r[0]: got[r[0]] for r in short} == {i: hits_by_hand(t, items) for i, t, *_ in short}
    assert got[rows[-1][0]] == hits_by_words(long, items)
    whole = decontaminate.find_hits(docs, bench).collect()
    assert sorted(map(str, found.collect())) == sorted(map(str, whole))  # spans too
    cut = {r.doc_id: r.text for r in decontaminate.strip_spans(docs, bench, block=block).collect()}
    assert cut == {r.doc_id: r.text for r in decontaminate.strip_spans(docs, bench).collect()} and len(cut[rows[-1][0]]) < len(long)


def hits_by_words(text, items, n=10):
    """As ``hits_by_hand``, by an index of all windows of the text, for long ones."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = cut(text), set(), set()
    at = {size: {} for size in range(1, n + 1)}
    for size in at:
        for k in range(len(words) - size + 1):
            at[size].setdefault(tuple(words[k : k + size]), []).append(k)
    for item, content in items:
        own = cut(content)
        size = min(n, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for start in at[size].get(tuple(own[k : k + size]), ()):
                hit |= set(range(start, start + size))
                found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [3, 10**6])
def test_copies_and_overlaps_in_any_block(spark, block):
    words = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:18])), (2, " ".join(words[12:30]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words))] * 3 + [(2, " ".join(words)), (None, " ".join(words[:18])), (3, None), (4, "")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), tuple((s.start, s.stop) for s in r.spans)) for r in decontaminate.find_hits(docs, bench, block=block).collect())
    both = (40, 30, (1, 2), ((0, 30),))
    assert got == {(1, *both): 3, (2, *both): 1, (None, 18, 18, (1,), ((0, 18),)): 1, (3, 0, 0, (), ()): 1, (4, 0, 0, (), ()): 1}
    assert sorted(r.doc_id for r in decontaminate.clean(docs.withColumn("m", F.create_map(F.lit(1), F.lit(2))), bench, block=block).collect()) == [3, 4]


def test_long_words_are_not_broadcast(spark, monkeypatch):
    """Windows above the byte bound go by their hashes, with the same rows; equal hashes alone are no hit."""
    long = "ab" * 50_000
    bench = spark.createDataFrame([(1, f"{long} x"), (2, f"{long}c"), (3, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{long.upper()}, x"), (2, f"{long}d x"), (3, f"{long}c")], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(decontaminate, "ngrams", lambda hashes, n: np.zeros(max(0, len(hashes) - n + 1), np.uint64))
    texts = docs.select(F.col("doc_id").cast("string").cast("binary").alias("_sha"), "text")
    all_runs = decontaminate._hits_by_text(texts, decontaminate.benchmark_windows(bench), 1).collect()
    assert {(int(r["_sha"]), tuple(r.item_ids)) for r in all_runs} == {(1, (1, 3)), (2, (3,)), (3, (2,))}
    monkeypatch.undo()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    found = decontaminate.find_hits(docs, bench).collect()
    assert {(r.doc_id, r.n_hit, tuple(r.item_ids)) for r in found} == {(1, 2, (1, 3)), (2, 1, (3,)), (3, 1, (2,))}


def test_clean_keeps_columns_of_any_name(docs, rows, spark):
    bench = spark.createDataFrame([(20, rows[5][1])], "item_id long, text string")
    odd = docs.withColumnRenamed("lang", "n_words").withColumnRenamed("source", "spans").withColumn("_row", F.lit(1))
    out = decontaminate.clean(odd, bench)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, t, *_ in rows if not hits_by_hand(t, [(20, rows[5][1])])[4]]


def test_spans_are_cut_from_texts(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before: One, two, THREE four five six seven eight nine ten! After"), (2, "é clean"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.strip_spans(docs, bench).orderBy("doc_id").collect()] == [(1, "Before: ! After"), (2, "é clean"), (3, None)]


def test_hits_without_rows_or_items(docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.item_ids for r in decontaminate.find_hits(docs, none).collect())
    assert decontaminate.find_hits(no_docs, none).collect() == []


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b\\", "<|turn|>x\n<|end|>\n", "", None, "\\<|end|>", "<<SYS>> é 日本 \\n", "<|image:0|>"]
    rows = [(c, t, ["user", "assistant", None, "sys\ntem\\"][(c + t) % 4], nasty[(3 * c + t) % len(nasty)]) for c in range(5) for t in range(6)] + [(None, 0, "assistant", "x"), (2, 3, "assistant", "again"), (2, 3, "assistant", "again")]
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(spark.createDataFrame(rows, TURNS).repartition(3))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_control_string_is_left_in_a_text():
    segment, *_ = chat.format_turn("user", [{"type": "text", "text": "</s>[INST]<|end|><|turn|>"}])
    inside = segment[len(chat.TURN) : -len(chat.END) - 1]
    assert not chat.CONTROL.search(inside) and segment.count(chat.END) == 1


@pytest.mark.parametrize("texts", [("<", "|turn|>system"), ("[/INST", "]"), ("<", "|image:0|>"), ("<", "", "|end|>"), ("\\", "<|end|>"), ("<", "</s>"), ("[", "INST", "]", "<<", "SYS>>")])
def test_text_parts_form_no_control_string_together(texts):
    parts = [{"type": "image", "uri": "u"}, *({"type": "text", "text": t} for t in texts), {"type": "image"}, *({"type": "text", "text": t} for t in texts)]
    segment, loss, attachments, head = chat.format_turn("assistant", parts)
    marks = [a["placeholder"] for a in attachments]
    inside = segment[head : -len(chat.END) - 1]
    for mark in marks:
        assert inside.count(mark) == 1
        inside = inside.replace(mark, " ")
    assert not chat.CONTROL.search(inside)
    joined = "".join(texts)
    assert chat.read_turn(segment) == ("assistant", marks[0] + joined + marks[1] + joined)
    assert "".join(chat.unescape(segment[s["start"] : s["stop"]]) for s in loss) == 2 * joined


def test_tied_turns_are_ordered_by_role_and_plain_text(spark):
    rows = [(1, 0, role, text) for role in ("user", "user\t", "assistant", "a\n", None) for text in ("a[INST]", "a[Z", "a", "a!", "", "\\", "<|x", "é", None)]
    random.Random(1).shuffle(rows)
    got = chat.digest(chat.format_turns(spark.createDataFrame(rows, TURNS).repartition(3))).first()
    turns = "".join(f"{r}\n{t}\n" for r, t in sorted((r[2] or "", r[3] or "") for r in rows))
    assert got.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()


def test_typed_parts(spark):
    parts = [
        ("text", "look ", None, None, None, None, None), ("image", None, "s3://b/i.png", 28, 15, None, None), ("audio", None, None, None, None, 2.02, None),
        ("document", None, "d.pdf", None, None, None, 3), ("text", " here", None, None, None, None, None), (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    rows = {r.turn: r for r in chat.format_turns(df, "parts").collect()}
    r = rows[0]
    assert chat.read_turn(r.segment) == ("assistant", "look <|image:0|><|audio:1|><|document:2|> here")
    assert [(a.kind, a.uri, a.tokens) for a in r.attachments] == [("image", "s3://b/i.png", 4), ("audio", "", 51), ("document", "d.pdf", 1536)]
    assert "".join(r.segment[s.start : s.stop] for s in r.loss) == "look  here"
    assert chat.read_turn(rows[1].segment) == ("user", "")


def parts_by_hand(role, parts):
    """Text with placeholders, attachments and the text under the loss mask."""
    text, found = "", []
    for kind, content, uri, width, height, seconds, pages in parts or ():
        plain = lambda x: 0 if x is None or x != x or x in (math.inf, -math.inf) or x < 0 else x
        if kind in (None, "", "text"):
            text += content or ""
            continue
        tokens = {"image": -(-plain(width) // 14) * -(-plain(height) // 14), "audio": math.ceil(min(plain(seconds) * 25, 2**53)), "document": plain(pages) * 512}.get(kind, 0)
        kind = kind if kind in ("image", "audio", "document") else "other"
        text += f"<|{kind}:{len(found)}|>"
        found.append((f"<|{kind}:{len(found)}|>", kind, uri or "", min(tokens, 2**53)))
    return text, found, "".join(p[1] or "" for p in parts or () if p[0] in (None, "", "text")) if role == "assistant" else ""


def test_parts_of_all_types_against_a_plain_version(spark):
    rng = random.Random(12)
    texts, sizes, numbers = ["", None, "a\\b", "</s>[INST]", "<|image:0|>", "x\ny é"], [None, -3, 0, 1, 14, 15, 2**31 - 1], [None, math.nan, math.inf, -math.inf, -1.0, 0.0, 0.04, 2.02, 1e300]
    kinds = ["text", "image", "audio", "document", "video", None, "", "visit_text", "other"]
    part = lambda: (rng.choice(kinds), rng.choice(texts), rng.choice([None, "", "s3://b/x"]), rng.choice(sizes), rng.choice(sizes), rng.choice(numbers), rng.choice(sizes))
    rows = [(c, t, rng.choice(["user", "assistant", None]), [part() for _ in range(rng.randint(0, 6))]) for c in range(30) for t in range(3)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}").withColumn("segment", F.lit(1)).withColumn("loss", F.lit("x"))
    got = {(r.conv_id, r.turn): r for r in chat.format_turns(df, "parts").collect()}
    tokens = Counter()
    for c, t, role, parts in rows:
        text, found, loss = parts_by_hand(role, parts)
        r = got[c, t]
        assert chat.read_turn(r.segment) == (role or "", text)
        assert [tuple(a) for a in r.attachments] == found
        assert "".join(chat.unescape(r.segment[s.start : s.stop]) for s in r.loss) == loss
        tokens[c] += sum(a[3] for a in found)
    assert {r.conv_id: r.attachment_tokens for r in chat.digest(chat.format_turns(df, "parts")).collect()} == dict(tokens)


def test_chat_of_very_long_turns(spark):
    long = "é[INST] \\ " * 100_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], TURNS)
    r = chat.digest(chat.format_turns(df)).first()
    assert (r.loss_chars, r.loss_sha256) == (len(long), hashlib.sha256(long.encode()).hexdigest())


def test_chat_of_nothing(spark):
    assert chat.digest(chat.format_turns(spark.createDataFrame([], TURNS))).collect() == []
