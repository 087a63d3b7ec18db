from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    parts = {"en": "the er in th ing and of re".split(), "fr": "le eau é que la ou ment è".split(), "de": "der ung sch ß und ein ü ch".split()}[lang]
    out = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in out)


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empties, repeated lines and very long texts."""
    rng = random.Random(4)
    known = [rng.choice(["en", "fr", "de"]) for _ in range(60)]
    texts: list[str | None] = [prose(rng, rng.randint(20, 120), lang) for lang in known]
    passage = prose(rng, 60)
    texts += [texts[0], texts[0], texts[1], None, "", "   \n\t ", "One", "one", "two words", "ONE two three", "short text of five words", "!!! ??? 123"]
    texts += [prose(rng, 15) + "\n" + passage + "\n" + prose(rng, 15) for _ in range(6)]
    for k in range(12):  # near copies of one text, from hardly to much edited
        words = texts[2].split()
        for _ in range(k):
            words[rng.randrange(len(words))] = f"edit{k}"
        texts.append(" ".join(words))
    texts += ["a" * 400, "a" * 90 + "b", "For " * 80, "Line one is here\nLine one is here\n\n#$% x\nLine one is here", prose(rng, 20_000, "fr")]
    return [(k, t, known[k] if k < 60 else None, "src0" if k % 3 == 0 else f"src{k % 5}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
