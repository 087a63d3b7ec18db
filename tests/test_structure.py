"""Tag tables against a stack, chunks against all ways of cutting."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from rlab.operators import structure as Z

PAGES = [
    "<html><body><p>one<p>two</p><br>three</body></html>",
    "</p></p><a>x</a></div><b><i>y</b></i></i></i><u/><em></em>",
    "no tag at all < 3 > 2",
    "",
    None,
    "<!-- <p> --><script>var t='</p><b>';</script><STYLE>p{}</style><DIV class='a' data-x=1><img src=x><input/></DIV></br>",
    "<a><a><a><a>" * 3 + "</a>" * 20 + "<b></b>",
    "<p>" * 30 + "</p>" * 15 + "<x>" * 5,
]


def by_stack(html, most):
    """Every closing tag pops what is on top."""
    html = re.sub(r"(?is)(<style[^>]*>).*?(</style>)", r"\1\2", re.sub(r"(?is)(<script[^>]*>).*?(</script>)", r"\1\2", re.sub(r"(?s)<!--.*?-->", "", html or "")))
    nodes, edges, stack = [], [], []
    for closes, name, own in re.findall(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*?(/?)>", html):
        name, void = name.lower(), bool(own) or name.lower() in Z.VOID
        if closes:
            if not void and stack:
                stack.pop()
            continue
        nodes.append((len(nodes), name, len(stack) + 1))
        if stack:
            edges.append((stack[-1], len(nodes) - 1))
        if not void:
            stack.append(len(nodes) - 1)
    return nodes[:most] or [(0, "", 0)], [e for e in edges if max(e) < most]


@pytest.mark.parametrize("most", [1000, 4])
def test_tag_tables_by_a_stack(spark, most):
    rng = random.Random(4)
    pieces = ["<p>", "</p>", "<b>", "</b>", "<br>", "<img/>", "</br>", "text", "<!--", "-->", "<DIV a='b'>", "</div>", "<script>", "</script>"]
    pages = PAGES + ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").repartition(4)
    nodes, edges = Z.tag_tables(df, max_nodes=most)
    got_nodes, got_edges = {}, {}
    for r in nodes.collect():
        got_nodes.setdefault(r.page_id, []).append((r.node, r.tag, r.level))
    for r in edges.collect():
        got_edges.setdefault(r.page_id, []).append((r.parent, r.child))
    for k, page in enumerate(pages):
        want = by_stack(page, most)
        assert (sorted(got_nodes[k]), sorted(got_edges.get(k, []))) == (want[0], sorted(want[1])), page


def test_tag_tables_use_built_in_functions_only(spark):
    df = spark.createDataFrame([(1, "<p>")], "page_id int, html string")
    for table in Z.tag_tables(df):
        assert not re.search("Python|Arrow|Pandas", table._jdf.queryExecution().executedPlan().toString())


def cheapest_by_hand(costs, most):
    """All ways to cut; the least sum, then the longest last chunk, then the longest one before it, and so on."""
    n, best = len(costs), None
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            starts = [0, *cuts]
            if any(b - a > most for a, b in zip(starts, [*cuts, n], strict=True)):
                continue
            key = (sum(costs[c] for c in cuts), starts[::-1])
            best = key if best is None or key < best else best
    return best[1][::-1]


@pytest.mark.parametrize("most", [1, 3, 4, 20])
def test_chunks_cost_least_of_all_ways(spark, most):
    rng = random.Random(most)
    texts = [[rng.choice([3, 5, 10]) for _ in range(rng.randint(1, 15 if most > 3 else 12))] for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, costs array<int>")
    for r in df.select("id", Z.cheapest_starts(F.col("costs"), most).alias("s")).collect():
        assert r.s == cheapest_by_hand(texts[r.id], most)


def test_chunks_hold_the_whole_text(spark):
    rng = random.Random(2)
    line = lambda: rng.choice(["", "  ", "short", "a line of more than forty characters, which costs most to begin at"])
    texts = ["\n".join(line() for _ in range(n)) for n in (1, 2, 19, 20, 21, 22, 90, 3000)] + [None, "", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {}
    for r in Z.chunk_table(df).orderBy("doc_id", "chunk_no").collect():
        found.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(texts):
        rows = found[k]
        assert "\n".join(r.chunk for r in rows) == (text or "") and [r.chunk_no for r in rows] == list(range(len(rows)))
        assert all(1 <= r.n_lines <= Z.MAX_WINDOW for r in rows)
        assert [r.first_line for r in rows] == list(itertools.accumulate([0, *(r.n_lines for r in rows[:-1])]))
