"""Queries on the structure of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlab.operators import structure as Z
from rlab.plans import adapters as A
from rlab.sources.io import spread


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(A.table(spark, sf_dir, "pages"))


def tag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of every page with their level."""
    return Z.tag_tables(_pages(spark, sf_dir))[0]


def tag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tag of a page holds which."""
    return Z.tag_tables(_pages(spark, sf_dir))[1]


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into chunks of at most 20 lines at least cost; texts of chunks as digests."""
    return Z.chunk_table(A.table(spark, sf_dir, "documents")).select("doc_id", "chunk_no", "first_line", "n_lines", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


QUERIES = {f.__name__: f for f in (tag_nodes, tag_edges, chunk_table)}

_VOID = ", ".join(f"'{v}'" for v in Z.VOID)
_NODES = rf"""plain AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)(<script[^>]*>).*?(</script>)', '\1\2', 'g'), '(?is)(<style[^>]*>).*?(</style>)', '\1\2', 'g') AS html
  FROM pages
), found AS (
  SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, '{Z.TAG}') AS t FROM plain)
), named AS (
  SELECT page_id, place, lower(regexp_extract(t, '{Z.TAG}', 2)) AS tag, regexp_extract(t, '{Z.TAG}', 1) = '/' AS closes, regexp_extract(t, '{Z.TAG}', 3) = '/' AS own FROM found
), turns AS (
  SELECT page_id, place, tag, CASE WHEN own OR tag IN ({_VOID}) THEN CASE WHEN closes THEN NULL ELSE 0 END WHEN closes THEN -1 ELSE 1 END AS turn FROM named
), sums AS (
  SELECT *, sum(turn) OVER (PARTITION BY page_id ORDER BY place) AS s FROM turns WHERE turn IS NOT NULL
), depths AS (
  SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY place)) + CASE WHEN turn = 0 THEN 1 ELSE 0 END AS level FROM sums
), nodes AS (
  SELECT page_id, place, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INTEGER) AS node, tag, turn, CAST(level AS INTEGER) AS level FROM depths WHERE turn >= 0
  QUALIFY node < {Z.MAX_NODES}
)"""

ORACLES = {
    "tag_nodes": f"WITH {_NODES} SELECT page_id, node, tag, level FROM nodes UNION ALL SELECT page_id, 0, '', 0 FROM pages WHERE page_id NOT IN (SELECT page_id FROM nodes)",
    "tag_edges": f"""WITH {_NODES}
SELECT c.page_id, max(p.node) AS parent, c.node AS child FROM nodes c JOIN nodes p ON p.page_id = c.page_id AND p.level = c.level - 1 AND p.node < c.node AND p.turn = 1 GROUP BY ALL""",
    "chunk_table": rf"""WITH RECURSIVE c AS (
  SELECT doc_id, lines, list_transform(lines, lambda x: CASE WHEN trim(x, ' ') = '' THEN {Z.BLANK_COST} WHEN length(x) < {Z.SHORT} THEN {Z.SHORT_COST} ELSE {Z.LINE_COST} END) AS costs
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), r AS (
  SELECT doc_id, 0 AS j, len(lines) AS n, costs, [{{'cost': 0, 'line': 0, 'starts': CAST([] AS INTEGER[])}}] AS ways FROM c
  UNION ALL
  SELECT doc_id, j + 1, n, costs, list_append(ways[-{Z.MAX_WINDOW - 1}:], {{'cost': best.cost + coalesce(costs[j + 2], 0), 'line': j + 1, 'starts': list_append(best.starts, best.line)}})
  FROM (SELECT *, list_sort(ways)[1] AS best FROM r WHERE j < n)
), s AS (
  SELECT doc_id, ways[-1].starts AS starts FROM r WHERE j = n
), k AS (
  SELECT doc_id, starts, unnest(starts) AS first_line, generate_subscripts(starts, 1) AS k FROM s
)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_no, first_line, CAST(coalesce(starts[k + 1], len(lines)) - first_line AS INTEGER) AS n_lines,
       CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS chunk_md5
FROM (SELECT doc_id, k, first_line, starts, lines, array_to_string(lines[first_line + 1 : coalesce(starts[k + 1], len(lines))], chr(10)) AS t FROM k JOIN c USING (doc_id))""",
}
