"""Structure of texts as tables: nested tags as nodes and edges, lines split into chunks at least cost. Built-in functions
only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags that have no content, and so never hold another.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*?(/?)>"
MAX_NODES = 1000

#: Costs of a chunk that begins at a blank line, at one below ``SHORT`` characters, and at any other.
BLANK_COST, SHORT_COST, LINE_COST, SHORT = 3, 5, 10, 40
MAX_WINDOW = 20


def tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, at, tag, turn): the tags of each page in order; turn is 1 for one that opens, -1 for one that closes, 0 for one
    without content. What stands in comments, scripts and styles is no tag."""
    plain = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "(?s)<!--.*?-->", "")
    plain = F.regexp_replace(plain, "(?is)(<script[^>]*>).*?(</script>)", "$1$2")
    plain = F.regexp_replace(plain, "(?is)(<style[^>]*>).*?(</style>)", "$1$2")
    found = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(plain, F.lit(TAG), 0)).alias("at", "_t"))
    name = F.lower(F.regexp_extract("_t", TAG, 2))
    closes, empty = F.regexp_extract("_t", TAG, 1) == "/", (F.regexp_extract("_t", TAG, 3) == "/") | name.isin(VOID)
    # a closing tag of a name without content closes nothing
    return found.select(key, "at", name.alias("tag"), F.when(empty, F.when(closes, None).otherwise(0)).when(closes, -1).otherwise(1).alias("turn")).where("turn is not null")


def tag_tables(pages: DataFrame, key: str = "page_id", html: str = "html", max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, node, tag, level) and edges (key, parent, child) of the tags of each page, in the order of the text, for
    the first ``max_nodes`` of a page; an edge is kept where both ends are.

    Nesting is a running depth: an opening tag goes one level down, a closing one closes the innermost open tag, whatever its
    name, and nothing where none is open; tags that are never closed stay open to the end of the page. The parent of a tag
    is the last one before it that opens one level up. A page without tags is one node without a name."""
    in_order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    steps = tags(pages, key, html).withColumn("_sum", F.sum("turn").over(in_order))
    lowest = F.least(F.lit(0), F.min("_sum").over(in_order))  # closing tags below it had nothing to close
    depth = F.col("_sum") - lowest
    seen = steps.withColumn("level", depth + F.when(F.col("turn") == 0, 1).otherwise(0)).where("turn >= 0")
    numbered = seen.withColumn("node", F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).where(F.col("node") < max_nodes)
    nodes = numbered.select(key, F.col("node").cast("int").alias("node"), "tag", F.col("level").cast("int").alias("level"))
    bare = pages.select(key).join(nodes.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("node"), F.lit("").alias("tag"), F.lit(0).alias("level"))
    # each tag stands under its own level as a parent, and under the level above as a child
    opens = numbered.where("turn = 1").select(key, "node", F.col("level").alias("_under"), F.col("node").alias("_parent"), F.lit(None).cast("int").alias("child"))
    asks = numbered.where("level > 1").select(key, "node", (F.col("level") - 1).alias("_under"), F.lit(None).cast("int").alias("_parent"), F.col("node").cast("int").alias("child"))
    before = Window.partitionBy(key, "_under").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    linked = opens.union(asks).withColumn("parent", F.last("_parent", True).over(before)).where("child is not null")
    return nodes.unionByName(bare), linked.select(key, F.col("parent").cast("int").alias("parent"), "child")


def line_costs(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.when(F.trim(x) == "", BLANK_COST).when(F.length(x) < SHORT, SHORT_COST).otherwise(LINE_COST))


def cheapest_starts(costs: Column, max_window: int = MAX_WINDOW) -> Column:
    """First lines (from 0) of the chunks of a text whose line i costs ``costs[i]`` to begin a chunk at, so that no chunk has
    more than ``max_window`` lines and the sum of costs is least; the first chunk begins for free, and of equal sums the one
    whose last chunks are longest is taken.

    A fold over the lines: it holds the sums and starts of the ways to reach each of the last ``max_window`` lines."""
    kind = "array<struct<cost:int,line:int,starts:array<int>>>"
    first = F.array(F.struct(F.lit(0).alias("cost"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("starts"))).cast(kind)
    ends = F.transform(F.slice(F.concat(costs, F.array(F.lit(0))), F.lit(2), F.size(costs)), lambda c, k: F.struct(c.alias("cost"), (k + 1).alias("line")))

    def step(ways: Column, end: Column) -> Column:
        best = F.array_min(ways)
        way = F.struct((best["cost"] + end["cost"]).cast("int").alias("cost"), end["line"].cast("int").alias("line"), F.concat(best["starts"], F.array(best["line"])).alias("starts"))
        kept = F.slice(ways, F.greatest(F.lit(1), F.size(ways) + 2 - max_window), F.lit(max_window))
        return F.concat(kept, F.array(way)).cast(kind)

    return F.aggregate(ends, first, step, lambda ways: F.element_at(ways, -1)["starts"])


def chunk_table(texts: DataFrame, key: str = "doc_id", text: str = "text", max_window: int = MAX_WINDOW) -> DataFrame:
    """(key, chunk_no, first_line, n_lines, chunk): each text cut between lines into chunks of at most ``max_window`` lines at
    least cost. A null text is one empty line."""
    lines = texts.select(F.col(key), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_lines"))
    starts = lines.select(key, "_lines", cheapest_starts(line_costs(F.col("_lines")), max_window).alias("_starts"))
    stop = F.coalesce(F.try_element_at("_starts", F.col("chunk_no") + 2), F.size("_lines"))
    cut = starts.select(key, "_lines", "_starts", F.posexplode("_starts").alias("chunk_no", "first_line")).withColumn("n_lines", stop - F.col("first_line"))
    return cut.select(key, "chunk_no", "first_line", "n_lines", F.array_join(F.slice("_lines", F.col("first_line") + 1, F.col("n_lines")), "\n").alias("chunk"))
