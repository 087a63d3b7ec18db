"""Shared state of a running application: the folder that all executors see, stored intermediate tables, sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlab.sources.io import scratch_dir as fresh_dir
from rlab.sources.io import stored

__all__ = ["BROADCAST_IDS", "fresh_dir", "lookup", "parts_for", "stored", "text_bytes"]

#: A side of at most this many ids (some 20 MB in memory) is broadcast; a larger one is merged.
BROADCAST_IDS = 500_000


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts (one aggregate)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def parts_for(n_bytes: int, each: int, least: int = 1) -> int:
    """Number of partitions of about ``each`` bytes."""
    return max(least, -(-n_bytes // each))


def lookup(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table of few short columns as the side that texts are looked up in: broadcast if its rows, which are counted,
    are at most ``most``, else merged. So texts do not move for a set of ids that fits into every task, at any size."""
    return F.broadcast(ids) if ids.count() <= most else ids.hint("merge")
