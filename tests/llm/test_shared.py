"""Sides that texts are looked up in."""

from __future__ import annotations

from rlab.llm.shared import lookup, stored


def test_lookup_is_broadcast_up_to_a_counted_size(spark):
    ids, rows = stored(spark.range(0, 100, 2), "ids"), spark.range(100)
    for most, kind in ((50, "BroadcastHashJoin"), (49, "SortMergeJoin")):
        found = rows.join(lookup(ids, most), "id", "left_semi")
        assert kind in found._jdf.queryExecution().toString() and found.count() == 50
