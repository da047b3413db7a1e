"""Connected components of an edge table by distributed union-find.

Each partition first contracts its own edges with a union-find forest; then
alternating large-star and small-star rounds (Kiveris et al., 2014) run as
joins and partially aggregated minima until the table is a forest of stars.
No link is ever collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexsupport.llm.store import Workspace

#: A key that holds more than one in so many of all rows is looked up by broadcast; so there are fewer such keys than this.
HOT_SHARE = 1000


class Forest:
    """Union-find with path halving; the smallest member is the root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, forest, kinds = None, Forest(), None

    def drain():
        pairs = [(x, forest.find(x)) for x in forest.parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], kinds), pa.array([r for _, r in pairs], kinds)], schema=schema)

    for batch in batches:
        schema, kinds = batch.schema, batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.parent) > 500_000:  # bounds the worker's memory, not the result
            yield drain()
            forest = Forest()
    if schema is not None:
        yield drain()


def components(edges: DataFrame, ws: Workspace, max_rounds: int = 100) -> DataFrame:
    """``(id, component)`` for every id that ``edges(a, b)`` links with another.

    ``component`` is the smallest id reachable. Null ends and loops are ignored;
    no edges give an empty table. ``a`` and ``b`` must have one orderable type.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    star = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(high.alias("u"), low.alias("v"))
    now = ws.write(star.mapInArrow(_contract, star.schema).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        # large-star: each edge hangs its high end below the least neighbour of its low end, where that has one below itself
        below = now.groupBy("u").agg(F.min("v").alias("m"))
        hubs = now.groupBy("v").agg(F.count("*").alias("times")).filter(F.col("times") * HOT_SHARE > mark[0]).select("v")
        hubs = hubs.join(below.withColumnRenamed("u", "v"), "v", "left").select("v", F.coalesce("m", "v").alias("top"))
        marked = now.join(F.broadcast(hubs), "v", "left")
        others = marked.filter("top IS NULL").select("u", "v").join(below.withColumnRenamed("u", "v"), "v", "left")
        large = marked.filter("top IS NOT NULL").select("u", F.col("top").alias("v")).unionByName(others.select("u", F.coalesce("m", "v").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, now = now, ws.write(small.distinct())
        ws.drop(before)
    else:
        raise RuntimeError("components did not settle")
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
