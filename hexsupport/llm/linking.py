"""Groups of similar things from shared keys, without emitting all pairs of a group.

Neighbours under each key are probed first, the most promising one for each
node, and joined into groups. Then all pairs under a key that lie in *different*
groups are probed. Pairs within a group need no proof: they are reachable. So a
group of copies costs its size, and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexsupport.llm.components import HOT_SHARE, components
from hexsupport.llm.store import Workspace

#: Nodes with at most so many keys carry them along, so that a pair is made once, at its first common key.
CARRIED = 64


def looked_up(rows: DataFrame, names: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """``rows`` joined with ``names``, which has one row for each of their keys, none of them null.

    Rows of a hot key stay in the tasks that read them, so none gets them all.
    """
    counts = ws.write(rows.groupBy(key).agg(F.count("*").alias("times")))
    total = counts.agg(F.sum("times")).first()[0] or 0
    hot = counts.filter(F.col("times") * HOT_SHARE > total).select(key)
    hot = ws.write(names.join(F.broadcast(hot), key, "left_semi"))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(names, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def grouped(nodes: DataFrame, fits: Callable[..., Column], least: Callable[..., Column], probe: Callable[[DataFrame], DataFrame], ws: Workspace) -> DataFrame:
    """``(id, component)`` of the nodes that link with another, from ``nodes(node, n, s, tokens)``.

    ``tokens`` are a node's keys in one order for all nodes; ``n`` and ``s`` are sizes.
    ``fits(n, s, m, t)``: nodes of these sizes can link. ``least(n, m)``: the common
    keys that they need. ``probe(pairs)``: the pairs (a, b) that link.
    """
    carried = F.when(F.size("tokens") <= CARRIED, F.col("tokens"))
    entries = nodes.select("node", "n", "s", carried.alias("own"), F.size("tokens").alias("of_own"), F.posexplode("tokens").alias("place", "token"))

    def can(df: DataFrame) -> DataFrame:
        return df.filter(fits(F.col("n"), F.col("s"), F.col("m"), F.col("t")))

    # first candidates: the neighbour by size, and the node in the most and longest lists, of each token
    lengths = entries.groupBy("token").agg(F.count("*").alias("of"))
    ranked = entries.join(lengths, "token")
    weight = ranked.groupBy("node").agg(F.sum("of").alias("weight"))
    ranked = ranked.filter("of > 2").join(weight, "node")
    by_size = Window.partitionBy("token").orderBy("n", "node")
    near = entries.select("node", "n", "s", *(F.lag(c).over(by_size).alias(x) for c, x in (("node", "a"), ("n", "m"), ("s", "t")))).filter("a IS NOT NULL")
    hubs = ranked.groupBy("token").agg(F.max(F.struct("weight", "s", "n", "node")).alias("hub"))
    hubs = hubs.select("token", F.col("hub.node").alias("a"), F.col("hub.n").alias("m"), F.col("hub.s").alias("t"))
    hubs = entries.join(hubs, "token").filter("node <> a")
    best = []
    for found in (near, hubs.select(near.columns)):
        pairs = can(found).groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("merged"))
        best.append(pairs.groupBy("b").agg(F.max_by("a", F.struct("merged", "a")).alias("a")))
    pairs = best[0].unionByName(best[1]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = probe(pairs)
    groups = components(links, ws)

    # then every pair of a token between different groups, at the first token that both have:
    # nodes that need r common tokens have it among all but the last r - 1 of each
    placed = entries.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("token")
    placed = ws.write(placed.join(mixed, "token").select("token", "node", "n", "s", "component", "own", "of_own", "place"))
    names = {"node": "b", "n": "m", "s": "t", "component": "other", "own": "its", "of_own": "of_its", "place": "at"}
    other = placed.select("token", *(F.col(c).alias(x) for c, x in names.items()))
    need, common = least(F.col("n"), F.col("m")), F.array_intersect("own", "its")
    known = F.col("own").isNotNull() & F.col("its").isNotNull()
    first = (F.col("place") <= F.col("of_own") - need) & (F.col("at") <= F.col("of_its") - need) & (F.size(common) >= need) & (F.get(common, F.lit(0)) == F.col("token"))
    across = can(placed.withColumnRenamed("node", "a").join(other, "token").filter(F.col("component") < F.col("other"))).filter(F.when(known, first).otherwise(True))
    across = across.groupBy("a", "b").agg(F.count("*").alias("merged"), F.bool_or(known).alias("known"), F.first("n").alias("n"), F.first("m").alias("m"))
    across = across.filter(F.col("known") | (F.col("merged") >= need)).select("a", "b")
    return components(links.unionByName(probe(across)), ws)
