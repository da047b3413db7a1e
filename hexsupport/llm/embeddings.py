"""Embedding near-dedup by sorted projection passes, and an exact check after them.

The vectors of a label are dealt into blocks by hash, and every pair of blocks
meets in one row. There, in several passes, the vectors are ordered
lexicographically by concatenated random hashes (signs of random projections);
vectors within a window of this order are compared, and verified pairs are united
across the passes. Windows miss links where a label is large or dense, and links
are to be counted, so an exact check follows: inside a block vectors stand in
slices of near ones; a pair of slices whose angle bounds rule out a link is
skipped. The others are multiplied in single precision, and again in double
precision where a cosine is too near the threshold to tell. A pair of blocks
gives counts and a union-find forest, never its pairs. The cost grows with the
square of a label's size as far as the bounds do not rule out. Equal vectors
collapse first, so copies cost nothing; vectors travel as they came (4 bytes a
component for floats).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexsupport.llm.components import components
from hexsupport.llm.linking import looked_up
from hexsupport.llm.store import Workspace, bound_batches

#: Vectors in a block at least, bytes of vectors in a block at most, and vectors in a slice.
BLOCK, BLOCK_BYTES, SLICE = 256, 1 << 22, 128
#: Blocks that a label is dealt into until these are of BLOCK_BYTES.
BLOCKS = 4
#: Passes, random hashes that are concatenated in each, and places of its order by which compared vectors are apart at most.
PASSES, HASHES, WINDOW = 4, 32, 8


def _units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision from rows of finite numbers that are not all zero."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def _unpacked(row: dict, kind: str) -> np.ndarray:
    return _units(np.frombuffer(row["vectors" + kind], np.dtype(f"f{len(row['vectors' + kind]) // (len(row['nodes' + kind]) // 8) // row['size']}")).reshape(-1, row["size"]))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, size, node, vector): the components as they came; null where a vector links with nothing."""
    for batch in batches:
        node, vector, label, sizes = [], [], [], []
        for own, group in zip(batch.column("embedding"), batch.column("label").to_pylist(), strict=True):
            x = None
            if own.is_valid and group is not None and len(own) and not own.values.null_count:
                x = own.values.to_numpy(zero_copy_only=False)
                x = x if np.isfinite(x).all() and x.any() else None
            if x is None:
                found = (None, None, None, None)
            else:
                group = f"{len(x)}:{group}"
                digest = xxhash.xxh3_64_intdigest(group.encode() + _units(x[None]).tobytes())
                found = (int(np.uint64(digest).astype(np.int64)), x.tobytes(), group, len(x))
            for to, value in zip((node, vector, label, sizes), found, strict=True):
                to.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(label, pa.string()), pa.array(sizes, pa.int32()), pa.array(node, pa.int64()), pa.array(vector, pa.binary())], ["vec_id", "label", "size", "node", "vector"])


def _order(x: np.ndarray) -> np.ndarray:
    """An order of the rows of ``x`` in which near ones stand together: halved along the line between far ones."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= SLICE:
            out.append(own)
            continue
        some = x[own]
        a = some[(some @ some.mean(0)).argmin()]
        b = some[(some @ a).argmin()]
        # whole slices in the first half, so that slices never straddle a cut
        half = (len(own) // SLICE + 1) // 2 * SLICE
        near = own[np.argsort(some @ (b - a), kind="stable")]
        todo += [near[half:], near[:half]]
    return np.concatenate(out)


def _block(table: pa.Table) -> pa.Table:
    """A block of a label as one row."""
    size, raw = table.column("size")[0].as_py(), table.column("vector").to_pylist()
    x = np.frombuffer(b"".join(raw), np.dtype(f"f{len(raw[0]) // size}")).reshape(-1, size)
    order = _order(_units(x))
    return pa.table({
        "label": table.column("label")[:1], "block": table.column("block")[:1], "blocks": table.column("blocks")[:1], "size": table.column("size")[:1],
        "nodes": pa.array([table.column("node").to_numpy()[order].tobytes()], pa.binary()),
        "times": pa.array([table.column("times").to_numpy()[order].tobytes()], pa.binary()),
        "vectors": pa.array([x[order].tobytes()], pa.binary()),
    })


def _passes(x: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, rows) of ``x`` that link, from windows of the orders by concatenated random hashes."""
    for k in range(PASSES):
        planes = np.random.default_rng(k).standard_normal((x.shape[1], HASHES))
        key = np.packbits(x @ planes >= 0, axis=1).astype(np.uint64)
        key = (key << np.arange(HASHES - 8, -1, -8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        order = np.argsort(key, kind="stable")
        own = x[order]
        for apart in range(1, min(WINDOW + 1, len(x))):
            near = (own[apart:] * own[:-apart]).sum(axis=1) >= reach
            yield order[apart:][near], order[:-apart][near]


def _bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each slice a centre of unit length, and the largest angle from it."""
    centres, spread = [], []
    for k in range(0, len(x), SLICE):
        own = x[k : k + SLICE]
        centre = own.mean(0)
        norm = np.sqrt((centre * centre).sum())
        centre = centre / norm if norm > 1e-9 else own[0]
        centres.append(centre)
        spread.append(np.arccos(np.clip(own @ centre, -1, 1)).max())
    return np.array(centres), np.array(spread)


def _meet(x: np.ndarray, y: np.ndarray, reach: float, same: bool):
    """(rows of ``x``, rows of ``y``, whether they link) of all slices that bounds do not rule out."""
    (cx, rx), (cy, ry) = _bounds(x), _bounds(y)
    widest = np.arccos(np.clip(reach, -1, 1)) + 1e-6
    may = np.arccos(np.clip(cx @ cy.T, -1, 1)) <= widest + rx[:, None] + ry[None, :]
    single_x, single_y, slack = x.astype(np.float32), y.astype(np.float32), 1e-6 * (x.shape[1] + 8)
    for k, row in enumerate(may):
        i = np.arange(k * SLICE, min(len(x), (k + 1) * SLICE))
        j = np.flatnonzero(np.repeat(row, SLICE)[: len(y)])
        if not len(j):
            continue
        close = single_x[i] @ (single_y if len(j) == len(y) else single_y[j]).T
        near = close >= reach - slack
        if same:
            near &= i[:, None] != j[None, :]
        if not near.any():
            continue
        if (near & (close < reach + slack)).any():
            near &= x[i] @ y[j].T >= reach
        yield i, j, near


def _links(reach: float):
    """(node, other, links): of each vector of a pair of blocks how many it links with, and the least vector it is joined to by these links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):  # one at a time: a row holds two blocks
                row = batch.slice(at, 1).to_pylist()[0]
                same = row["nodes_b"] is None
                nodes, times = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["times"], np.int64)
                x = _unpacked(row, "")
                y, shift = x, 0
                if not same:
                    y, shift = _unpacked(row, "_b"), len(nodes)
                    nodes, times = np.concatenate([nodes, np.frombuffer(row["nodes_b"], np.int64)]), np.concatenate([times, np.frombuffer(row["times_b"], np.int64)])
                root, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)

                def unite(these: np.ndarray) -> None:
                    joined = np.unique(root[these])
                    if len(joined) > 1:
                        root[np.isin(root, joined)] = joined[0]

                for i, j in _passes(x if same else np.concatenate([x, y]), reach):
                    for pair in np.stack([i, j], 1)[root[i] != root[j]]:
                        unite(pair)
                for i, j, near in _meet(x, y, reach, same):
                    j = j + shift
                    links[i] += near @ times[j]
                    if not same:
                        links[j] += near.T @ times[i]
                    for k in np.flatnonzero(near.any(1)).tolist():
                        own = j[near[k]]
                        if (root[own] != root[i[k]]).any():
                            unite(np.append(own, i[k]))
                has = np.flatnonzero(links)
                if len(has):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[has]), pa.array(nodes[root[has]]), pa.array(links[has])], ["node", "other", "links"])

    return run


def near_duplicates(vectors: DataFrame, reach: float = 0.93) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Vectors of one label and length link when their cosine in double precision
    is ``reach`` or more. Defined results: vectors that are null, empty, zero or
    hold a null or non-finite component, and vectors without a label, link with
    nothing, are their own component and kept. Rows with equal vectors link.
    ``component_id`` is the smallest non-null vec_id reachable; a row with a null
    vec_id is kept only where its component has no other id. Every row has its
    result, also repeated ones; other columns, whatever their names, are ignored.
    Vectors of one label whose 64-bit digests clash would count as equal. An
    empty table gives an empty one.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    ws = Workspace(spark, "embeddings")
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    placed = ws.write(rows.mapInArrow(_nodes, "vec_id long, label string, size int, node long, vector binary"))
    every = placed.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("times"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("size").alias("size"), F.first("vector").alias("vector"))
    every = ws.write(every)

    sizes = every.groupBy("label").agg(F.count("*").alias("n"), F.max(F.length("vector")).alias("bytes")).filter("n > 1")
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / F.col("bytes")))
    wanted = F.least(most, F.greatest(F.lit(BLOCK), F.ceil(F.col("n") / BLOCKS)))
    sizes = sizes.select("label", F.ceil(F.col("n") / wanted).cast("int").alias("blocks"))
    dealt = every.join(sizes, "label").select("label", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks", "size", "node", "times", "vector")
    blocks = ws.write(dealt.groupBy("label", "block").applyInArrow(_block, "label string, block int, blocks int, size int, nodes binary, times binary, vectors binary"))
    data = ("nodes", "times", "vectors")
    left = blocks.filter("block + 1 < blocks").withColumn("block_b", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    right = blocks.filter("block > 0").select("label", F.col("block").alias("block_b"), *(F.col(c).alias(f"{c}_b") for c in data)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block_b") - 1)))
    met = left.join(right, ["label", "block", "block_b"]).select("size", *data, *(f"{c}_b" for c in data))
    alone = blocks.select("size", *data, *(F.lit(None).cast("binary").alias(f"{c}_b") for c in data))
    met = met.unionByName(alone)
    links = ws.write(met.mapInArrow(_links(reach), "node long, other long, links long"))
    groups = ws.write(components(links.select(F.col("node").alias("a"), F.col("other").alias("b")), ws))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))

    nodes = every.select("node", "times", "first").join(groups.withColumnRenamed("id", "node"), "node", "left").join(counts, "node", "left")
    nodes = ws.write(nodes.withColumn("component", F.coalesce("component", "node")))
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    nodes = looked_up(nodes, least, "component", ws)
    nodes = ws.write(nodes.select("node", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    rows = placed.select("vec_id", "node")
    linked = looked_up(rows.filter("node IS NOT NULL"), nodes, "node", ws)
    out = linked.unionByName(rows.filter("node IS NULL"), allowMissingColumns=True)
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
