"""Centroid clustering by plain Lloyd rounds in whole numbers.

Each round is one pass over the vectors: the centroids are broadcast, a task
finds for each of its vectors the nearest one in NumPy, and hands on one row of
whole-number sums for each cluster. These rows are added up by cluster, and the
new centroids, ``k`` rows whatever the table's size, come back to the driver.
Sums of whole numbers do not depend on their order, so a repeated task or
another partitioning changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors that a task compares at once; it bounds memory, not results.
ROWS = 4096
#: Largest size of a whole-number component, so that squared distances fit 64 bits: dims * (2 * LARGEST)^2 < 2^63 for up to 512 components.
LARGEST = 1 << 26
#: Most centroids and components; their product bounds what is collected and broadcast.
MOST_CENTROIDS, MOST_DIMS = 4096, 512
#: Distances are added up in two parts, by and below this base, so that no sum of a table's rows overflows.
BASE = 1 << 32


@dataclass(frozen=True)
class Model:
    """Centroids by number, and the clusters' inertia after the last assignment."""

    centroids: tuple[tuple[int, ...], ...]
    sizes: tuple[int, ...]
    inertia: tuple[int, ...]


def whole(vectors: pd.Series, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have just ``dims`` components, none null or non-finite, and those vectors' ``floor(scale * x)``."""
    there = np.array([x is not None and len(x) == dims for x in vectors], bool)
    own = np.array([np.asarray(x, np.float64) for x in vectors[there]], np.float64).reshape(-1, dims)
    finite = np.isfinite(own).all(1)
    there[there] = finite
    own = np.floor(own[finite] * scale)
    if (np.abs(own) > LARGEST).any():
        raise ValueError(f"a component times {scale} is beyond {LARGEST}, so squared distances do not fit 64 bits")
    return there, own.astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector, the lowest of equally near ones, and the squared distance."""
    squared = np.empty((len(centroids), len(vectors)), np.int64)
    for j, centroid in enumerate(centroids):
        apart = vectors - centroid
        squared[j] = np.einsum("ij,ij->i", apart, apart)
    cluster = squared.argmin(0)
    return cluster, squared[cluster, np.arange(len(vectors))]


def _lots(frames: Iterator[pd.DataFrame], dims: int, scale: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in frames:
        for a in range(0, len(frame), ROWS):
            lot = frame.iloc[a : a + ROWS]
            there, vectors = whole(lot["vector"], dims, scale)
            if len(vectors):
                yield lot[there], vectors


def _sums(table: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> list:
    """For each cluster with vectors: their number, summed distance and summed components."""
    sent = table.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(sent.value)
        size, high, low, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, vectors in _lots(frames, dims, scale):
            cluster, distance = nearest(vectors, sent.value)
            size += np.bincount(cluster, minlength=k)
            np.add.at(high, cluster, distance // BASE)
            np.add.at(low, cluster, distance % BASE)
            np.add.at(total, cluster, vectors)
        own = np.flatnonzero(size)
        if len(own):
            yield pd.DataFrame({"cluster": own.astype(np.int32), "size": size[own], "high": high[own], "low": low[own], "total": list(total[own])})

    parts = table.mapInPandas(run, "cluster int, size long, high long, low long, total array<long>")
    wide = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(dims)]
    rows = parts.groupBy("cluster").agg(F.sum("size").alias("size"), F.sum("high").alias("high"), F.sum("low").alias("low"), *wide).collect()  # at most k rows
    sent.unpersist()
    return [(r["cluster"], r["size"], r["high"] * BASE + r["low"], [int(r[f"t{i}"]) for i in range(dims)]) for r in rows]


def _seeds(table: DataFrame, k: int, dims: int, scale: int, salt: str) -> np.ndarray:
    """The whole-number vectors with the ``k`` smallest hashes of their ids; rows of one id in the order of their vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple] = []
        for lot, vectors in _lots(frames, dims, scale):
            best = sorted(best + list(zip(lot["hash"], map(tuple, vectors.tolist()), strict=True)))[:k]
        if best:
            yield pd.DataFrame({"hash": [h for h, _ in best], "whole": [list(v) for _, v in best]})

    hashed = table.filter("id IS NOT NULL").select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("hash"), "vector")
    found = hashed.mapInPandas(run, "hash string, whole array<long>").orderBy("hash", "whole").limit(k)
    return np.array([r["whole"] for r in found.collect()], np.int64).reshape(-1, dims)


def _table(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))


def lloyd(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> Model:
    """Centroids of all vectors after ``rounds`` rounds, with the sizes and inertia of their clusters.

    Kept are vectors of just ``dims`` components, none null or non-finite, as
    whole numbers ``floor(scale * x)``. The first centroids are the ``k`` kept
    vectors whose ``sha256(salt + id)`` (lowercase hex) is smallest, in that order.
    In each round every vector goes to its nearest centroid (squared distance;
    ties: the smaller number), and each centroid that got vectors becomes their
    ``floor(sum / count)``.
    Defined results: fewer than ``k`` kept vectors give as many centroids, none
    give none; vectors with a null id are assigned but start no centroid; rows of
    one id count each. A component beyond ``LARGEST`` is an error, since its
    squared distance fits no 64 bits.
    """
    if not (1 <= k <= MOST_CENTROIDS and 1 <= dims <= MOST_DIMS and rounds >= 0):
        raise ValueError(f"k must be 1 to {MOST_CENTROIDS}, dims 1 to {MOST_DIMS}, rounds 0 or more")
    table = _table(df, id_col, vector_col)
    centroids = _seeds(table, k, dims, scale, salt)
    if not len(centroids):
        return Model((), (), ())
    table = table.select("vector")
    for _ in range(rounds):
        now = centroids.copy()
        for cluster, size, _, total in _sums(table, centroids, dims, scale):
            now[cluster] = [t // size for t in total]
        centroids = now
    sizes, inertia = [0] * len(centroids), [0] * len(centroids)
    for cluster, size, far, _ in _sums(table, centroids, dims, scale):
        sizes[cluster], inertia[cluster] = size, far
    return Model(tuple(map(tuple, centroids.tolist())), tuple(sizes), tuple(inertia))


def assigned(df: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """One row for each kept vector (see ``lloyd``): its id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and the ``centroid_sha256``.

    Defined results: vectors that are not kept have no row; rows of one id have
    one each; other columns of ``df``, whatever their names, are left out; an
    empty table, or a model without centroids, gives an empty one.
    """
    kind = df.schema[id_col].dataType
    carried = T.StringType() if isinstance(kind, T.IntegralType) else kind  # pandas makes whole numbers beside nulls inexact
    schema = T.StructType([T.StructField("id", carried)]).add("cluster", "integer").add("distance", "long")
    centroids = np.array(model.centroids, np.int64).reshape(-1, dims)
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot, vectors in _lots(frames, dims, scale):
            if len(sent.value):
                cluster, distance = nearest(vectors, sent.value)
                yield pd.DataFrame({"id": lot["id"].array, "cluster": cluster.astype(np.int32), "distance": distance})

    out = _table(df, id_col, vector_col).withColumn("id", F.col("id").cast(carried)).mapInPandas(run, schema).withColumn("id", F.col("id").cast(kind))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids]
    of_cluster = F.element_at(_literals(model.inertia, "bigint"), F.col("cluster") + 1)
    digest = F.element_at(_literals(digests, "string"), F.col("cluster") + 1)
    return out.select(F.col("id").alias(id_col), "cluster", "distance", of_cluster.alias("cluster_inertia"), F.lit(sum(model.inertia)).cast("long").alias("inertia"), digest.alias("centroid_sha256"))


def _literals(values, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """``lloyd`` and then ``assigned``: every kept vector with its cluster."""
    return assigned(df, lloyd(df, id_col, vector_col, k, rounds, dims, scale, salt), id_col, vector_col, dims, scale)
