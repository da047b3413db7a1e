"""N-gram Jaccard join: exact set-similarity linking of documents by T-occurrence search.

Two documents link when their shingle sets reach the threshold. A document of n
shingles must share T = ceil(j / (1 + j) * (n + m)) of them with a partner of m.
DivideSkip divides inverted lists by length, merges the short ones with a heap
and probes the long ones by binary search for what the merge admits. Lists over
the whole corpus fit no task, so it works on two levels: over the corpus, each
document's ``n - ceil(j n) + 1`` shortest lists (rarest shingle first in one
global order) meet by an equi-join that says who may link at all; among those,
``reaching`` runs DivideSkip over the whole sets and settles every link.

1. Digest: each text's set size and a 64-bit digest of its set. Equal sets are
   one node from here on, so exact copies cost nothing further.
2. Postings: every task packs (shingle, node) into blobs by shingle bucket; a
   bucket's lists are sorted, and lists of length one, which can admit nobody,
   end there.
3. Short lists: the rest comes back by node, which keeps its shortest.
4. Probes: pairs whose merged count can still reach T are settled by DivideSkip
   over the whole sets, each node against its candidates of a batch; neighbours
   by size first, then pairs between the groups that these make (see ``linking``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexsupport.llm.linking import grouped, looked_up
from hexsupport.llm.shingles import BASE, shingle_sets
from hexsupport.llm.store import Workspace, bound_batches, buckets_for, lean, small, unused

#: Documents and shingles that a task packs at once.
PACK_DOCS, PACK_SHINGLES = 60_000, 1_000_000
#: A shingle of more documents than this in one pack has its list dealt apart from its bucket, and counts as longest.
HOT = 4096
#: Sets that a task remembers as packed; forgetting costs repeated entries, which collapse later.
REMEMBERED = 200_000
LONGEST = 1 << 40
#: Weight of a longest list's logarithm in the number of lists that are probed, not merged.
SKIP_WEIGHT = 0.0085
#: Bits of a shingle's hash that lists leave out.
CUT = np.uint64(16)
#: Documents (16 bytes each) that are broadcast to pick texts out of a scan; more are joined by shuffling.
BROADCAST_ROWS = 100_000


def node_of(own: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def _digests(width: int):
    """(doc_id, row, n_shingles, n_tokens, node): ``n_tokens`` lists hold a set's shingles, fewer where two share the bits that lists keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            n, kinds, node = [], [], []
            for own in shingle_sets(batch.column("text"), width):
                token = own >> CUT
                n.append(len(own))
                kinds.append(int((token[1:] != token[:-1]).sum()) + bool(len(own)))
                node.append(node_of(own))
            counts = [pa.array(x, pa.int64()) for x in (n, kinds, node)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *counts], ["doc_id", "row", "n_shingles", "n_tokens", "node"])

    return run


_PACKED = "bucket long, tops binary, tails binary, owners binary, nodes binary, marks binary"


def _pack(width: int, buckets: int, most: int):
    """Blobs of a task's lists by bucket; equal sets of a task are packed once as far as it remembers.

    Entries of hot lists go to further buckets, where all are kept; one entry and a mark stay behind.
    """
    names = ["bucket", "tops", "tails", "owners", "nodes", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        seen: set[int] = set()

        def drain() -> pa.RecordBatch:
            token = np.concatenate(sets) >> CUT
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            bucket, marks = (token % np.uint64(buckets)).astype(np.int64), np.zeros(0, np.uint64)
            if len(sets) > most:
                order = np.argsort(token, kind="stable")
                start = np.flatnonzero(np.append(True, np.diff(token[order]) != 0))
                many = np.diff(np.append(start, len(token)))
                marks = token[order[start[many > most]]]
                hot = np.isin(token, marks)
                hot[order[start]] = False
                bucket[hot] = buckets + ((token[hot] + owner[hot] * BASE) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 15 else bucket, kind="stable")
            token, owner, bucket = token[order], owner[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            kept = bucket[cuts]
            cuts = [*cuts.tolist(), len(bucket)]
            parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            tops, tails = (token >> np.uint64(16)).astype(np.uint32), (token & np.uint64(0xFFFF)).astype(np.uint16)
            used = []
            for p in parts:  # a bucket's blob carries only the nodes that it refers to
                mine, owner[p] = np.unique(owner[p], return_inverse=True)
                used.append(np.array(nodes, np.int64)[mine].tobytes())
            blobs = [[x[p].tobytes() for p in parts] for x in (tops, tails, owner)]
            own = (marks % np.uint64(buckets)).astype(np.int64)
            marked = [marks[own == k].tobytes() if len(marks) else b"" for k in kept.tolist()]
            nodes.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept), *(pa.array(x, pa.binary()) for x in (*blobs, used, marked))], names)

        held = 0
        for batch in batches:
            for own in shingle_sets(batch.column("text"), width):
                if not len(own) or (node := node_of(own)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                sets.append(own)
                held += len(own)
                if held > PACK_SHINGLES or len(nodes) >= PACK_DOCS:
                    yield drain()
                    held = 0
        if nodes:
            yield drain()

    return run


def _lists(buckets: int):
    """A bucket's (node, rank, token) for tokens that at least two nodes have; rank is the list's length."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        tokens, nodes = [], []
        for tops, tails, owners, ids in zip(*(table.column(c) for c in ("tops", "tails", "owners", "nodes")), strict=True):
            tokens.append(np.frombuffer(tops.as_py(), np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(tails.as_py(), np.uint16))
            nodes.append(np.frombuffer(ids.as_py(), np.int64)[np.frombuffer(owners.as_py(), np.uint16)])
        token, node = np.concatenate(tokens), np.concatenate(nodes)
        marks = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("marks")]))
        apart = table.column("bucket")[0].as_py() >= buckets
        order = np.argsort(token, kind="stable")
        token, node = token[order], node[order]
        marked = np.full(len(token), apart) if apart or not len(marks) else np.isin(token, marks)
        same = np.append(False, token[1:] == token[:-1])
        shared = same | np.append(same[1:], False) | marked
        token, node, marked = token[shared], node[shared], marked[shared]
        order = np.lexsort((node, token))  # a node that several tasks packed counts once
        token, node, marked = token[order], node[order], marked[order]
        fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))[: len(token)]
        token, node, marked = token[fresh], node[fresh], marked[fresh]
        _, place, length = np.unique(token, return_inverse=True, return_counts=True)
        rank = np.where(marked, LONGEST, length[place]) if len(token) else np.zeros(0, np.int64)
        many = rank > 1
        return pa.table({"node": node[many], "rank": rank[many].astype(np.int64), "token": token[many].astype(np.int64)})

    return run


def reaching(probe: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The places of the ``sets`` that link with ``probe``, by DivideSkip over the inverted lists of its shingles.

    All sets are sorted and distinct. The lists are divided by length: a heap
    merges the short ones, and the sets that they bring near enough to the
    overlap they need are searched by halving in the ``skip`` longest.
    """
    n, size = len(probe), len(sets)
    m = np.array([len(s) for s in sets], np.int64)
    need = np.maximum(-(-num * (n + m) // (num + den)), 1)
    can = need <= np.minimum(n, m)
    if not can.any():
        return np.zeros(0, np.int64)
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(size), m)
    at = np.minimum(np.searchsorted(probe, shingle), n - 1)
    hit = probe[at] == shingle
    entry = np.sort(at[hit] * size + owner[hit])  # the lists one after another, each by set
    length = np.bincount(entry // size, minlength=n)
    ends = np.cumsum(length)
    by_length = np.argsort(length, kind="stable")
    least, longest = int(need[can].min()), int(length.max())
    skip = min(least - 1, int(least / (SKIP_WEIGHT * np.log2(max(longest, 1)) + 1)))
    short, long = by_length[: n - skip], by_length[n - skip :]
    merged = np.zeros(size, np.int64)
    for k in heapq.merge(*((entry[ends[i] - length[i] : ends[i]] % size).tolist() for i in short.tolist() if length[i])):
        merged[k] += 1
    admitted = np.flatnonzero(can & (merged >= need - skip))
    if skip and len(admitted) and len(entry):
        wanted = (long[:, None] * size + admitted).ravel()
        place = np.minimum(np.searchsorted(entry, wanted), len(entry) - 1)
        merged[admitted] += (entry[place] == wanted).reshape(skip, len(admitted)).sum(axis=0)
    return admitted[merged[admitted] >= need[admitted]]


def _probe(width: int, num: int, den: int):
    """The pairs (a, b) whose whole sets reach the threshold; the pairs of a batch that share a node are settled together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            first = {c: np.unique(batch.column(c).to_numpy(), return_index=True, return_inverse=True)[1:] for c in ("a", "b")}
            one, other = ("a", "b") if len(first["a"][0]) < len(first["b"][0]) else ("b", "a")
            rows, group = first[one]
            order = np.argsort(group, kind="stable")
            texts = batch.column(f"text_{other}").take(pa.array(order))
            found, keep, place = shingle_sets(texts, width), [], 0
            for probe, many in zip(shingle_sets(batch.column(f"text_{one}").take(pa.array(rows)), width), np.bincount(group).tolist(), strict=True):
                sets = [next(found) for _ in range(many)]
                keep.append(order[place + reaching(probe, sets, num, den)])
                place += many
            kept = np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.int64)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return run


def linked(documents: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Documents link when ``den * intersection >= num * union`` of their shingle
    sets; ``component_id`` is the smallest id reachable by links, its own
    included. Defined results: null, empty or wordless texts have no shingles
    and link with nothing; rows that repeat an id are judged by their own text
    each; a null id is never a component id, so rows with null ids that link
    with no other id have a null component. Ids are whole numbers, or texts of
    such; texts of any length are read whole. An empty table gives an empty one.
    Other columns of the input are ignored.
    """
    return _grouped(documents, width, num, den, id_col, text_col).drop("node", "group")


def _grouped(documents: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``linked`` with the row's ``node``, and the ``group`` of nodes that it belongs to (null without shingles)."""
    spark = documents.sparkSession
    bound_batches(spark)
    ws = Workspace(spark, "ngrams")
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    docs = documents.select(key.alias("doc_id"), F.xxhash64(key, text).alias("row"), text.alias("text"))
    digest = ws.write(docs.mapInArrow(_digests(width), "doc_id long, row long, n_shingles long, n_tokens long, node long"))
    nodes = digest.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.min("row").alias("row"), F.max("n_shingles").alias("n"), F.max("n_tokens").alias("of"))

    buckets = buckets_for(spark, (digest.agg(F.sum("n_shingles")).first()[0] or 0) * 14)
    packed = docs.select("text").mapInArrow(_pack(width, buckets, HOT), _PACKED)
    shared = packed.groupBy("bucket").applyInArrow(_lists(buckets), "node long, rank long, token long")
    owned = shared.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("rank", "token"))).alias("lists"))
    # of n shingles, n - ceil(n j) + 1 lists are short; the lists of length one, which end above, stand before these
    short = F.size("lists") - F.ceil(F.col("n") * num / den) + 1 + F.col("n") - F.col("of")
    short = owned.join(nodes, "node").withColumn("short", short.cast("int")).filter("short > 0")
    short = ws.write(short.select("node", "row", "n", F.slice("lists", 1, F.col("short")).getField("token").alias("tokens")))

    def least_merged(n: Column, m: Column) -> Column:
        """The common short lists that, with all that the long lists can add, just reach T."""
        reach = F.ceil((n + m) * num / (num + den))
        return reach - F.greatest(F.ceil(n * num / den), F.ceil(m * num / den)) + 1

    def fits(n: Column, s: Column, m: Column, t: Column) -> Column:
        return (F.least(n, m) * den >= F.greatest(n, m) * num) & (F.least(s, t) >= least_merged(n, m))

    def probed(pairs: DataFrame) -> DataFrame:
        pairs = ws.write(pairs.select("a", "b"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        found = ws.write(wanted.join(short.select("node", "row"), "node"))
        found = F.broadcast(found) if small(found, BROADCAST_ROWS) else found
        texts = docs.select("row", "text").join(found, "row").select("node", "text").dropDuplicates(["node"])
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return ws.write(both.mapInArrow(_probe(width, num, den), "a long, b long"))

    groups = grouped(short.select("node", "n", F.size("tokens").alias("s"), "tokens"), fits, least_merged, probed, ws)
    # names of groups go to nodes first, each of which is one row, and then to rows
    placed = ws.write(nodes.select("node", "doc").join(groups.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("group", F.coalesce("component", "node")))
    least = placed.groupBy("group").agg(F.min("doc").alias("component_id"))
    named = ws.write(looked_up(placed.select("node", "group"), least, "group", ws))
    full = looked_up(digest.filter("n_shingles > 0").select("node", "doc_id", "n_shingles"), named, "node", ws)
    empty = digest.filter("n_shingles = 0").select("node", "doc_id", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", "n_shingles", "node", "group", "component_id")


def _named(width: int, at: int, name: str):
    """The rows with their node as column ``name``; the text is the column at place ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            node = [node_of(own) for own in shingle_sets(batch.column(at), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], [*batch.schema.names, name])

    return run


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` without near copies: of each component the row with its smallest id stays.

    Rows whose id is null stay, and rows that link with no other, also of a
    repeated id; so null, empty and wordless texts always stay. Where a
    component's smallest id is repeated in it, its first row by text stays. Texts
    of any length are compared whole. Columns pass through, whatever their names.
    An empty table gives an empty one.
    """
    id_col, text_col, width = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("width", 5)
    ws = Workspace(documents.sparkSession, "kept")
    found = ws.write(_grouped(documents, **options))
    doc = F.col(f"`{id_col}`").cast("long")
    key, node, own_node, group, least, rank = unused(documents, "id", "node", "own", "group", "least", "rank")
    lost = found.filter("doc_id <> component_id")
    repeated = ws.write(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(key)))
    if repeated.isEmpty():
        return documents.join(lost.select(F.col("doc_id").alias(key)).distinct(), doc == F.col(key), "left_anti")
    # of other ids the id names the row; of repeated ones the id and the shingles, and then the text
    gone = lost.select(F.col("doc_id").alias(key)).unionByName(repeated).distinct()
    single = documents.join(gone, doc == F.col(key), "left_anti")
    many = documents.join(repeated, doc == F.col(key), "left_semi")
    many = many.mapInArrow(_named(width, documents.columns.index(text_col), node), T.StructType([*many.schema.fields, T.StructField(node, T.LongType())]))
    own = found.join(repeated, F.col("doc_id") == F.col(key), "left_semi")
    own = own.select(F.col("doc_id").alias(key), F.col("node").alias(own_node), F.col("group").alias(group), F.col("component_id").alias(least)).distinct()
    many = many.join(own, (doc == F.col(key)) & (F.col(node) == F.col(own_node)))
    linking = many.filter(F.col(group).isNotNull() & (F.col(key) == F.col(least)))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(f"`{text_col}`")))
    first = linking.withColumn(rank, place).filter(F.col(rank) == 1)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return single.unionByName(many.filter(F.col(group).isNull()).select(*columns)).unionByName(first.select(*columns))
