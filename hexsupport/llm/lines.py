"""Line dedup: fuzzy lines by MinHash, one line of each component stays.

Lines are split at ``\\n``. Equal lines are one node. Its signature over
character shingles comes from one-permutation MinHash, in which empty places
take over from their neighbours; bands of the signature are keys.

1. Every task signs the lines that are new to it and packs (key, line) by bucket
   of keys; a bucket keeps the keys that two lines share. Keys with the same
   lines are one group, so copies that share all their bands are compared once.
2. A group is dealt into blocks of bounded size, each with the group's least
   line as hub. Within a block lines are compared by the exact Jaccard similarity
   of their shingles, outwards from lines already reached.
3. Links make components by distributed union-find. Groups of several blocks that
   still hold more than one component have their smaller components compared
   with all of their lines, block by block, so that no link is lost.
4. The line of a component that occurs first (by document id, then place) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexsupport.llm.components import Forest, components
from hexsupport.llm.shingles import MULTIPLIERS, mix
from hexsupport.llm.store import Workspace, bound_batches, buckets_for, lean, unused

#: Characters of a shingle; a shorter line is one shingle.
WIDTH = 8
#: Bands and rows of the signature: at a similarity of 0.8, a pair shares a band with probability 0.995.
BANDS, ROWS = 10, 4
PLACES = BANDS * ROWS
#: Bytes of lines that are signed at once, and (key, line) entries that a task packs at once.
SLICE, PACK = 1 << 16, 500_000
#: Lines that a task remembers as packed; forgetting costs repeated entries, which collapse later.
REMEMBERED = 100_000
#: A key of more lines than this in one pack is dealt apart from its bucket.
HOT = 2048
#: Lines, and characters unless it is one line, of a block.
BLOCK, BLOCK_CHARS = 512, 1 << 22
EMPTY = np.uint32(0xFFFFFFFF)
#: Lines of these characters alone, and empty ones, have no content.
BLANK = " \t\r\x0b\x0c"
#: The seed of 64-bit line ids; Spark's own function has the same.
SEED = 42

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_LOWER_BYTE = np.arange(256, dtype=np.uint32)
_LOWER_BYTE[65:91] += 32
_LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(line: str) -> set[str]:
    """The shingles by which lines are compared."""
    low = line.translate(_LOWER)
    return {low[i : i + WIDTH] for i in range(max(1, len(low) - WIDTH + 1))}


def _signatures(lines: list[bytes]) -> np.ndarray:
    """The signature of each line, as rows of ``PLACES`` numbers. Shingles are of bytes here; the exact comparison takes characters."""
    pieces, owner = lines, range(len(lines))
    if max(map(len, lines)) > SLICE:  # long lines go in overlapping pieces
        cut = [(k, x[i : i + SLICE + WIDTH - 1]) for k, x in enumerate(lines) for i in range(0, max(1, len(x) - WIDTH + 1), SLICE)]
        owner, pieces = zip(*cut, strict=True)
    flat, row = np.full(len(lines) * PLACES, EMPTY, np.uint32), 0
    while row < len(pieces):
        end, held = row, 0
        while end < len(pieces) and (held == 0 or held + len(pieces[end]) <= SLICE):
            held += len(pieces[end])
            end += 1
        size = np.array([len(x) for x in pieces[row:end]])
        c = _LOWER_BYTE[np.frombuffer(b"".join(pieces[row:end]) + bytes(WIDTH), np.uint8)]
        two = c[:-1] * _ODD[0] + c[1:]
        four = two[:-2] * _ODD[1] + two[2:]
        h = four[:held] * _ODD[2] + four[4 : held + 4]
        h ^= h >> np.uint32(16)
        h *= _ODD[3]
        h ^= h >> np.uint32(13)
        h *= _ODD[4]
        h ^= h >> np.uint32(16)
        place = ((h >> np.uint32(16)) * np.uint32(PLACES)) >> np.uint32(16)
        h *= _ODD[5]  # the place has used up the upper bits
        ends = np.cumsum(size)
        starts = ends - size
        tails = (ends[:, None] - np.arange(1, WIDTH)).ravel()  # what begins there reaches into the next line
        h[tails[(tails >= np.repeat(starts, WIDTH - 1))]] = EMPTY
        for k in np.flatnonzero(size < WIDTH).tolist():
            whole = xxhash.xxh3_64_intdigest(c[starts[k] : ends[k]].tobytes())
            h[starts[k]], place[starts[k]] = whole & 0xFFFFFFFF, (whole >> 32) % PLACES
        place += np.repeat(np.array(owner[row:end], np.uint32) * np.uint32(PLACES), size)
        np.minimum.at(flat, place, h)
        row = end
    out = flat.reshape(-1, PLACES)
    gaps = np.flatnonzero((out == EMPTY).any(axis=1))
    some = out[gaps]
    for _ in range(PLACES):  # an empty place takes over from its right neighbour
        gap = some == EMPTY
        if not gap.any():
            break
        some = np.where(gap, np.roll(some, -1, axis=1), some)
    out[gaps] = some
    return out


def _keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    banded = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), banded.shape[:2]).copy()
    for k in range(ROWS):
        total = mix(total * MULTIPLIERS[k] + banded[:, :, k])
    return total


_PACKED = "bucket long, keys binary, lines binary, marks binary"


def _blobs(key: np.ndarray, line: np.ndarray, buckets: int, most: int) -> pa.RecordBatch:
    """Entries by bucket. Those of hot keys go to further buckets, where all are kept; one entry and a mark stay behind."""
    order = np.argsort(key)
    key, line = key[order], line[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(start, len(key)))
    hot = np.repeat(many > most, many)
    marks = key[start[many > most]]
    cold = ~hot
    cold[start] = True
    bucket = np.where(cold, key % np.uint64(buckets), np.uint64(buckets) + mix(key + line.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, key, line = bucket[order], key[order], line[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    some, cuts = bucket[cuts], np.append(cuts, len(bucket))
    parts = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    own = (marks % np.uint64(buckets)).astype(np.int64)
    marked = [marks[own == b].tobytes() if len(marks) else b"" for b in some.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (key, line)), pa.array(marked, pa.binary())], ["bucket", "keys", "lines", "marks"])


def _pack(buckets: int, most: int):
    """(bucket, keys, lines, marks) of a task's bands; a task packs a line once as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        keys, lines, held, seen = [], [], 0, set()
        for batch in batches:
            fresh: dict[int, bytes] = {}
            for text in batch.column("text"):
                if text.is_valid:
                    for line in text.as_buffer().to_pybytes().split(b"\n"):
                        if line and (one := xxhash.xxh64_intdigest(line, SEED)) not in seen and not line.isspace():
                            seen.add(one)
                            fresh[one] = line
            if len(seen) > REMEMBERED:
                seen.clear()
            if fresh:
                keys.append(_keys(_signatures(list(fresh.values()))).ravel())
                lines.append(np.repeat(np.array(list(fresh), np.uint64).view(np.int64), BANDS))
                held += len(keys[-1])
            if held > PACK:
                yield _blobs(np.concatenate(keys), np.concatenate(lines), buckets, most)
                keys, lines, held = [], [], 0
        if keys:
            yield _blobs(np.concatenate(keys), np.concatenate(lines), buckets, most)

    return run


def _shared(buckets: int):
    """A bucket's (token, node): the lines of keys that at least two lines have; the token names the set of these lines."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        take = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)])
        key, line, marks = take("keys", np.uint64), take("lines", np.int64), np.unique(take("marks", np.uint64))
        order = np.argsort(key, kind="stable")
        key, line = key[order], line[order]
        apart = table.column("bucket")[0].as_py() >= buckets
        marked = np.full(len(key), apart) if apart or not len(marks) else np.isin(key, marks)
        same = np.append(False, key[1:] == key[:-1])
        some = same | np.append(same[1:], False) | marked
        key, line, marked = key[some], line[some], marked[some]
        order = np.lexsort((line, key))
        key, line, marked = key[order], line[order], marked[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))[: len(key)]
        key, line, marked = key[fresh], line[fresh], marked[fresh]
        if not len(key):
            return pa.table({"token": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.diff(np.append(start, len(key)))
        name = np.repeat(mix(np.add.reduceat(mix(line.view(np.uint64)), start) + many.astype(np.uint64)), many)
        token = np.where(marked, key, name).view(np.int64)
        kept = (np.repeat(many, many) > 1) | marked
        return pa.table({"token": token[kept], "node": line[kept]})

    return run


def _rolled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the shingle at each code point (A-Z lower-cased); a span shorter than a shingle has one, at its start."""
    chars = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    n = len(chars)
    padded = np.concatenate([chars, np.zeros(WIDTH, np.uint64)])
    two = padded[:-1] * MULTIPLIERS[1] + padded[1:]
    four = two[:-2] * MULTIPLIERS[2] + two[2:]
    rolled = mix(four[:n] * MULTIPLIERS[3] + four[4 : n + 4])
    for k in np.flatnonzero(ends - starts < WIDTH).tolist():
        own = chars[starts[k] : ends[k]]
        rolled[starts[k]] = mix((own * MULTIPLIERS[np.arange(len(own)) % 5] + np.arange(len(own), dtype=np.uint64)).cumsum(dtype=np.uint64)[-1:] * MULTIPLIERS[4] + np.uint64(len(own)))[0]
    return rolled


def _sets(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the distinct shingles of lines."""
    size = np.array([len(x) for x in texts])
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(size)
    starts = ends - size
    rolled, out = _rolled(data, starts, ends), []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        own = np.sort(rolled[a : max(a + 1, b - WIDTH + 1)])
        out.append(own[np.append(True, own[1:] != own[:-1])])
    return out


class Compared:
    """Lines side by side, one of which is held against all others at a time."""

    def __init__(self, texts: list[str], num: int, den: int):
        sets = _sets(texts)
        self.num, self.den = num, den
        self.size = np.array([len(x) for x in sets])
        self.starts = np.cumsum(self.size) - self.size
        kinds, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(kinds), np.int32)

    def near(self, x: int) -> np.ndarray:
        """Which lines link with line ``x``, itself included."""
        own = self.ids[self.starts[x] : self.starts[x] + self.size[x]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.ids], self.starts)
        self.mark[own] = 0
        return self.den * both >= self.num * (self.size + self.size[x] - both)


def _within(texts: list[str], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join all lines which links join."""
    if len(texts) == 2:
        a, b = _sets(texts)
        both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
        return [(0, 1)] if den * both >= num * (len(a) + len(b) - both) else []
    lines, links = Compared(texts, num, den), []
    left = np.ones(len(texts), bool)
    while left.sum() > 1:
        todo = [int(left.argmax())]
        left[todo[0]] = False
        while todo and left.any():
            x = todo.pop()
            found = np.flatnonzero(lines.near(x) & left).tolist()
            left[found] = False
            links += [(x, y) for y in found]
            todo += found
    return links


def _across(texts: list[str], kind: list[int], side: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links between lines of side 1 and lines of side 0 that join different components."""
    lines, links, forest = Compared(texts, num, den), [], Forest()
    kinds, other = np.array(kind), np.array(side) == 0
    for x in np.flatnonzero(~other).tolist():
        for y in np.flatnonzero(lines.near(x) & other & (kinds != kinds[x])).tolist():
            if forest.find(kind[x]) != forest.find(kind[y]):
                forest.union(kind[x], kind[y])
                links.append((x, y))
    return links


def _linked(num: int, den: int, keys: tuple[str, ...]):
    """Links (a, b) from rows that stand together by ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        rest = None

        def links(group: pa.RecordBatch) -> list[tuple[int, int]]:
            node, texts = group.column("node").to_pylist(), group.column("line_text").to_pylist()
            if len(node) < 2:
                return []
            found = _within(texts, num, den) if "side" not in group.schema.names else _across(texts, group.column("component").to_pylist(), group.column("side").to_pylist(), num, den)
            return [(node[x], node[y]) for x, y in found]

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            if not len(batch):
                continue
            fresh = np.zeros(len(batch), bool)
            for c in keys:
                own = batch.column(c).to_numpy(zero_copy_only=False)
                fresh[1:] |= own[1:] != own[:-1]
            cuts = [0, *np.flatnonzero(fresh).tolist()]
            rest = batch.slice(cuts[-1])  # it may go on in the next batch
            yield out([x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in links(batch.slice(a, b - a))])
        if rest is not None:
            yield out(links(rest))

    return run


def _content(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK)) != ""


def _once(value: Column, f) -> Column:
    """``f(value)``, with ``value`` evaluated once for a row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _links(docs: DataFrame, known: DataFrame, num: int, den: int, ws: Workspace) -> DataFrame:
    """(id, component) of the lines that link with another, from ``docs(row, text)`` and ``known(line, first)``."""
    buckets = buckets_for(docs.sparkSession, known.count() * BANDS * 16)
    packed = docs.select("text").mapInArrow(_pack(buckets, HOT), _PACKED)
    placed = ws.write(packed.groupBy("bucket").applyInArrow(_shared(buckets), "token long, node long").distinct())

    # the texts of these lines, from one document each
    wanted = ws.write(placed.select(F.col("node").alias("line")).distinct().join(known, "line").select("line", "first.row", "first.place"))
    of_row = wanted.groupBy("row").agg(F.collect_list(F.struct("place", F.col("line").alias("node"))).alias("wanted"))
    # by shuffling at every size: these documents grow with the corpus
    found = docs.join(of_row.hint("merge"), "row").select(F.explode(_once(F.split("text", "\n"), lambda parts: F.transform("wanted", lambda x: F.struct(x["node"].alias("node"), F.get(parts, x["place"]).alias("line_text"))))).alias("x"))
    dealt = ws.write(placed.join(found.select("x.*").dropDuplicates(["node"]), "node"))

    sizes = dealt.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.length("line_text")).alias("chars"), F.min("node").alias("hub"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.ceil(F.col("chars") / BLOCK_CHARS))).cast("int")
    large = ws.write(sizes.withColumn("blocks", blocks).filter("blocks > 1").select("token", "hub", "blocks"))
    several = not large.isEmpty()
    block = lambda of: F.pmod(F.xxhash64("node"), of).cast("int")
    if several:
        dealt = ws.write(dealt.join(large, "token", "left").select("token", "node", "line_text", "hub", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("block", block(F.col("blocks"))))
        hubs = dealt.filter("node = hub").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = dealt.filter("hub IS NULL OR node <> hub").unionByName(hubs).select("token", "block", "node", "line_text")
    else:
        rows = dealt.select("token", F.lit(0).alias("block"), "node", "line_text")
    keys = ("token", "block")
    links = ws.write(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked(num, den, keys), "a long, b long"))
    groups = components(links, ws)
    if not several:
        return groups

    at = dealt.filter("hub IS NOT NULL").join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    at = ws.write(at.select("token", "node", "line_text", "block", "blocks", "component"))
    shares = at.groupBy("token", "component").agg(F.count("*").alias("n"))
    most = shares.groupBy("token").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).filter("kinds > 1")
    most = most.select("token", F.col("most.component").alias("largest"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("others"))
    at = at.join(most, "token")
    every = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("side", F.lit(0))
    lesser = at.filter("component <> largest").withColumn("other", block(F.col("others"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    keys = ("token", "block", "other")
    rows = every.unionByName(lesser).select(*keys, "node", "line_text", "component", "side")
    more = ws.write(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked(num, den, keys), "a long, b long"))
    return components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), ws)


def deduplicated(documents: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with near-copies of lines taken out of ``text_col``, and ``n_lines``, ``n_removed`` (long).

    Lines link when their sets of 8-character shingles (A-Z lower-cased) have a
    Jaccard similarity of ``num / den`` or more; of each component the line that
    occurs first stays: smallest id (null first), then the row's hash, then
    place. Defined results: null texts stay null with 0 lines; lines of white
    space only are never taken out and not counted; rows that repeat both id and
    text are one document and keep the same lines; lines whose 64-bit ids clash
    stay. Every row stays, also when no line is left; other columns pass
    through, columns of the names of the counts (in any case) are replaced.
    Texts of any length are taken whole: a line is signed in pieces, and compared
    in memory of about 60 bytes a character. An empty table gives an empty one.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    ws = Workspace(spark, "lines")
    text = F.col(f"`{text_col}`")
    row = F.xxhash64(f"`{id_col}`", f"`{text_col}`")
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), row.alias("row"), text.alias("text"))
    lines = docs.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("place", "x")).filter(_content(F.col("x")))
    every = ws.write(lines.select("doc_id", "row", "place", F.xxhash64("x").alias("line"), F.xxhash64(F.lit(1), "x").alias("check")))
    known = every.groupBy("line").agg(F.count("*").alias("times"), F.min("check").alias("x"), F.max("check").alias("y"), F.min(F.struct("doc_id", "row", "place")).alias("first")).filter("x = y")
    known = ws.write(known.select("line", "times", "first"))

    groups = _links(docs.select("row", "text"), known, num, den, ws).select(F.col("id").alias("line"), "component")
    touched = known.join(groups, "line", "left").filter("times > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "line"))
    touched = ws.write(touched.select("line", "component", "first", "times"))
    stays = touched.groupBy("component").agg(F.min("first").alias("stays"))
    fate = ws.write(touched.join(stays, "component").select("line", "stays", "times"))
    # a line of a thousandth of all occurrences or more is one of a thousand at most: these are broadcast, so that none makes a task of its own
    common = fate.filter(F.col("times") * 1000 >= every.count())
    found = every.join(F.broadcast(common), "line").unionByName(every.join(F.broadcast(common.select("line")), "line", "left_anti").join(fate.join(F.broadcast(common.select("line")), "line", "left_anti"), "line"))
    lost = found.filter(~F.struct("doc_id", "row", "place").eqNullSafe(F.col("stays")))
    own, gone = unused(documents, "row", "gone")
    kept = [c for c in documents.columns if c.lower() not in ("n_lines", "n_removed")]
    gone_of = lost.groupBy(F.col("row").alias(own)).agg(F.collect_set("place").alias(gone)).hint("shuffle_hash")
    rows = documents.select(*(F.col(f"`{c}`") for c in kept), row.alias(own)).join(gone_of, own, "left")
    whole = lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(parts, i)), "\n")
    cleaned = F.when(F.col(gone).isNull(), text).otherwise(_once(F.split(text, "\n"), whole))
    columns = [cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept]
    n_lines = F.coalesce(F.size(F.filter(F.split(text, "\n"), _content)), F.lit(0))
    return rows.select(*columns, F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"))
