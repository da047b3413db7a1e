"""Periodic runs of words by Karp, Miller and Rosenberg's naming of powers of two.

Level ``k`` names every block of ``2^k`` words, and equal blocks have equal
names: a name of level ``k + 1`` stands for a pair of names of level ``k``.
Blocks that occur once need no name, and naming ends with the level on which no
block occurs twice. How far two places agree is then read off by going down the
levels.

A run of period ``q`` and at least ``4 q`` words agrees with itself ``q`` words
on over at least ``3 q`` places. So some multiple of ``2 q`` lies in it whose
block of the largest power of two up to ``q`` is that ``q`` words on. Only such
places of the grid are extended, to both sides. The words of many texts are
named side by side; names differ between texts, so no block crosses a border.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexsupport.llm.store import bound_batches, lean

#: Words that are named side by side, and places of the grid that are tried at once; they bound memory, not results.
WORDS, PLACES = 1 << 17, 1 << 19
RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))


class Names:
    """Names of the blocks of ``1, 2, 4, ...`` items of an array; a block that occurs once has a negative name of its own."""

    def __init__(self, items: np.ndarray):
        self.n = n = len(items)
        self.levels: list[np.ndarray] = []
        own = np.arange(n)
        _, keys = np.unique(items, return_inverse=True)
        while True:
            names = -1 - np.arange(n + 1, dtype=np.int32)
            times = np.bincount(keys)
            again = times[keys] > 1
            own, keys = own[again], keys[again]
            if not len(own):
                break
            names[own] = (np.cumsum(times > 1) - 1)[keys]
            self.levels.append(names)
            half = 1 << len(self.levels) - 1
            first = names[own]
            second = names[np.minimum(own + half, n)]
            both = second >= 0
            own, pairs = own[both], first[both].astype(np.int64) << 32 | second[both]
            _, keys = np.unique(pairs, return_inverse=True)
            if not len(own):
                break

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of items that agree from places ``a`` and ``b`` on (``a < b <= n``)."""
        size = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            size += (names[a + size] == names[b + size]).astype(np.int64) << k
        return size

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of items that agree before places ``a`` and ``b`` (``a < b <= n``)."""
        size = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, at = self.levels[k], a - size - (1 << k)
            size += ((at >= 0) & (names[np.maximum(at, 0)] == names[b - size - (1 << k)])).astype(np.int64) << k
        return size


def _grid(n: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The multiples of ``2 q`` below ``n - q`` with ``q``, for periods ``low <= q < high``, in lots."""
    while low < high:
        periods = np.arange(low, min(high, low + max(1, PLACES * 2 * low // n)))
        times = -(-np.maximum(n - periods, 0) // (2 * periods))
        low = int(periods[-1]) + 1
        if (total := int(times.sum())) <= 2 * PLACES:
            period = np.repeat(periods, times)
            yield (np.arange(total) - np.repeat(np.cumsum(times) - times, times)) * 2 * period, period
        else:  # one short period in a very long text
            for period, own in zip(periods.tolist(), times.tolist(), strict=True):
                for a in range(0, own, PLACES):
                    at = np.arange(a, min(own, a + PLACES)) * 2 * period
                    yield at, np.full(len(at), period)


def find(items: np.ndarray, longest: int, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs, by start, then period.

    A run is a stretch with smallest period ``q``, of ``max(least, times * q)``
    items at least, that neither neighbour extends. ``longest`` bounds the length
    of a run; ``times`` is 4 or more.
    """
    if times < 4:
        raise ValueError("times must be 4 or more")
    names, found = Names(items), [np.empty((0, 3), np.int64)]
    cover, known = np.full(len(items), -1, np.int32), np.empty((0, 3), np.int64)
    for k, level in enumerate(names.levels):
        low, high = 1 << k, min(2 << k, longest // times + 1)
        if low >= high:
            break
        own = []
        for at, period in _grid(names.n, low, high):
            same = level[at] == level[at + period]
            at, period = at[same], period[same]
            if len(known):
                start, size, short = known[cover[at]].T
                again = (cover[at] >= 0) & (at + period < start + size) & (period % short == 0)
                at, period = at[~again], period[~again]  # within a run of a part of the period: the same stretch
            before = names.behind(at, at + period)
            size = before + names.ahead(at, at + period) + period
            long = size >= np.maximum(least, times * period)
            if long.any():
                own.append(np.unique(np.stack([(at - before)[long], size[long], period[long]], 1), axis=0))
        found += own
        fresh = np.concatenate([found[0], *own])
        fresh = fresh[fresh[:, 1] >= 8 * fresh[:, 2]]  # the only ones that are met again often
        for i, (start, size, _) in enumerate(fresh.tolist(), len(known)):
            cover[start : start + size] = i
        known = np.concatenate([known, fresh])
    rows = np.unique(np.concatenate(found), axis=0)
    # a stretch found again with a multiple of its period is the same stretch
    first = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)] if len(rows) else np.empty(0, bool)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _settle(texts: list[list[bytes]], least: int, times: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Runs of each of some texts' words (rows, and how many each text has), and each text's words without the repeats."""
    codes, sizes, base = [], [], 0
    for words in texts:
        table = defaultdict(count(base).__next__)
        codes.append(np.fromiter(map(table.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
        base += len(table)
    ends = np.cumsum(sizes)
    rows = find(np.concatenate(codes), max(sizes), least, times)
    owner = np.searchsorted(ends, rows[:, 0], "right")
    # words after the first period of a run, counted by what opens and closes
    open_ = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(open_, rows[:, 0] + rows[:, 2], 1)
    np.add.at(open_, rows[:, 0] + rows[:, 1], -1)
    kept = np.cumsum(open_)[:-1] == 0
    rows = rows - np.stack([(ends - sizes)[owner], np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)], 1)
    times_of = np.bincount(owner, minlength=len(texts))
    collapsed = []
    for words, end, n in zip(texts, ends.tolist(), times_of.tolist(), strict=True):
        collapsed.append(b" ".join(compress(words, kept[end - len(words) : end].tolist()) if n else words))
    return rows, times_of, collapsed


def periodic(df: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", n_words_col: str = "n_words", least: int = 6, times: int = 4, keep_text: bool = True) -> DataFrame:
    """``df`` with the runs of each whole text's words, and the text with each run cut to its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``runs_col`` lists ``(start, length, period)``
    in words from 0, by start, then period; ``collapsed_col`` joins the words that
    stay by one space; ``n_words_col`` counts all words. A run has ``least`` words
    and ``times`` periods (4 or more) at least and its smallest period.
    Defined results: a null or empty text, or one without words, has no runs and
    an empty collapsed text; columns of the new names (in any case) are replaced;
    other columns, repeated rows and nulls pass through. A text of any length is
    settled whole, in memory of a few numbers for each of its words and levels.
    An empty table gives an empty one.
    """
    bound_batches(df.sparkSession)
    new = [runs_col, collapsed_col, n_words_col]
    if text_col.lower() in {c.lower() for c in new}:
        raise ValueError(f"the text column must not be named {text_col}")
    rest = [c for c in df.columns if c.lower() not in {c.lower() for c in new}]
    at = rest.index(text_col)
    out = [i for i, c in enumerate(rest) if keep_text or i != at]
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            rows, counts, texts, sizes, waiting, held = [np.empty((0, 3), np.int64)], [], [], [], [], 0

            def settle() -> None:
                nonlocal held
                if held:
                    own, times_of, collapsed = _settle(waiting, least, times)
                    rows.append(own)
                    counts.extend(times_of.tolist())
                    texts.extend(collapsed)
                else:
                    counts.extend([0] * len(waiting))
                    texts.extend([b""] * len(waiting))
                waiting.clear()
                held = 0

            for text in batch.column(at).cast(pa.binary()):
                words = (text.as_py() or b"").split()  # of bytes: at white space of ASCII alone
                if held and held + len(words) > WORDS:
                    settle()
                waiting.append(words)
                sizes.append(len(words))
                held += len(words)
            settle()
            all_rows = np.concatenate(rows)
            runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(all_rows[:, i])) for i in range(3)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), runs)
            more = [lists, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in out] + more, [rest[i] for i in out] + new)

    base = df.select(*(F.col(f"`{c}`") for c in rest))
    schema = T.StructType([base.schema.fields[i] for i in out]).add(runs_col, RUNS).add(collapsed_col, "string").add(n_words_col, "long")
    return base.mapInArrow(run, schema)


def greatest(runs_col: str = "runs") -> Column:
    """The run of the greatest exact length by period (ties: smallest start, then period), or null."""
    none = F.lit(None).cast(RUNS.elementType)
    return F.reduce(F.col(f"`{runs_col}`"), none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def listed(runs_col: str = "runs") -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(F.col(f"`{runs_col}`"), lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
