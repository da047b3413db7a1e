"""Token counts by rank-synchronous merging of ragged arrays.

The pieces (pre-tokens) of many texts lie side by side in flat arrays of symbols,
one stretch each. In every round each stretch applies its pair of lowest rank,
wherever that pair stands in it, and all stretches do so at once: ranks are a
table lookup, the lowest rank a segmented minimum, the merge a compressed copy.
Only pairs beside a merge are looked up again. A stretch without any pair that
merges leaves with its number of symbols, which is its number of tokens.

Two neighbouring bytes that no token holds side by side are never joined, so a
piece is cut there first: long runs of letters become many short stretches.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from hexsupport.llm.bpe import Table
from hexsupport.llm.store import bound_batches, lean

#: How a byte-level pre-tokenizer splits.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Largest tokenizer file that is broadcast.
MAX_FILE = 64 << 20
#: Pieces kept by a worker with their counts, and the longest kept, in characters; they bound memory, not results.
KEPT, KEPT_SIZE = 400_000, 40
#: Characters of texts whose pieces are settled together, pieces of one text taken at once, and symbols merged together.
TEXTS, TURN, SYMBOLS = 1 << 20, 50_000, 1 << 20
NONE = np.iinfo(np.int32).max


def _letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@cache
def _unsettled() -> np.ndarray:
    """By code point: characters on whose class Unicode's versions differ, since one of them has not assigned it."""
    there = np.r_[0:0xD800, 0xE000:0x110000]
    letters = there.astype("<u4").tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, bool)
    out[there] = [unicodedata.category(c) == "Cn" for c in letters]
    for run in regex.finditer(r"\p{Cn}+", letters):
        out[there[run.start() : run.end()]] = True
    return out


class Merges:
    """The merges of a byte-level tokenizer file, and the counts of recent pieces."""

    def __init__(self, content: str):
        own = json.loads(content)
        model, split, added = own["model"], own.get("pre_tokenizer") or {}, own.get("added_tokens") or []
        unusual = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or unusual or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or split.get("use_regex") is False or own.get("normalizer"):
            raise ValueError(f"only byte-level BPE without a normalizer, prefix spaces and {unusual or 'other options'} is counted")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at their neighbours are not counted")
        vocab, letters = model["vocab"], _letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.top = max(vocab.values()) + 1
        ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            ranks[vocab[a] * self.top + vocab[b]] = rank
        self.made = np.array([vocab[a + b] for a, b in pairs] or [0], np.int32)
        self.ranks = Table(ranks)
        self.symbol = np.array([vocab[c] for c in letters], np.int32)
        self.joined = np.zeros(1 << 16, bool)
        value = {c: b for b, c in enumerate(letters)}
        for token in vocab:
            raw = [value[c] for c in token if c in value]
            self.joined[[a << 8 | b for a, b in zip(raw, raw[1:], strict=False)]] = True
        self.specials = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.library = Tokenizer.from_str(content).pre_tokenizer
        self.cuts = regex.compile(SPLIT)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.ranks(left.astype(np.int64) * self.top + right)
        return np.where(found < 0, NONE, found).astype(np.int32)

    def survivors(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of symbols that each stretch of bytes comes to; ``sizes`` are positive and add up to the bytes."""
        out = np.zeros(len(sizes), np.int64)
        stretch, symbol = np.arange(len(sizes)), self.symbol[raw]
        rank = np.full(len(symbol), NONE, np.int32)
        rank[:-1] = self._rank(symbol[:-1], symbol[1:])
        rank[np.cumsum(sizes) - 1] = NONE  # the last symbol of a stretch has no right neighbour
        while len(stretch):
            lowest = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            done = lowest == NONE
            out[stretch[done]] = sizes[done]
            if done.any():
                stay = np.repeat(~done, sizes)
                symbol, rank = symbol[stay], rank[stay]
                stretch, sizes, lowest = stretch[~done], sizes[~done], lowest[~done]
                if not len(stretch):
                    break
            owner = np.repeat(np.arange(len(stretch)), sizes)
            at = np.flatnonzero(rank == lowest[owner])
            # a pair of equal symbols overlaps itself in a row of them: of such hits every other one counts, from the left
            first = np.r_[True, at[1:] != at[:-1] + 1]
            begun = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begun) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]  # a stretch's last symbol stays without a neighbour
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            sizes = sizes - np.bincount(owner[at], minlength=len(sizes))
            symbol, rank, at = symbol[stay], rank[stay], at - np.arange(len(at))
            ends = np.zeros(len(symbol), bool)
            ends[np.cumsum(sizes) - 1] = True
            right = at[~ends[at]]
            left = at[at > 0] - 1
            left = left[~ends[left]]
            again = np.concatenate([left, right])
            rank[again] = self._rank(symbol[again], symbol[again + 1])
        return out

    def count(self, raws: list[bytes]) -> list[int]:
        """The number of tokens of each piece, none of them empty."""
        sizes = np.array([len(raw) for raw in raws], np.int64)
        data = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.zeros(len(data), bool)
        ends[:-1] = ~self.joined[data[:-1].astype(np.int32) << 8 | data[1:]]
        ends[np.cumsum(sizes) - 1] = True
        last = np.flatnonzero(ends)
        parts = np.diff(last, prepend=-1)
        counts, a = np.zeros(len(parts), np.int64), 0
        while a < len(parts):
            begun = int(last[a - 1]) + 1 if a else 0
            b = max(a + 1, int(np.searchsorted(last, begun + SYMBOLS)))
            counts[a:b] = self.survivors(data[begun : int(last[b - 1]) + 1], parts[a:b])
            a = b
        whole = np.cumsum(counts)[np.searchsorted(last, np.cumsum(sizes) - 1)]
        return np.diff(whole, prepend=0).tolist()

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text without special tokens, in turns."""
        if not text.isascii() and _unsettled()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            yield [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        elif len(text) <= TEXTS:
            yield self.cuts.findall(text)
        else:
            cuts = self.cuts.finditer(text)
            while turn := [m.group() for m in islice(cuts, TURN)]:
                yield turn

    def learn(self, pieces) -> dict[str, int]:
        """The counts of all ``pieces``; those of long pieces are not kept."""
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for piece in set(pieces).difference(known):
            if piece in older:
                known[piece] = older[piece]
            else:
                new.append(piece)
        if not new:
            return known
        counts = self.count([piece.encode("utf-8", "surrogatepass") for piece in new])
        known.update((p, n) for p, n in zip(new, counts, strict=True) if len(p) <= KEPT_SIZE)
        long = {p: n for p, n in zip(new, counts, strict=True) if len(p) > KEPT_SIZE}
        return _Both(known, long) if long else known

    def totals(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; the pieces of all are settled together."""
        found = []
        for text in texts:
            parts = self.specials.split(text) if self.specials else [text]
            found.append((len(parts) - 1, [piece for part in parts for turn in self.pieces(part) for piece in turn]))
        counts = self.learn(chain.from_iterable(own for _, own in found))
        return [specials + sum(map(counts.__getitem__, own)) for specials, own in found]

    def total_of_long(self, text: str) -> int:
        """The number of tokens of a text of any length, whose pieces are taken in turns."""
        n = -1
        for part in self.specials.splititer(text) if self.specials else [text]:
            n += 1
            for turn in self.pieces(part):
                counts = self.learn(turn)
                n += sum(map(counts.__getitem__, turn))
        return n


class _Both(dict):
    """Counts of long pieces, and those that are kept."""

    def __init__(self, known: dict[str, int], long: dict[str, int]):
        super().__init__(long)
        self.known = known

    def __missing__(self, piece: str) -> int:
        return self.known[piece]


_OWN: dict[str, Merges] = {}


def _worker_merges(key: str, sent) -> Merges:
    """A Python worker serves many tasks; it reads a tokenizer once and keeps the last one."""
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Merges(sent.value)
    return _OWN[key]


def counted(df: DataFrame, path: str, text_col: str = "text", limit: int = 512, keep_text: bool = True) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each whole text.

    ``path`` is a tokenizer file of byte-level BPE. Its added tokens count as one
    wherever they stand in a text; no begin, end or other token is added.
    Defined results: a null or empty text has no bytes and no tokens; columns of
    the new names (in any case) are replaced; other columns, repeated rows and
    nulls pass through. A text of any length is counted whole, its pieces in
    turns. An empty table gives an empty one.
    """
    bound_batches(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        content = f.read(MAX_FILE + 1)
    if len(content) > MAX_FILE:
        raise ValueError(f"{path} has over {MAX_FILE} characters")
    Merges(content)  # a file of another kind fails here and not in a task
    sent = df.sparkSession.sparkContext.broadcast(content)
    new = {"n_bytes", "n_tokens", "over_limit"}
    if text_col.lower() in new:
        raise ValueError(f"the text column must not be named {text_col}")
    rest = [c for c in df.columns if c.lower() not in new]
    at = rest.index(text_col)
    out = [i for i, c in enumerate(rest) if keep_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        merges = _worker_merges(path, sent)
        for batch in batches:
            totals, waiting, held = [], [], 0
            for text in batch.column(at):
                own = text.as_py() or ""
                if waiting and held + len(own) > TEXTS:
                    totals += merges.totals(waiting)
                    waiting, held = [], 0
                if len(own) > TEXTS:
                    totals.append(merges.total_of_long(own))
                else:
                    waiting.append(own)
                    held += len(own)
            totals += merges.totals(waiting)
            size = pc.fill_null(pc.binary_length(batch.column(at)), 0).cast(pa.int64())
            tokens = np.array(totals, np.int64)
            more = [size, pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in out] + more, [rest[i] for i in out] + ["n_bytes", "n_tokens", "over_limit"])

    base = df.select(*(F.col(f"`{c}`") for c in rest))
    schema = T.StructType([base.schema.fields[i] for i in out]).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return base.mapInArrow(run, schema)
