"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end it in a valid
encoding. ``Prefixes`` stores that token for each prefix, so the encoding of any
prefix is read off backwards, bytes can be appended exactly, and an edit only
recomputes prefixes until they agree with the old ones again. The time is
linear in the text, also for a text without any place to split.

A token is valid after another if merging their joined bytes from scratch gives
just these two. That is decided by undoing the merges on both sides of the
border, latest first, and asking whether the border's neighbours would have
been merged earlier.

The tokens that can end a prefix are found by an automaton of all tokens (Aho
and Corasick): after each byte it knows the longest token that ends there, and
each token knows the next shorter one that ends it.

Short pieces not seen before are settled together, prefix length by prefix
length, with arrays in place of single steps.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexsupport.llm.store import bound_batches, lean

#: Entries of a worker's caches of split pieces, of token pairs and of the automaton's steps; they bound memory, not results.
PIECES, PAIRS, STEPS = 200_000, 200_000, 100_000
#: Longest piece that is kept in the cache, in characters.
KEPT = 40
#: Longest piece that is settled together with others, in bytes, and the least and most pieces that are.
SHORT, FEW, MANY = 32, 64, 1 << 14
#: Pieces of a text that are looked up at once, and characters of texts whose pieces are.
TURN, TEXTS = 50_000, 1 << 20
#: Largest rank file that is broadcast.
MAX_RANK_FILE = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens and their ids (base64 token, space, id on each line)."""
    with open(path, "rb") as f:
        content = f.read(MAX_RANK_FILE + 1)
    if len(content) > MAX_RANK_FILE:
        raise ValueError(f"{path} has over {MAX_RANK_FILE} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Recent(dict):
    """A dict that makes missing values and forgets those unused for ``size`` to ``2 * size`` others."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Table:
    """Whole numbers by whole numbers, none below 0, looked up by arrays (open addressing); -1 where there is none."""

    def __init__(self, found: dict[int, int]):
        bits = (3 * len(found) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        key, value = np.array(list(found), np.int64), np.array(list(found.values()), np.int32)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = key[first], value[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, value, slot = key[left], value[left], slot[left] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        there = self.keys[slot]
        value = np.where(there == key, self.values[slot], -1)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.mask
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            value[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return value


class Vocabulary:
    """Tokens by id, their last merges, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.reach = max(map(len, ranks), default=0)
        self.parts = {rank: self._last_merge(token) for token, rank in ranks.items() if len(token) > 1}
        self.top = max(self.tokens, default=-1) + 1
        #: Tokens that merging makes; the others end no prefix.
        self.made = {token: rank for token, rank in ranks.items() if len(token) == 1 or self.parts[rank] is not None}
        #: The automaton's states by state * 256 + byte, its longest shorter state, and the longest token that ends a state's bytes.
        self.trie: dict[int, int] = {}
        self.fail, self.ends = array("i", [0]), [None]
        #: The next shorter token that ends a token.
        self.shorter: dict[int, int | None] = {}
        self._link()
        self.steps = Recent(self._step, STEPS)
        self._lay_out()
        #: Whether a token may follow another, by left * top + right.
        self.follows = Recent(self._follows, PAIRS)
        self.split = regex.compile(pattern).findall
        self.cuts = regex.compile(pattern).finditer
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.long: list[str] = []

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, if merging its bytes ends so."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 62:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        ids = self.ranks.get(parts[0]), self.ranks.get(parts[1])
        return None if None in ids else ids

    def _link(self) -> None:
        trie, fail, ends, layers = self.trie, self.fail, self.ends, []
        for token, rank in self.made.items():
            state = 0
            for depth, byte in enumerate(token):
                key = state << 8 | byte
                state = trie.get(key)
                if state is None:
                    state = trie[key] = len(ends)
                    fail.append(0)
                    ends.append(None)
                    if depth == len(layers):
                        layers.append([])
                    layers[depth].append(key)
            ends[state] = rank
        for depth, layer in enumerate(layers):  # shorter states are linked first
            for key in layer:
                state = trie[key]
                if depth:
                    fail[state] = self._step(fail[key >> 8] << 8 | key & 255)
                shorter = ends[fail[state]]
                if ends[state] is None:
                    ends[state] = shorter
                else:
                    self.shorter[ends[state]] = shorter

    def _step(self, key: int) -> int:
        """The state that the automaton goes to, by state * 256 + byte."""
        trie, fail, byte = self.trie, self.fail, key & 255
        while (found := trie.get(key)) is None:
            if key < 256:
                return 0
            key = fail[key >> 8] << 8 | byte
        return found

    def _lay_out(self) -> None:
        """The same as arrays, for pieces that are settled together; -1 stands for none."""
        ranks, top = self.ranks, self.top
        merged = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    merged[left * top + right] = rank
        self.all_merged, self.all_trie = Table(merged), Table(self.trie)
        self.all_fail = np.array(self.fail, np.int64)
        self.all_ends = np.array([-1 if x is None else x for x in self.ends], np.int64)
        self.all_sizes, self.all_shorter, self.all_lefts, self.all_rights = (np.full(top, -1, np.int64) for _ in range(4))
        for rank, size in self.size.items():
            self.all_sizes[rank] = size
        for rank, shorter in self.shorter.items():
            self.all_shorter[rank] = -1 if shorter is None else shorter
        for rank, own in self.parts.items():
            if own is not None:
                self.all_lefts[rank], self.all_rights[rank] = own

    def _steps(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """``_step`` of many."""
        found = self.all_trie(state << 8 | byte)
        todo = np.flatnonzero(found < 0)
        while len(todo):
            own = state[todo]
            found[todo[own == 0]] = 0
            todo = todo[own != 0]
            state[todo] = self.all_fail[state[todo]]
            found[todo] = self.all_trie(state[todo] << 8 | byte[todo])
            todo = todo[found[todo] < 0]
        return found.astype(np.int64)

    def _all_follow(self, pairs: np.ndarray) -> np.ndarray:
        """``_follows`` of many."""
        left, right = np.divmod(pairs, self.top)
        out, live, before = np.ones(len(pairs), bool), np.arange(len(pairs)), np.full(len(pairs), 1 << 62)
        while len(live):
            merged = self.all_merged(left * self.top + right)
            wrong = (merged >= 0) & (merged < before)
            out[live[wrong]] = False
            last, first = self.all_rights[left], self.all_lefts[right]
            on = np.flatnonzero(~wrong & ((last >= 0) | (first >= 0)))
            live, left, right, last, first = live[on], left[on], right[on], last[on], first[on]
            undo = (first < 0) | (last >= 0) & (left > right)
            before, left, right = np.where(undo, left, right + 1), np.where(undo, last, left), np.where(undo, right, first)
        return out

    def _pieces(self, raws: list[bytes]) -> Iterator[tuple[int, ...]]:
        """The ids of each of many short pieces, none of them empty."""
        size = np.array([len(raw) for raw in raws], np.int64)
        order = np.argsort(-size, kind="stable")
        starts, data = (np.cumsum(size) - size)[order], np.frombuffer(b"".join(raws), np.uint8)
        size = size[order]
        last = np.full((len(raws), int(size[0]) + 1), -1, np.int64)
        state = np.zeros(len(raws), np.int64)
        for i in range(1, int(size[0]) + 1):
            many = int(np.searchsorted(-size, -i, "right"))  # pieces that are so long
            state = self._steps(state[:many], data[starts[:many] + (i - 1)])
            token, todo = self.all_ends[state], np.arange(many)
            while len(todo):
                own = token[todo]
                if (own < 0).any():
                    raise ValueError(f"no token ends the prefix of {i} bytes; the ranks lack a byte")
                inner = self.all_sizes[own] != i
                todo, own = todo[inner], own[inner]
                pairs, place = np.unique(last[todo, i - self.all_sizes[own]] * self.top + own, return_inverse=True)
                todo = todo[~self._all_follow(pairs)[place]]
                token[todo] = self.all_shorter[token[todo]]
            last[:many, i] = token
        rows, tokens, row, at = [], [], np.arange(len(raws)), size
        while len(row):
            own = last[row, at]
            rows.append(row)
            tokens.append(own)
            at = at - self.all_sizes[own]
            row, at = row[at > 0], at[at > 0]
        rows, tokens = order[np.concatenate(rows[::-1])], np.concatenate(tokens[::-1])
        tokens = tokens[np.argsort(rows, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(rows, minlength=len(raws))).tolist()
        return (tuple(tokens[a:b]) for a, b in zip([0, *ends], ends, strict=False))

    def _follows(self, pair: int) -> bool:
        left, right = divmod(pair, self.top)
        ranks, tokens, parts = self.ranks, self.tokens, self.parts
        before = 1 << 62  # the border's neighbours coexist only until this rank is merged
        while True:
            merged = ranks.get(tokens[left] + tokens[right])
            if merged is not None and merged < before:
                return False
            own = parts.get(left), parts.get(right)
            if own[0] is None and own[1] is None:
                return True
            if own[1] is None or own[0] is not None and left > right:
                before, left = left, own[0][1]  # of equal ranks the left one is merged first
            else:
                before, right = right + 1, own[1][0]

    def extend(self, data: bytes, last: list[int], end: int, state: int | None = None) -> int:
        """Appends the last tokens of the prefixes of ``data`` of up to ``end`` bytes to those in ``last``.

        ``state`` is the automaton's after the prefixes in ``last``; the one after ``end`` bytes is returned.
        """
        steps, ends, shorter, size, follows, top = self.steps, self.ends, self.shorter, self.size, self.follows, self.top
        if state is None:
            state = 0
            for byte in data[max(0, len(last) - 1 - self.reach) : len(last) - 1]:  # no token is longer
                state = steps[state << 8 | byte]
        for i in range(len(last), end + 1):
            state = steps[state << 8 | data[i - 1]]
            token = ends[state]
            while token is not None and (length := size[token]) != i and not follows[last[i - length] * top + token]:
                token = shorter[token]
            if token is None:
                raise ValueError(f"no token ends the prefix of {i} bytes; the ranks lack a byte")
            last.append(token)
        return state

    def back(self, last: list[int], at: int) -> list[int]:
        """The ids of the prefix of ``at`` bytes."""
        found, size = [], self.size
        while at:
            token = last[at]
            found.append(token)
            at -= size[token]
        found.reverse()
        return found

    def _piece(self, raw: bytes) -> tuple[int, ...]:
        last = [-1]
        self.extend(raw, last, len(raw))
        return tuple(self.back(last, len(raw)))

    def learn(self, pieces) -> None:
        """Sees to it that ``self.pieces`` has the ids of all ``pieces``."""
        if len(self.pieces) > PIECES:
            self.pieces, self.older = {}, self.pieces
        known, older, ranks = self.pieces, self.older, self.ranks
        short, raws = [], []
        for piece in set(pieces).difference(known):
            ids = older.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                whole = ranks.get(raw)
                if whole is not None:  # a piece that is a token is that token, also one that merging never makes
                    ids = (whole,)
                elif len(raw) <= SHORT:
                    short.append(piece)
                    raws.append(raw)
                    continue
                else:
                    ids = self._piece(raw)
            known[piece] = ids
            if len(piece) > KEPT:
                self.long.append(piece)
        for a in range(0, len(raws), MANY):
            own = raws[a : a + MANY]
            known.update(zip(short[a : a + MANY], self._pieces(own) if len(own) >= FEW else map(self._piece, own), strict=True))

    def ids(self, pieces: list[str], learnt: bool = False) -> Iterator[int]:
        if not learnt:
            self.learn(pieces)
        return chain.from_iterable(map(self.pieces.__getitem__, pieces))

    def forget_long(self) -> None:
        """Long pieces do not stay in the cache."""
        for piece in self.long:
            self.pieces.pop(piece, None)
        self.long.clear()

    def encode(self, text: str) -> list[int]:
        return self.encode_long(text).tolist()

    def encode_long(self, text: str) -> array:
        """The ids of a text of any length, whose pieces are taken in turns."""
        out, cuts = array("i"), self.cuts(text)
        while pieces := [m.group() for m in islice(cuts, TURN)]:
            out.extend(self.ids(pieces))
            self.forget_long()
        return out

    def encode_all(self, texts: list[str]) -> Iterator[array]:
        """The ids of each of some short texts, whose pieces are learnt together."""
        split = [self.split(text) for text in texts]
        self.learn(chain.from_iterable(split))
        for pieces in split:
            yield array("i", self.ids(pieces, learnt=True))
        self.forget_long()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The last token of each prefix of a byte string; ``last[i]`` ends the prefix of ``i`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(bytes(self.data), self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` in place of ``data[start:end]``; returns how many prefixes were recomputed."""
        old, shift = self.last, start + len(new) - end
        self.data[start:end] = new
        self.last = old[: start + 1]
        data, agree, state = bytes(self.data), 0, None
        for i in range(start + 1, len(data) + 1):
            state = self.vocabulary.extend(data, self.last, i, state)
            agree = agree + 1 if i > start + len(new) and self.last[i] == old[i - shift] else 0
            if agree >= self.vocabulary.reach:  # later prefixes depend on nothing before
                self.last += old[i + 1 - shift :]
                return i - start
        return len(self.data) - start

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, or of all."""
        return self.vocabulary.back(self.last, len(self.data) if end is None else end)


_OWN: dict[str, Vocabulary] = {}


def _worker_vocabulary(key: str, sent, pattern: str) -> Vocabulary:
    """A Python worker serves many tasks; it builds a vocabulary once and keeps the last one."""
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Vocabulary(sent.value, pattern)
    return _OWN[key]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str | None = None) -> DataFrame:
    """``df`` with ``ids_col`` (array of int): the ids of each whole text, and with ``bytes_col`` the bytes decoded from them.

    Each match of ``pattern`` is encoded by itself; there are no special tokens.
    Defined results: a null or empty text has no ids; a column of the name
    ``ids_col`` or ``bytes_col`` (in any case) is replaced; other columns, repeated
    rows and nulls pass through. A text of any length is encoded whole, its pieces
    in turns. An empty table gives an empty one.
    """
    bound_batches(df.sparkSession)
    sent, key = df.sparkSession.sparkContext.broadcast(read_ranks(path)), f"{path}\n{pattern}"
    rest = [c for c in df.columns if c.lower() not in (ids_col.lower(), (bytes_col or ids_col).lower())]
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        vocabulary = _worker_vocabulary(key, sent, pattern)
        decoder = Decoder(vocabulary.ranks) if bytes_col else None
        for batch in batches:
            ids, ends, waiting, held = array("i"), [0], [], 0

            def settle() -> None:
                for own in vocabulary.encode_all(waiting):
                    ids.extend(own)
                    ends.append(len(ids))
                waiting.clear()

            for text in batch.column(at):
                own = text.as_py() or ""
                if len(own) <= TEXTS:
                    waiting.append(own)
                    held += len(own)
                if held > TEXTS or len(own) > TEXTS:
                    settle()
                    held = 0
                if len(own) > TEXTS:
                    ids.extend(vocabulary.encode_long(own))
                    ends.append(len(ids))
            settle()
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)) if ids else pa.array([], pa.int32()))
            more = [(ids_col, arrays)] + ([(bytes_col, decoder(arrays))] if decoder else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(x for _, x in more)], [*batch.schema.names, *(c for c, _ in more)])

    base = df.select(*(F.col(f"`{c}`") for c in rest))
    schema = T.StructType(list(base.schema.fields)).add(ids_col, T.ArrayType(T.IntegerType()))
    return base.mapInArrow(run, schema.add(bytes_col, "binary") if bytes_col else schema)


class Decoder:
    """Token bytes side by side, so that arrays of ids are decoded without a loop over ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.flat = np.frombuffer(b"".join(token for token, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, column: pa.ListArray) -> pa.Array:
        """The bytes of each array of ids; none for null."""
        ids, lengths = column.flatten(), self.lengths
        if ids.null_count:
            raise ValueError("an array of ids holds a null")
        ids = ids.to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths) or not lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])
        data = np.empty(int(ends[-1]), np.uint8)
        for a in range(0, len(ids), 1 << 17):
            own = ids[a : a + (1 << 17)]
            size = lengths[own]
            base, until = int(ends[a]), int(ends[a + len(own)])
            data[base:until] = self.flat[np.repeat(self.starts[own] - (ends[a : a + len(own)] - base), size) + np.arange(until - base)]
        rows = ends[np.concatenate([[0], np.cumsum(counts)])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col`` (binary): the bytes that each array of ids stands for.

    Defined results: null or empty ids give no bytes; an id outside the
    vocabulary, or a null inside an array, is an error; a column of the name
    ``bytes_col`` is replaced. An empty table gives an empty one.
    """
    bound_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    rest = [c for c in df.columns if c.lower() != bytes_col.lower()]
    at = rest.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        decoder = Decoder(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decoder(batch.column(at))], [*batch.schema.names, bytes_col])

    base = df.select(*(F.col(f"`{c}`") for c in rest))
    return base.mapInArrow(run, T.StructType(list(base.schema.fields)).add(bytes_col, "binary"))


def digests(df: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of the ids and bytes."""
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    out = df.withColumn("n_tokens", F.size(ids).cast("long")).withColumn("ids_sha256", F.sha2(F.array_join(ids.cast("array<string>"), " "), 256))
    return out.withColumn("decoded_sha256", F.sha2(F.coalesce(F.col(bytes_col), F.lit(b"")), 256)).drop(ids_col, bytes_col)
