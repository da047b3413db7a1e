"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all training texts in numpy, one vector for a
language and task, summed in two steps. The log-probability matrix (languages x
``BUCKETS``) is broadcast: its size is bounded by ``max_languages``. Scoring
gathers each language's log-probabilities at a slice's n-grams and sums them by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexsupport.llm.shingles import LOWER, text_slices
from hexsupport.llm.store import bound_batches, lean, unused

#: Hash buckets of n-grams.
BUCKETS = 1 << 15
#: Lengths of the n-grams, in characters.
SIZES = (1, 2, 3)
#: Bytes of text that are handled at once.
SLICE = 1 << 15
#: N-grams that a task holds before it counts them.
PACK = 1 << 20
UNKNOWN = "und"

_ODD = np.array([0x9E3779B1, 0x7F4A7C15, 0x85EBCA6B, 0xC2B2AE35], np.uint32)

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(rows, UTF-8 bytes, offsets of the rows' bytes, whether a text goes on) of about ``SLICE`` bytes; a long text comes in several, each with the two characters before it."""
    for row, end, data, offsets in text_slices(column, SLICE):
        if len(data) <= 4 * SLICE:
            yield np.arange(row, end), data, offsets, False
            continue
        at = 0  # one text
        while at < len(data):
            start, until = at, min(len(data), at + SLICE)
            for _ in range(2 if at else 0):
                start -= 1
                while data[start] & 0xC0 == 0x80:
                    start -= 1
            while until < len(data) and data[until] & 0xC0 == 0x80:
                until += 1
            yield np.array([row]), data[start:until], np.array([0, until - start]), at > 0
            at = until


def _grams(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(rows, buckets at each character by size, where each row's characters begin, whether a row has a letter).

    An n-gram that would reach beyond its text, or was seen with an earlier piece of it, has the bucket ``BUCKETS``.
    """
    for rows, data, offsets, goes_on in _pieces(column):
        starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])[offsets]
        chars = np.frombuffer(LOWER[data].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        some = np.flatnonzero(starts[1:] > starts[:-1])
        letter = np.zeros(len(rows), bool)
        if len(some):
            letter[some] = np.logical_or.reduceat(_letters()[chars], starts[some])
        found, rolled = [], np.zeros(len(chars), np.uint32)
        for size in SIZES:
            # each size goes on from the one before
            rolled = rolled[: len(chars) - size + 1] * _ODD[0] + chars[size - 1 :] + _ODD[1] if len(chars) >= size else rolled[:0]
            h = rolled ^ rolled >> np.uint32(16)
            h *= _ODD[2]
            h ^= h >> np.uint32(13)
            h *= _ODD[3]
            bucket = np.full(len(chars), BUCKETS, np.uint16)
            bucket[: len(h)] = h >> np.uint32(17)
            for k in range(1, size):
                cut = starts[1:] - k
                bucket[cut[cut >= starts[:-1]]] = BUCKETS
            if goes_on:
                bucket[: len(SIZES) - size] = BUCKETS
            found.append(bucket)
        yield rows, found, starts, letter


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    held, shard = 0, 0

    def settle() -> None:
        for name, parts in waiting.items():
            counts[name] = counts.get(name, 0) + np.bincount(np.concatenate(parts), minlength=BUCKETS + 1)[:BUCKETS]
        waiting.clear()

    for batch in batches:
        lang = batch.column("lang").to_pylist()
        shard = batch.column("shard")[0].as_py() if len(batch) else shard
        for name in lang:
            docs[name] = docs.get(name, 0) + 1
            counts.setdefault(name, np.zeros(BUCKETS, np.int64))
        for rows, found, starts, _ in _grams(batch.column("text")):
            for k, row in enumerate(rows.tolist()):
                waiting.setdefault(lang[row], []).extend(bucket[starts[k] : starts[k + 1]] for bucket in found)
            held += sum(map(len, found))
            if held > PACK:
                settle()
                held = 0
    settle()
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([shard] * len(counts), pa.int32()), pa.array([docs[x] for x in counts], pa.int64()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "shard", "docs", "counts"])


def _total(table: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS, np.int64)
    for counts in table.column("counts"):
        total += np.frombuffer(counts.as_py(), np.int64)
    docs = sum(table.column("docs").to_pylist())
    return pa.table({"lang": table.column("lang")[:1], "shard": pa.array([0], pa.int32()), "docs": pa.array([docs], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def train(labelled: DataFrame, max_languages: int = 256) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities) from ``labelled(text, lang)``; null languages are left out.

    More than ``max_languages`` languages are an error: it bounds the matrix.
    """
    bound_batches(labelled.sparkSession)
    schema = "lang string, shard int, docs long, counts binary"
    rows = labelled.filter("lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"), (F.spark_partition_id() % 32).alias("shard"))
    parts = rows.mapInArrow(_count, schema).groupBy("lang", "shard").applyInArrow(_total, schema)
    found = parts.groupBy("lang").applyInArrow(_total, schema).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    found = sorted(found, key=lambda r: r.lang)
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in found], np.float64).reshape(len(found), BUCKETS) + 0.5
    docs = np.array([r.docs for r in found], np.float64)
    return [r.lang for r in found], np.log(docs / docs.sum()), np.log(counts / counts.sum(axis=1, keepdims=True))


def predict(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the most probable language and its posterior probability (rounded to 6 digits).

    Defined results: null texts, texts without a letter, and a model without
    languages give ``und`` and 0; equal probabilities go to the language first
    in alphabetical order; columns of the names of the results (in any case) are
    replaced; rows, repeated or not, are judged each by its own text; texts of
    any length are scored whole, by slices. An empty table gives an empty one.
    """
    bound_batches(df.sparkSession)
    langs, prior, matrix = model
    matrix = np.hstack([matrix, np.zeros((len(langs), 1))])  # the bucket of no n-gram
    sent = df.sparkSession.sparkContext.broadcast((langs, prior, np.ascontiguousarray(matrix)))
    rest = [c for c in df.columns if c.lower() not in (lang_col.lower(), score_col.lower())]
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        langs, prior, matrix = sent.value
        for batch in batches:
            best, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            total, letters = np.tile(prior, (len(batch), 1)), np.zeros(len(batch), bool)
            for rows, found, starts, letter in _grams(batch.column(at)):
                letters[rows] |= letter
                some = np.flatnonzero(starts[1:] > starts[:-1])
                for k in range(len(langs) if len(some) else 0):
                    own = matrix[k]
                    each = own[found[0]]
                    for bucket in found[1:]:
                        each += own[bucket]
                    total[rows[some], k] += np.add.reduceat(each, starts[some])
            if langs and len(batch):
                some = np.flatnonzero(letters)
                top = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                best[some] = np.array(langs, object)[top[some]]
                score[some] = share[some].round(6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score)], [*batch.schema.names, lang_col, score_col])

    base = df.select(*(F.col(f"`{c}`") for c in rest))
    return base.mapInArrow(run, T.StructType(list(base.schema.fields)).add(lang_col, "string").add(score_col, "double"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def trained_on(documents: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A model of all documents that are not held out and have both an id and a language."""
    return train(documents.filter(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang"))


def accepted(documents: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows with a recognised language: not ``und`` and of at least ``min_score``; the columns stay as they are."""
    lang, score = unused(documents, "lang_pred", "lang_score")
    marked = predict(documents, trained_on(documents), lang_col=lang, score_col=score)
    return marked.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).drop(lang, score)
