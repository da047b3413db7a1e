"""Centroid clustering, token counts and periodic runs: against plain versions, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hexsupport.llm import centroids, counts, queries, runs
from tests.oracle import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n\t", "a", "é", "😀 漢字 ß", "x" * 30_000, "lorem ipsum " * 20_000, "\x00\x01", "same", "same", "a b c"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, None if i % 3 == 0 else "en", 1, 2, 3) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, N_Tokens int, RUNS int, cluster int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text


# op 11


def _lloyd(rows, k=40, rounds=5, dims=64, scale=256):
    """Plain Python: ``(id, vector)`` rows to ``(id, cluster, distance)`` and the centroids."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    own = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(own)) for _, v in kept]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, j) in zip(kept, assign(), strict=True):
            groups.setdefault(j, []).append(v)
        for j, vectors in groups.items():
            own[j] = [sum(x) // len(vectors) for x in zip(*vectors, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)], own


def _vectors():
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.003, 0.0, 0.25, 0.999]) for _ in range(3)]) for i in range(60)]
    rows += [(5, rows[5][1]), (7, [0.5, 0.5, 0.5]), (None, [0.1, 0.2, 0.3]), (None, None), (80, None), (81, []), (82, [1.0, 2.0]), (83, [1.0, None, 2.0]), (84, [float("nan")] * 3), (85, [math.inf, 0.0, 0.0]), (86, [0.0] * 3), (2**53 + 1, [0.9] * 3)]
    return rows


@pytest.mark.parametrize("k", [1, 4, 200])
def test_clusters_equal_plain_lloyd(spark, k):
    rows = _vectors()
    table = spark.createDataFrame([(1, i, v, "x") for i, v in rows], "cluster int, vec_id long, embedding array<double>, distance string").repartition(5)
    want, own = _lloyd(rows, k, 3, 3)
    out = centroids.clustered(table, k=k, rounds=3, dims=3).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in out) == sorted((-1 if i is None else i, j, d) for i, j, d in want)
    for r in out:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, own[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == sum(d for _, _, d in want)


def test_clusters_of_nothing_and_of_equal_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.clustered(none).count() == 0 and centroids.clustered(none.limit(0)).count() == 0
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {(r.cluster, r.distance) for r in centroids.clustered(equal, k=3, dims=2).collect()} == {(0, 0)}


def test_clusters_of_far_vectors(spark):
    """Squared distances near the limit are exact; beyond it there is an error."""
    far = spark.createDataFrame([(i, [x] * 64) for i, x in enumerate((-262144.0, 262144.0, 262143.5))], "vec_id long, embedding array<double>")
    want, _ = _lloyd([(r.vec_id, r.embedding) for r in far.collect()], 1)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in centroids.clustered(far, k=1).collect()) == sorted(want)
    with pytest.raises(Exception, match="64 bits"):
        centroids.clustered(far.withColumn("embedding", F.transform("embedding", lambda x: 2 * x)))
    with pytest.raises(ValueError, match="k must be"):
        centroids.lloyd(far, k=0)


def test_nearest_takes_the_lowest_of_equal():
    cluster, distance = centroids.nearest(np.array([[0], [4], [2]]), np.array([[4], [0], [0], [4]]))
    assert cluster.tolist() == [1, 0, 0] and distance.tolist() == [0, 0, 4]


# op 12


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    with open(PATH, encoding="utf-8") as f:
        return counts.Merges(f.read())


def _library_counts(library, texts):
    return [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark, documents, library):
    out = queries.op12_token_counts(spark, SF).collect()
    want = dict(zip(documents.index, _library_counts(library, documents), strict=True))
    assert len(out) == len(documents)
    for r in out:
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len(documents[r.doc_id].encode()), want[r.doc_id] > 512)


def test_counts_of_random_and_odd_texts(merges, library, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aeinrsth  \n\t.,'01😀éß漢\x00xx") for _ in range(rng.randint(0, 120))) for _ in range(800)]
    texts += ["x" * 5000, "ab" * 3000, "=-" * 4000 + "-" * 777 + "=" * 333, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "   <|endoftext|>  ", "՘a֋ 1₏", "don't 'S 's   　x"]
    want = _library_counts(library, texts)
    assert merges.totals(texts) == want and [merges.total_of_long(t) for t in texts] == want
    monkeypatch.setattr(counts, "TEXTS", 50)
    monkeypatch.setattr(counts, "TURN", 7)
    monkeypatch.setattr(counts, "SYMBOLS", 40)
    monkeypatch.setattr(counts, "KEPT", 30)
    merges.known.clear()
    merges.older.clear()
    assert merges.totals(texts) == want and [merges.total_of_long(t) for t in texts] == want


def test_every_round_merges_in_all_stretches(merges):
    """As many rounds as the stretch that needs most, however many stretches there are."""
    raws = [b"international", b"xxxxxxxxx", b" the", b"q"] * 50
    rounds, lookup = [], merges._rank
    merges._rank = lambda *own: rounds.append(1) or lookup(*own)
    merges.survivors(np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws]))
    many, rounds[:] = len(rounds), []
    merges.survivors(np.frombuffer(b"".join(raws[:4]), np.uint8), np.array([len(r) for r in raws[:4]]))
    merges._rank = lookup
    assert many == len(rounds) <= 13


def test_counts_of_odd_rows(spark, odd, library):
    out = counts.counted(odd, PATH, limit=3)
    assert out.columns == ["doc_id", "text", "lang", "RUNS", "cluster", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(zip([t or "" for t in ODD], _library_counts(library, ODD), strict=True))
    rows = out.collect()
    assert sorted((r.text or "", r.n_tokens) for r in rows) == want
    assert all(r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 3) for r in rows)
    assert counts.counted(odd.limit(0), PATH, keep_text=False).count() == 0
    with pytest.raises(ValueError, match="only byte-level"):
        counts.counted(odd, public_tokenizers.path("word_bpe_49k.json"))


# op 13


def _runs(w, least=6, times=4):
    out, n = set(), len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_a_plain_search(monkeypatch):
    rng = random.Random(3)
    for turn in range(600):
        if turn == 400:
            monkeypatch.setattr(runs, "PLACES", 5)
        n, k = rng.randint(1, 90), rng.choice([1, 2, 3, 5, 20])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert [tuple(r) for r in runs.find(np.array(w), n).tolist()] == _runs(w)


def test_names_tell_how_far_places_agree():
    w = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2, 1, 3, 1])
    names = runs.Names(w)
    for a in range(len(w)):
        for b in range(a + 1, len(w) + 1):
            ahead = next(i for i in range(len(w)) if b + i >= len(w) or w[a + i] != w[b + i])
            behind = next(i for i in range(len(w)) if a - i - 1 < 0 or w[a - i - 1] != w[b - i - 1])
            assert names.ahead(np.array([a]), np.array([b])) == [ahead] and names.behind(np.array([a]), np.array([b])) == [behind]


def _plain(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    own = _runs(w)
    gone = {i for s, size, q in own for i in range(s + q, s + size)}
    best = max(own, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (
        len(own), *best, own and 1000 * best[1] // best[2] or None, hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in own).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
    )


def test_runs_of_documents(spark, documents, tmp_path):
    short = {i: t for i, t in documents.items() if len(t.split()) < 400}
    short |= {-5: "a a a a a a", -6: None, -7: "", -8: "a b a b a b a b c c c c c c c", 10**12: "x y z " * 90, -9: "é é é é é é é é é é é é\x0b\x0c"}
    planted = [i for i in range(-4000, 0) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rng = random.Random(8)
    short |= {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 150))) for i in planted}
    spark.createDataFrame(list(short.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(out) == len(short) and sum(r.n_runs > 0 for r in out) > 20
    for r in out:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == _plain(r.doc_id, short[r.doc_id]), r.doc_id


def test_runs_of_odd_rows(spark, odd):
    out = runs.periodic(odd)
    assert out.columns == ["doc_id", "text", "lang", "N_Tokens", "cluster", "runs", "collapsed", "n_words"]
    rows = {r.text: r for r in out.collect()}
    assert out.count() == len(ODD)
    assert [tuple(x) for x in rows["lorem ipsum " * 20_000].runs] == [(0, 40_000, 2)] and rows["lorem ipsum " * 20_000].collapsed == "lorem ipsum"
    assert rows[None].runs == [] and rows[None].collapsed == "" and rows[None].n_words == 0
    assert rows["a b c"].n_words == 1 and rows["😀 漢字 ß"].collapsed == "😀 漢字 ß"
    assert runs.periodic(odd.limit(0), keep_text=False).count() == 0
    with pytest.raises(ValueError, match="4 or more"):
        runs.find(np.array([1]), 1, times=3)


def test_greatest_run_of_equal_ratios(spark):
    rows = spark.createDataFrame([([(9, 8, 2), (3, 12, 3), (20, 4, 1)],), ([],)], f"runs {runs.RUNS.simpleString()}")
    assert [r.best and tuple(r.best) for r in rows.select(runs.greatest().alias("best")).collect()] == [(9, 8, 2), None]
