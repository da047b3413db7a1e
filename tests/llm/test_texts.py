"""Operators that judge each text: against plain versions, and on odd input."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hexsupport.llm import bpe, langid, licenses, pii, quality, queries, urls
from tests.oracle import SF

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = "lorem ipsum " * 20_000
ODD = [None, "", " ", "\n\n\t", "a", "é", "😀 漢字 ß", "x" * 30_000, LONG, "\x00\x01", "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, None if i % 3 == 0 else "en", "s", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, token_ids int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_the_library(spark, documents, tik):
    for r in queries.op1_bpe_encode_decode(spark, SF).collect():
        ids = tik.encode_ordinary(documents[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()


def test_bpe_on_random_text(vocabulary, tik):
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("aeinrsth  \n\t.,'01😀éß漢\x00") for _ in range(rng.randint(0, 120)))
        assert vocabulary.encode(text) == tik.encode_ordinary(text)
        assert vocabulary.decode(vocabulary.encode(text)) == text.encode()


def test_bpe_settles_short_pieces_together(vocabulary, tik, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeinorstüéß漢😀") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    text, alone = " ".join(words), []
    monkeypatch.setattr(vocabulary, "_piece", lambda own: alone.append(own))
    assert vocabulary.encode(text) == tik.encode_ordinary(text)
    assert not alone
    monkeypatch.undo()
    tokens = list(vocabulary.ranks)
    raws = [b"".join(rng.choices(tokens, k=rng.randint(1, 4))) for _ in range(3000)]  # also tokens that no merge makes, and broken characters
    assert list(vocabulary._pieces(raws)) == [vocabulary._piece(raw) for raw in raws]


def test_bpe_appends_and_edits(vocabulary):
    rng = random.Random(6)
    for _ in range(100):
        raw = "".join(rng.choice("thereandointion ") for _ in range(300)).encode()
        grown = bpe.Prefixes(vocabulary, raw[:100])
        grown.append(raw[100:])
        whole = bpe.Prefixes(vocabulary, raw)
        assert grown.last == whole.last and whole.ids(50) == bpe.Prefixes(vocabulary, raw[:50]).ids()
        a = rng.randint(0, 250)
        b, new = a + rng.randint(0, 20), raw[: rng.randint(0, 9)]
        whole.replace(a, b, new)
        assert whole.last == bpe.Prefixes(vocabulary, raw[:a] + new + raw[b:]).last


def test_bpe_odd_input(spark, odd, tik):
    out = bpe.digests(bpe.decode(bpe.encode(odd, PATH, PATTERN), PATH)).collect()
    assert len(out) == len(ODD) and [r.n_tokens for r in out] == [len(tik.encode_ordinary(t or "")) for t in ODD]
    assert bpe.encode(odd.limit(0), PATH, PATTERN).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([99_999_999],)], "token_ids array<int>"), PATH).collect()


def test_url_rules(spark):
    cases = ["http://EXAMPLE.com/en/x?q", "https://www.example.com/en/", "ftp://a.net/es/1#f", "http://net/fr/", "http://example.com", "nothing", None, "", "http://xnet/es/", "http://a.b.example.com/EN/", "x://y://z/", "http://h.com/" + "a/" * 5000]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)], "page_id int, url string, rule string")
    out = {r.page_id: r for r in urls.judge(pages, urls.rules(spark, queries.URL_RULES)).collect()}
    assert [out[i].rule for i in range(11)] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, "com/", None]
    assert out[0].verdict == "block" and out[1].verdict == "allow" and (out[6].host, out[6].path) == ("", "") and out[11].rule == "com/"


def test_url_rules_without_final_slash_and_conflicts(spark):
    pages = spark.createDataFrame([(1, "http://a.org/abc/d"), (2, "http://a.org/abx"), (3, "http://b.a.org/q")], "page_id int, url string")
    ruled = spark.createDataFrame([("block", "a.org", "/ab"), ("allow", "a.org", "/abc/"), ("allow", "a.org", ""), ("block", "b.a.org", "/q"), ("allow", "b.a.org", "/q"), (None, "a.org", "/"), ("block", None, "/")], "verdict string, host string, path string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, ruled).collect()} == {1: ("a.org/abc/", "allow"), 2: ("a.org/ab", "block"), 3: ("b.a.org/q", "block")}
    assert urls.judge(pages, ruled.limit(0), default="block").filter("verdict = 'block'").count() == 3
    assert urls.judge(pages.limit(0), ruled).count() == 0


def _measured(text: str) -> tuple[int, ...]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, documents, odd):
    for r in queries.op6_quality_rules(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _measured(documents[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    out = quality.judged(odd).collect()
    measured = collections.Counter((r.text, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in out)
    assert measured == collections.Counter((t, _measured(t or "")) for t in ODD)
    assert quality.judged(odd.limit(0)).count() == 0


def test_quality_agrees_with_labels(spark):
    big = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    out = queries.op6_quality_rules(spark, big).join(labels, "doc_id").filter("NOT base_failed")
    good = out.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = out.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.95 and (bad or 0) < 0.2


def test_quality_estimation_finds_a_noisy_rule():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    votes = [np.where(rng.random(4000) < a, np.where(good, 1, -1), np.where(good, -1, 1)) for a in (0.95, 0.9, 0.9, 0.6)]
    counts = collections.Counter(zip(*(v.tolist() for v in votes), strict=True))
    model = quality.fit(sorted(counts.items()), ["a", "b", "c", "d"])
    assert abs(model.good - 0.8) < 0.05 and model.votes["a"][1][0] > model.votes["d"][1][0] > 0.5


def test_quality_is_fitted_on_all_rows(spark, odd, monkeypatch):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda patterns, names: seen.extend(patterns) or fit(patterns, names))
    assert quality.judged(odd).filter("base_failed").count() > 0
    assert sum(n for _, n in seen) == len(ODD)


def _base_spans(text: str) -> list[tuple[str, int, int]]:
    def luhn(s: str) -> bool:
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in s[::-1])) % 10 == 0

    def digits(m: re.Match) -> str:
        return re.sub("[^0-9]", "", m.group())

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


PRIVATE = ["x@y.z_d@e.f", "a@b.c.d..e", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4", "+1 (2) 3 +49 30 1234567", "4111 1111-1111 1111", "9" * 20_000, "a." * 9000 + "@b.c", "1-" * 20_000, "a@" + "b." * 9000 + "c", "😀 a@b.co", "\ufdd0a@b.cd\ufdd1"]


@pytest.fixture(scope="module")
def trees(spark):
    return pii.train(spark)


def test_personal_base_spans(spark, documents, odd, trees):
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for r in queries.op7_personal_data(spark, SF).collect():
        base = _base_spans(documents[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest()
        assert {text([b]) for b in base} <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE)], "i int, text string")
    for r in pii.detected(rows, trees=trees).select("i", pii.listed("base").alias("base")).collect():
        assert r.base == text(_base_spans(PRIVATE[r.i]))
    assert pii.detected(odd, trees=trees).count() == len(ODD) and pii.detected(odd.limit(0), trees=trees).count() == 0


def test_personal_spans_by_context(spark, trees):
    texts = ["please call (443) 555-5793 today", "mail john (at) site (dot) org now", "order 20210304 pages 12345678", "plain words at home. Then more", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = {r.i: r.spans for r in pii.detected(rows, trees=trees).select("i", pii.listed("spans").alias("spans")).collect()}
    assert found == {0: "phone:12:26", 1: "email:5:29", 2: "", 3: "", 4: ""}
    assert {r.i: r.text for r in pii.redacted(rows, trees=trees).collect()}[0] == "please call [PHONE] today"


def test_redaction_leaves_other_columns(spark, trees):
    long = "so " * 20_000 + "call (443) 555-5793 today"
    texts = ["please call (443) 555-5793 today", None, "", long]
    rows = spark.createDataFrame([(i, t, "mine", "own", "x") for i, t in enumerate(texts)], "i int, Text string, base string, SPANS string, _text string")
    out = pii.redacted(rows, "Text", trees)
    assert out.columns == rows.columns
    assert sorted(map(tuple, out.collect())) == [(0, "please call [PHONE] today", "mine", "own", "x"), (1, None, "mine", "own", "x"), (2, "", "mine", "own", "x"), (3, long.replace("(443) 555-5793", "[PHONE]"), "mine", "own", "x")]
    named = rows.select("i", rows["Text"].alias("base"))
    assert [r.base for r in pii.redacted(named, "base", trees).orderBy("i").limit(3).collect()] == ["please call [PHONE] today", None, ""]
    assert pii.redacted(rows.limit(0), "Text", trees).count() == 0


def test_personal_numbers_beside_others(spark, trees):
    """Each marked number is found, whatever stands beside it."""
    texts = ["call <555-123-4567> <555-987-6543> now", "tel <555-123-4567> / <555-987-6543> now", "on 2024-01-05 <555-123-4567> now", "tel.<555-123-4567> now", "phone,<555-123-4567> now", "so <(826) 555-4081> 190.137.223.204 now", "so 190.137.223.204 <(843) 555-4081> now", "call <555-123-4567> <555-987-6543> <555-222-3333> <555-444-1111> now", "serial 12345678 12345678 kg"]
    plain = [t.replace("<", "").replace(">", "") for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "i int, text string")
    found = {r.i: [plain[r.i][x.s : x.e] for x in r.spans if x.kind == "phone"] for r in pii.detected(rows, trees=trees).collect()}
    assert found == {i: re.findall("<(.*?)>", t) for i, t in enumerate(texts)}


def test_languages(spark, odd):
    documents = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = queries.op8_language_id(spark, SF.replace("sf0.001", "sf0.01")).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 100 and (out.lang_pred == out.lang).mean() > 0.98 and out.score.between(0, 1).all()
    model = langid.train(documents)
    marked = langid.predict(odd.withColumn("score", F.lit("old")), model).collect()
    assert [r.lang_pred == "und" for r in marked] == [not any(c.isalpha() for c in t or "") for t in ODD]
    assert langid.predict(odd, langid.train(documents.limit(0))).filter("lang_pred = 'und' AND score = 0").count() == len(ODD)
    with pytest.raises(ValueError, match="over 1 languages"):
        langid.train(documents, 1)


def test_languages_ignore_held_out_rows(spark):
    rows = [(i, "aaa bbb" if i % 2 else "zzz yyy", "x" if i % 2 else "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), "z").otherwise(F.col("lang")))
    assert langid.trained_on(spoiled)[0] == ["x", "y"]


def _bucket(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * 0x9E3779B1 + ord(c) + 0x7F4A7C15) % 2**32
    h ^= h >> 16
    h = h * 0x85EBCA6B % 2**32
    h ^= h >> 13
    return (h * 0xC2B2AE35 % 2**32) >> 17


def _features(text: str | None) -> collections.Counter:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return collections.Counter(_bucket(text[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1))


def test_languages_equal_plain_naive_bayes(spark):
    """Every document, scored by the multinomial model with half a count added, written out for one document at a time."""
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in documents.collect() if r.doc_id is not None]
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        if r.lang is not None and not held(r):
            counts[r.lang].update(_features(r.text))
            docs[r.lang] += 1
    mass = {k: sum(c.values()) + 0.5 * langid.BUCKETS for k, c in counts.items()}
    out = {r.doc_id: r for r in langid.predict(documents, langid.trained_on(documents)).collect()}
    for r in rows:
        own = _features(r.text)
        log = {k: math.log(docs[k] / sum(docs.values())) + sum(n * math.log((counts[k][b] + 0.5) / mass[k]) for b, n in own.items()) for k in counts}
        best = min(log, key=lambda k: (-log[k], k))
        if not any(c.isalpha() for c in r.text or ""):
            assert (out[r.doc_id].lang_pred, out[r.doc_id].score) == ("und", 0.0)
        else:
            assert out[r.doc_id].lang_pred == best
            assert out[r.doc_id].score == pytest.approx(1 / sum(math.exp(x - log[best]) for x in log.values()), abs=2e-6)


def test_equal_languages_go_to_the_first_name(spark):
    labelled = spark.createDataFrame([("la casa", "y"), ("la casa", "x")], "text string, lang string")
    out = langid.predict(labelled.drop("lang"), langid.train(labelled)).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("x", 0.5)] * 2


def test_licenses(spark, odd):
    rng = random.Random(1)
    words = licenses.TEMPLATES["MIT"].split()
    changed = " ".join("zzz" if rng.random() < 0.05 else w for w in words)
    texts = ["so " * 30 + changed + " and " * 40 + licenses.TEMPLATES["MIT"], "Licensed under the Apache License, Version 2.0.", "the code of the license", licenses.TEMPLATES["GPL-3.0-or-later"].upper()]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = {r.i: [(h.license, t[h.start : h.end]) for h in r.licenses] for r, t in zip(sorted(licenses.scanned(rows).collect()), texts, strict=True)}
    assert [n for n, _ in out[0]] == ["MIT", "MIT"] and out[0][1][1] == licenses.TEMPLATES["MIT"].rstrip(".")
    assert [n for n, _ in out[1]] == ["Apache-2.0-short"] and out[2] == [] and [n for n, _ in out[3]] == ["GPL-3.0-or-later"]
    assert licenses.scanned(odd).filter("size(licenses) > 0").count() == 0 and licenses.scanned(odd.limit(0)).count() == 0


def test_licenses_of_long_texts_and_named_columns(spark):
    text = "so " * 50_000 + licenses.TEMPLATES["MIT"] + " and" * 50_000
    rows = spark.createDataFrame([(1, text, "old", "y")], "license int, text string, LICENSES string, start string")
    out = licenses.scanned(rows)
    assert out.columns == ["license", "text", "start", "licenses"]
    assert [[h.license for h in r.licenses] for r in out.select("licenses").collect()] == [["MIT"]]


@pytest.mark.parametrize("name", ["ISC", "MIT", "MIT-short", "GPL-3.0-or-later"])
@pytest.mark.parametrize("between", [" ", " so then ", " zzz " * 9])
def test_adjacent_copies_of_a_notice(name, between):
    scanner, own = licenses.Scanner(licenses.TEMPLATES, 0.8), licenses.TEMPLATES[name]
    for n in (1, 2, 3, 10):
        text = "words before " + between.join([own] * n) + " words after"
        starts = [m.start() for m in re.finditer(re.escape(own), text)]
        assert [(h[0], h[1], h[2]) for h in scanner.scan(text)] == [(name, 1.0, a) for a in starts]
    # a changed word in each copy, another place each time
    copies = [own.split() for _ in range(5)]
    for k, copy in enumerate(copies):
        copy[1 + k % (len(copy) - 2)] = "changed"
    assert [h[0] for h in scanner.scan("a " + between.join(" ".join(c) for c in copies) + " b")] == [name] * 5


def test_alignment_is_increasing_and_equal():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and v < w for (x, v), (y, w) in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.align(list("xaybzc"), list("abc"))) == 3


def test_columns_named_like_inner_ones_pass_through(spark, trees):
    """Whatever an input column is called, it comes back as it was, unless it is named like a result."""
    rows = [(1, "http://www.a.org/b/c", "mail x@y.org or call (443) 555-5793 " * 9, "mine", "own", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, url string, _text string, _path string, _WORDS string, HOST string").withColumn("_vote_length", F.lit("v")).withColumn("_Salt", F.lit("s"))
    judged = urls.judge(df, urls.rules(spark, [("block", "a.org/b/")])).first()
    assert (judged["_path"], judged["_Salt"], judged["_WORDS"], judged["host"], judged["rule"]) == ("mine", "s", "own", "www.a.org", "a.org/b/")
    measured = quality.judged(df, text_col="_text").first()
    assert measured["_text"] == rows[0][2] and measured["_WORDS"] == "own" and measured["_vote_length"] == "v" and measured.n_words == 54
    marked = pii.detected(df, text_col="_text", trees=trees).first()
    assert marked["_text"] == rows[0][2] and marked["_path"] == "mine" and {x.kind for x in marked.spans} == {"email", "phone"}
    labelled = df.select(F.col("_text").alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("_lang_pred"), F.lit("z").alias("LANG_SCORE"))
    assert langid.predict(labelled, langid.train(labelled)).columns == ["text", "lang", "_lang_pred", "LANG_SCORE", "lang_pred", "score"]


def test_very_long_texts(spark, trees, tik):
    """A text of some megabytes and many matches: measured, searched, scored and encoded whole."""
    lead = "el perro come "
    words = lead + "la casa de la montaña verde " * 60_000 + "end of it all"
    numbers = "mail a@b.org and call (443) 555-5793 today. " * 1500
    rows = spark.createDataFrame([(1, words), (2, numbers)], "doc_id long, text string")
    measured = {r.doc_id: r for r in quality.judged(rows).collect()}
    assert measured[1].n_words == len(words.split()) and measured[1].n_repeat_words == 6 * 60_000
    spans = {r.doc_id: r.spans for r in pii.detected(rows, trees=trees).collect()}
    assert spans[1] == [] and sum(x.kind == "email" for x in spans[2]) == 1500 and sum(x.kind == "phone" for x in spans[2]) == 1500
    assert all(numbers[x.s : x.e] in ("a@b.org", "(443) 555-5793") for x in spans[2])
    labelled = spark.createDataFrame([("la casa verde de la montaña", "es"), ("the house of the green hill", "en")], "text string, lang string")
    scored = langid.predict(rows, langid.train(labelled)).filter("doc_id = 1").first()
    assert scored.lang_pred == "es" and scored.score == 1.0
    encoded = bpe.encode(rows, PATH, PATTERN).filter("doc_id = 1").first().token_ids
    assert encoded == tik.encode_ordinary(words)


def test_pieces_of_long_texts_score_like_the_whole():
    """The n-grams of a text that is cut into pieces are those of the text, each once."""
    import pyarrow as pa

    text = "ein Bär, zwei Bären 漢字 " * 9000
    whole = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    n = [int((bucket < langid.BUCKETS).sum()) for _, found, _, _ in langid._grams(pa.array([text])) for bucket in found]
    assert sum(n) == sum(len(whole) - size + 1 for size in langid.SIZES)
