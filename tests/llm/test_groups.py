"""Operators that relate rows: against brute force, and on odd input."""

from __future__ import annotations

import collections
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hexsupport.llm import components, embeddings, lines, linking, mixing, ngrams, store
from tests.oracle import SF


def _roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _set(text: str | None) -> set:
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(low))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _corpus(seed: int) -> list[str | None]:
    """Copies, near copies of all degrees, shared passages, and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(50)]
    out: list[str | None] = [None, "", "  ", "one", "ONE", "two words", "x" * 5000]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(6, 160))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own if rng.random() < 0.8 else own + passage))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed):
    texts = _corpus(seed)
    sets = [_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = _roots(len(texts), links)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component string")
    found = {r.doc_id: r for r in ngrams.linked(docs).collect()}
    assert [found[i].component_id for i in range(len(texts))] == want
    assert [found[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    kept = {r.doc_id for r in ngrams.keep_one(docs).collect()}
    assert kept == {i for i in range(len(texts)) if want[i] == i}


@pytest.mark.parametrize(("num", "den"), [(4, 5), (1, 2), (1, 1), (1, 10)])
def test_divide_skip_equals_counting(num, den):
    rng = np.random.default_rng(num * 100 + den)
    linked = 0
    for _ in range(300):
        probe = np.unique(rng.integers(0, 1 << 63, rng.integers(0, 60), dtype=np.uint64))
        sets = []
        for _ in range(rng.integers(1, 30)):
            own = probe[rng.random(len(probe)) < rng.choice([0.1, 0.8, 0.9, 1.0])]
            sets.append(np.unique(np.append(own, rng.integers(0, 1 << 63, rng.integers(0, rng.choice([2, 8, 200])), dtype=np.uint64))))
        both = [len(np.intersect1d(probe, s)) for s in sets]
        expected = [k for k, (s, c) in enumerate(zip(sets, both, strict=True)) if c and den * c >= num * (len(probe) + len(s) - c)]
        assert ngrams.reaching(probe, sets, num, den).tolist() == expected
        linked += len(expected)
    assert linked > 100


def test_near_copies_with_hot_shingles(spark, monkeypatch):
    """A passage that most texts share, in lists that are dealt apart from their buckets."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(30))
    texts = [t if t is None or i % 3 == 0 else f"{passage} {t}" for i, t in enumerate(_corpus(3))]
    sets = [_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    monkeypatch.setattr(ngrams, "HOT", 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    found = {r.doc_id: r.component_id for r in ngrams.linked(docs).collect()}
    assert [found[i] for i in range(len(texts))] == _roots(len(texts), links)


def test_hot_keys_are_looked_up_apart(spark):
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN -8 ELSE id END AS key")
    names = rows.select("key").distinct().selectExpr("key", "key * 2 AS name")
    out = linking.looked_up(rows, names, "key", store.Workspace(spark, "hot"))
    assert sorted(map(tuple, out.select("id", "name").collect())) == [(k, 14 if k % 3 == 0 else -16 if k % 3 == 1 else 2 * k) for k in range(4000)]
    none = linking.looked_up(rows.limit(0), names.limit(0), "key", store.Workspace(spark, "hot"))
    assert none.columns == ["key", "id", "name"] and none.isEmpty()


def test_near_copies_odd_ids(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    docs = spark.createDataFrame([(5, a), (5, a), (7, b), (3, b), (None, a), (None, "z"), (9, None)], "doc_id long, text string")
    rows = collections.Counter((r.doc_id, r.component_id) for r in ngrams.linked(docs).collect())
    assert rows == {(5, 5): 2, (7, 3): 1, (3, 3): 1, (None, 5): 1, (None, None): 1, (9, 9): 1}
    assert ngrams.linked(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in ngrams.keep_one(docs).collect()) == ["3", "5", "9", "None", "None"]


def test_only_the_linked_rows_of_a_repeated_id_go(spark):
    a, b, c, e = "a b c d e f g h", "q r s t u v w x", "i j k l m n o p", "1 2 3 4 5 6 7 8"
    rows = [(1, a), (2, a), (2, b), (3, c), (3, e), (3, e.replace(" ", "  ")), (4, e), (5, ""), (5, None), (None, a), (6, "alone here")]
    docs = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    out = ngrams.keep_one(docs)
    assert out.columns == docs.columns
    want = [(1, a), (2, b), (3, c), (3, e.replace(" ", "  ")), (5, ""), (5, None), (None, a), (6, "alone here")]
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter(want)


def test_a_chain_is_one_component(spark):
    ws = store.Workspace(spark, "test")
    n = 500
    order = list(range(n))
    random.Random(0).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001), (None, 3)], "a long, b long").repartition(7)
    out = {r.id: r.component for r in components.components(edges, ws).collect()}
    assert all(out[i] == 0 for i in range(n)) and out[1000] == out[1001] == 1000
    assert components.components(edges.limit(0), ws).count() == 0


def _vectors(seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for size in (1, 1, 2, 40, 300):
            base = rng.standard_normal(24)
            for _ in range(size):
                x = base + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.25])
                rows.append((k, x.tolist(), label))
                k += 1
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 3, [2.0] * 3]
    return rows + [(k + i, x, 1) for i, x in enumerate(odd)]


def test_vectors_equal_brute_force(spark):
    rows = _vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component", F.lit("x"))
    good = [i for i, (_, x, label) in enumerate(rows) if x and label is not None and None not in x and np.isfinite(x).all() and any(x)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    links = [(i, j) for i in good for j in good if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    want, count = _roots(len(rows), links), collections.Counter(i for i, _ in links)
    out = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(out) == len(rows)
    assert [out[i].component_id for i in range(len(rows))] == want
    assert [out[i].n_links for i in range(len(rows))] == [count[i] for i in range(len(rows))]
    assert all(out[i].kept == (want[i] == i) for i in range(len(rows)))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_no_link_is_lost_in_a_dense_label(spark):
    """A cloud of mutual cosine 0.8 with pairs of cosine 0.95 in it, of more vectors than any window of sorted keys covers."""
    rng = np.random.default_rng(5)
    n, pairs, size = 20_000, 500, 64
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(0.8) * unit(rng.standard_normal(size)) + np.sqrt(0.2) * unit(rng.standard_normal((n, size))))
    aside = rng.standard_normal((pairs, size))
    aside = unit(aside - (aside * x[:pairs]).sum(1)[:, None] * x[:pairs])
    x[n - pairs :] = 0.95 * x[:pairs] + np.sqrt(1 - 0.95**2) * aside
    links = [(i + k, j) for k in range(0, n, 1000) for i, j in np.argwhere(x[k : k + 1000] @ x.T >= 0.93).tolist() if i + k != j]
    assert len(links) >= 2 * pairs
    want, count = _roots(n, links), collections.Counter(i for i, _ in links)
    df = spark.createDataFrame([(i, v, "hot") for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label string")
    out = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert [out[i].component_id for i in range(n)] == want
    assert [out[i].n_links for i in range(n)] == [count[i] for i in range(n)]


def test_one_of_a_group_stays_whatever_columns_are_named(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    rows = [(i, t, 0, 1, 2, "x", "y", "z") for i, t in [(5, a), (5, b), (7, a), (9, b), (8, "w " * 100_000)]]
    for repeated in (True, False):
        docs = spark.createDataFrame(rows[1 - repeated :], "doc_id long, text string, _id int, _NODE int, _own int, _group string, _Least string, _rank string")
        out = ngrams.keep_one(docs)
        assert out.columns == docs.columns
        assert collections.Counter((r.doc_id, r.text[0]) for r in out.collect()) == collections.Counter([(5, "a"), (5, "q"), (8, "w")] if repeated else [(5, "q"), (7, "a"), (8, "w")])


def _deduplicated(texts: dict) -> dict:
    first, order = {}, []
    for i in sorted(texts):
        for j, line in enumerate((texts[i] or "").split("\n")):
            if line.strip(" \t\n\r\x0b\x0c") and line not in first:
                first[line] = (i, j)
                order.append(line)
    sets = [lines.shingles(x) for x in order]
    roots = _roots(len(order), [(a, b) for a in range(len(order)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    stays = {}
    for k, line in enumerate(order):
        stays[roots[k]] = min(stays.get(roots[k], first[line]), first[line])
    place = {line: k for k, line in enumerate(order)}
    return {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if x not in place or stays[roots[place[x]]] == (i, j)) for i, t in texts.items()}


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulrstn") for _ in range(rng.randint(2, 8)))
    pool = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(30)]
    texts: dict = {0: None, 1: "", 2: "\n \n", 3: "short\nshort\nSHORT"}
    for i in range(4, 60):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(pool) if rng.random() < 0.5 else " ".join(word() for _ in range(20))
            if rng.random() < 0.3 and len(line) > 120:
                at = rng.randrange(len(line))
                line = line[:at] + "Z" + line[at + 1 :]
            own.append(line)
        texts[i] = "\n".join(own)
    docs = spark.createDataFrame([(i, t, "y") for i, t in texts.items()], "doc_id long, text string, line string")
    out = {r.doc_id: r for r in lines.deduplicated(docs).collect()}
    want = _deduplicated(texts)
    assert {i: r.text for i, r in out.items()} == want
    for i, r in out.items():
        assert r.n_lines == sum(bool(x.strip()) for x in (texts[i] or "").split("\n"))
        assert r.n_removed == len((texts[i] or "").split("\n")) - len((want[i] or "").split("\n")) or want[i] == ""


def test_lines_in_many_blocks_equal_brute_force(spark, monkeypatch):
    """Families whose lines chain, meet a hub or keep apart, under keys that are hot and groups of many blocks."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulrstn") for _ in range(rng.randint(2, 8)))
    texts: dict = {}
    for _ in range(3):
        line = " ".join(word() for _ in range(30))
        for k in range(60):
            own = line
            for _ in range(1 if k < 30 else 7):
                at = rng.randrange(len(own))
                own = own[:at] + rng.choice("XYZQ") + own[at + 1 :]
            texts[len(texts)] = own + "\n" + word()
            line = own if k % 9 == 8 else line
    monkeypatch.setattr(lines, "BLOCK", 8)
    monkeypatch.setattr(lines, "HOT", 5)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    out = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert out == _deduplicated(texts)


def test_bands_meet_near_copies():
    """The share of pairs of Jaccard similarity 0.8 to 0.86 that have a key in common."""
    rng = random.Random(2)
    met = tried = 0
    while tried < 400:
        a = "".join(rng.choice("abcdefgh ") for _ in range(300))
        b = list(a)
        for _ in range(rng.randint(3, 5)):
            b[rng.randrange(300)] = rng.choice("XYZ")
        b = "".join(b)
        x, y = lines.shingles(a), lines.shingles(b)
        if 0.8 <= len(x & y) / len(x | y) <= 0.86:
            keys = lines._keys(lines._signatures([a.encode(), b.encode()]))
            met, tried = met + bool((keys[0] == keys[1]).any()), tried + 1
    assert met >= 0.98 * tried


def test_lines_of_any_length(spark):
    """A line that is signed in several pieces, a text of many copies of one line, and columns with names like inner ones."""
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    near = long[:100_000] + "#" + long[100_001:]
    docs = spark.createDataFrame([(1, long, "a", "b"), (2, near + "\nown", "c", "d"), (3, "\n".join(["again and again"] * 20_000), "e", "f")], "doc_id long, text string, _row string, GONE string")
    out = {r.doc_id: r for r in lines.deduplicated(docs).collect()}
    assert out[1].text == long and out[2].text == "own" and out[3].text == "again and again"
    assert (out[3].n_lines, out[3].n_removed) == (20_000, 19_999) and (out[2]["_row"], out[3]["GONE"]) == ("c", "f")


def test_lines_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "same line\nother"), (1, "same line\nother"), (2, "same line"), (None, "same line")], "doc_id long, text string")
    out = sorted((str(r.doc_id), r.text) for r in lines.deduplicated(docs).collect())
    assert out == [("1", "other"), ("1", "other"), ("2", ""), ("None", "same line")]
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_raking_meets_the_targets(spark):
    rng = random.Random(7)
    cells = [(s, lang, t, rng.randint(1, 1000)) for s in "abc" for lang in ("x", "y", None) for t in "pq"]
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.2, "y": 0.7, None: 0.1}, {"p": 0.6, "q": 0.4}]
    weight, misfit = mixing.rake(cells, targets)
    assert misfit < 1e-8 and sum(weight) == pytest.approx(1)
    for k, goal in enumerate(targets):
        for v, share in goal.items():
            assert sum(w for c, w in zip(cells, weight, strict=True) if c[k] == v) == pytest.approx(share, abs=1e-7)
    tokens = [c[3] for c in cells]
    chance = mixing.calibrate(tokens, weight, 0.4 * sum(tokens))
    assert max(chance) <= 1 and sum(t * p for t, p in zip(tokens, chance, strict=True)) == pytest.approx(0.4 * sum(tokens))


def test_raking_as_a_table_equals_the_driver(spark):
    rows = spark.createDataFrame([(s, lang, "t", 10 + i * j) for i, s in enumerate("abc") for j, lang in enumerate(["x", "y", None])], "source string, lang string, topic string, n_tokens long")
    key = lambda r: (r.source, str(r.lang))
    one, two = (sorted(mixing.cell_rates(rows, store.Workspace(spark, "t"), {"source": {"a": 0.6, "b": 0.4}}, driver_cells=n, rounds=3).collect(), key=key) for n in (1000, 2))
    assert [r.probability for r in one] == pytest.approx([r.probability for r in two], abs=1e-9)


def test_kept_tokens_come_near_their_targets(spark):
    """The shares of the kept tokens against the targets, and every probability against raking in plain Python."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice("aaab"), rng.choice(("x", "y", "y"))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("topic", F.lit("t"))
    out = mixing.mixed(docs, topic_col="topic", targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}}, budget_share=0.3).collect()
    tokens, kept = collections.Counter(), collections.Counter()
    for r in out:
        tokens[r.source, r.lang] += r.n_tokens
        kept[r.source, r.lang] += r.n_tokens * r.kept
    weight = {c: n / sum(tokens.values()) for c, n in tokens.items()}
    for _ in range(200):
        for k, goal in enumerate(({"a": 0.5, "b": 0.5}, {"x": 0.4, "y": 0.6})):
            total = collections.Counter()
            for c, w in weight.items():
                total[c[k]] += w
            weight = {c: w * goal[c[k]] / total[c[k]] for c, w in weight.items()}
    budget = 0.3 * sum(tokens.values())
    for r in out:
        assert r.probability == pytest.approx(budget * weight[r.source, r.lang] / tokens[r.source, r.lang], rel=1e-6) and r.misfit < 1e-8
    for k, goal in enumerate(({"a": 0.5, "b": 0.5}, {"x": 0.4, "y": 0.6})):
        for v, share in goal.items():
            assert sum(n for c, n in kept.items() if c[k] == v) / sum(kept.values()) == pytest.approx(share, abs=0.04)


@pytest.mark.parametrize("driver_cells", [1000, 1])
def test_misfit_tells_what_a_full_cell_lacks(spark, driver_cells):
    """Half of the tokens are asked of a tenth of them: within a budget of 0.1 they are there, of 0.5 they are not."""
    rows = [(i, "w " * 10, "rare" if i % 10 == 0 else "common", "x") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("topic", F.lit("t"))
    for budget, share in ((0.1, 0.5), (0.5, 0.2)):
        out = mixing.mixed(docs, topic_col="topic", targets={"source": {"rare": 0.5, "common": 0.5}}, budget_share=budget, driver_cells=driver_cells).collect()
        tokens = collections.Counter()
        for r in out:
            tokens[r.source] += r.n_tokens * r.probability
        assert tokens["rare"] / sum(tokens.values()) == pytest.approx(share)
        assert all(r.misfit == pytest.approx(0.5 - share, abs=1e-9) for r in out)


def test_mixing_odd_input(spark):
    docs = spark.createDataFrame([(1, "a b c", None, "en"), (1, "a b c", None, "en"), (None, "d e", "s", None), (2, None, "s", "en"), (3, "", "s", "en")], "doc_id long, text string, source string, lang string").withColumn("weight", F.lit("old"))
    out = mixing.mixed(docs, budget_share=1.0).collect()
    assert len(out) == 5 and len({r.kept for r in out if r.doc_id == 1}) == 1
    assert all(0 <= r.probability <= 1 for r in out) and sorted(r.n_tokens for r in out) == [0, 0, 2, 3, 3]
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ws = store.Workspace(spark, "stages")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = ws.write(stage(spark, before, SF))
        assert after.columns == columns
        was, now = ({r.doc_id: r.text for r in df.collect()} for df in (before, after))
        if name == "language_id":
            assert now == was
        elif name == "line_dedup":
            want = _deduplicated(was)
            assert now == {i: t for i, t in want.items() if t.strip() or not was[i].strip()}
            assert after.filter("n_chars <> length(text)").count() == 0
        elif name == "ngram_jaccard_join":
            ids = sorted(was)
            sets = [_set(was[i]) for i in ids]
            root = _roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
            assert set(now) == {ids[k] for k in range(len(ids)) if root[k] == k}
        else:
            assert set(now) <= set(was)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count() == corpus_pipeline.run(spark, SF).count()


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, Kept int, _node int, COMPONENT string, token_ids int"


def _odd_documents(spark):
    """Two languages, and rows of every odd kind; columns named like inner ones and like results."""
    rng = random.Random(9)
    words = {"en": "the house of green hills and some other small things were there".split(), "es": "la casa de las montañas verdes y algunas otras cosas estaban".split()}
    texts = [(" ".join(rng.choices(words[k], k=rng.randint(20, 60))), k) for k in ("en", "es") for _ in range(15)]
    texts += [(texts[0][0], "en"), (texts[0][0] + " again", "en"), (None, "en"), (None, None), ("", "es"), (" \n\n ", None), ("12 34 !!", "en"), ("漢字 " * 5, None), ("a", "en"), ("the small house " * 20_000, "en")]
    rows = [(i, t, k, "s" if i % 3 else None, len(t or ""), "old", i, 7, "x", None) for i, (t, k) in enumerate(texts)]
    rows += [rows[1], rows[1], (None, *rows[2][1:]), (None, None, *rows[2][2:]), (1, *rows[3][1:])]
    return spark.createDataFrame(rows, ODD_COLUMNS)


def test_pipeline_of_odd_documents(spark):
    """Null, empty, long, repeated and clashing rows pass every stage; only rows without a language, copies and what sampling leaves out go."""
    docs = _odd_documents(spark)
    ws = store.Workspace(spark, "odd")
    before = ws.write(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = ws.write(stage(spark, before, ""))
        assert after.columns == docs.columns, name
        was, now = ([(r.doc_id, r.text, r.n_chars) for r in df.collect()] for df in (before, after))
        if name == "language_id":
            lost = collections.Counter(was) - collections.Counter(now)
            assert not collections.Counter(now) - collections.Counter(was)
            # nothing with letters of the two languages goes, everything without a letter does
            assert {t for _, t, _ in lost} >= {None, "", " \n\n ", "12 34 !!"}
            assert all(not any("a" <= c <= "z" for c in t or "") for _, t, _ in lost)
            assert all(any(c.isalpha() for c in t) for _, t, _ in now)
        elif name == "line_dedup":
            # rows of one id and text are one document; of all others each text stays once
            kept = list({(i, t): t for i, t, _ in now}.values())
            assert len(kept) == len(set(kept)) and all(n == len(t) for _, t, n in now)
            assert {t for _, t, _ in was} >= set(kept)  # each text is one line here
        elif name == "ngram_jaccard_join":
            sets = [_set(t) for i, t, _ in now if i is not None]  # rows without an id always stay
            assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        else:
            assert not collections.Counter(now) - collections.Counter(was)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, "")
    assert {"doc_id", "text", "n_tokens"} & set(last.columns) and last.count() == before.count()


def test_pipeline_of_no_documents(spark, tmp_path):
    none = _odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_pipeline_leaves_only_its_result(spark):
    """What stages wrote on their way is gone from the shared folder."""
    root = store.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, SF)
    (own,) = set(os.listdir(root)) - before
    assert own.startswith("pipeline-") and len(os.listdir(f"{root}/{own}")) == 1 and out.count() > 0


def test_workspaces_are_freed_also_on_failure(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    root = store.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with pytest.raises(KeyError), store.temporary():
        ngrams.keep_one(docs).count()
        assert set(os.listdir(root)) > before
        raise KeyError
    assert set(os.listdir(root)) == before
