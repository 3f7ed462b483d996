"""Quality classifier, phrase mining and ranked search against plain versions on small, awkward tables."""

import collections
import math
import re

import numpy as np
import pytest

from hirelake.llm import oracle, phrase_mining, quality_classifier, ranked_search

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdeé"), RNG.integers(1, 4))) for _ in range(60)]
TEXTS = [
    (1, " ".join(RNG.choice(VOCAB, 3000)), "en"), (2, None, "en"), (3, "", None), (4, "A b. A b! a B\na b c a b", None),
    (5, "a a a a a a a", "de"), (6, " ".join(RNG.choice(VOCAB[:8], 900)) + ".", "de"), (7, " \t\n", "fr"), (None, "a a a", "de"),
    (8, "x\x00y x\x00y x\x00y", "fr"), (9, "one two three four five six. " * 30, "fr"), (9, "one two three four five six. " * 30, "fr"),
]
COLUMNS = "doc_id long, text string, lang string, id string, n string, rank int, numbers string, phrase string, item_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "x", "y", 1, "z", "p", "i") for t in TEXTS], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def plain_phrases(least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for _, t, lang in TEXTS:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    held = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    rows = []
    for (lang, w), a in held.items():
        parts = lambda x: {x[i:j] for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        if any(c >= a for (m, x), c in held.items() if m == lang and len(x) > len(w) and w in parts(x)):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out = []
    for lang in n:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return out


@pytest.mark.parametrize("least,longest,top", [(3, 5, 2000), (20, 3, 7), (1, 2, 50)])
def test_phrases(docs, least, longest, top):
    got = phrase_mining.collocations(docs, least, longest, top).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(least, longest, top))


def test_phrases_in_rounds_and_shards(docs, monkeypatch):
    for name, value in (("PAIRS", 900), ("TRIE", 40), ("WORDS", 7), ("ROW", 100)):
        monkeypatch.setattr(phrase_mining, name, value)
    got = phrase_mining.collocations(docs, 4, 4, 2000).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(4, 4, 2000))


def test_no_phrases(docs, none):
    assert phrase_mining.collocations(none).count() == 0
    assert phrase_mining.collocations(docs.filter("doc_id = 2")).count() == 0


def test_cut_score_is_exact(spark):
    a, n, left, right = 9_000_000_000_000, 12_345_678_901_234, 9_000_000_000_001, 9_999_999_999_999
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    from pyspark.sql import functions as F

    got = row.select(phrase_mining.cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_trie_steps():
    s, t = (RNG.integers(1, 300, 4000).astype(np.uint32) for _ in range(2))
    pairs = sorted(set(zip(s.tolist(), t.tolist())))
    s, t = (np.array(x, np.uint32) for x in zip(*pairs))
    trie = phrase_mining.Trie(s, t, np.arange(1, len(s) + 1))
    x = RNG.integers(0, 320, 20_000).astype(np.uint32)
    at, slot = trie.reached(x)
    number = {p: k + 1 for k, p in enumerate(pairs)}
    want = {i: number[p] for i, p in enumerate(zip(x[:-1].tolist(), x[1:].tolist())) if p in number}
    assert dict(zip(at.tolist(), trie.ids[slot].tolist())) == want and len(trie.check) < 3 * len(pairs)


ITEMS = [(10, "One TWO two missing"), (11, "a b é"), (12, None), (13, ""), (14, " ".join(VOCAB[:9])), (14, "a b é"), (None, "x y")]


def plain_search(top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    held = [(i, collections.Counter(terms(t))) for i, t, _ in TEXTS if terms(t)]
    docs, size = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in ITEMS:
        rows = []
        for i, c in held:
            m = 50 + 50 * c.total() * docs // size
            s = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                rows.append((-s, -1 if i is None else i))
        out += [(item, k + 1, None if i == -1 else i, -s) for k, (s, i) in enumerate(sorted(rows)[:top])]
    return out


@pytest.mark.parametrize("leaf,block,terms", [(16, 8192, 500_000), (1, 8192, 500_000), (2, 3, 5)])
def test_search(spark, docs, monkeypatch, leaf, block, terms):
    for name, value in (("LEAF", leaf), ("BLOCK", block), ("TERMS", terms)):
        monkeypatch.setattr(ranked_search, name, value)
    items = spark.createDataFrame([(*i, "r") for i in ITEMS], "item_id long, text string, rank string")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = ranked_search.ranked_search(docs, items, 3).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_search(3), key=key)


def test_search_of_nothing(docs, none, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.ranked_search(none, items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    n, kinds = 3000, 200
    at = [np.sort(rng.choice(kinds, rng.integers(0, 30), replace=False, p=(w := 1 / np.arange(1, kinds + 1)) / w.sum())) for _ in range(n)]
    tf = [rng.integers(1, 9, len(a)).astype(np.int64) for a in at]
    ids, m = rng.permutation(n), rng.integers(50, 300, n).astype(np.int64)
    tree = ranked_search.Tree(ids, m, at, tf)
    seen, plain = [], ranked_search.Tree.scores
    for _ in range(20):
        item = np.sort(rng.choice(kinds, 8, replace=False))
        weight = rng.integers(0, 5000, 8)
        said = np.array([sum(int(ranked_search.gained(w, t[a == k], m[i]).sum()) for k, w in zip(item, weight)) for i, (a, t) in enumerate(zip(at, tf))])
        bound = tree.bounds(item, weight)
        of = {int(i): int(s) for i, s in zip(ids, said)}
        for node, (lo, hi) in enumerate(zip(tree.lo, tree.hi)):
            assert all(of[int(i)] <= bound[node] for i in tree.ids[lo:hi])
        tree.scores = lambda lo, hi, *rest: (seen.append(hi - lo), plain(tree, lo, hi, *rest))[1]
        got = list(zip(*(x.tolist() for x in tree.best(item, weight, 10))))
        assert got == sorted(((int(i), int(s)) for i, s in zip(ids, said) if s > 0), key=lambda x: (-x[1], x[0]))[:10]
    assert sum(seen) < 0.8 * 20 * n


def test_classifier(spark, docs, none):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 40))
    bad = lambda: " ".join(w + "###" for w in rng.choice(["alpha", "beta", "gamma", "delta"], 40))
    rows = [(i, good() if i % 3 else bad(), "x") for i in range(240)]
    d = spark.createDataFrame(rows + [(1, rows[1][1], "x"), (None, "text", "x"), (500, None, "x"), (501, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)] + [(2, None), (None, 1), (3, 1)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    got = quality_classifier.classify(d, labels, F.coalesce(F.col("doc_id") >= 200, F.lit(False))).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id and 160 <= r.doc_id < 240)
    assert len({r.score for r in got if r.doc_id in (500, 501)}) == 1
    unlearnt = quality_classifier.classify(docs, labels.limit(0), F.lit(False)).collect()
    assert {r.score for r in unlearnt} == {0.5} and len(unlearnt) == len(TEXTS)
    assert quality_classifier.classify(none, labels, F.lit(True)).count() == 0


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(RNG.choice(VOCAB, 400)) + " a a Éa\t\nb"
    whole = np.sort(np.concatenate([*quality_classifier.features(text)]))
    monkeypatch.setattr(quality_classifier, "PIECE", 64)
    assert (np.sort(np.concatenate([*quality_classifier.features(text)])) == whole).all()


def test_sql_is_there():
    assert {"op12_phrase_mining", "op13_ranked_search"} <= set(oracle.ORACLE)


def test_rows_of_sequences_are_small():
    """Readers hold thousands of rows at once, so rows stay near ROW numbers, however long the texts; numbers and breaks stay."""
    texts = [np.tile(np.array([5, 6, 7, 0, 0, 8, 0], np.uint32), 20_000), np.array([0, 1, 2, 0], np.uint32), np.zeros(1, np.uint32), np.full(3_000, 9, np.uint32) * (np.arange(3_000) < 2_999)]
    batches = list(phrase_mining._written(iter(texts)))
    rows = [np.frombuffer(x, np.uint32) for b in batches for x in b.column(0).to_pylist()]
    assert max(map(len, rows[:-1])) <= phrase_mining.ROW + 3_000 and sorted(map(len, rows))[len(rows) // 2] <= phrase_mining.ROW + 8
    x = np.concatenate(texts)
    stays = (x != 0) | np.append(False, x[:-1] != 0)
    assert all(r[-1] == 0 for r in rows) and np.array_equal(np.concatenate(rows), x[stays])
    assert np.array_equal(np.concatenate(list(phrase_mining._sequences(b.slice(1) for b in batches))), np.concatenate(rows)[len(rows[0]) :])
    assert list(phrase_mining._written(iter([]))) == [] and next(phrase_mining._written(iter([np.zeros(2, np.uint32)]))).num_rows == 0
