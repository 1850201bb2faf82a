from __future__ import annotations

import random
import re

import numpy as np
import pytest

from rowaudit.llm import ngram_join


def _sets(docs, words):
    out = {}
    for i, text in docs:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if x]
        out[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def _brute(docs, words, num, den):
    s = _sets(docs, words)
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def _corpus(seed: int, n: int = 260):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    docs = []
    for i in range(n):
        if docs and r.random() < 0.6:
            words = docs[r.randrange(len(docs))][1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
                if words:
                    k = r.randrange(len(words))
                    words[k : k + r.randrange(2)] = [r.choice(vocabulary)]
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 9, 12, 30, 60, 200]))]
            if r.random() < 0.3:
                words = passage + words
        docs.append((i, r.choice([" ", "  ", "\t", "\n"]).join(words)))
    return docs


@pytest.mark.parametrize(("seed", "words", "num", "den"), [(1, 3, 9, 10), (2, 5, 8, 10)])
def test_against_brute_force(spark, seed, words, num, den):
    docs = _corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.gram_links(df, words=words, num=num, den=den).collect()}
    assert got == _brute(docs, words, num, den)


def test_whole_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.gram_links(df).collect()}
    assert got == _brute(docs, 3, 9, 10)


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(5000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (None, "a b"), (7, long), (7, long), (8, long + " tail"), (9, "c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as hi", "1 as n", "2 as token")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.gram_links(df).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, 4), (7, 4998, 7), (7, 4998, 7), (8, 4999, 7), (9, 1, 9)], key=repr)
    kept = ngram_join.one_of_each_group(df, words=3, num=9, den=10)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 7, 7, 9]
    assert ngram_join.gram_links(df.limit(0)).count() == 0


def test_near_copies_go_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(None, a), (2, a + " tail"), (None, b), (None, b + " tail"), (None, b), (None, c), (2, d), (1, d + " tail"), (2, "2 is here for once"), (None, "no id, no copy at all"), (None, ""), (None, None), (1, c + " c"), (1, c + " d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each_group(df).collect()]
    single = [(2, a + " tail"), (1, d + " tail"), (2, "2 is here for once"), (None, "no id, no copy at all"), (None, ""), (None, None)]
    assert sorted((r for r in got if r in single), key=repr) == sorted(single, key=repr)
    assert len(got) == len(single) + 2
    assert sum(i is None and (t or "").startswith("b0") for i, t in got) == 1
    assert sum(i == 1 and (t or "").startswith("c0") for i, t in got) == 1


def test_tree_finds_the_components_of_all_links():
    r = random.Random(3)
    sets = []
    for _ in range(120):
        base = set(r.sample(range(400), 60)) if not sets or r.random() < 0.3 else set(sets[r.randrange(len(sets))].tolist())
        for _ in range(r.randrange(5)):
            base.discard(r.choice(sorted(base)))
            base.add(r.randrange(400))
        sets.append(np.array(sorted(base), np.int64))
    forest = ngram_join._Forest()
    for a, b in ngram_join.tree_links(list(range(120)), sets, 9, 10):
        forest.join(a, b)
    want = ngram_join._Forest()
    for a in range(120):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 10 * i >= 9 * (len(sets[a]) + len(sets[b]) - i):
                want.join(a, b)
    assert [forest.find(k) for k in range(120)] == [want.find(k) for k in range(120)]


def test_parity_bits_never_exceed_the_difference():
    r = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.8], r.integers(0, 1 << 63, r.integers(1, 90)).astype(np.uint64)]))
        assert ngram_join.differ_at_least(ngram_join.parity(a), ngram_join.parity(b)) <= len(np.setxor1d(a, b))


def test_one_family_of_thousands_across_components(spark, monkeypatch):
    """Near copies of one text, each with its own edits: most lie just beyond the bound of each other, many in small components."""
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    r = random.Random(11)
    base = [f"v{k}" for k in range(60)]
    docs, stems = [], []
    for i in range(2400):
        words = list(r.choice(stems)) if stems and r.random() < 0.5 else list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            words[r.randrange(60)] = f"x{r.randrange(4000)}"
        stems.append(words)
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.gram_links(df).collect()}
    grams = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for _, t in docs]
    number = {g: k for k, g in enumerate(sorted(set().union(*grams)))}
    hot = np.zeros((len(docs), len(number)), np.float32)
    for i, g in enumerate(grams):
        hot[i, [number[x] for x in g]] = 1
    both, size = hot @ hot.T, hot.sum(axis=1)
    forest = ngram_join._Forest()
    for a, b in zip(*np.nonzero(10 * both >= 9 * (size[:, None] + size[None, :] - both)), strict=True):
        forest.join(int(a), int(b))
    assert got == {i: (len(grams[i]), forest.find(i)) for i in range(len(docs))}
    assert 50 < len({c for _, c in got.values()}) < 2350


def test_sets_that_share_half_of_their_digest(spark):
    docs = _corpus(4, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.gram_links(df, key_bits=5).collect()}
    assert got == _brute(docs, 3, 9, 10)
