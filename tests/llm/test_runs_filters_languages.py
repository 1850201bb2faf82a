"""Periodic runs, filter audits and language identification against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rowaudit.llm import filter_audit, language_id, periodic_runs, queries

from ..compare import rows

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Ünï, it's 3 x" + chr(160) + "y"), (4, "Ünï, it's 3 x" + chr(160) + "y"), (None, "plain words"), (7, "word " * 30_000), (8, "a b c " * 20), (8, "a b c " * 20)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'z' as runs", "1 as n_words", "2 as score", "'xx' as lang", "5 as mask")


def _plain_runs(word, least=24, power=3):
    """Every period in turn, from the smallest: stretches of equal words, unless a smaller period has them."""
    out, n = [], len(word)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if word[i] != word[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and word[j] == word[j + q]:
                j += 1
            length = j - i + q
            own = word[i : i + length]
            if length >= max(least, power * q) and not any(all(own[k] == own[k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out)


def test_runs_against_every_period():
    r = np.random.default_rng(3)
    texts = []
    for k in range(300):
        base = r.integers(0, 2 + k % 4, r.integers(0, 90))
        for _ in range(k % 3):
            at, p = r.integers(0, len(base) + 1), r.integers(1, 20)
            base = np.concatenate([base[:at], np.tile(r.integers(0, 3, p), r.integers(2, 7))[: -int(r.integers(1, 3))], base[at:]])
        texts.append(base)
    texts += [np.zeros(500, int), np.arange(100) % 33, np.arange(99) % 33, np.arange(98) % 33, np.zeros(24, int), np.zeros(23, int)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = periodic_runs.find_runs(np.concatenate(texts), ends)
    want = [(k, *x) for k, t in enumerate(texts) for x in _plain_runs(t.tolist())]
    assert [tuple(map(int, x)) for x in got] == want
    assert len(want) > 100
    small = periodic_runs.find_runs(np.concatenate(texts), ends, least=6, power=4)
    assert [tuple(map(int, x)) for x in small] == [(k, *x) for k, t in enumerate(texts) for x in _plain_runs(t.tolist(), 6, 4)]


def test_runs_are_refused_below_three_periods():
    with pytest.raises(ValueError, match="three periods"):
        periodic_runs.find_runs(np.zeros(9, int), np.array([0, 9]), power=2)


def test_periodic_runs_query_against_plain_python(spark, sf):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in docs:
        word, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(word), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            word = [word[i] if i < a else word[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue  # the plain version is quadratic; the next test has a long text
        runs = _plain_runs(word)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(word) if i not in gone)))
        assert tuple(got[doc_id])[1:] == want, doc_id


def test_runs_of_a_long_text(spark):
    r = np.random.default_rng(1)
    noise, unit = [f"n{k}" for k in r.integers(0, 10**9, 20_000)], [f"u{k}" for k in range(5000)]
    text = " ".join(noise + unit * 4 + unit[:77] + noise[:3])
    got = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in got["runs"]] == [(20_000, 20_077, 5000)]
    assert got["collapsed"] == " ".join(noise + unit + noise[:3])


def test_the_strongest_run_is_compared_exactly():
    assert periodic_runs._strongest(np.array([[0, 5, 30, 10], [0, 50, 33, 11], [0, 90, 31, 10], [0, 120, 62, 20]])) == 2
    big = 10**15
    assert periodic_runs._strongest(np.array([[0, 5, 3 * big, big], [0, 9, 3 * big + 1, big]])) == 1


def test_runs_odd_rows(spark, odd):
    got = sorted(((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic_runs.periodic_runs(odd).collect()), key=repr)
    unit = "Ünï, it's 3 x" + chr(160) + "y"
    assert got == sorted(
        [(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 4, (), unit), (4, 4, (), unit), (None, 2, (), "plain words"), (7, 30_000, ((0, 30_000, 1),), "word"), (8, 60, ((0, 60, 3),), "a b c"), (8, 60, ((0, 60, 3),), "a b c")], key=repr
    )
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0


def test_text_counts_against_plain_python():
    r = np.random.default_rng(5)
    some = list("abAB  \t\n\r\x0b\x0cÉé漢😀#$%&*|  ") + ["ab", "ab "]
    texts = ["".join(r.choice(some, r.integers(0, 60))) for _ in range(400)] + [None, "", " ", "x", "É" * 50]
    for part in (pa.array(texts, pa.string()), pa.array(["zz", *texts], pa.string())[1:], pa.array([], pa.string())):
        got = filter_audit.text_counts(part)
        for k, t in enumerate(part.to_pylist()):
            t = t or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            assert [int(got[c][k]) for c in filter_audit.COUNTS] == [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))]


def test_filter_audit_of_odd_tables(spark):
    long = " ".join(f"w{k}" for k in range(120))
    docs = [(5, long, "en"), (3, long, "en"), (3, long, "de"), (9, long, None), (None, long, "en"), (7, long.upper(), ""), (8, None, "en"), (2, "", "en"), (1, "short #", "de"), (1, "short #", "de"), (6, "word " * 500, "en"), (4, long + " É|", "fr")]
    labels = [(5, 1, 0), (5, 0, 1), (3, 1, None), (None, 1, 1), (6, 0, 1), (8, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'q' as part", "1 as mask", "2 as n_words", "3 as good", "'h' as hash").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as mask")
    con = duckdb.connect()
    for name, table in (("documents", df.select("doc_id", "text", "lang")), ("labels", known.select("doc_id", "quality", "toxic"))):
        con.register(name, table.toArrow())
    got = filter_audit.filter_audit(df, known).toPandas()
    assert rows(got) == rows(con.sql(queries.ORACLE_SQL["op12_filter_audit"]).df())
    assert len(got) == 4 * 600
    assert filter_audit.filter_audit(df.limit(0), known.limit(0)).count() == 0


def test_interactions_of_two_filters(spark):
    cells = spark.createDataFrame([("p", 0, 10, 2, 0), ("p", 1, 3, 1, 0), ("p", 2, 4, 0, 4), ("p", 3, 5, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit.interactions(cells, "XY").collect()}
    assert got == {("XY", 1): (14, 8, 0, 3, 2, 1, 11), ("XY", 2): (10, 4, 5, 4, 0, 4, 13), ("YX", 1): (13, 9, 0, 4, 1, 5, 13), ("YX", 2): (10, 3, 5, 3, 1, 0, 11)}


@pytest.fixture(scope="module")
def vocabulary():
    return language_id.Vocabulary(TOKENIZER)


def _ways(vocabulary, word):
    """All ways to spell a word, as lists of piece numbers."""
    number = {p: k for k, p in enumerate(vocabulary.pieces)}
    symbols = (*word.encode(), language_id.END)

    def rest(at):
        if at == len(symbols):
            yield []
        for to in range(at + 1, len(symbols) + 1):
            if (k := number.get(symbols[at:to])) is not None:
                for tail in rest(to):
                    yield [k, *tail]

    return list(rest(0))


WORDS = ["the", "straße", "a", "ñandú", "hello", "zzzz", "的", "international"[:9], "the"]


def test_forward_sums_all_segmentations(vocabulary):
    r = np.random.default_rng(2)
    p = r.random((len(vocabulary.pieces), 3)) ** 4
    log_p = np.log(p / p.sum(axis=0))
    got = language_id.word_scores(vocabulary, pa.array(WORDS), log_p)
    for k, w in enumerate(WORDS):
        want = [math.log(sum(math.exp(sum(log_p[x, lang] for x in way)) for way in _ways(vocabulary, w))) for lang in range(3)]
        assert got[k] == pytest.approx(want, rel=1e-9)


def test_expected_pieces_against_all_segmentations(vocabulary):
    r = np.random.default_rng(4)
    p = r.random((len(vocabulary.pieces), 2)) ** 4
    log_p = np.log(p / p.sum(axis=0))
    lang, n = np.array([k % 2 for k in range(len(WORDS))]), np.arange(1.0, len(WORDS) + 1)
    want = np.zeros(log_p.shape)
    for w, a, m in zip(WORDS, lang, n, strict=True):
        ways = _ways(vocabulary, w)
        weight = np.array([math.exp(sum(log_p[x, a] for x in way)) for way in ways])
        for way, share in zip(ways, weight / weight.sum(), strict=True):
            np.add.at(want, (way, a), share * m)
    got = language_id.expected_pieces(vocabulary, pa.array(WORDS), lang, n, log_p) / language_id.UNIT
    assert np.abs(got - want).max() < 0.02


def test_remembered_words_have_the_same_scores(vocabulary, monkeypatch):
    log_p = np.log(np.random.default_rng(1).random((len(vocabulary.pieces), 2)) + 1e-3)
    monkeypatch.setattr(language_id, "GROUP", 3)
    monkeypatch.setattr(language_id, "REMEMBERED", 8)
    spelled = language_id._Remembered(vocabulary, log_p)
    for some in (["the", "a"], ["a", "zzzz", "ñandú"], ["hello"], ["the", "a", "hello", "straße", "的", "x"], [], ["x"]):
        assert np.array_equal(spelled.of(some), language_id.word_scores(vocabulary, pa.array(some, pa.string()), log_p))
        assert len(spelled.place) <= max(4, len(some))


def test_long_words_do_not_underflow(vocabulary):
    log_p = np.full((len(vocabulary.pieces), 2), -math.log(len(vocabulary.pieces)))
    got = language_id.word_scores(vocabulary, pa.array(["qx" * 3000, "a"]), log_p)
    assert np.isfinite(got).all() and (got[0] < -1000).all()


def test_language_of_held_out_texts(spark, sf):
    got = queries.op13_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_model_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").limit(60)
    a, b = (language_id.train(docs.repartition(n), TOKENIZER) for n in (1, 5))
    assert a.langs == b.langs and np.array_equal(a.log_p, b.log_p) and np.array_equal(a.prior, b.prior)


def test_language_odd_rows(spark, odd):
    learnt = spark.createDataFrame([("the cat and the dog", "en"), ("el gato y el perro", "es"), (None, "es"), ("nothing said", None), ("", "en"), ("123", "zz")], "text string, lang string").selectExpr("*", "1 as word", "2 as n")
    model = language_id.train(learnt, TOKENIZER)
    assert model.langs == ["en", "es", "zz"]
    odd = odd.unionByName(spark.createDataFrame([(20, "12 3!"), (21, "the dog"), (22, "EL PERRO")], "doc_id long, text string"), allowMissingColumns=True)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(odd, model, TOKENIZER).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (20, "und"), (21, "en"), (22, "es")} <= got
    assert not any(lang == "und" for k, lang in got if k in (4, 7, 8, None))
    assert language_id.predict(odd.limit(0), model, TOKENIZER).count() == 0
    nothing = language_id.train(learnt.limit(0), TOKENIZER)
    assert {tuple(r)[1:] for r in language_id.predict(odd, nothing, TOKENIZER).collect()} == {("und", 0.0)}


def test_all_orders_are_there(spark, sf):
    got = queries.op12_filter_audit(spark, sf).filter("part = 'en'").select("filter_order").distinct().collect()
    assert {r[0] for r in got} == {"".join(p) for p in itertools.permutations("ABCDE")}
