"""Each stage of the pipeline against brute force on what it was given."""

from __future__ import annotations

import re

import corpus_pipeline
from rowaudit.llm import pii, toxicity

from .test_ngram_join import _brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = corpus_pipeline.without_toxic(spark, docs, sf).persist()
    assert one.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"] for r in toxicity.score(docs, model, into="s").filter("s < 0.5").collect()}
    assert {r["doc_id"] for r in one.collect()} == kept

    two = corpus_pipeline.without_exact_copies(spark, one, sf).persist()
    first = {}
    for r in sorted(one.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]), r["doc_id"])
    assert {r["doc_id"] for r in two.collect()} == set(first.values())

    three = corpus_pipeline.without_near_copies(spark, two, sf).persist()
    groups = _brute([(r["doc_id"], r["text"]) for r in two.collect()], 5, 8, 10)
    assert {r["doc_id"] for r in three.collect()} == {i for i, (_, c) in groups.items() if i == c}

    four = corpus_pipeline.without_personal_data(spark, three, sf).persist()
    assert four.dtypes == docs.dtypes
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        assert r["text"] == pii.redact(before[r["doc_id"]], pii.find(before[r["doc_id"]]))
        assert r["n_chars"] == len(r["text"])

    five = corpus_pipeline.packed(spark, four, sf)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in four.collect()}


def test_run_equals_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() == len({(r["doc_id"], r["piece"]) for r in got.collect()})


def test_dedup_stages_decide_by_row(spark, sf):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (None, text.upper()), (None, "alone, no id"), (4, text + " near"), (4, "alone, id 4"), (3, text + " near it"), (None, "no id here either")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two = corpus_pipeline.without_exact_copies(spark, docs, sf).persist()
    assert two.count() == 6
    three = corpus_pipeline.without_near_copies(spark, two, sf)
    assert sorted(((r["doc_id"], r["text"]) for r in three.collect()), key=repr) == sorted([(None, "alone, no id"), (4, "alone, id 4"), (3, text + " near it"), (None, "no id here either")], key=repr)


CLASHES = {"score": "1", "norm": "2", "hash": "3", "rank": "4", "_row": "5", "component_id": "6", "slot": "7", "key": "8"}


def _odd_docs(spark):
    copy, near = " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(78)) + " other end"
    rows = [
        (1, copy), (2, copy.upper()), (3, near), (None, copy), (None, None), (None, ""), (5, "mail me: some.one@host.example.org now"), (5, "same id, other text"), (5, "same id, other text"),
        (6, "you stupid worthless idiot, pathetic scum"), (7, "plain words " * 40_000), (8, " \n"), (9, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *(f"'{v}' as `{c}`" for c, v in CLASHES.items())).repartition(3), rows


def test_stages_on_odd_rows(spark, sf):
    docs, rows = _odd_docs(spark)
    one = corpus_pipeline.without_toxic(spark, docs, sf)
    assert one.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=repr)
    assert [r for r in sorted(rows, key=repr) if r not in kept] in ([], [rows[9]])
    two = corpus_pipeline.without_exact_copies(spark, docs, sf)
    assert two.columns == docs.columns
    texts = [(r["doc_id"], (r["text"] or "").lower()) for r in two.collect()]
    assert sorted(t for _, t in texts) == sorted({(t or "").lower() for _, t in rows})
    assert (1, rows[0][1]) in texts
    assert (9, "") in texts
    three = corpus_pipeline.without_near_copies(spark, docs, sf)
    assert three.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in three.collect()]
    assert [r for r in left if (r[1] or "").lower().startswith("w0 w1")] == [(1, rows[0][1])]
    assert sorted((r for r in left if not (r[1] or "").strip()), key=repr) == sorted([(None, None), (None, ""), (8, " \n"), (9, None)], key=repr)
    assert (5, rows[6][1]) in left
    four = corpus_pipeline.without_personal_data(spark, docs, sf)
    assert four.dtypes == docs.dtypes
    assert sorted((r["doc_id"], r["text"]) for r in four.collect() if r["doc_id"] == 5)[0] == (5, "mail me: [EMAIL] now")
    five = corpus_pipeline.packed(spark, docs, sf).collect()
    assert sum(r["n_tokens"] == 1 for r in five) >= 4
    assert {r["doc_id"] for r in five} == {i for i, _ in rows}
    assert all(r["bin_start"] + r["n_tokens"] <= r["bin_length"] for r in five)


def test_stages_on_an_empty_table(spark, sf):
    empty = _odd_docs(spark)[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0, name
        assert name == "best-fit packing" or out.columns == empty.columns
