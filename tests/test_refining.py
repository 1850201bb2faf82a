"""An order that is refined gives the rows of one that is sorted again."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowaudit.operators import diff, refining


def _tables(spark, seed, n=300, texts=("A", "B", None)):
    dice = random.Random(seed)
    rows = [(dice.choice(texts), dice.choice([1.0, 2.0, float("nan"), None]), dice.randrange(3), dice.randrange(4), dice.randrange(60), dice.choice("xyz ")) for _ in range(n)]
    rows += rows[:20]
    other = [(*r[:5], "q") if dice.random() < 0.1 else r for r in rows]
    dice.shuffle(other)
    kinds = "a string, b double, c int, d long, e int, f string"
    return spark.createDataFrame(rows, kinds).repartition(3), spark.createDataFrame(other, kinds).repartition(2)


def _rows(d):
    return sorted((tuple(r) for r in d.select("row_id", "category", "source_hash", "target_hash").collect()), key=repr)


@pytest.mark.parametrize(("seed", "texts", "partitions"), [(1, ("A", "B", None), 5), (2, ("a", " A", "b ", "B"), 3), (3, ("A",), 40)])
def test_the_same_rows_as_sorting_again(spark, seed, texts, partitions):
    s, t = _tables(spark, seed, texts=texts)
    want, n_want = diff.diff_with_retry(s, t, ["a"], ["b", "c", "d", "e", "f"])
    got, n_got = refining.diff_refined(s, t, ["a"], ["b", "c", "d", "e", "f"], partitions=partitions)
    assert n_got == n_want
    assert _rows(got) == _rows(want)


def test_only_tied_rows_are_sorted_again(spark, monkeypatch):
    sizes, whole = [], refining.ordered
    monkeypatch.setattr(refining, "ordered", lambda df, *rest: (sizes.append(df.count()), whole(df, *rest))[1])
    s = spark.range(1000).selectExpr("if(id < 980, id, 980) as k", "id % 3 as a", "id as b", "'x' as v")
    t = s.withColumn("v", F.when(F.col("b") == 7, "y").otherwise("x"))
    got, used = refining.diff_refined(s, t, ["k"], ["a", "b"], steps=(0, 1, 2))
    assert (used, sizes) == (2, [1000, 1000, 20, 20, 20, 20])
    assert {r[0]: r[1] for r in got.groupBy("category").count().collect()} == {"matching": 999, "mismatched": 1}
    assert _rows(got) == _rows(diff.diff_with_retry(s, t, ["k"], ["a", "b"], steps=(0, 1, 2))[0])


def test_empty_lost_rows_and_equal_tables(spark):
    s, t = _tables(spark, 4, 40)
    for x, y in ((s, s), (s.limit(0), t), (s.limit(0), t.limit(0)), (s, t.filter("e > 3"))):
        x, y = x.persist(), y.persist()
        (got, a), (want, b) = refining.diff_refined(x, y, ["a"], ["b", "c"]), diff.diff_with_retry(x, y, ["a"], ["b", "c"])
        assert a == b
        assert _rows(got) == _rows(want)
