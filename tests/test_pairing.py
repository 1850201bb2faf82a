"""Rows paired by their place, from files that lie in order already."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowaudit.operators import diff, fingerprint, numbering
from rowaudit.sources import tables


def _plain(s, t, key):
    """What a positional difference must give, by sorting both sides whole."""
    a, b = ([r.row_hash for r in sorted(fingerprint.fingerprint(df, [key]).collect(), key=lambda r: (r[key] is not None, r[key] or 0, r.row_hash))] for df in (s, t))
    kind = lambda x, y: "missing" if y is None else "extra" if x is None else "matching" if x == y else "mismatched"
    width = max(len(a), len(b))
    a, b = a + [None] * (width - len(a)), b + [None] * (width - len(b))
    return [(i + 1, kind(x, y), x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))]


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(numbering, "_LEAST", 30)


def test_paired_rows_are_not_shuffled_again(spark, short):
    s = spark.range(500).selectExpr("id % 7 as k", "id as v")
    d = diff.positional_diff(s, s.filter("v <> 30"), ["k"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan parquet") == 16
    assert d.rdd.getNumPartitions() == 8


@pytest.mark.parametrize("lost", ["v < 300", "v % 3 = 0", "v >= 0", "v = 5", "v > 700"])
def test_stretches_give_what_sorting_whole_gives(spark, short, lost):
    s = spark.range(1000).selectExpr("if(id % 10 = 3, null, id % 97) as k", "id as v").unionAll(spark.range(150).selectExpr("5L as k", "-1L as v"))
    t = s.filter(f"not ({lost}) or v < 0").unionAll(spark.range(40).selectExpr("id as k", "id + 5000 as v"))
    for a, b in ((s, t), (t, s)):
        assert [tuple(r) for r in diff.positional_diff(a, b, ["k"]).orderBy("row_id").collect()] == _plain(a, b, "k")


def test_one_side_or_both_may_be_empty(spark, short):
    s = spark.range(200).selectExpr("id as k")
    none = s.limit(0)
    assert {tuple(r) for r in diff.positional_diff(s, none, ["k"]).groupBy("category").count().collect()} == {("missing", 200)}
    assert {tuple(r) for r in diff.positional_diff(none, s, ["k"]).groupBy("category").count().collect()} == {("extra", 200)}
    assert diff.positional_diff(none, none, ["k"]).count() == 0


def test_no_stretch_grows_beyond_what_a_task_should_sort(spark, monkeypatch):
    monkeypatch.setattr(numbering, "_MOST", 20)
    s = spark.range(400).selectExpr("id as k")
    d = diff.positional_diff(s, s.filter("k <> 9"), ["k"])
    assert d.rdd.getNumPartitions() == 20
    assert max(r[0] for r in d.groupBy(F.spark_partition_id()).count().select("count").collect()) == 20
    assert sorted(tuple(r) for r in d.groupBy("category").count().collect()) == [("matching", 9), ("mismatched", 390), ("missing", 1)]


def test_folders_may_have_any_names_and_go_together(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    monkeypatch.setattr(tables, "shared_dir", lambda _: str(folder))
    s = spark.range(50).selectExpr("id as k")
    assert diff.positional_diff(s, s, ["k"]).filter("category = 'matching'").count() == 50
    assert len(list(folder.iterdir())) == 1
    with tables.attempt(spark):
        diff.positional_diff(s, s, ["k"])
        assert len(list(folder.iterdir())) == 2
    assert len(list(folder.iterdir())) == 1


def test_rows_that_are_equal_spread_over_ranges(spark):
    ranges = []
    numbered = numbering.numbered(spark.range(0, 100_000, 1, 2).selectExpr("1 as k"), ["k"], partitions=8, ranges=ranges)
    assert max(r.size for r in ranges) < 30_000
    assert numbered.agg(F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()[:] == (100_000, 1, 100_000)
