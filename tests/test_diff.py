"""Differences: invariants and edge values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowaudit.operators import counts, diff, numbering, objects
from rowaudit.sources import tables


def _pair(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n"), (5, None)], "k int, v string")
    t = spark.createDataFrame([(1, "a  "), (2, "x"), (4, "d"), (None, "n"), (5, None)], "k int, v string")
    return s, t


def test_keyed_diff_with_null_keys(spark):
    s, t = _pair(spark)
    got = {(r["k"], r["category"]) for r in diff.keyed_diff(s, t, ["k"]).collect()}
    assert got == {(1, "matching"), (2, "mismatched"), (3, "missing"), (4, "extra"), (None, "matching"), (5, "matching")}
    row = diff.diff_totals(diff.keyed_diff(s, t, ["k"])).first()
    assert (row["source_rows"], row["target_rows"], row["match_percent"], row["is_match"]) == (5, 5, 60.0, False)
    assert diff.diff_totals(diff.keyed_diff(s, s, ["k"])).first()["is_match"]
    empty = diff.diff_totals(diff.keyed_diff(s.limit(0), t.limit(0), ["k"])).first()
    assert (empty["source_rows"], empty["match_percent"], empty["is_match"]) == (0, 0.0, True)


def test_missing_and_extra_keys_with_nulls(spark):
    s, t = _pair(spark)
    assert [r["k"] for r in diff.missing_keys(s, t, ["k"]).collect()] == [3]
    assert [r["key_text"] for r in diff.missing_keys(t, s, ["k"]).collect()] == ["4"]


def test_multiset_diff_counts_copies(spark):
    s = spark.createDataFrame([("a",)] * 5 + [("b",)], "v string")
    t = spark.createDataFrame([("a",)] * 3 + [("c",)] * 2, "v string")
    row = diff.query_parity(s, t).first()
    assert (row["source_rows"], row["target_rows"], row["missing"], row["extra"], row["same"]) == (6, 5, 3, 2, False)
    assert diff.query_parity(s, s).first()["same"]


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_numbers_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("x"), "id")
    got = numbering.numbered(df, [F.col("x"), F.col("id")], partitions=partitions).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(1, 1001))
    assert [(r["x"], r["id"]) for r in got] == sorted((r["x"], r["id"]) for r in got)


def test_positional_equals_keyed_without_missing_or_extra_rows(spark):
    s = spark.range(200).select("id", (F.col("id") % 7).cast("string").alias("v"))
    t = s.withColumn("v", F.when(F.col("id") % 50 == 3, "x").otherwise(F.col("v")))
    count = lambda d: {r["category"]: r["count"] for r in d.groupBy("category").count().collect()}
    assert count(diff.positional_diff(s, t, ["id"])) == count(diff.keyed_diff(s, t, ["id"])) == {"matching": 196, "mismatched": 4}


def test_column_diff_marks_an_ordering_problem(spark):
    s = spark.createDataFrame([(1, "a", "b", "c")], "k int, x string, y string, z string")
    t = spark.createDataFrame([(1, None, None, None)], "k int, x string, y string, z string")
    row = diff.column_diff(s, t, ["k"]).first()
    assert (row["n_differing"], row["differing"], row["source_nulls"], row["target_nulls"], row["ordering_problem"]) == (3, "x,y,z", 0, 3, True)


@pytest.mark.parametrize(
    ("s", "t", "kind", "severity"),
    [
        (5, 5, "Match", "Info"), (0, 5, "Row Count Mismatch", "Critical"), (5, 0, "Row Count Mismatch", "Critical"), (1000, 1010, "Row Count Mismatch", "Warning"), (1000, 1011, "Row Count Mismatch", "Error"),
        (1000, 1100, "Row Count Mismatch", "Error"), (1000, 1101, "Row Count Mismatch", "Critical"), (-1, -1, "Query Error", "Error"), (-1, 3, "Source Query Error", "Error"), (3, -1, "Target Query Error", "Error"),
        (3, None, "Missing Table", "Critical"), (None, 3, "Extra Table", "Warning"), (0, 0, "Match", "Info"),
    ],
)
def test_count_severity(spark, s, t, kind, severity):
    side = lambda n, name: spark.createDataFrame([("s", name, n)] if n is not None else [], "schema_name string, table_name string, row_count long")
    row = counts.compare_counts(side(s, "T"), side(t, "t")).first()
    assert (row["issue_type"], row["severity"]) == (kind, severity)


def test_logical_schema_leaves_partitions_out(spark):
    names = [("s", "asset"), ("s", "asset_sys_p1"), ("s", "organization")]
    t = spark.createDataFrame(names, "schema_name string, table_name string")
    c = spark.createDataFrame([("s", "asset", "id"), ("s", "asset_sys_p1", "id"), ("s", "organization", "id"), ("s", "organization", "name")], "schema_name string, table_name string, column_name string")
    p = spark.createDataFrame([("s", "asset", "asset_sys_p1")], "schema_name string, parent_table string, partition_name string")
    row = objects.logical_summary(t, c, p).first()
    assert (row["logical_tables"], row["physical_tables"], row["logical_columns"], row["partitioned_tables"], row["partitions"]) == (2, 3, 3, 1, 1)


def test_hashes_are_written_as_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab")], "Row_ID long, Hash_Value string").withColumn("Hash_Length", F.length("Hash_Value"))
    tables.write_hashes(df, str(tmp_path / "h"))
    back = spark.read.option("header", True).csv(str(tmp_path / "h"))
    assert back.columns == ["Row_ID", "Hash_Value", "Hash_Length"]
    assert tuple(back.first()) == ("1", "ab", "2")
    a, b = tables.read_pair(spark, {"format": "csv", "path": str(tmp_path / "h"), "options": {"header": True}}, {"format": "csv", "path": str(tmp_path / "h"), "options": {"header": True}})
    assert a.count() == b.count() == 1


def test_findings_are_listed_gravest_first(spark):
    from rowaudit.operators import summary

    df = spark.createDataFrame([("Info", "a"), ("Critical", "b"), ("Warning", "a"), ("Critical", "a")], "severity string, table_name string")
    assert [tuple(r) for r in summary.listing(df).collect()] == [("Critical", "a"), ("Critical", "b"), ("Warning", "a"), ("Info", "a")]


def test_results_are_written_by_schema(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "schema_name string, n int")
    tables.write_results(df, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").glob("schema_name=*")) == ["schema_name=s1", "schema_name=s2"]


def test_equal_numbers_of_all_types_match(spark):
    rows = [(k, x) for k, x in enumerate([0.0, -0.0, 100.0, 0.1, 1.5, 12345678.5, 1e-5, 2.5e-7, 99999999999.25, None])]
    source = spark.createDataFrame(rows, "k long, x double").selectExpr("k", "x", "cast(x as long) as n")
    target = source.selectExpr("k", "cast(x as decimal(30,10)) as x", "cast(n as double) as n")
    assert {r["category"] for r in diff.keyed_diff(source, target, ["k"]).collect()} == {"matching"}


def test_column_diff_of_null_keys_and_absent_columns(spark):
    source = spark.createDataFrame([(None, "a", 1), (1, "b", 2), (2, "c", 3)], "k int, v string, mine int")
    target = spark.createDataFrame([(None, "x", 1.0), (1, "b", 2.0), (2, "y", 3.0)], "k int, V string, theirs double")
    got = sorted(tuple(r) for r in diff.column_diff(source, target, ["k"]).select(F.coalesce("k", F.lit(-1)), "n_differing", "differing", "absent").collect())
    assert got == [(-1, 1, "v", "mine,theirs"), (2, 1, "v", "mine,theirs")]
    assert diff.column_diff(source.limit(0), target, ["k"]).count() == 0


def test_numbers_over_equal_rows(spark):
    df = spark.range(500).selectExpr("id % 2 as x")
    got = numbering.numbered(df, [F.col("x")], partitions=7)
    assert sorted(r["row_id"] for r in got.collect()) == list(range(1, 501))
    assert got.filter("x = 0").agg(F.max("row_id")).first()[0] == 250
