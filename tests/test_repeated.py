"""Hashes kept between audits, and causes of differences."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from rowaudit.operators import causes, diff, fingerprint, kept_hashes


def _read(spark) -> int:
    """Rows that all stages so far have read from files; their bytes aren't counted where Parquet reads ahead in threads of its own."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).inputRecords() for k in range(stages.size()))


def test_a_later_run_reads_new_and_changed_files_only(spark, tmp_path):
    source, state = str(tmp_path / "source"), str(tmp_path / "state")
    part = lambda k: spark.range(k * 5000, (k + 1) * 5000).selectExpr("id", "sha2(cast(id as string), 512) as v").coalesce(1)
    for k in range(8):
        part(k).write.parquet(f"{source}/p{k}")
    whole = lambda: sorted(map(tuple, fingerprint.fingerprint(spark.read.parquet(f"{source}/p*"), ["id"]).collect()))
    run = lambda: kept_hashes.refreshed(spark, source, state, ["id"])

    before = _read(spark)
    first = run()
    of_first = _read(spark) - before
    assert sorted(map(tuple, first.collect())) == whole()

    before = _read(spark)
    again = run()
    assert of_first >= 40_000 and _read(spark) - before < 300
    assert sorted(map(tuple, again.collect())) == whole()

    part(2).withColumn("v", F.lit("changed")).write.mode("overwrite").parquet(f"{source}/p2")
    part(5).limit(0).write.mode("overwrite").parquet(f"{source}/p5")
    part(9).write.parquet(f"{source}/p9")
    before = _read(spark)
    last = run()
    assert 10_000 <= _read(spark) - before < 10_400
    assert sorted(map(tuple, last.collect())) == whole()
    assert sorted(map(tuple, kept_hashes.refreshed(spark, source, str(tmp_path / "other"), ["id"]).collect())) == whole()
    assert {r["category"] for r in diff.paired_hashes(last, fingerprint.fingerprint(spark.read.parquet(f"{source}/p*"), ["id"]), ["id"]).collect()} == {"matching"}


def test_a_run_that_fails_leaves_the_last_one_in_force(spark, tmp_path):
    source, state = str(tmp_path / "source"), str(tmp_path / "state")
    spark.range(10).write.parquet(f"{source}/a")
    assert kept_hashes.refreshed(spark, source, state, ["id"]).count() == 10
    # hashes of a run whose manifest is missing
    stray = spark.read.parquet(f"{state}/hashes").withColumn("_run", F.lit("2-stray"))
    stray.write.mode("append").partitionBy("_run", "_bucket").parquet(f"{state}/hashes")
    assert kept_hashes.refreshed(spark, source, state, ["id"]).count() == 10


def test_causes_of_odd_rows(spark):
    t = dt.datetime(2024, 3, 1, 10, 20, 30)
    s = [(None, "abc", Decimal("1.25"), t, "x"), (1, "Ab ", Decimal("5.00"), t, "x"), (2, None, None, None, "x"), (3, "same", Decimal("0.00"), t, "x"), (4, "gone", Decimal("1.00"), t, "x")]
    u = [(None, "abd", 1.3, t, 5), (1, "aB", 0.05, t + dt.timedelta(hours=-3), 5), (2, "", 0.0, t, 5), (3, "same  ", 0.0, t, 5)]
    source = spark.createDataFrame(s, "bad0 int, v string, x decimal(10,2), t timestamp_ntz, mine string")
    target = spark.createDataFrame(u, "BAD0 int, V string, x double, t timestamp_ntz, theirs int")
    got = sorted(tuple(r) for r in causes.column_causes(source, target, ["bad0"]).collect())
    assert got == [("t", "filled", "", 1), ("t", "shifted", "-180 minutes", 1), ("v", "case", "", 1), ("v", "filled", "", 1), ("v", "unexplained", "", 1), ("x", "filled", "", 1), ("x", "rounded", "1", 1), ("x", "scaled", "by 10^2", 1)]
    assert causes.column_causes(source, source, ["bad0"]).count() == 0
    assert causes.column_causes(source.limit(0), target, ["bad0"]).count() == 0
    assert causes.column_causes(source.select("bad0"), target.select("bad0"), ["bad0"]).count() == 0


def test_keys_named_like_the_numbers_of_keys(spark):
    df = spark.createDataFrame([(1, 2, "a")], "k1 int, k0 int, v string")
    assert [tuple(r)[:3] for r in diff.keyed_diff(df, df, ["k1", "k0"]).collect()] == [(1, 2, "matching")]


def test_sketches_merge_within_their_error(spark):
    from rowaudit.operators import sketches

    df = spark.range(40_000).selectExpr("id as k", "id % 7000 as a", "cast(if(id % 4 = 0, null, id % 11) as string) as v", "cast(null as double) as nothing", "timestamp_seconds(id) as t", "array(id) as many")
    whole = {r["column_name"]: r for r in sketches.estimates(sketches.column_sketches(df)).collect()}
    parts = [sketches.column_sketches(df.filter(f"k between {lo} and {hi}")) for lo, hi in ((0, 9_999), (10_000, 39_999), (50_000, 60_000))]
    both = {r["column_name"]: r for r in sketches.estimates(sketches.merged(parts[0].union(parts[1]).union(parts[2]))).collect()}
    for got in (whole, both):
        assert set(got) == {"k", "a", "v", "nothing", "t"}
        assert abs(got["k"]["n_distinct"] - 40_000) < 2000 and abs(got["a"]["n_distinct"] - 7000) < 350
        assert (got["v"]["n_rows"], got["v"]["n_null"], got["v"]["n_distinct"], got["v"]["values_at"]) == (40_000, 10_000, 11, None)
        assert (got["nothing"]["n_null"], got["nothing"]["n_distinct"], got["nothing"]["values_at"]) == (40_000, 0, None)
        assert all(abs(x - share * 40_000) < 2000 for x, share in zip(got["k"]["values_at"], (0.01, 0.25, 0.5, 0.75, 0.99), strict=True))
        assert abs(got["t"]["values_at"][2] - 20_000) < 2000
    assert {r["n_rows"] for r in sketches.column_sketches(df.limit(0)).collect()} == {0}
