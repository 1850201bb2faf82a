"""Audits of many pairs, checksum trees, alignment, numbers of all types and free names."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowaudit.functions import canonical
from rowaudit.operators import alignment, audit, checksums, counts, diff, failures, filters, numbering
from rowaudit.sources import tables


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def _fails():
    raise RuntimeError("broken callback")


@pytest.fixture
def sides(spark, tmp_path):
    broken = tmp_path / "broken.parquet"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no Parquet at all")
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (4, "w")], "id long, v string")
    bad = {
        "path": lambda: spark.read.parquet("/nowhere/at/all.parquet"), "file": lambda: spark.read.schema(a.schema).parquet(str(broken)), "callback": _fails,
        "driver": lambda: spark.read.format("jdbc").option("url", "jdbc:nowhere:x").option("dbtable", "t").load(),
    }
    return a, b, bad


def test_each_failure_is_one_row_and_the_rest_is_unharmed(spark, sides):
    a, b, bad = sides
    pairs = [audit.Pair("s", "a.b", lambda: a, lambda: b, ("ID",)), audit.Pair("s", "a.c", lambda: a, lambda: a, ("id",)), audit.Pair("s", "key", lambda: a, lambda: a, ("nowhere",)), audit.Pair("s", "columns", lambda: a, lambda: a.drop("v"), ("id",))]
    pairs += [audit.Pair("s", name, lambda: a, f, ("id",)) for name, f in bad.items()]
    got = {r["table_name"]: r for r in audit.audit_pairs(spark, pairs).collect()}
    whole = lambda n: [got[n][c] for c in ("compared_by", *audit.TOTALS, "duplicate_keys", "error")]
    assert whole("a.b") == ["keys", 3, 3, 1, 1, 1, 1, 0, None]
    assert whole("a.c") == ["keys", 3, 3, 3, 0, 0, 0, 0, None]
    errors = {n: r["error"] for n, r in got.items() if r["error"]}
    assert errors.pop("file")
    assert errors == {"key": "KEY_NOT_FOUND", "columns": "COLUMNS_DIFFER", "path": "PATH_NOT_FOUND", "callback": "RuntimeError", "driver": "SQLException"}
    assert all(whole(n)[1:8] == [0] * 7 for n in (*errors, "file"))
    found, keys = audit.count_drill_down(spark, [*pairs, audit.Pair("s", "a.d", lambda: a, lambda: b.limit(2), ("id",)), audit.Pair("t.u", "d", lambda: a.union(a), lambda: a, ("id",))])
    assert {r["table_name"]: (r["source_count"], r["target_count"]) for r in found.collect()} == {"A.B": (3, 3), "A.C": (3, 3), "KEY": (3, 3), "COLUMNS": (3, 3), "PATH": (3, -1), "FILE": (3, -1), "CALLBACK": (3, -1), "DRIVER": (3, -1), "A.D": (3, 2), "D": (6, 3)}
    assert sorted(tuple(r) for r in keys.collect()) == [("s", "a.d", "missing", "3"), *(("t.u", "d", "duplicate", str(k)) for k in (1, 2, 3))]


def test_no_pairs_and_no_tables(spark):
    assert audit.audit_pairs(spark, []).count() == 0
    assert counts.row_counts({}).count() == 0
    assert [df.count() for df in audit.count_drill_down(spark, [])] == [0, 0]
    assert audit.pair_samples(spark, []).count() == 0


def test_pairs_with_repeated_or_other_keys_are_compared_by_rows(spark):
    a = spark.createDataFrame([(1, "x")] * 5 + [(2, "y"), (None, "n")], "id int, v string")
    b = spark.createDataFrame([(1, "x")] * 3 + [(2, "z"), (None, "n")], "id int, v string")
    pairs = [audit.Pair("s", "twice", lambda: a, lambda: b, ("id",)), audit.Pair("s", "other", lambda: b, lambda: a, ("id",), target_keys=("v", "id")), audit.Pair("s", "empty", lambda: a.limit(0), lambda: b.limit(0), ("id",))]
    got = {r["table_name"]: tuple(r)[3:] for r in audit.audit_pairs(spark, pairs).collect()}
    assert got == {"twice": ("rows", 7, 5, 4, 0, 3, 1, 1, None), "other": ("rows", 5, 7, 4, 0, 1, 3, 0, None), "empty": ("keys", 0, 0, 0, 0, 0, 0, 0, None)}


def test_samples_of_many_pairs(spark, sides):
    a, b, bad = sides
    pairs = [audit.Pair("s", "t", lambda: a, lambda: b, ("id",)), audit.Pair("s", "bad", lambda: a, bad["file"], ("id",)), audit.Pair("s", "rows", lambda: a, lambda: b)]
    assert sorted(tuple(r) for r in audit.pair_samples(spark, pairs).collect()) == [("s", "t", "extra", 1, "4"), ("s", "t", "mismatched", 1, "2"), ("s", "t", "missing", 1, "3")]


def test_healthy_work_is_one_job_and_failures_few():
    jobs = []

    def job(some):
        jobs.append(len(some))
        if any(x % 50 == 7 for x in some):
            raise ValueError
        return {x: x * x for x in some}

    found, failed = failures.together(job, list(range(100)))
    assert failed == {7: "ValueError", 57: "ValueError"} and len(found) == 98 and len(jobs) < 30
    jobs.clear()
    assert failures.together(job, list(range(8, 50)))[1] == {} and len(jobs) == 1


def test_the_number_of_shuffles_does_not_grow_with_the_pairs(spark):
    a = spark.range(50).selectExpr("id", "id % 7 as v")

    def exchanges(n):
        opened = [audit._opened(k, audit.Pair("s", f"t{k}", lambda: a, lambda: a, ("id",))) for k in range(n)]
        plan = audit._tagged(opened).groupBy("pair", "k1", "k2").agg(F.sum("s"), F.bit_xor("h1"))._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange"), plan.count("xxhash64")

    assert exchanges(3) == exchanges(12)


@pytest.mark.parametrize("by", ["hash", "range"])
def test_checksum_tree_equals_the_keyed_difference(spark, by):
    s = spark.range(3000).selectExpr("cast(if(id = 17, null, id) as double) as source_hash", "concat('v', id) as node", "id % 3 as category")
    t = s.filter("node <> 'v40'").withColumn("category", F.when(F.col("node") == "v2999", 9).otherwise(F.col("category"))).union(s.limit(1).selectExpr("5000.5", "'new'", "1"))
    want, got = (sorted((tuple(r) for r in f(s, t, ["source_hash"]).collect()), key=repr) for f in (diff.keyed_diff, lambda *x: checksums.checksum_diff(*x, by=by)))
    assert got == want and Counter(r[1] for r in got) == {"matching": 2998, "missing": 1, "mismatched": 1, "extra": 1}
    assert checksums.checksum_totals(s, t, ["source_hash"], by=by).first() == diff.diff_totals(diff.keyed_diff(s, t, ["source_hash"])).first()
    assert checksums.differing_ranges(s, t, ["source_hash"], by=by).count() == 3
    assert checksums.checksum_diff(s.limit(0), t.limit(0), ["source_hash"], by=by).count() == 0
    assert {r["category"] for r in checksums.checksum_diff(s, t.limit(0), ["source_hash"], by=by).collect()} == {"missing"}


def test_rows_that_swap_or_repeat_are_seen(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "k int, v string")
    swapped = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (3, "c")], "k int, v string")
    fewer = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    one = lambda a, b: {r["category"] for r in checksums.checksum_diff(a, b, ["k"], levels=(1,)).collect()}
    assert one(s, s) == {"matching"}
    assert "mismatched" in one(s, swapped) and "missing" in one(s, fewer)


def test_equal_tables_shuffle_sums_only(spark, tmp_path):
    df = spark.range(200_000).selectExpr("id as k", "sha2(cast(id as string), 256) as v").repartition(4)
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    before = _shuffled(spark)
    assert checksums.checksum_diff(t, t, ["k"]).filter("category = 'matching'").count() == 200_000
    of_tree = _shuffled(spark) - before
    before = _shuffled(spark)
    assert diff.keyed_diff(t, t, ["k"]).filter("category = 'matching'").count() == 200_000
    assert of_tree < 3_000_000 < 10_000_000 < _shuffled(spark) - before


def _longest(values):
    best = []
    for k, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(k) if values[j] < v), default=0))
    return max(best, default=0)


def test_heaviest_chain_against_brute_force():
    r = random.Random(1)
    for _ in range(200):
        v = np.array(r.sample(range(50), r.randint(0, 12)))
        kept = alignment.heaviest_chain(v, np.ones(len(v), int))
        assert (np.diff(v[kept]) > 0).all() and len(kept) == _longest(v.tolist())
    assert alignment.heaviest_chain(np.array([5, 1, 2]), np.array([9, 4, 4])).tolist() == [0]
    assert alignment.heaviest_chain(np.array([5, 1, 2]), np.array([7, 4, 4])).tolist() == [1, 2]


def _aligned(spark, s, t, **options):
    frame = lambda x: spark.createDataFrame([(k, v) for k, v in enumerate(x)], "pos long, v string")
    got = [tuple(r) for r in alignment.aligned_diff(frame(s), frame(t), ["pos"], columns=["v"], **options).collect()]
    assert sorted(a for a, _, _ in got if a is not None) == list(range(1, len(s) + 1))
    assert sorted(b for _, b, _ in got if b is not None) == list(range(1, len(t) + 1))
    for a, b, c in got:
        assert (c in ("matching", "moved")) == (a is not None and b is not None and s[a - 1] == t[b - 1])
        assert (c == "missing") == (b is None) and (c == "extra") == (a is None)
    return got


def test_a_lost_a_new_a_changed_and_a_moved_row(spark):
    s = [f"r{k}" for k in range(40)]
    t = [*s[:5], *s[6:20], "new", s[20], "changed", *s[22:30], *s[31:], s[30]]
    other = {(a, b, c) for a, b, c in _aligned(spark, s, t) if c != "matching"}
    assert other == {(6, None, "missing"), (None, 20, "extra"), (22, 22, "mismatched"), (31, 40, "moved")}


def test_alignment_of_copies_and_of_empty_sides(spark):
    got = Counter(c for _, _, c in _aligned(spark, ["x"] * 30 + ["a", "b"], ["a"] + ["x"] * 28 + ["c"]))
    assert got == {"matching": 28, "moved": 1, "mismatched": 1, "missing": 2} or got == {"matching": 1, "moved": 28, "mismatched": 1, "missing": 2}
    assert _aligned(spark, [], ["a"]) == [(None, 1, "extra")]
    assert _aligned(spark, ["a"], []) == [(1, None, "missing")]
    assert _aligned(spark, [], []) == []


def test_alignment_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 8)
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "STRETCH", 7)
    s = [f"r{k}" for k in range(120)]
    t = [*s[60:70], *s[:30], *s[31:60], *s[70:], "z"]
    got = Counter(c for _, _, c in _aligned(spark, s, t))
    assert got == {"matching": 109, "moved": 10, "missing": 1, "extra": 1}


def test_numbers_match_from_the_smallest_to_the_greatest(spark):
    r = random.Random(7)
    values = [1e19, 1234567890123456.5, 1e23, 8.41e21, 2e-3, 1e-5, 9.5e-6, 1e15, 123456789012345.6, -1e19, -2.5e-7, 0.1, 1e-37]
    values += [round(r.uniform(-1, 1), 12) * 10.0 ** r.randint(-20, 20) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, x double")
    texts = df.select("x", canonical.double_text(F.col("x")).alias("t")).collect()
    assert all(float(t) == x and ("E" not in t or abs(x) < 1e-5) for x, t in texts)
    for kind, low, high in (("decimal(38,0)", 1e15, 1e37), ("decimal(38,18)", 1e-4, 1e18), ("decimal(38,37)", 1e-20, 0.9)):
        some = df.filter(f"abs(x) between {low} and {high}")
        exact = some.selectExpr("k", f"cast(x as {kind}) as x").filter("x is not null")
        again = exact.selectExpr("k", "cast(x as double) as x")
        for a, b in ((exact, again), (again, exact), (exact, exact), (again.withColumn("x", F.col("x")), again)):
            assert {c["category"] for c in diff.keyed_diff(a, b, ["k"]).select("category").collect()} == {"matching"}
    whole = spark.createDataFrame([(1, 1234567890123456768), (2, 2**63 - 1)], "k long, x long")
    assert {c["category"] for c in diff.keyed_diff(whole, whole.withColumn("x", F.col("x").cast("double")), ["k"]).collect()} == {"matching"}


def test_columns_may_be_named_like_helpers(spark):
    s = spark.createDataFrame([(1, 5, "a", "p"), (2, 6, "b", "q")], "row_id int, row_hash int, s0 string, _s string")
    t = spark.createDataFrame([(1, 5, "a", "p"), (2, 6, "b", "x")], "row_id int, row_hash int, s0 string, _s string")
    assert [tuple(r) for r in diff.positional_column_diff(s, t.withColumn("row_id", F.lit(9)), ["row_hash"]).select("row_id", "differing").orderBy("row_id").collect()] == [(1, "row_id"), (2, "_s,row_id")]
    assert Counter(r["category"] for r in diff.keyed_diff(s, t, ["row_hash", "_s"]).collect()) == {"matching": 1, "missing": 1, "extra": 1}
    assert Counter(r["category"] for r in diff.positional_diff(s, t, ["row_hash"]).collect()) == {"matching": 1, "mismatched": 1}
    assert diff.missing_keys(s, t, ["_s"]).columns == ["_s", "key_text"]
    both = diff.keyed_diff(s.withColumnRenamed("s0", "category"), t.withColumnRenamed("s0", "category"), ["category"])
    assert both.columns == ["_category", "category", "source_hash", "target_hash"]
    named = numbering.numbered(s.withColumnRenamed("_s", "place"), [F.col("row_hash")], into="place")
    assert sorted(r["place"] for r in named.collect()) == [1, 2]


def test_a_procedure_of_a_table_whose_name_holds_a_suffix(spark):
    made = [("procedure", "DATA_SET_INSERT"), ("procedure", "DATA_SET"), ("procedure", "MY_GET_PROC"), ("procedure", "OTHER_SET_INSERT")]
    objects = spark.createDataFrame([("S", *m) for m in made], "schema_name string, kind string, object_name string")
    kept = filters.drop_derived(objects, spark.createDataFrame([("s", "data_set"), ("s", "my_get")], "schema_name string, table_name string"))
    assert {r["object_name"] for r in kept.collect()} == {"OTHER_SET_INSERT"}


def test_intermediate_folders_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda _: str(tmp_path))
    s = spark.range(50).selectExpr("id", "id % 3 as v")
    assert diff.positional_diff(s, s, ["v"]).count() == 50
    assert len(list(tmp_path.iterdir())) == 1
    with pytest.raises(Exception, match="nowhere"):
        diff.positional_diff(s, s, ["nowhere"])
    diff.diff_with_retry(s, s.withColumn("v", F.lit(0)), ["v"], ["id"])
    assert len(list(tmp_path.iterdir())) == 2


def test_values_that_do_not_fit_are_counted(spark):
    from rowaudit.operators import value_fit

    df = spark.createDataFrame([(1, 40000, 1.5, "abc  ", "12"), (2, -40000, 1e300, "äöü", "x"), (3, None, float("nan"), None, None), (4, 5, 2.5e-7, "", " -3.5e2 ")], "k long, n int, x double, v string, s string")
    df = df.selectExpr("*", "cast(n * 0.01 as decimal(20,6)) as d", "timestamp_ntz '2024-01-01 00:00:00.25' as t", "cast(9e18 as bigint) as big")
    catalog = [("K", "bigint", None, None, None), ("n", "smallint", None, None, None), ("x", "bigint", None, None, None), ("v", "varchar", None, None, 3), ("s", "integer", None, None, None), ("d", "numeric", 4, 1, None), ("t", "timestamp", 1, None, None), ("big", "int8", None, None, None), ("gone", "text", None, None, None)]
    got = {r["column_name"]: r for r in value_fit.value_fit(df, catalog).collect()}
    faults = lambda c: {f: got[c][f"n_{f}"] for f in value_fit.FAULTS if got[c][f"n_{f}"]}
    assert faults("n") == {"overflow": 2} and faults("v") == {"truncated": 1} and faults("s") == {"unparsed": 1} and faults("t") == {"rounded": 4}
    assert faults("x") == {"overflow": 2, "rounded": 2} and faults("d") == {"rounded": 1} and faults("big") == {}
    assert {c: got[c]["verdict"] for c in ("k", "n", "big")} == {"k": "ruled out", "n": "proven", "big": "ruled out"} and "gone" not in got
    assert value_fit.value_fit(df, []).count() == 0
    assert {r["verdict"] for r in value_fit.value_fit(df.limit(0), catalog).collect()} == {"ruled out"}


def test_profiles_merge(spark):
    from rowaudit.operators import value_fit

    df = spark.createDataFrame([(1, 0.001, "é "), (None, 123.5, ""), (-1234, 2.5e-7, None), (0, float("inf"), "ab")], "n int, x double, v string").repartition(3)
    row = {r["column_name"]: r for r in value_fit.profile(df).collect()}
    assert [row["n"][c] for c in ("n_rows", "n_null", "whole_digits", "scale")] == [4, 1, 4, 0]
    assert [row["x"][c] for c in ("whole_digits", "scale")] == [3, 8]
    assert [row["v"][c] for c in ("n_null", "chars", "bytes", "n_not_ascii", "n_padded")] == [1, 2, 3, 1, 1]
    parts = [value_fit.profile(df.filter(f"n is {x} null")) for x in ("", "not")]
    assert sorted(map(repr, value_fit.merged(parts[0].union(parts[1])).collect())) == sorted(map(repr, value_fit.profile(df).collect()))


def test_minimal_keys_against_all_sets(spark):
    from itertools import combinations

    from rowaudit.operators import key_search

    r = random.Random(5)
    data = [(r.randint(0, 6), r.choice("abcd"), r.randint(0, 9), None if k == 3 else k, k // 2) for k in range(60)]
    df = spark.createDataFrame(data, "a int, b string, c int, d int, e int")
    unique = lambda s: len({tuple(x["abcde".index(c)] for c in s) for x in data}) == len(data) and "d" not in s
    sets = [s for n in (1, 2, 3) for s in combinations("abcde", n) if unique(s)]
    want = {",".join(s) for s in sets if not any(set(t) < set(s) for t in sets)}
    assert want and {x["columns"] for x in key_search.minimal_keys(df).collect()} == want
    assert {x["columns"] for x in key_search.minimal_keys(df.limit(0)).collect()} == set("abcde")
    assert key_search.minimal_keys(df.union(df)).count() == 0
