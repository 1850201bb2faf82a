"""What jobs move and write for each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowaudit.operators import diff, fingerprint, numbering


def _noted(monkeypatch, module, taken):
    whole = module.written
    monkeypatch.setattr(module, "written", lambda df, name, **kw: (taken.append((name, dict(df.dtypes))), whole(df, name, **kw))[1])


def test_a_positional_difference_writes_each_hash_once(spark, monkeypatch):
    taken = []
    _noted(monkeypatch, numbering, taken)
    s = spark.range(50).selectExpr("id % 7 as k", "id as v")
    d = diff.positional_diff(s, s.filter("v <> 30"), ["k"])
    assert taken == [("ranges", {"row_hash": "binary", "place": "bigint"})] * 2
    want = sorted((r.k, r.row_hash) for r in fingerprint.fingerprint(s, ["k"]).collect())
    assert [r.source_hash for r in d.orderBy("row_id").collect()] == [h for _, h in want]


def test_a_retry_that_can_only_end_last_sorts_once(spark, monkeypatch):
    sorts = []
    monkeypatch.setattr(diff, "numbered", lambda df, order, **kw: (sorts.append(len(order)), numbering.numbered(df, order, **kw))[1])
    s = spark.range(60).selectExpr("id % 2 as a", "id % 5 as b", "id as c", "'x' as v")
    t = s.withColumn("v", F.when(F.col("c") == 7, "y").otherwise("x"))
    d, used = diff.diff_with_retry(s, t, ["a"], ["b", "c"], steps=(0, 1, 2))
    assert (used, sorts) == (2, [4, 4])
    assert {r[0]: r[1] for r in d.groupBy("category").count().collect()} == {"matching": 59, "mismatched": 1}
    same, used = diff.diff_with_retry(s, s.orderBy("c"), ["a"], ["b", "c"], steps=(0, 1, 2))
    assert used == 0
    assert same.filter("category <> 'matching'").isEmpty()
    fewer, used = diff.diff_with_retry(s, t.filter("c <> 9"), ["a"], ["b", "c"], steps=(0, 1, 2))
    assert used == 0
    assert fewer.count() == 60


def test_numbered_rows_carry_no_column_twice(spark, sf, monkeypatch):
    from rowaudit import jobs

    taken = []
    _noted(monkeypatch, numbering, taken)
    jobs.QUERIES["canonical_row_number"](spark, sf)
    assert taken == [("ranges", {"l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "row_hash": "binary", "place": "bigint"})]


def test_a_text_is_parsed_by_the_format_of_its_outline_only(spark, monkeypatch):
    from rowaudit.functions import canonical

    fits = {"05-MAR-2024 01.05.09.000 PM": "d-MMM-yyyy h.mm.ss.SSS a", "2024-03-05 13:05:09.000000": "yyyy-MM-dd HH:mm:ss.SSSSSS", "2024-03-05": "yyyy-MM-dd", "not a time": None, "5-MAR-24 1.05.09 am": "d-MMM-yy h.mm.ss a"}
    monkeypatch.setattr(canonical.F, "try_to_timestamp", lambda text, form: F.lit("2024-03-05 00:00:00").cast("timestamp") + F.when(F.col("form").eqNullSafe(form), F.expr("interval 0 hours")).otherwise(F.raise_error(F.lit("tried in vain")).cast("interval day to second")))
    df = spark.createDataFrame(list(fits.items()), "x string, form string")
    got = {r["x"]: r["at"] for r in df.select("x", canonical.parse_timestamp(F.col("x")).alias("at")).collect()}
    assert {x for x, at in got.items() if at is None} == {"not a time"}


def test_sets_that_repeat_often_are_never_counted_whole(spark, monkeypatch):
    from rowaudit.operators import key_search

    whole = []
    real = key_search.F.pmod
    array = key_search.F.array
    monkeypatch.setattr(key_search.F, "array", lambda *sets: (whole.append(len(sets)), array(*sets))[1])
    monkeypatch.setattr(key_search.F, "pmod", lambda *a: (whole.append("slice"), real(*a))[1])
    df = spark.range(20000).selectExpr("id as k", "cast(id * 0.97 as int) as near", "id % 2 as two")
    assert {r["columns"] for r in key_search.minimal_keys(df).collect()} == {"k", "near,two"}
    assert whole == [2, "slice", 1, 1, "slice", 1]


def test_rows_move_only_of_pairs_that_can_be_read(spark, monkeypatch, tmp_path):
    from rowaudit.operators import audit

    moved, real = [], audit._compared
    monkeypatch.setattr(audit, "_compared", lambda some: (moved.append([(p.number, p.equal) for p in some]), real(some))[1])
    s = spark.range(40).selectExpr("id as k", "id % 3 as v")
    s.limit(1).selectExpr("'no Parquet'").write.text(str(tmp_path / "broken"))
    broken = lambda: spark.read.schema(s.schema).parquet(str(tmp_path / "broken"))
    pairs = [audit.Pair("s", "same", lambda: s, lambda: s, ("k",)), audit.Pair("s", "broken", lambda: s, broken, ("k",)), audit.Pair("s", "off", lambda: s, lambda: s.filter("k <> 4"), ("k",)), audit.Pair("s", "twice", lambda: s.union(s), lambda: s.union(s), ("k",))]
    got = {r["table_name"]: (r["compared_by"], *tuple(r)[4:11]) for r in audit.audit_pairs(spark, pairs).collect()}
    assert moved == [[(0, True), (2, False), (3, True)], []] or moved == [[(0, True), (2, False), (3, True)]]
    assert got == {"same": ("keys", 40, 40, 40, 0, 0, 0, 0), "broken": (None, 0, 0, 0, 0, 0, 0, 0), "off": ("keys", 40, 39, 39, 0, 1, 0, 0), "twice": ("rows", 80, 80, 80, 0, 0, 0, 40)}


def test_passes_that_leave_most_rows_tied_are_left_out(spark, monkeypatch):
    from rowaudit.operators import refining

    sizes, whole = [], refining.ordered
    monkeypatch.setattr(refining, "ordered", lambda df, *rest: (sizes.append((df.count(), dict(df.dtypes)["row_hash"])), whole(df, *rest))[1])
    s = spark.range(60).selectExpr("id % 2 as a", "id % 5 as b", "id as c", "'x' as v")
    t = s.withColumn("v", F.when(F.col("c") == 7, "y").otherwise("x"))
    got, used = refining.diff_refined(s, t, ["a"], ["b", "c"], steps=(0, 1, 2))
    assert (used, sizes) == (2, [(60, "binary")] * 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, diff.diff_with_retry(s, t, ["a"], ["b", "c"], steps=(0, 1, 2))[0].collect()))
