"""What audits of many pairs read and hash."""

from __future__ import annotations

import datetime as dt
from itertools import product

from pyspark.sql import functions as F

from rowaudit.functions.canonical import text_of
from rowaudit.operators import audit


def _totals(spark, pairs):
    return {r["table_name"]: tuple(r)[3:] for r in audit.audit_pairs(spark, pairs).collect()}


def test_what_several_pairs_have_in_common_is_done_once(spark, tmp_path, monkeypatch):
    work = []
    for f in ("_counts", "_tagged"):
        monkeypatch.setattr(audit, f, lambda some, f=f, real=getattr(audit, f), **kw: (work.append((f, len(some))), real(some, **kw))[1])
    for name in "ab":
        spark.range(30).selectExpr("id", f"if(id = 7, '{name}', 'same') as v").write.parquet(str(tmp_path / name))
    a, b = (lambda n=n: spark.read.parquet(str(tmp_path / n)) for n in "ab")
    pairs = [audit.Pair("s", "keys", a, b, ("id",)), audit.Pair("s", "again", a, b, ("ID",)), audit.Pair("s", "rows", a, b), audit.Pair("s", "other", a, b, ("id",), target_keys=("v",)), audit.Pair("s", "turned", b, a, ("id",)), audit.Pair("s", "twice", a, b, ("v",))]
    by_keys, by_rows = ("keys", 30, 30, 29, 1, 0, 0, 0, None), ("rows", 30, 30, 29, 0, 1, 1, 0, None)
    assert _totals(spark, pairs) == {"keys": by_keys, "again": by_keys, "rows": by_rows, "other": by_rows, "turned": by_keys, "twice": (*by_rows[:7], 1, None)}
    assert work == [("_counts", 2), ("_tagged", 2), ("_tagged", 4)]  # two tables; two pairs of tables by keys, one of them by another key too, and one by rows


def test_one_table_that_fails_is_the_error_of_all_its_pairs(spark, tmp_path, monkeypatch):
    work, real = [], audit._counts
    monkeypatch.setattr(audit, "_counts", lambda some: (work.append(len(some)), real(some))[1])
    s = spark.range(20).selectExpr("id as k")
    s.limit(1).selectExpr("'no Parquet'").write.text(str(tmp_path / "broken"))
    broken = lambda: spark.read.schema(s.schema).parquet(str(tmp_path / "broken"))
    got = _totals(spark, [audit.Pair("s", "left", broken, lambda: s, ("k",)), audit.Pair("s", "fine", lambda: s, lambda: s, ("k",)), audit.Pair("s", "right", lambda: s, broken)])
    assert got["left"][-1] and got["left"][-1] == got["right"][-1]
    assert got["fine"] == ("keys", 20, 20, 20, 0, 0, 0, 0, None)
    assert work == [2, 1, 1]


def test_values_of_one_type_are_hashed_without_their_text(spark):
    a = spark.sql("select 1 as k, cast(2 as decimal(18,2)) as d, timestamp_ntz '2024-01-01 10:00:00' as t, 1.5d as x")
    plan = audit._tagged([audit._opened(0, audit.Pair("s", "t", lambda: a, lambda: a.withColumn("k", F.col("k").cast("long")), ("k",)))]).select("k1", "h1")._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan and "date_format" not in plan and "concat" not in plan


def test_hashes_are_equal_just_where_texts_are(spark):
    day, clock = dt.date(2024, 3, 5), dt.datetime(2024, 3, 5, 0, 0)
    columns = {
        "int": [0, 1, -1, None], "bigint": [0, 1, 2**40, None], "decimal(9,2)": ["0", "1", "1.50", None], "decimal(20,2)": ["1.5", "1", "12345678901234.25", None], "decimal(9,3)": ["1.500", "1", None],
        "double": [0.0, -0.0, float("nan"), 1.5, float("inf"), None], "float": [0.0, -0.0, float("nan"), 1.5, None], "boolean": [True, False, None], "date": [day, None], "timestamp": [clock, dt.datetime(2024, 3, 5, 0, 0, 1), None],
        "timestamp_ntz": [clock, None], "string": ["NULL", "x", "x  ", "", "0A1B2C3D-9", "0a1b2c3d-9", None], "binary": [b"", b"x", None],
    }
    frames = {k: spark.createDataFrame([(str(i), v) for i, v in enumerate(x)], f"i string, v {'string' if k.startswith('decimal') else k}").selectExpr("i", f"cast(v as {k}) as v") for k, x in columns.items()}
    alike = [("int", "bigint"), ("decimal(9,2)", "decimal(20,2)"), ("decimal(9,2)", "decimal(9,3)"), ("date", "timestamp"), ("date", "timestamp_ntz"), ("timestamp", "timestamp_ntz"), ("int", "decimal(9,2)"), *((k, k) for k in columns)]
    for one, other in alike:
        a, b = frames[one], frames[other]
        s, t = (df.select("i", text_of("v", df.schema["v"].dataType).alias("text")).collect() for df in (a, b))
        want = {(x["i"], y["i"]) for x, y in product(s, t) if x["text"] == y["text"]}
        left, right = ([(r["k1"], r["k2"]) for r in audit._tagged([audit._Open(0, x.select("v"), y.select("v"), (), True)]).collect()] for x, y in ((a, b), (b, a)))
        assert {(str(i), str(j)) for (i, x), (j, y) in product(enumerate(left), enumerate(right)) if x == y} == want, (one, other)


def test_nulls_do_not_slide_into_the_next_column(spark):
    a = spark.createDataFrame([(1, None, 5), (2, 5, None)], "k int, a int, b int")
    b = spark.createDataFrame([(1, 5, None), (2, 5, None)], "k int, a int, b int")
    assert _totals(spark, [audit.Pair("s", "t", lambda: a, lambda: b, ("k",)), audit.Pair("s", "r", lambda: a, lambda: b)]) == {"t": ("keys", 2, 2, 1, 1, 0, 0, 0, None), "r": ("rows", 2, 2, 1, 0, 1, 1, 0, None)}
