"""Every registered query of the audit jobs against its SQL, and the entry points."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rowaudit import jobs
from rowaudit.functions import canonical
from rowaudit.jobs import count_audit
from rowaudit.operators import counts, filters, summary

from .compare import duck, rows


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_query_matches_its_sql(spark, sf, name):
    got = jobs.QUERIES[name](spark, sf).toPandas()
    if name not in jobs.ORACLE_SQL:
        assert len(got)
        return
    want = duck(sf).sql(jobs.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_source_key_is_looked_up(spark, sf):
    got = jobs.QUERIES["keys_exist_all"](spark, sf).toPandas()
    source, target = (set(map(tuple, jobs.registry.fixture(spark, sf, f"lineitem_{x}", {}).select("l_orderkey", "l_linenumber").toPandas().to_numpy().tolist())) for x in ("src", "tgt"))
    assert {k for k, _ in source if k % 7}
    assert sorted(map(tuple, got[["l_orderkey", "l_linenumber"]].to_numpy().tolist())) == sorted(source & target)


def _to_utc(local: dt.datetime) -> dt.datetime:
    there = local.replace(tzinfo=ZoneInfo("America/New_York"), fold=1)  # shown twice: standard time
    plain = there.astimezone(dt.UTC)
    skipped = plain.astimezone(there.tzinfo).replace(tzinfo=None) != local
    return local if skipped else plain.replace(tzinfo=None)


def test_all_orders_become_utc(spark, sf):
    got = {r["o_orderkey"]: (r["local_time"], r["utc_time"]) for r in jobs.QUERIES["tz_to_utc"](spark, sf).collect()}
    orders = jobs.registry.fixture(spark, sf, "orders_src", {}).selectExpr("o_orderkey", "cast(o_orderdate as timestamp_ntz) + interval 12 hours as t").collect()
    assert got == {r["o_orderkey"]: (r["t"], _to_utc(r["t"])) for r in orders}
    assert {r["t"].month for r in orders} == set(range(1, 13))


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "Asia/Kolkata"])
def test_every_quarter_hour_around_the_changeovers(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _changeovers(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def _changeovers(spark):
    days = [dt.datetime(y, m, d) for y in (1995, 2001, 2006, 2007, 2024) for m, r in ((3, range(7, 16)), (4, range(1, 9)), (10, range(24, 32)), (11, range(1, 9))) for d in r]
    times = [d + dt.timedelta(minutes=15 * k) for d in days for k in range(96)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select("t", canonical.local_to_utc(F.col("t")).alias("u"))
    assert [(r["t"], r["u"]) for r in df.collect() if r["u"] != _to_utc(r["t"])] == []


def test_first_names_are_cut_before_the_shuffle(spark):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, null, id % 3) as side", "lpad(id, 5, '0') as name")
    got = summary.first_names(df, ["side"], "name", 10)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == ["side", "name", "rank", "more"]
    want = {(s, f"{3 * k + (s or 0):05d}", k + 1, (657 if s is None or s == 1 else 656)) for s in (None, 1, 2) for k in range(10)}
    assert {tuple(r) for r in got.collect()} == want


def test_mapping_texts_are_bounded(spark, monkeypatch):
    whole = filters.parse_mapping
    monkeypatch.setattr(filters, "parse_mapping", lambda c: F.array(F.struct(c.alias("source"), c.alias("target"))))
    tables = spark.range(1000).selectExpr("'S' as schema_name", "concat('T', id) as table_name", "id as t")
    texts = [r["source"] for r in count_audit.parse_mapping(tables).collect()]
    assert len(texts) == 10 and max(len(x.split(",")) for x in texts) == 100
    monkeypatch.setattr(filters, "parse_mapping", whole)
    assert count_audit.parse_mapping(tables).select("source").distinct().count() == 1000


def test_issues_are_listed_gravest_first(spark, sf):
    got = [(("Critical", "Error", "Warning", "Info").index(r["severity"]), r["schema_name"], r["table_name"], r["column_name"]) for r in jobs.QUERIES["issue_listing"](spark, sf).collect()]
    assert got == sorted(got) and len({g[0] for g in got}) > 1


def test_derived_names_lose_a_prefix_at_the_start_only(spark):
    made = [("sequence", "SEQ_EMP"), ("sequence", "EMP_ID_SEQ"), ("sequence", "XSEQ_EMP"), ("sequence", "TMP_LOG_SEQ"), ("procedure", "SP_EMP"), ("procedure", "EMP_INSERT"), ("function", "FN_DEPT"), ("procedure", "_GET"), ("trigger", "SEQ_EMP")]
    objects = spark.createDataFrame([("S", *m) for m in made], "schema_name string, kind string, object_name string")
    kept = filters.drop_derived(objects, spark.createDataFrame([("s", "emp")], "schema_name string, table_name string"), ["tmp_"])
    assert {tuple(r)[1:] for r in kept.collect()} == {("sequence", "XSEQ_EMP"), ("function", "FN_DEPT"), ("procedure", "_GET"), ("trigger", "SEQ_EMP")}


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    row = df.first()
    assert row["matching"] + row["mismatched"] + row["missing"] == row["source_rows"]
    assert row["matching"] + row["mismatched"] + row["extra"] == row["target_rows"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_unreadable_tables_count_minus_one(spark):
    tables = {"there": spark.range(7), "gone": lambda: spark.read.parquet("/nowhere/at/all.parquet"), "also there": lambda: spark.range(3)}
    assert {r["table_name"]: r["row_count"] for r in counts.row_counts(tables).collect()} == {"there": 7, "gone": -1, "also there": 3}


def test_entry_leaves_out_only_what_was_taken_out(monkeypatch):
    real = __spark_entry__.importlib.import_module

    def without(name):
        if name.startswith(("rowaudit.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=missing)
        return real(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", without)
    missing = "rowaudit.llm"
    assert set(__spark_entry__.queries()) == set(jobs.QUERIES)
    missing = "numpy"
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
