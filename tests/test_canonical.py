"""Canonical text: edge values."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.functions import canonical
from rowaudit.operators import fingerprint, objects


def _texts(spark, values, kind, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))
    return [r[0] for r in df.orderBy("i").select(canonical.text_of("v", kind, **options)).collect()]


def test_row_text_drops_the_separator_behind_leading_empty_values(spark):
    df = spark.createDataFrame([("", "x", "y"), ("x", "", "y"), ("", "|a", "b"), (None, "x", "y"), ("NULL", "x", "y"), ("a|b", "c", "d"), ("a", "b|c", "d")], "a string, b string, c string")
    assert [r[0] for r in df.select(canonical.row_text(df)).collect()] == ["x|y", "x||y", "|a|b", "NULL|x|y", "NULL|x|y", "a|b|c|d", "a|b|c|d"]
    assert len({r[0] for r in df.select(canonical.row_text(df, safe=True)).collect()}) == 6


def test_text_is_trimmed_at_the_right_of_all_white_space(spark):
    assert _texts(spark, ["a \t", "a  ", " a", "", None], T.StringType()) == ["a", "a", " a", "", "NULL"]
    assert _texts(spark, ["", " ", "a "], T.StringType(), empty_as_null=True) == ["NULL", "NULL", "a"]


def test_guid_like_text(spark):
    values = ["ABCDEF01-2345-6789-ABCD-EF0123456789", "A" * 32, "A" * 31, "ABCDEF-1", "ABC-", "ABCDEF01-2345 "]
    assert _texts(spark, values, T.StringType()) == [values[0].lower(), "a" * 32, "A" * 31, "abcdef-1", "ABC-", "ABCDEF01-2345"]


def test_decimals(spark):
    values = [Decimal(x) for x in ("0", "0.1", "1.5", "10", "-2.50", "0.00001", "0.000001", "0.00000123", "12345678901234567890")]
    assert _texts(spark, values, T.DecimalType(38, 10)) == ["0", "0.1", "1.5", "10", "-2.5", "0.00001", "1E-06", "1.23E-06", "12345678901234567890"]


def test_floats_with_17_digits(spark):
    assert _texts(spark, [0.1, 1e16, 1e17, 1e300, -0.5, float("nan"), float("inf")], T.DoubleType(), parity=True) == ["0.10000000000000001", "10000000000000000", "1E+17", "1.0000000000000001E+300", "-0.5", "NaN", "Infinity"]


def test_times_and_other_types(spark):
    t = dt.datetime(2024, 3, 5, 1, 2, 3, 45)
    assert _texts(spark, [t, None], T.TimestampNTZType()) == ["2024-03-05 01:02:03.000045", "NULL"]
    assert _texts(spark, [True, False], T.BooleanType()) == ["true", "false"]
    assert _texts(spark, [bytearray(b"\x01\xff")], T.BinaryType()) == ["01ff"]
    assert _texts(spark, [bytearray(b"\x01")], T.BinaryType(), skip_binary=True) == ["BLOB_SKIPPED"]
    spans = [dt.timedelta(hours=1, minutes=2, seconds=3), dt.timedelta(days=2), -dt.timedelta(days=1, seconds=1), dt.timedelta(microseconds=5)]
    assert _texts(spark, spans, T.DayTimeIntervalType()) == ["01:02:03", "2.00:00:00", "-1.00:00:01", "00:00:00.0000050"]


def test_xml(spark):
    values = ["<?xml version='1.0'?><a y='2' x=' 1 '> <c>t </c>\n<b/></a>", "  <a/>", "<a><b></a>", "&lt;a/&gt;", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(canonical.normalise_xml(F.col("v"))).collect()] == ['<a x="1" y="2"><b /><c>t</c></a>', "<a />", "<a><b></a>", None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("5-Mar-24 1.02.03.5 PM", dt.datetime(2024, 3, 5, 13, 2, 3, 500000)), ("05-MAR-2024 12.00.00 am", dt.datetime(2024, 3, 5)), ("2024-03-05 10:11:12.123456", dt.datetime(2024, 3, 5, 10, 11, 12, 123456)),
        ("2024-03-05 10:11", dt.datetime(2024, 3, 5, 10, 11)), ("2024-03-05", dt.datetime(2024, 3, 5)), ("garbage", None), ("", None),
    ],
)
def test_timestamps_from_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(canonical.parse_timestamp(F.col("v"))).first()[0] == want


def test_local_time_to_utc(spark):
    values = [dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 7, 1, 12), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v timestamp_ntz").orderBy("i")
    assert [r[0] for r in df.select(canonical.local_to_utc(F.col("v"))).collect()] == [dt.datetime(2024, 1, 1, 17), dt.datetime(2024, 7, 1, 16), values[2], dt.datetime(2024, 11, 3, 6, 30)]


@pytest.mark.parametrize(("code", "want"), [("r", "RANGE"), ("R", "RANGE"), ("l", "LIST"), ("L", "LIST"), ("h", "HASH"), ("H", "HASH"), ("", "None"), (None, "None"), ("RANGE", "RANGE"), ("range", "RANGE"), ("LIST", "LIST"), ("hash", "HASH")])
def test_partition_strategy(spark, code, want):
    assert spark.createDataFrame([(code,)], "c string").select(objects.strategy(F.col("c"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("RANGE (id)", ["id"]), ("LIST (region, sub_region)", ["region", "sub_region"]), ("HASH (tenant_id)", ["tenant_id"]), ("", []), (None, []), ("RANGE", [])])
def test_partition_keys(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(objects.key_columns(F.col("c"))).first()[0] == want


def test_key_fallback(spark):
    df = spark.createDataFrame([(1, 2, "x")], "order_id int, Line int, note string")
    assert fingerprint.key_columns(df, ["LINE"]) == ["Line"]
    assert fingerprint.key_columns(df) == ["order_id"]
    assert fingerprint.key_columns(df.drop("order_id")) == ["Line", "note"]


def test_lob_limit(spark):
    df = spark.createDataFrame([("abcdef",)], "v string")
    assert fingerprint.lob_prefix(df, ["v"], 3).first()[0] == "abc"
    with pytest.raises(ValueError, match="limit"):
        fingerprint.lob_prefix(df, ["v"], 5000)
