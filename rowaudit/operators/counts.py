"""Row counts of two sides, by table and partition, with graded findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .failures import stacked, together

FAILED = -1
ERRORS = ("Query Error", "Source Query Error", "Target Query Error")


def counted(spark: SparkSession, tables: Iterable[tuple[str, str, DataFrame | Callable[[], DataFrame]]]) -> DataFrame:
    """``schema_name``, ``table_name``, ``row_count`` of many tables ``(schema, table, DataFrame or callback)``; Parquet serves plain
    counts from its footers. A table that can't be opened or read, for whatever reason, counts ``FAILED``: those that open
    are counted in one job, and only if it fails, again by halves (a number for each comes to the driver). No tables give no rows."""
    tables = list(tables)
    opened, numbers = [], {}
    for k, (_, _, table) in enumerate(tables):
        try:
            opened.append((k, table() if callable(table) else table))
        except Exception:  # noqa: BLE001 - callbacks and drivers raise what they like
            numbers[k] = FAILED

    def count(some: list[tuple[int, DataFrame]]) -> dict[int, int]:
        each = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(k).alias("k"), "row_count") for k, df in some]
        return {r["k"]: r["row_count"] for r in stacked(each).collect()}

    found, failed = together(count, opened)
    numbers |= found | {opened[k][0]: FAILED for k in failed}
    return spark.createDataFrame([(s, t, numbers[k]) for k, (s, t, _) in enumerate(tables)], "schema_name string, table_name string, row_count long")


def row_counts(tables: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """``table_name``, ``row_count`` of tables by name; see ``counted``."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return counted(spark, [("", n, t) for n, t in tables.items()]).drop("schema_name")


def partition_counts(df: DataFrame, partition: Column, name: str = "partition_name") -> DataFrame:
    return df.groupBy(partition.alias(name)).agg(F.count(F.lit(1)).alias("row_count"))


def compare_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """One finding for each table of either side, paired by schema and name in any case: type, severity, difference, percent of the source.

    Equal counts are Info; a difference above 10 % is Critical, above 1 % an Error, else a Warning (an empty source counts
    as 100 %). A count of -1 is a failed query. Tables of one side only are Critical if missing, a Warning if extra."""
    side = lambda df, c: df.groupBy(F.upper("schema_name").alias("schema_name"), F.upper("table_name").alias("table_name")).agg(F.first("row_count").alias(c))
    both = side(source, "source_count").join(side(target, "target_count"), ["schema_name", "table_name"], "full_outer")
    s, t = F.col("source_count"), F.col("target_count")
    off = F.abs(t - s)
    kind = (
        F.when(t.isNull(), "Missing Table").when(s.isNull(), "Extra Table").when((s < 0) & (t < 0), ERRORS[0]).when(s < 0, ERRORS[1]).when(t < 0, ERRORS[2]).when(s == t, "Match").otherwise("Row Count Mismatch")
    )
    counted = F.col("issue_type").isin("Match", "Row Count Mismatch")
    percent = F.when(s > 0, off.cast("double") / s * 100).when(off > 0, 100.0).otherwise(0.0)
    out = both.withColumn("issue_type", kind)
    out = out.withColumns({"difference": F.when(counted, off), "percent": F.when(counted, percent)})
    severity = (
        F.when(F.col("issue_type") == "Missing Table", "Critical").when(F.col("issue_type") == "Extra Table", "Warning").when(F.col("issue_type").isin(*ERRORS), "Error").when(F.col("issue_type") == "Match", "Info")
        .when(F.col("percent") > 10, "Critical").when(F.col("percent") > 1, "Error").otherwise("Warning")
    )
    return out.withColumn("severity", severity)


def count_rollup(findings: DataFrame) -> DataFrame:
    """A row for each schema and one for all: tables by finding, rows of both sides, counts by severity, overall status."""
    n = lambda c, name: F.count_if(c).alias(name)
    kind, severity = F.col("issue_type"), F.col("severity")
    rows = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0))
    out = findings.rollup("schema_name").agg(
        F.count(F.lit(1)).alias("tables"), n(kind == "Match", "matching"), n(kind == "Row Count Mismatch", "mismatched"), n(kind == "Missing Table", "missing"), n(kind == "Extra Table", "extra"),
        rows("source_count").alias("source_rows"), rows("target_count").alias("target_rows"), *(n(severity == x, x.lower()) for x in ("Critical", "Error", "Warning")),
    )
    state = F.when(F.col("critical") + F.col("error") > 0, "FAILED").when(F.col("warning") > 0, "WARNING").otherwise("PASSED")
    return out.withColumns({"schema_name": F.coalesce("schema_name", F.lit("TOTAL")), "status": state})


def top_gaps(findings: DataFrame, n: int = 10) -> DataFrame:
    """The greatest differences among errors and critical findings with both counts."""
    both = findings.filter(F.col("severity").isin("Critical", "Error") & F.col("difference").isNotNull())
    return both.select("schema_name", "table_name", "source_count", "target_count", "difference", "percent").orderBy(F.desc("difference"), "schema_name", "table_name").limit(n)
