"""Roll-ups of findings by table, schema and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _audit_totals() -> list[Column]:
    off = F.col("mismatched") + F.col("missing") + F.col("extra")
    bad = F.col("error").isNotNull()
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return [
        F.count(F.lit(1)).alias("objects"), F.count_if(~bad & (off == 0)).alias("passed"), F.count_if(~bad & (off > 0)).alias("failed"), F.count_if(bad).alias("errors"),
        *(n(c) for c in ("source_rows", "target_rows", "matching", "mismatched", "missing", "extra")),
        F.when(F.sum("source_rows") > 0, F.sum("matching").cast("double") * 100.0 / F.sum("source_rows").cast("double")).otherwise(0.0).alias("match_percent"),
    ]


def executive_summary(per_table: DataFrame) -> DataFrame:
    """One row over all audited tables and views."""
    kinds = [F.count_if(F.col("object_type") == k).alias(c) for k, c in (("Table", "tables"), ("View", "views"))]
    return per_table.agg(*kinds, *_audit_totals())


def schema_rollup(per_table: DataFrame) -> DataFrame:
    """A row for each schema, and one for all (``TOTAL``)."""
    return per_table.rollup("schema_name").agg(*_audit_totals()).withColumn("schema_name", F.coalesce("schema_name", F.lit("TOTAL")))


def top_mismatches(per_table: DataFrame, n: int = 10) -> DataFrame:
    off = F.col("mismatched") + F.col("missing") + F.col("extra")
    return per_table.filter(F.col("error").isNull() & (off > 0)).select("schema_name", "table_name", off.alias("differences")).orderBy(F.desc("differences"), "table_name").limit(n)


def status(issues: DataFrame, *by: str) -> DataFrame:
    """``exit_code`` 2, 1 or 0 and ``status``: whether anything is critical or an error, anything a warning, or nothing."""
    code = F.max(F.when(F.col("severity").isin("Critical", "Error"), 2).when(F.col("severity") == "Warning", 1).otherwise(0)).alias("exit_code")
    return issues.groupBy(*by).agg(code).withColumn("status", F.when(F.col("exit_code") == 2, "FAILED").when(F.col("exit_code") == 1, "WARNING").otherwise("PASSED"))


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name``, ``n_distinct``, ``n_null``: columns become rows, so one shuffle serves all of them, folded first."""
    names = columns or [n for n, k in df.dtypes if not k.startswith(("binary", "array", "map", "struct"))][:10]
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value")) for n in names))).alias("x")).select("x.*")
    values = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("column_name").agg(F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))


def first_names(df: DataFrame, by: list[str], name: str, n: int) -> DataFrame:
    """The first ``n`` names of each group, and how many more there are."""
    first = df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(name))).filter(F.col("rank") <= n)
    # Sizes come from counts that each task folds first: a count over the window would keep Spark from cutting ranks before the shuffle.
    sizes = df.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return first.join(sizes, same).drop(*(f"_{c}" for c in by))


def issue_counts(issues: DataFrame, by: str, severities: tuple[str, ...] = ("Critical", "Error", "Warning", "Info")) -> DataFrame:
    """Issues by type and severity, a column for each severity."""
    return issues.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in severities))


def order_keys(catalog: DataFrame, cap: int = 6) -> DataFrame:
    """The columns to order a table by, at most ``cap``, from a catalog with ``is_key``: all that can be, if they are few enough; else key columns, then numbers and times, then the rest, each by name."""
    from .fingerprint import is_lob, is_numeric_or_time, is_orderable

    kind, name = F.col("data_type"), F.col("column_name")
    able = catalog.filter(is_orderable(kind) & ~is_lob(name, kind))
    table = W.partitionBy("schema_name", "table_name")
    rank = F.when(F.count(F.lit(1)).over(table) <= cap, 0).when(F.col("is_key"), 0).when(is_numeric_or_time(kind), 1).otherwise(2)
    placed = able.withColumn("_rank", rank).withColumn("place", F.row_number().over(table.orderBy("_rank", F.lower(name))))
    return placed.filter(F.col("place") <= cap).select("schema_name", "table_name", "column_name", "place")


def order_keys_by_stats(stats: DataFrame, target: int = 6) -> DataFrame:
    """The same by statistics (``n_distinct``, ``n_null``): first numbers and times, at most half (three at least), times and keys and many values first; then the others by many values and few nulls."""
    from .fingerprint import is_lob, is_numeric_or_time, is_orderable

    kind, name = F.col("data_type"), F.col("column_name")
    able = stats.filter(is_orderable(kind) & ~is_lob(name, kind)).withColumns({"_number": is_numeric_or_time(kind), "_time": F.upper(kind).contains("TIMESTAMP") | (F.upper(kind) == "DATE")})
    table = W.partitionBy("schema_name", "table_name")
    first = F.row_number().over(W.partitionBy("schema_name", "table_name", "_number").orderBy(F.desc("_time"), F.desc("is_key"), F.desc("n_distinct"), F.lower(name)))
    ranked = able.withColumn("_first", F.when(F.col("_number"), first)).withColumn("_later", ~F.coalesce(F.col("_first") <= max(target // 2, 3), F.lit(False)))
    placed = ranked.withColumn("place", F.row_number().over(table.orderBy("_later", F.when(~F.col("_later"), F.col("_first")), F.desc("n_distinct"), "n_null", F.lower(name))))
    return placed.filter(F.col("place") <= target).select("schema_name", "table_name", "column_name", "place")


def listing(issues: DataFrame, severities: tuple[str, ...] = ("Critical", "Error", "Warning", "Info")) -> DataFrame:
    """Findings in reading order: the gravest first, then by table and column."""
    rank = F.array_position(F.array(*map(F.lit, severities)), F.col("severity"))
    return issues.orderBy(rank, *(c for c in ("schema_name", "table_name", "column_name") if c in issues.columns))
