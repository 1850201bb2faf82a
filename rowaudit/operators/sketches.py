"""Column statistics as sketches: of parts, kept, merged, and read without the rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sizes of the sketches of distinct values (2^14 registers, 0.8 % standard error) and of quantiles (about 1.3 % of the rank).
DISTINCT_SIZE, QUANTILE_SIZE = 14, 200
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _as_double(c: Column, kind: T.DataType) -> Column | None:
    """A column's values on a line, times in seconds; None for what has no such order."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, _TIME):
        return F.unix_micros(c.cast("timestamp")) / 1_000_000
    return None


def column_sketches(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row for each column: ``column_name``, ``data_type``, ``n_rows``, ``n_null``, ``distinct`` (a sketch of its values) and ``quantiles`` (of
    numbers and times; null for others and where all values are null).

    All columns in one pass, a row a task: nothing is exploded and no value is shuffled. ``merged`` puts the rows of parts, days or
    files together; ``estimates`` reads them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in (columns or df.columns) if not isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType))]
    none = F.lit(None).cast("binary")
    each = []
    for n in names:
        c = F.col(f"`{n}`")
        line = _as_double(c, kinds[n])
        quantiles = none if line is None else F.when(F.count(c) > 0, F.kll_sketch_agg_double(line, F.lit(QUANTILE_SIZE)))
        each.append(F.struct(F.lit(n).alias("column_name"), F.lit(kinds[n].simpleString()).alias("data_type"), F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_null"), F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(DISTINCT_SIZE)).alias("distinct"), quantiles.alias("quantiles")))
    return df.agg(F.array(*each).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of parts as one, by column (and ``by``)."""
    found = sketches.groupBy(*by, "column_name", "data_type").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_union_agg("distinct", F.lit(False)).alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.count("quantiles").alias("some"))
    return found.withColumn("quantiles", F.when(F.col("some") > 0, F.col("quantiles"))).drop("some")


def estimates(sketches: DataFrame, *, at: tuple[float, ...] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """``n_distinct``, exact or within some percent, and ``values_at``, the values at the shares ``at`` of a column's rows (times in seconds)."""
    values = F.array(*(F.kll_sketch_get_quantile_double("quantiles", F.lit(x)) for x in at))
    return sketches.select(*(c for c in sketches.columns if c not in ("distinct", "quantiles")), F.hll_sketch_estimate("distinct").alias("n_distinct"), F.when(F.col("quantiles").isNotNull(), values).alias("values_at"))


def as_statistics(sketches: DataFrame, schema_name: str, table_name: str, keys: Iterable[str] = ()) -> DataFrame:
    """What ``summary.order_keys_by_stats`` ranks columns by, from sketches: no row of the table is read again."""
    key = F.lower("column_name").isin(*(k.lower() for k in keys)) if list(keys) else F.lit(False)
    return estimates(sketches).select(F.lit(schema_name).alias("schema_name"), F.lit(table_name).alias("table_name"), "column_name", F.upper("data_type").alias("data_type"), key.alias("is_key"), "n_distinct", "n_null")
