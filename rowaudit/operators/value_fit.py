"""Do the values fit the types they move to? What the data itself proves or rules out, beside what catalogs let one fear."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import decimal_text, double_text
from .types import ALIASES

#: Ranges of integer types, and significant decimal digits that floats keep (fixed values).
WHOLE = {"smallint": 15, "integer": 31, "bigint": 63}
KEPT = {"real": 6, "double precision": 15}
#: State of a column, and how two states become one.
STATE = {"n_rows": "sum", "n_null": "sum", "whole_digits": "max", "scale": "max", "chars": "max", "bytes": "max", "n_not_ascii": "sum", "n_padded": "sum", "n_with_time": "sum", "fraction_digits": "max"}
FAULTS = ("overflow", "rounded", "truncated", "time_lost", "unparsed")


def _number(c: Column, kind: T.DataType) -> tuple[Column, Column]:
    """How many digits a number has before and behind the point; null for what is no finite number."""
    if isinstance(kind, T.IntegralType):
        return F.when(c == 0, 0).otherwise(F.length(F.abs(c.cast("decimal(38,0)")).cast("string"))), F.when(c.isNotNull(), 0)
    real = isinstance(kind, (T.FloatType, T.DoubleType))
    text = F.replace(double_text(c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c) if real else decimal_text(c, kind.scale), F.lit("-"), F.lit(""))
    small = F.abs(c) < 1e-5  # printed as d.dddE06 once the sign is off
    head, whole = F.substring_index(text, "E", 1), F.substring_index(text, ".", 1)
    behind = lambda x: F.when(x.contains("."), F.length(x) - F.locate(".", x)).otherwise(0)
    scale = F.when(small & text.contains("E"), behind(head) + F.substring_index(text, "E", -1).try_cast("int")).otherwise(behind(text))
    finite = text.rlike("^[0-9]")
    return F.when(finite, F.when(small | (whole == "0"), 0).otherwise(F.length(whole))), F.when(finite, scale)


def _fraction_digits(c: Column) -> Column:
    """Digits behind the second that a time needs."""
    return F.length(F.rtrim(F.date_format(c, "SSSSSS"), F.lit("0")))


def _measures(c: Column, kind: T.DataType) -> dict[str, Column]:
    no = F.lit(None).cast("long")
    out = dict.fromkeys(STATE, no)
    out |= {"n_rows": F.lit(1).cast("long"), "n_null": c.isNull().cast("long")}
    if isinstance(kind, T.NumericType):
        whole, scale = _number(c, kind)
        out |= {"whole_digits": whole.cast("long"), "scale": scale.cast("long")}
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        out |= {"chars": F.length(c).cast("long"), "bytes": F.octet_length(c).cast("long"), "n_not_ascii": (F.length(c) != F.octet_length(c)).cast("long"), "n_padded": (F.rtrim(c) != c).cast("long")}
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out |= {"n_with_time": (F.date_trunc("day", c) != c).cast("long"), "fraction_digits": _fraction_digits(c).cast("long")}
    return out


def profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row for each column with its ``STATE``: rows and nulls, the most digits before and behind the point, the most characters and bytes,
    texts beyond ASCII and with blanks at the end, times that aren't midnight and their digits behind the second.

    All columns in one pass; a task sends one row. States of parts of a table, or of its files of last week, merge (``merged``)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = list(columns or df.columns)
    gather = {"sum": F.sum, "max": F.max}
    aggs = [F.struct(F.lit(n).alias("column_name"), *(gather[STATE[k]](m).cast("long").alias(k) for k, m in _measures(F.col(f"`{n}`"), kinds[n]).items())) for n in names]
    return df.agg(F.array(*aggs).alias("states")).select(F.explode("states").alias("x")).select("x.*")


def merged(profiles: DataFrame, *by: str) -> DataFrame:
    """States of parts as one, by column (and ``by``)."""
    gather = {"sum": F.sum, "max": F.max}
    return profiles.groupBy(*by, "column_name").agg(*(gather[how](k).alias(k) for k, how in STATE.items()))


def _faults(c: Column, kind: T.DataType, target: str, precision: int | None, scale: int | None, length: int | None) -> dict[str, Column]:
    """For each fault, whether a value has it; a fault that the types rule out isn't listed."""
    base = ALIASES.get(target.lower().split("(")[0].strip(), target.lower().split("(")[0].strip())
    if isinstance(kind, T.NumericType):
        whole, digits = _number(c, kind)
        if base in WHOLE:
            limit = F.lit(float(2 ** WHOLE[base])) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(str(2 ** WHOLE[base])).cast("decimal(38,0)")
            return {"overflow": (F.floor(c) >= limit) | (F.floor(c) < -limit) | (whole.isNull() & c.isNotNull()), "rounded": digits > 0}
        if base == "numeric" and precision:
            return {"overflow": whole > precision - (scale or 0), "rounded": digits > (scale or 0)}
        if base in KEPT:
            return {"rounded": whole + digits > KEPT[base]}
        if base.startswith("character") and length:
            return {"truncated": F.length(c.cast("string")) > length}
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if base == "date":
            return {"time_lost": F.date_trunc("day", c) != c}
        if base.startswith("timestamp") and precision is not None:
            return {"rounded": _fraction_digits(c) > precision}
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        if base.startswith("character") and length:
            return {"truncated": F.length(c) > length}
        if base in WHOLE or base in ("numeric", *KEPT):
            return {"unparsed": ~c.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")}
        if base in ("date", "timestamp"):
            return {"unparsed": F.try_to_timestamp(c).isNull() & c.isNotNull()}
    return {}


def value_fit(df: DataFrame, catalog: Iterable[tuple[str, str, int | None, int | None, int | None]]) -> DataFrame:
    """For each column of the target's ``catalog`` ``(name, type, precision, scale, length)`` that ``df`` has, in any case: ``column_name``, ``target_type``,
    ``at_risk`` (its type lets a value not fit), the number of values with each of ``FAULTS``, ``n_unfit``, and ``verdict``.

    A risk is ``proven`` by a value that doesn't fit and ``ruled out`` if all do; without a risk the column is ``safe``. All
    columns in one pass, a row a task. Nulls fit. The catalog's rows are one table's columns. An empty table rules all out."""
    kinds = {f.name.lower(): f for f in df.schema.fields}
    rows = []
    for name, target, precision, scale, length in catalog:
        if name.lower() not in kinds:
            continue
        field = kinds[name.lower()]
        faults = _faults(F.col(f"`{field.name}`"), field.dataType, target, precision, scale, length)
        any_ = reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in faults.values()), F.lit(False))
        declared = f"{target}({','.join(str(x) for x in ((precision, scale) if precision is not None and scale is not None else (precision if precision is not None else length,)))})" if precision is not None or length else target
        rows.append(F.struct(F.lit(field.name).alias("column_name"), F.lit(declared).alias("target_type"), F.lit(bool(faults)).alias("at_risk"), *(F.count_if(faults.get(f, F.lit(False))).alias(f"n_{f}") for f in FAULTS), F.count_if(any_).alias("n_unfit")))
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, target_type string, at_risk boolean, " + ", ".join(f"n_{f} long" for f in FAULTS) + ", n_unfit long, verdict string")
    verdict = F.when(~F.col("at_risk"), "safe").when(F.col("n_unfit") > 0, "proven").otherwise("ruled out")
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("x")).select("x.*").withColumn("verdict", verdict)
