"""Why columns differ: what would turn the source's value into the target's, folded to causes by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import comparable, text_of
from .diff import keyed_diff

#: A shift of whole quarter hours up to this many minutes is one of zones; a factor of a power of ten up to this exponent one of units.
ZONES, UNITS = 14 * 60, 6
_TEXT, _TIME = (T.StringType, T.CharType, T.VarcharType), (T.TimestampType, T.TimestampNTZType)


def _of_text(a: Column, b: Column) -> list[tuple[Column, str, Column]]:
    none = F.lit("")
    a, b = F.rtrim(a), F.rtrim(b)  # as canonical texts have it
    misread = F.decode(F.encode(a, "UTF-8"), "ISO-8859-1")
    lost = F.regexp_replace(a, r"[^\x00-\x7F]", "?")
    return [
        (F.lower(a) == F.lower(b), "case", none), (F.trim(a) == F.trim(b), "padding", none), ((misread == b) & (a != b), "encoding", F.lit("UTF-8 read as ISO-8859-1")), ((lost == b) & (a != b), "encoding", F.lit("replaced by ?")),
        ((F.length(b) > 0) & (F.length(b) < F.length(a)) & a.startswith(b), "truncated", F.length(b).cast("string")), (F.length(b) == 0, "emptied", none),
    ]


def _of_number(a: Column, b: Column) -> list[tuple[Column, str, Column]]:
    out = []
    for k in range(7):
        out.append((F.round(a, k) == b, "rounded", F.lit(str(k))))
        out.append((((F.floor(F.abs(a) * 10**k) / 10**k) * F.signum(a)).cast("double") == b.cast("double"), "digits cut", F.lit(str(k))))
    for k in range(1, UNITS + 1):
        out += [(a * 10**k == b, "scaled", F.lit(f"times 10^{k}")), (b * 10**k == a, "scaled", F.lit(f"by 10^{k}"))]
    return [((a == -b) & (b != 0), "sign", F.lit("")), *out]


def _of_time(a: Column, b: Column) -> list[tuple[Column, str, Column]]:
    minutes = F.round((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 60_000_000, 6)
    return [
        (F.date_trunc("day", a) == b, "time lost", F.lit("")), (F.date_trunc("second", a) == b, "fraction lost", F.lit("")), ((F.abs(minutes) <= ZONES) & (minutes % 15 == 0), "shifted", F.concat(minutes.cast("long").cast("string"), F.lit(" minutes")))
    ]


def column_causes(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """For each column that differs in rows of one key: ``column_name``, ``cause``, ``detail``, and ``n`` rows.

    Causes, the first that holds: ``nulled``, ``filled``, ``case``, ``padding``, ``encoding``, ``truncated``, ``emptied``; ``sign``, ``rounded`` or
    ``digits cut`` (detail: digits kept), ``scaled``; ``time lost``, ``fraction lost``, ``shifted`` (minutes); ``swapped`` (the other column);
    else ``unexplained``. Whether values differ is told by their canonical texts; what turns one into the other, by the values
    as the source's type has them.

    Only rows that differ are fetched, and a row for each column and cause leaves a task. Columns of one side only are not
    looked at; keys should be unique, nulls pair. Equal or empty tables give no rows."""
    source, target = comparable(source, target)
    kinds = [{f.name.lower(): f for f in df.schema.fields} for df in (source, target)]
    of_key = {k.lower() for k in keys}
    names = sorted(c for c in kinds[0] if c in kinds[1] and c not in of_key)
    if not names:
        return source.sparkSession.createDataFrame([], "column_name string, cause string, detail string, n long")
    both_have = [[*keys, *(own[c].name for c in names)] for own in kinds]
    thin = [df.select(*(F.col(f"`{c}`") for c in cols)) for df, cols in zip((source, target), both_have, strict=True)]
    bad = keyed_diff(*thin, keys).filter("category = 'mismatched'")
    bad = bad.select(*(F.col(f"`{k}`").alias(f"bad{i}") for i, k in enumerate(bad.columns[: len(keys)])))
    same = lambda p, q: [F.col(f"{p}{i}").eqNullSafe(F.col(f"{q}{i}")) for i in range(len(keys))]

    def side(df: DataFrame, own: dict, p: str) -> DataFrame:
        values = df.select(*(F.col(f"`{k}`").alias(f"{p}{i}") for i, k in enumerate(keys)), *(F.col(f"`{own[c].name}`").alias(f"{p}v{i}") for i, c in enumerate(names)), F.array(*(text_of(own[c].name, own[c].dataType) for c in names)).alias(f"{p}t"))
        return values.join(bad, same(p, "bad"), "left_semi")

    rows = side(thin[0], kinds[0], "a").join(side(thin[1], kinds[1], "b"), same("a", "b"))
    found = []
    for i, c in enumerate(names):
        a, b, kind = F.col(f"av{i}"), F.col(f"bv{i}"), kinds[0][c].dataType
        at, bt = F.col("at")[i], F.col("bt")[i]
        tests = [(b.isNull() & a.isNotNull(), "nulled", F.lit("")), (a.isNull() & b.isNotNull(), "filled", F.lit(""))]
        if isinstance(kind, _TEXT):
            tests += _of_text(a, b.cast("string"))
        elif isinstance(kind, T.NumericType) and isinstance(kinds[1][c].dataType, T.NumericType):
            tests += _of_number(a, b)
        elif isinstance(kind, _TIME) and isinstance(kinds[1][c].dataType, (*_TIME, T.DateType)):
            tests += _of_time(a, b.cast(kind))
        place = F.array_position("at", bt)
        other = F.element_at(F.array(*(F.lit(kinds[0][n].name) for n in names)), F.when(place > 0, place).otherwise(1).cast("int"))
        tests.append(((place > 0) & (place != i + 1) & (F.element_at("bt", F.when(place > 0, place).otherwise(1).cast("int")) == at), "swapped", other))
        cause = F.when(at == bt, F.lit(None))
        for holds, name, detail in tests:
            cause = cause.when(holds, F.struct(F.lit(kinds[0][c].name).alias("column_name"), F.lit(name).alias("cause"), detail.alias("detail")))
        found.append(cause.otherwise(F.struct(F.lit(kinds[0][c].name).alias("column_name"), F.lit("unexplained").alias("cause"), F.lit("").alias("detail"))))
    told = rows.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return told.groupBy("x.column_name", "x.cause", "x.detail").agg(F.count(F.lit(1)).alias("n"))
