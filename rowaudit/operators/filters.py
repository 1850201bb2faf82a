"""Which tables, views and other objects take part."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of dropped tables start so; what the names of a table's sequences and procedures start with, or hold besides (fixed values).
DROPPED = "BIN$"
SEQUENCE_PREFIXES, SEQUENCE_PARTS = ("SEQ_",), ("_SEQ", "_ID")
PROCEDURE_PREFIXES = ("PROC_", "SP_", "FN_", "PKG_")
PROCEDURE_PARTS = ("_PROC", "_SP", "_FN", "_PKG", "_INSERT", "_UPDATE", "_DELETE", "_SELECT", "_GET", "_SET")
#: Of these, the ones that go in a third reading of a procedure's name, for tables whose own names hold others (fixed values).
PROCEDURE_FEW = ("_PROC", "_INSERT", "_UPDATE", "_DELETE")


def name_contains(name: Column, schema: Column, patterns: Iterable[str]) -> Column:
    """Whether a short or full name holds one of the patterns, in any case."""
    full = F.lower(F.concat_ws(".", schema, name))
    return reduce(lambda a, p: a | full.contains(p.lower()), patterns, F.lit(False))


def drop_ignored(objects: DataFrame, ignored: Iterable[tuple[str, str]], *, name: str, kind: Column) -> DataFrame:
    """Without the objects on a list of ``(kind, name)``; a name may carry its schema. The list is configuration, so it is sent to all tasks."""
    rows = [(k.lower(), n.upper()) for k, n in ignored]
    if not rows:
        return objects
    table = F.broadcast(objects.sparkSession.createDataFrame(rows, "_kind string, _name string"))
    on = (F.lower(kind) == F.col("_kind")) & ((F.upper(name) == F.col("_name")) | (F.upper(F.concat_ws(".", "schema_name", name)) == F.col("_name")))
    return objects.join(table, on, "left_anti")


def filter_tables(tables: DataFrame, patterns: Iterable[str] = (), ignored: Iterable[tuple[str, str]] = (), *, name: str = "table_name", kind: str = "table") -> DataFrame:
    """Without dropped tables, names that hold a pattern, and ignored ones."""
    kept = tables.filter(~F.col(name).startswith(DROPPED) & ~name_contains(F.col(name), F.col("schema_name"), patterns))
    return drop_ignored(kept, ignored, name=name, kind=F.lit(kind))


def logical_tables(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """Without tables that are partitions of others."""
    child = partitions.select(F.upper("schema_name").alias("_s"), F.upper("partition_name").alias("_p")).distinct()
    return tables.join(child, (F.upper("schema_name") == F.col("_s")) & (F.upper("table_name") == F.col("_p")), "left_anti")


def drop_derived(objects: DataFrame, excluded: DataFrame, patterns: Iterable[str] = ()) -> DataFrame:
    """Without sequences, procedures and functions named after an excluded table: less one prefix at the start, less all
    suffixes, or less the few commonest ones, the name is an excluded table's or holds one of the ``patterns`` that exclude tables."""

    def stems(name: Column, prefixes: tuple[str, ...], *parts: tuple[str, ...]) -> Column:
        begun = reduce(lambda rest, p: F.when(name.startswith(p), F.substr(name, F.lit(len(p) + 1))).otherwise(rest), reversed(prefixes), name)
        bare = [reduce(lambda n, p: F.replace(n, F.lit(p), F.lit("")), some, name) for some in parts]
        return F.filter(F.array_distinct(F.array(begun, *bare)), lambda n: n != "")

    upper = F.upper("object_name")
    stem = F.when(F.col("kind") == "sequence", stems(upper, SEQUENCE_PREFIXES, SEQUENCE_PARTS)).when(F.col("kind").isin("procedure", "function"), stems(upper, PROCEDURE_PREFIXES, PROCEDURE_PARTS, PROCEDURE_FEW)).otherwise(F.array(F.lit(None).cast("string")))
    held = F.exists(stem, lambda n: name_contains(n, F.col("schema_name"), patterns))
    objects = objects.filter(~F.coalesce(held, F.lit(False)))
    names = excluded.select(F.upper("schema_name").alias("_s"), F.upper("table_name").alias("_t")).distinct()
    made = objects.select("schema_name", "kind", "object_name", F.explode(stem).alias("_stem"))
    gone = made.join(names, (F.upper("schema_name") == F.col("_s")) & (F.col("_stem") == F.col("_t")), "left_semi").select("schema_name", "kind", "object_name").distinct()
    return objects.join(gone, ["schema_name", "kind", "object_name"], "left_anti")


def common_tables(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables of both sides, paired in any case."""
    s = source.select(F.upper("schema_name").alias("schema_key"), F.upper("table_name").alias("table_key"), F.col("table_name").alias("source_table"))
    t = target.select(F.upper("schema_name").alias("schema_key"), F.upper("table_name").alias("table_key"), F.col("table_name").alias("target_table"))
    return s.join(t, ["schema_key", "table_key"])


def all_names(source: DataFrame, target: DataFrame) -> DataFrame:
    each = [df.select(F.upper("schema_name").alias("schema_key"), F.upper("table_name").alias("table_key")) for df in (source, target)]
    return each[0].union(each[1]).distinct()


def parse_mapping(text: Column) -> Column:
    """``A.B=c.d, E.F`` as an array of structs ``(source, target)``: the source in upper, the target in lower case; no target means the source's name."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.upper(F.trim(F.split_part(x, F.lit("="), F.lit(1)))).alias("source"), F.lower(F.trim(F.when(x.contains("="), F.split_part(x, F.lit("="), F.lit(2))).otherwise(x))).alias("target")))
