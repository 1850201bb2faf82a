"""Are tables, keys, indexes and code objects all there? Differences of catalogs, for all schemas in one job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters

#: Names that hold this belong to what a migration adds to tables without a key (fixed value).
ARTIFACT = "rowid"


def _up(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({f"_{c}": F.upper(c) for c in columns})


def _two_sided(source: DataFrame, target: DataFrame, on: list[str], show: list[str], kind: str) -> DataFrame:
    """Rows of either side without a partner, with ``side`` missing or extra, and whether the two sides' counts differ by schema."""
    s, t = _up(source, *on), _up(target, *on)
    keys = [f"_{c}" for c in on]
    missing = s.join(t.select(*keys).distinct(), keys, "left_anti").select(F.lit("missing").alias("side"), *show)
    extra = t.join(s.select(*keys).distinct(), keys, "left_anti").select(F.lit("extra").alias("side"), *show)
    n = s.groupBy("_schema_name").agg(F.count(F.lit(1)).alias("_ns")).join(t.groupBy("_schema_name").agg(F.count(F.lit(1)).alias("_nt")), "_schema_name", "full_outer")
    n = n.select("_schema_name", (F.coalesce("_ns", F.lit(0)) != F.coalesce("_nt", F.lit(0))).alias("counts_differ"))
    both = missing.unionByName(extra).withColumn("_schema_name", F.upper("schema_name"))
    return both.join(n, "_schema_name").drop("_schema_name").withColumn("object_kind", F.lit(kind))


def table_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    return _two_sided(source, target, ["schema_name", "table_name"], ["schema_name", "table_name"], "table")


def column_order_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables whose columns differ in number or order, the target's added key column left out: ``finding`` and, for order, place and both names."""
    from pyspark.sql import Window as W

    def side(df: DataFrame, name: str) -> DataFrame:
        df = _up(df, "schema_name", "table_name", "column_name").filter(F.lower("column_name") != ARTIFACT)
        by = W.partitionBy("_schema_name", "_table_name")
        return df.select("_schema_name", "_table_name", F.row_number().over(by.orderBy("column_id", "_column_name")).alias("place"), F.count(F.lit(1)).over(by).alias(f"{name}_columns"), F.col("_column_name").alias(f"{name}_column"))

    keys = ["_schema_name", "_table_name"]
    both = side(source, "source").join(side(target, "target"), [*keys, "place"])
    numbers = both.filter("source_columns <> target_columns").select(*keys, F.lit("count").alias("finding"), F.lit(None).cast("int").alias("place"), F.col("source_columns").cast("string").alias("source"), F.col("target_columns").cast("string").alias("target")).distinct()
    order = both.filter("source_columns = target_columns and source_column <> target_column").select(*keys, F.lit("order").alias("finding"), "place", F.col("source_column").alias("source"), F.col("target_column").alias("target"))
    return numbers.unionByName(order).withColumnsRenamed({"_schema_name": "schema_name", "_table_name": "table_name"})


def key_lists(columns: DataFrame) -> DataFrame:
    """Each constraint with its columns in order."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "column_name")))
    return columns.groupBy("schema_name", "table_name", "constraint_name", "kind").agg(F.transform(ordered, lambda x: x["column_name"]).alias("columns"))


def logical(objects: DataFrame, partitions: DataFrame) -> DataFrame:
    """Without what belongs to partitions of tables."""
    return filters.logical_tables(objects, partitions)


def pk_diff(source: DataFrame, target: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Primary keys of one side only by table; ``artifact`` marks disabled source keys and added single-column target keys, which are expected."""
    added = key_lists(target_columns.filter("kind = 'P'")).filter((F.size("columns") == 1) & (F.lower(F.col("columns")[0]) == ARTIFACT)).select("schema_name", "constraint_name")
    s, t = source.filter("kind = 'P'"), target.filter("kind = 'P'")
    real = _two_sided(s.filter("is_enabled"), t.join(added, ["schema_name", "constraint_name"], "left_anti"), ["schema_name", "table_name"], ["schema_name", "table_name", "constraint_name"], "primary key").withColumn("artifact", F.lit(None).cast("string"))
    off = s.filter(~F.col("is_enabled")).select(F.lit("missing").alias("side"), "schema_name", "table_name", "constraint_name", F.lit("disabled in source").alias("artifact"))
    new = t.join(added, ["schema_name", "constraint_name"], "left_semi").select(F.lit("extra").alias("side"), "schema_name", "table_name", "constraint_name", F.lit("added key").alias("artifact"))
    return real.unionByName(off.unionByName(new).withColumns({"counts_differ": F.lit(None).cast("boolean"), "object_kind": F.lit("primary key")}))


def drop_excluded_fks(fks: DataFrame, excluded: Iterable[str], ignored: Iterable[str]) -> DataFrame:
    """Without foreign keys from or to an excluded table, or ignored by name; both lists are configuration."""
    tables, names = [x.upper() for x in excluded], [x.upper() for x in ignored]
    return fks.filter(~F.upper("table_name").isin(*tables) & ~F.upper(F.coalesce("ref_table", F.lit(""))).isin(*tables) & ~F.upper("constraint_name").isin(*names))


def fk_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Foreign keys of one side only, by table and referenced table; disabled source keys are set apart."""
    s, t = source.filter("kind = 'F'"), target.filter("kind = 'F'")
    show = ["schema_name", "table_name", "constraint_name", "ref_table"]
    real = _two_sided(s.filter("is_enabled"), t, ["schema_name", "table_name", "ref_table"], show, "foreign key").withColumn("artifact", F.lit(None).cast("string"))
    off = s.filter(~F.col("is_enabled")).select(F.lit("missing").alias("side"), *show, F.lit(None).cast("boolean").alias("counts_differ"), F.lit("foreign key").alias("object_kind"), F.lit("disabled in source").alias("artifact"))
    return real.unionByName(off)


def fk_rule_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Enabled source foreign keys whose first partner by table pair has another ON DELETE rule."""
    on = ["schema_name", "table_name", "ref_table"]
    first = _up(target.filter("kind = 'F'"), *on).groupBy(*(f"_{c}" for c in on)).agg(F.min_by("on_delete", "constraint_name").alias("target_rule"))
    both = _up(source.filter("kind = 'F' and is_enabled"), *on).join(first, [f"_{c}" for c in on])
    return both.filter(~F.col("on_delete").eqNullSafe(F.col("target_rule"))).select("schema_name", "table_name", "ref_table", F.col("on_delete").alias("source_rule"), "target_rule")


def constraint_counts(source: DataFrame, target: DataFrame, kind: str) -> DataFrame:
    """Constraints of a kind by schema on both sides. Generated source names and NOT NULL conditions don't count as checks."""

    def side(df: DataFrame, name: str, generated: bool) -> DataFrame:
        df = df.filter(F.col("kind") == kind)
        if kind == "C":
            df = df.filter(~F.upper(F.coalesce("condition", F.lit(""))).contains("IS NOT NULL"))
            df = df.filter(~F.col("constraint_name").startswith("SYS_")) if generated else df
        return df.groupBy(F.upper("schema_name").alias("schema_name")).agg(F.count(F.lit(1)).alias(name))

    both = side(source, "source_count", True).join(side(target, "target_count", False), "schema_name", "full_outer")
    n = both.select("schema_name", F.coalesce("source_count", F.lit(0)).alias("source_count"), F.coalesce("target_count", F.lit(0)).alias("target_count"))
    return n.withColumn("is_issue", (F.col("source_count") != F.col("target_count")) & F.lit(kind == "U"))


def secondary_indexes(indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Without indexes that back primary keys or unique constraints."""
    backing = constraints.filter("kind in ('P', 'U')").select("schema_name", F.col("constraint_name").alias("index_name"))
    return indexes.join(backing, ["schema_name", "index_name"], "left_anti")


def index_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Indexes of one side only by table and name; those of added key columns are marked."""
    d = _two_sided(source, target, ["schema_name", "table_name", "index_name"], ["schema_name", "table_name", "index_name"], "index")
    return d.withColumn("artifact", F.when((F.col("side") == "extra") & F.lower("index_name").contains(ARTIFACT), "added key"))


def fk_supporting(indexes: DataFrame, fk_columns: DataFrame) -> DataFrame:
    """Indexes that serve a foreign key: of the same columns, or named so."""
    fks = key_lists(fk_columns.filter("kind = 'F'")).select("schema_name", "table_name", F.upper("constraint_name").alias("fk_name"), F.upper(F.array_join("columns", ",")).alias("fk_columns"))
    both = indexes.join(fks, ["schema_name", "table_name"], "left")
    name = F.lower("index_name")
    by_name = name.contains("(fk)") | name.rlike(r"_fk\d*$") | name.rlike("^fk[a-z0-9]+")
    mine = F.coalesce((F.upper(F.replace("columns", F.lit(" "), F.lit(""))) == F.col("fk_columns")) | F.upper("index_name").startswith(F.col("fk_name")), F.lit(False)) | by_name
    return both.groupBy("schema_name", "table_name", "index_name").agg(F.bool_or(mine).alias("supports_fk"))


def code_object_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """By kind: objects of both sides, and how many are missing or extra."""
    side = lambda df, c: df.select(F.upper("schema_name").alias("schema_name"), "kind", F.upper("object_name").alias("name"), F.lit(1).alias(c)).distinct()
    both = side(source, "s").join(side(target, "t"), ["schema_name", "kind", "name"], "full_outer")
    return both.groupBy("kind").agg(F.count("s").alias("source_count"), F.count("t").alias("target_count"), F.count_if(F.col("t").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("extra"))


def foreign_keys(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Each foreign key with its columns and the ones it refers to, matched by position, as text."""
    fk = columns.filter("kind = 'F'").join(constraints.filter("kind = 'F'").select("schema_name", "constraint_name", "ref_table", "on_delete"), ["schema_name", "constraint_name"])
    ordered = F.sort_array(F.collect_list(F.struct("position", "column_name", "ref_column")))
    g = fk.groupBy("schema_name", "table_name", "constraint_name", "ref_table", "on_delete").agg(ordered.alias("c"))
    return g.select("schema_name", "table_name", "constraint_name", "ref_table", "on_delete", F.array_join(F.transform("c", lambda x: x["column_name"]), ",").alias("columns"), F.array_join(F.transform("c", lambda x: x["ref_column"]), ",").alias("ref_columns"))


def key_match(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Tables with a primary key on both sides: whether the key columns agree in number, names and order, in any case."""
    side = lambda df, c: key_lists(df.filter("kind = 'P'")).select(F.upper("schema_name").alias("schema_name"), F.upper("table_name").alias("table_name"), F.transform("columns", F.upper).alias(c))
    both = side(source_columns, "s").join(side(target_columns, "t"), ["schema_name", "table_name"])
    return both.select("schema_name", "table_name", F.array_join("s", ",").alias("source_key"), F.array_join("t", ",").alias("target_key"), (F.col("s") == F.col("t")).alias("comparable"))


def table_statistics(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """All tables with whether they are partitioned or a partition of another, and their partitions."""
    parents = partitions.groupBy("schema_name", F.col("parent_table").alias("table_name")).agg(F.count(F.lit(1)).alias("n_partitions"))
    children = partitions.select("schema_name", F.col("partition_name").alias("table_name"), F.col("parent_table"))
    both = tables.join(parents, ["schema_name", "table_name"], "left").join(children, ["schema_name", "table_name"], "left")
    role = F.when(F.col("n_partitions").isNotNull(), "partitioned").when(F.col("parent_table").isNotNull(), "partition").otherwise("plain")
    return both.select("schema_name", "table_name", role.alias("role"), F.coalesce("n_partitions", F.lit(0)).alias("n_partitions"), "parent_table")


def logical_summary(tables: DataFrame, columns: DataFrame, partitions: DataFrame) -> DataFrame:
    """By schema: logical and physical tables, logical columns, partitioned tables, partitions."""
    n = lambda df, c, what=None: df.groupBy("schema_name").agg((what if what is not None else F.count(F.lit(1))).alias(c))
    out = n(tables, "physical_tables")
    for df in (n(logical(tables, partitions), "logical_tables"), n(logical(columns, partitions), "logical_columns"), n(partitions, "partitioned_tables", F.count_distinct("parent_table")), n(partitions, "partitions")):
        out = out.join(df, "schema_name", "left")
    return out.na.fill(0)


def table_column_summary(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """For each table, also those without columns: columns, their total length, nullable ones and others."""
    n = columns.groupBy("schema_name", "table_name").agg(F.count(F.lit(1)).alias("columns"), F.coalesce(F.sum("char_length"), F.lit(0)).alias("total_length"), F.count_if("is_nullable").alias("nullable"), F.count_if(~F.col("is_nullable")).alias("not_null"))
    return tables.select("schema_name", "table_name").join(n, ["schema_name", "table_name"], "left").na.fill(0)


def strategy(code: Column) -> Column:
    """RANGE, LIST or HASH from a letter or word in any case; else None."""
    c = F.lower(F.coalesce(code, F.lit("")))
    return F.when(c.isin("r", "range"), "RANGE").when(c.isin("l", "list"), "LIST").when(c.isin("h", "hash"), "HASH").otherwise("None")


def key_columns(definition: Column) -> Column:
    """The columns of ``STRATEGY (a, b)``; none without parentheses."""
    inside = F.regexp_extract(F.coalesce(definition, F.lit("")), r"\(([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")


def partition_metadata(partitions: DataFrame) -> DataFrame:
    """Each partition's strategy and key columns, and a line that tells them."""
    p = partitions.withColumns({"strategy": strategy(F.col("code")), "keys": F.array_join(key_columns(F.col("definition")), ", ")})
    return p.select("schema_name", "parent_table", "partition_name", "strategy", "keys", F.format_string("%s: %s (%s) - %s", "parent_table", "strategy", "keys", "partition_name").alias("detail"))


def grade(issues: Column, artifacts: Column, critical: Column) -> Column:
    """A+ to C from the issues less the artifacts, and whether any is critical."""
    n = issues - artifacts
    return F.when((n <= 0) & ~critical, "A+").when((n <= 5) & ~critical, "A").when(n <= 10, "B+").when(n <= 20, "B").otherwise("C")


def all_issues(*each: DataFrame) -> DataFrame:
    """Findings of all checks in one form: schema, kind, side, text, artifact."""
    out = None
    for d in each:
        names = [c for c in ("table_name", "constraint_name", "index_name", "ref_table") if c in d.columns]
        one = d.select(F.upper("schema_name").alias("schema_name"), "object_kind", "side", F.upper(F.concat_ws(" ", *names)).alias("text"), (F.col("artifact") if "artifact" in d.columns else F.lit(None).cast("string")).alias("artifact"))
        out = one if out is None else out.unionByName(one)
    return out


def schema_rollup(issues: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """By schema: tables, columns, issues, artifacts and the grade; missing tables and primary keys are critical."""
    real = F.col("artifact").isNull()
    n = issues.groupBy("schema_name").agg(F.count_if(real).alias("issues"), F.count_if(~real).alias("artifacts"), F.bool_or(real & (F.col("side") == "missing") & F.col("object_kind").isin("table", "primary key")).alias("critical"))
    t = tables.groupBy(F.upper("schema_name").alias("schema_name")).agg(F.count(F.lit(1)).alias("tables")).join(columns.groupBy(F.upper("schema_name").alias("schema_name")).agg(F.count(F.lit(1)).alias("columns")), "schema_name", "left")
    both = t.join(n, "schema_name", "left").select("schema_name", "tables", "columns", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("issues", "artifacts")), F.coalesce("critical", F.lit(False)).alias("critical"))
    return both.withColumn("grade", grade(F.col("issues"), F.col("artifacts"), F.col("critical")))


def top_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    """The findings that most schemas share."""
    g = issues.filter("artifact is null").groupBy("object_kind", "side", "text").agg(F.count_distinct("schema_name").alias("schemas"), F.array_join(F.sort_array(F.collect_set("schema_name")), ",").alias("schema_names"))
    return g.orderBy(F.desc("schemas"), "text", "object_kind", "side").limit(n)


def expected_extras(source: DataFrame, target: DataFrame) -> DataFrame:
    """By schema and kind: target objects that the source lacks, and whether all of them belong to added key columns."""
    s = source.select(F.upper("schema_name").alias("schema_name"), "kind", F.upper("object_name").alias("name")).distinct()
    t = target.select(F.upper("schema_name").alias("schema_name"), "kind", F.upper("object_name").alias("name")).distinct()
    return t.join(s, ["schema_name", "kind", "name"], "left_anti").groupBy("schema_name", "kind").agg(F.count(F.lit(1)).alias("extras"), F.bool_and(F.lower("name").contains(ARTIFACT)).alias("all_expected"))
