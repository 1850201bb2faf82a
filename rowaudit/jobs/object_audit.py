"""Are all schema objects there? Differences of the derived catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, objects, summary
from .registry import query

_LOGICAL = "not exists (select 1 from partitions_tgt p where p.schema_name = {a}.schema_name and p.partition_name = {a}.table_name)"


def _two(source: str, target: str, on: str, show: str, kind: str) -> str:
    """SQL of a difference both ways: ``source`` and ``target`` name common table expressions."""
    eq = " and ".join(f"upper(a.{c}) = upper(b.{c})" for c in on.split())
    names = ", ".join(f"a.{c}" for c in show.split())
    count = "coalesce((select count(*) from {s} x where upper(x.schema_name) = upper(a.schema_name)), 0)"
    differ = f"{count.format(s=source)} <> {count.format(s=target)} as counts_differ"
    return f"""select 'missing' as side, {names}, {differ}, '{kind}' as object_kind from {source} a where not exists (select 1 from {target} b where {eq})
               union all select 'extra' as side, {names}, {differ}, '{kind}' as object_kind from {target} a where not exists (select 1 from {source} b where {eq})"""


_TABLES = f"ts as (select * from tables_src where table_name not like 'BIN$%'), tt as (select * from tables_tgt t where {_LOGICAL.format(a='t')})"
_TABLE_DIFF = _two("ts", "tt", "schema_name table_name", "schema_name table_name", "table")


@query("table_diff", "tables_src tables_tgt partitions_tgt", f"with {_TABLES} {_TABLE_DIFF}")
def table_diff(source: DataFrame, target: DataFrame, partitions: DataFrame) -> DataFrame:
    return objects.table_diff(filters.filter_tables(source), filters.logical_tables(target, partitions))


@query(
    "column_order_diff", "cat_src cat_tgt",
    """with s as (select upper(schema_name) as sn, upper(table_name) as tn, upper(column_name) as cn, row_number() over (partition by upper(schema_name), upper(table_name) order by column_id, upper(column_name)) as place, count(*) over (partition by upper(schema_name), upper(table_name)) as n from cat_src where lower(column_name) <> 'rowid'),
            t as (select upper(schema_name) as sn, upper(table_name) as tn, upper(column_name) as cn, row_number() over (partition by upper(schema_name), upper(table_name) order by column_id, upper(column_name)) as place, count(*) over (partition by upper(schema_name), upper(table_name)) as n from cat_tgt where lower(column_name) <> 'rowid'),
            b as (select s.sn, s.tn, cast(s.place as int) as place, s.n as a, t.n as b, s.cn as c, t.cn as d from s join t on s.sn = t.sn and s.tn = t.tn and s.place = t.place)
       select distinct sn as schema_name, tn as table_name, 'count' as finding, cast(null as int) as place, cast(a as varchar) as source, cast(b as varchar) as target from b where a <> b
       union all select sn, tn, 'order', place, c, d from b where a = b and c <> d""",
)
def column_order_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    return objects.column_order_diff(source, target)


_CONS = f"ct as (select * from cons_tgt c where {_LOGICAL.format(a='c')}), added as (select schema_name, constraint_name from cons_cols_tgt where kind = 'P' group by 1, 2 having count(*) = 1 and min(lower(column_name)) = 'rowid')"
_PK = f"""{_CONS}, ps as (select * from cons_src where kind = 'P' and is_enabled), pt as (select * from ct where kind = 'P' and not exists (select 1 from added x where x.schema_name = ct.schema_name and x.constraint_name = ct.constraint_name)),
    pk as (select side, schema_name, table_name, constraint_name, counts_differ, object_kind, cast(null as varchar) as artifact from ({_two("ps", "pt", "schema_name table_name", "schema_name table_name constraint_name", "primary key")}) as d
           union all select 'missing', schema_name, table_name, constraint_name, null, 'primary key', 'disabled in source' from cons_src where kind = 'P' and not is_enabled
           union all select 'extra', schema_name, table_name, constraint_name, null, 'primary key', 'added key' from ct where kind = 'P' and exists (select 1 from added x where x.schema_name = ct.schema_name and x.constraint_name = ct.constraint_name))"""
_FK = f"""fs as (select * from cons_src where kind = 'F' and is_enabled and table_name not in ('T3', 'T8') and ref_table not in ('T3', 'T8') and constraint_name <> 'FK_T11'),
    ft as (select * from ct where kind = 'F' and upper(table_name) not in ('T3', 'T8') and upper(ref_table) not in ('T3', 'T8') and upper(constraint_name) <> 'FK_T11'),
    fk as (select side, schema_name, table_name, constraint_name, ref_table, counts_differ, object_kind, cast(null as varchar) as artifact from ({_two("fs", "ft", "schema_name table_name ref_table", "schema_name table_name constraint_name ref_table", "foreign key")}) as d
           union all select 'missing', schema_name, table_name, constraint_name, ref_table, null, 'foreign key', 'disabled in source' from cons_src
           where kind = 'F' and not is_enabled and table_name not in ('T3', 'T8') and ref_table not in ('T3', 'T8') and constraint_name <> 'FK_T11')"""
_CONS_NEEDS = "cons_src cons_tgt cons_cols_tgt partitions_tgt"


def _pk(source: DataFrame, target: DataFrame, columns: DataFrame, partitions: DataFrame) -> DataFrame:
    return objects.pk_diff(source, objects.logical(target, partitions), columns)


def _fks(df: DataFrame) -> DataFrame:
    """Foreign keys without those of two excluded tables and one ignored by name."""
    return objects.drop_excluded_fks(df.filter("kind = 'F'"), ["T3", "T8"], ["FK_T11"])


@query("pk_diff", _CONS_NEEDS, f"with {_PK} select * from pk")
def pk_diff(source: DataFrame, target: DataFrame, columns: DataFrame, partitions: DataFrame) -> DataFrame:
    return _pk(source, target, columns, partitions)


@query("fk_diff", _CONS_NEEDS, f"with {_CONS}, {_FK} select * from fk")
def fk_diff(source: DataFrame, target: DataFrame, columns: DataFrame, partitions: DataFrame) -> DataFrame:
    return objects.fk_diff(_fks(source), _fks(objects.logical(target, partitions)))


@query(
    "fk_delete_rule_diff", "cons_src cons_tgt",
    """with t as (select upper(schema_name) as sn, upper(table_name) as tn, upper(ref_table) as rn, min_by(on_delete, constraint_name) as target_rule from cons_tgt where kind = 'F' group by 1, 2, 3)
       select schema_name, table_name, ref_table, on_delete as source_rule, target_rule from cons_src s join t on s.schema_name = t.sn and s.table_name = t.tn and s.ref_table = t.rn where kind = 'F' and is_enabled and on_delete is distinct from target_rule""",
)
def fk_delete_rule_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    return objects.fk_rule_diff(source, target)


def _counts_sql(kind: str, extra_s: str = "", extra_t: str = "") -> str:
    return f"""with s as (select schema_name, count(*) as n from cons_src where kind = '{kind}' {extra_s} group by 1), t as (select upper(schema_name) as schema_name, count(*) as n from cons_tgt where kind = '{kind}' {extra_t} group by 1)
        select coalesce(s.schema_name, t.schema_name) as schema_name, coalesce(s.n, 0) as source_count, coalesce(t.n, 0) as target_count, {"coalesce(s.n, 0) <> coalesce(t.n, 0)" if kind == "U" else "false"} as is_issue from s full outer join t on s.schema_name = t.schema_name"""


@query("unique_constraint_counts", "cons_src cons_tgt", _counts_sql("U"))
def unique_constraint_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    return objects.constraint_counts(source, target, "U")


@query("check_constraint_counts", "cons_src cons_tgt", _counts_sql("C", "and constraint_name not like 'SYS\\_%' escape '\\' and condition not like '%IS NOT NULL%'", "and condition not like '%IS NOT NULL%'"))
def check_constraint_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    return objects.constraint_counts(source, target, "C")


_SECONDARY = f"""xs as (select * from idx_src i where not exists (select 1 from cons_src c where c.kind in ('P', 'U') and c.schema_name = i.schema_name and c.constraint_name = i.index_name)),
    xt as (select * from idx_tgt i where not exists (select 1 from cons_tgt c where c.kind in ('P', 'U') and c.schema_name = i.schema_name and c.constraint_name = i.index_name) and {_LOGICAL.format(a='i')})"""
_INDEX = f"ix as (select *, case when side = 'extra' and lower(index_name) like '%rowid%' then 'added key' end as artifact from ({_two('xs', 'xt', 'schema_name table_name index_name', 'schema_name table_name index_name', 'index')}) as d)"
_INDEX_NEEDS = "idx_src idx_tgt cons_src cons_tgt partitions_tgt"


def _index(idx_s: DataFrame, idx_t: DataFrame, cons_s: DataFrame, cons_t: DataFrame, partitions: DataFrame) -> DataFrame:
    return objects.index_diff(objects.secondary_indexes(idx_s, cons_s), objects.logical(objects.secondary_indexes(idx_t, cons_t), partitions))


@query("secondary_indexes", _INDEX_NEEDS, f"with {_SECONDARY} select schema_name, table_name, index_name from xs union all select schema_name, table_name, index_name from xt")
def secondary_indexes(idx_s: DataFrame, idx_t: DataFrame, cons_s: DataFrame, cons_t: DataFrame, partitions: DataFrame) -> DataFrame:
    both = objects.secondary_indexes(idx_s, cons_s).unionByName(objects.logical(objects.secondary_indexes(idx_t, cons_t), partitions))
    return both.select("schema_name", "table_name", "index_name")


@query("index_diff", _INDEX_NEEDS, f"with {_SECONDARY}, {_INDEX} select * from ix")
def index_diff(*each: DataFrame) -> DataFrame:
    return _index(*each)


@query(
    "index_diff_samples", _INDEX_NEEDS,
    f"""with {_SECONDARY}, {_INDEX}, r as (select side, index_name, schema_name, cast(row_number() over (partition by side order by index_name, schema_name) as int) as rank, greatest(count(*) over (partition by side) - 10, 0) as more from ix)
        select side, rank, index_name || '.' || schema_name as name, more from r where rank <= 10""",
)
def index_diff_samples(*each: DataFrame) -> DataFrame:
    named = _index(*each).select("side", F.concat_ws(".", "index_name", "schema_name").alias("name"))
    return summary.first_names(named, ["side"], "name", 10).select("side", "rank", "name", "more")


@query("bitmap_indexes", "idx_src", "select schema_name, table_name, index_name, columns from idx_src where kind = 'BITMAP'")
def bitmap_indexes(indexes: DataFrame) -> DataFrame:
    return indexes.filter("kind = 'BITMAP'").select("schema_name", "table_name", "index_name", "columns")


@query(
    "fk_supporting_indexes", "idx_src cons_cols_src",
    """with f as (select schema_name, table_name, constraint_name, string_agg(column_name, ',' order by position) as cols from cons_cols_src where kind = 'F' group by 1, 2, 3)
       select i.schema_name, i.table_name, i.index_name, bool_or(coalesce(i.columns = f.cols or starts_with(i.index_name, f.constraint_name), false)) as supports_fk from idx_src i left join f on f.schema_name = i.schema_name and f.table_name = i.table_name group by 1, 2, 3""",
)
def fk_supporting_indexes(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    return objects.fk_supporting(indexes, columns)


@query(
    "code_object_diff", "objects_src objects_tgt",
    """with s as (select distinct schema_name as sn, kind, object_name as n from objects_src), t as (select distinct upper(schema_name) as sn, kind, upper(object_name) as n from objects_tgt)
       select coalesce(s.kind, t.kind) as kind, count(s.n) as source_count, count(t.n) as target_count, count(*) filter (t.n is null) as missing, count(*) filter (s.n is null) as extra from s full outer join t on s.sn = t.sn and s.kind = t.kind and s.n = t.n group by 1""",
)
def code_object_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    return objects.code_object_diff(source, target)


@query("primary_keys", "cons_cols_src", "select schema_name, table_name, constraint_name, string_agg(column_name, ',' order by position) as key_columns from cons_cols_src where kind = 'P' group by 1, 2, 3")
def primary_keys(columns: DataFrame) -> DataFrame:
    return objects.key_lists(columns.filter("kind = 'P'")).select("schema_name", "table_name", "constraint_name", F.array_join("columns", ",").alias("key_columns"))


@query(
    "foreign_keys", "cons_cols_src cons_src",
    """select c.schema_name, c.table_name, c.constraint_name, k.ref_table, k.on_delete, string_agg(c.column_name, ',' order by c.position) as columns, string_agg(c.ref_column, ',' order by c.position) as ref_columns
       from cons_cols_src c join cons_src k on k.schema_name = c.schema_name and k.constraint_name = c.constraint_name and k.kind = 'F' where c.kind = 'F' group by 1, 2, 3, 4, 5""",
)
def foreign_keys(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    return objects.foreign_keys(columns, constraints)


@query(
    "key_match_guard", "cons_cols_src cons_cols_tgt",
    """with s as (select schema_name as sn, table_name as tn, string_agg(upper(column_name), ',' order by position) as k from cons_cols_src where kind = 'P' group by 1, 2), t as (select upper(schema_name) as sn, upper(table_name) as tn, string_agg(upper(column_name), ',' order by position) as k from cons_cols_tgt where kind = 'P' group by 1, 2)
       select s.sn as schema_name, s.tn as table_name, s.k as source_key, t.k as target_key, s.k = t.k as comparable from s join t on s.sn = t.sn and s.tn = t.tn""",
)
def key_match_guard(source: DataFrame, target: DataFrame) -> DataFrame:
    return objects.key_match(source, target)


@query(
    "table_statistics", "tables_tgt partitions_tgt",
    """with p as (select schema_name, parent_table, count(*) as n from partitions_tgt group by 1, 2)
       select t.schema_name, t.table_name, case when p.n is not null then 'partitioned' when c.parent_table is not null then 'partition' else 'plain' end as role, coalesce(p.n, 0) as n_partitions, c.parent_table
       from tables_tgt t left join p on p.schema_name = t.schema_name and p.parent_table = t.table_name left join partitions_tgt c on c.schema_name = t.schema_name and c.partition_name = t.table_name""",
)
def table_statistics(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    return objects.table_statistics(tables, partitions)


@query(
    "logical_schema_summary", "tables_tgt cat_tgt partitions_tgt",
    f"""select schema_name, count(*) as physical_tables, count(*) filter ({_LOGICAL.format(a='t')}) as logical_tables, (select count(*) from cat_tgt c where c.schema_name = t.schema_name) as logical_columns,
            (select count(distinct parent_table) from partitions_tgt q where q.schema_name = t.schema_name) as partitioned_tables, (select count(*) from partitions_tgt q where q.schema_name = t.schema_name) as partitions from tables_tgt t group by schema_name""",
)
def logical_schema_summary(tables: DataFrame, columns: DataFrame, partitions: DataFrame) -> DataFrame:
    return objects.logical_summary(tables, columns, partitions)


@query(
    "table_column_summary", "tables_tgt cat_tgt",
    """select t.schema_name, t.table_name, count(c.column_name) as columns, cast(coalesce(sum(c.char_length), 0) as bigint) as total_length, count(*) filter (c.is_nullable) as nullable, count(*) filter (not c.is_nullable) as not_null
       from tables_tgt t left join cat_tgt c on c.schema_name = t.schema_name and c.table_name = t.table_name group by 1, 2""",
)
def table_column_summary(tables: DataFrame, columns: DataFrame) -> DataFrame:
    return objects.table_column_summary(tables, columns)


@query(
    "partition_metadata", "partitions_tgt",
    """with p as (select *, case lower(code) when 'r' then 'RANGE' when 'range' then 'RANGE' when 'l' then 'LIST' when 'list' then 'LIST' when 'h' then 'HASH' when 'hash' then 'HASH' else 'None' end as strategy,
            case substring(definition, 1, 4) when 'RANG' then case when definition = 'RANGE' then '' else 'c0' end when 'LIST' then 'c0, c1' else 'c2' end as keys from partitions_tgt)
       select schema_name, parent_table, partition_name, strategy, keys, parent_table || ': ' || strategy || ' (' || keys || ') - ' || partition_name as detail from p""",
)
def partition_metadata(partitions: DataFrame) -> DataFrame:
    return objects.partition_metadata(partitions)


_ALL = f"""{_TABLES}, td as ({_TABLE_DIFF}), {_PK}, {_FK}, {_SECONDARY}, {_INDEX},
    a as (select upper(schema_name) as schema_name, object_kind, side, upper(table_name) as text, cast(null as varchar) as artifact from td union all select upper(schema_name), object_kind, side, upper(table_name || ' ' || constraint_name), artifact from pk
          union all select upper(schema_name), object_kind, side, upper(table_name || ' ' || constraint_name || ' ' || ref_table), artifact from fk union all select upper(schema_name), object_kind, side, upper(table_name || ' ' || index_name), artifact from ix)"""
_ALL_NEEDS = "tables_src tables_tgt partitions_tgt cons_src cons_tgt cons_cols_tgt idx_src idx_tgt cat_src"


def _all(ts: DataFrame, tt: DataFrame, parts: DataFrame, cs: DataFrame, ct: DataFrame, cct: DataFrame, xs: DataFrame, xt: DataFrame, _: DataFrame) -> DataFrame:
    return objects.all_issues(
        objects.table_diff(filters.filter_tables(ts), filters.logical_tables(tt, parts)), _pk(cs, ct, cct, parts), objects.fk_diff(_fks(cs), _fks(objects.logical(ct, parts))), _index(xs, xt, cs, ct, parts)
    )


@query("all_issues", _ALL_NEEDS, f"with {_ALL} select * from a")
def all_issues(*each: DataFrame) -> DataFrame:
    return _all(*each)


@query(
    "schema_rollup", _ALL_NEEDS,
    f"""with {_ALL}, n as (select schema_name, count(*) filter (artifact is null) as issues, count(*) filter (artifact is not null) as artifacts, bool_or(artifact is null and side = 'missing' and object_kind in ('table', 'primary key')) as critical from a group by 1),
        t as (select schema_name, count(*) as tables from ts group by 1), c as (select schema_name, count(*) as columns from cat_src group by 1),
        b as (select t.schema_name, tables, columns, coalesce(issues, 0) as issues, coalesce(artifacts, 0) as artifacts, coalesce(critical, false) as critical from t left join c on c.schema_name = t.schema_name left join n on n.schema_name = t.schema_name)
        select *, case when issues - artifacts <= 0 and not critical then 'A+' when issues - artifacts <= 5 and not critical then 'A' when issues - artifacts <= 10 then 'B+' when issues - artifacts <= 20 then 'B' else 'C' end as grade from b""",
)
def schema_rollup(*each: DataFrame) -> DataFrame:
    return objects.schema_rollup(_all(*each), filters.filter_tables(each[0]), each[-1])


@query("top_schema_issues", _ALL_NEEDS, f"with {_ALL} select object_kind, side, text, count(distinct schema_name) as schemas, string_agg(distinct schema_name, ',' order by schema_name) as schema_names from a where artifact is null group by 1, 2, 3 order by schemas desc, text, object_kind, side limit 10")
def top_schema_issues(*each: DataFrame) -> DataFrame:
    return objects.top_issues(_all(*each))


@query(
    "expected_extra_objects", "objects_src objects_tgt",
    """select upper(schema_name) as schema_name, kind, count(distinct upper(object_name)) as extras, bool_and(lower(object_name) like '%rowid%') as all_expected from objects_tgt t
       where not exists (select 1 from objects_src s where s.schema_name = upper(t.schema_name) and s.kind = t.kind and s.object_name = upper(t.object_name)) group by 1, 2""",
)
def expected_extra_objects(source: DataFrame, target: DataFrame) -> DataFrame:
    return objects.expected_extras(source, target)
