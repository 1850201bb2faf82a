"""Source and target pairs and catalogs, derived by Spark from the given tables; the same text runs in the other engine.

Braces name the tables a fixture needs. Numbers in the conditions only spread the planted differences over the rows.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from .tables import table, written

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_KEY = "concat('S', cast(p_partkey % 5 as varchar(9)))"
_T = "cast((p_partkey - p_partkey % 40) / 40 as bigint)"
_C = "cast(((p_partkey % 40) - (p_partkey % 5)) / 5 as bigint)"
_P = "case when p_partkey % 11 = 0 then cast(p_size % 18 + 1 as int) when p_partkey % 11 = 1 then 15 else null end"
_SC = "case when p_partkey % 11 = 0 then 0 when p_partkey % 11 = 1 then cast(p_size % 4 as int) else null end"
_TNUM = "try_cast(substring(table_name, 2, 9) as bigint)"

SQL: dict[str, str] = {
    "orders_src": """
        select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as o_totalprice, o_orderdate, o_orderpriority from {orders}""",
    "orders_tgt": """
        select o_orderkey, o_custkey, o_orderstatus,
               case when o_orderkey % 89 = 3 then cast(o_totalprice + 1 as decimal(18,2)) else o_totalprice end as o_totalprice,
               o_orderdate,
               case when o_orderkey % 83 = 5 then concat(o_orderpriority, '  ') else o_orderpriority end as o_orderpriority
        from {orders_src} where o_orderkey % 97 <> 0
        union all
        select o_orderkey + 10000000 as o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        from {orders_src} where o_orderkey % 101 = 0""",
    "lineitem_src": """
        select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as decimal(18,2)) as l_quantity, cast(l_extendedprice as decimal(18,2)) as l_extendedprice,
               l_returnflag, l_linestatus, l_shipdate from {lineitem}""",
    "lineitem_tgt": """
        select * from {lineitem_src} where (l_orderkey + l_partkey) % 211 <> 0
        union all
        select * from {lineitem_src} where (l_orderkey + l_suppkey) % 223 = 0""",
    "cat_src": f"""
        select {_KEY} as schema_name, concat('T', cast({_T} as varchar(9))) as table_name, concat('C', cast({_C} as varchar(9))) as column_name, {_C} + 1 as column_id,
               case p_partkey % 11 when 0 then 'NUMBER' when 1 then 'NUMBER' when 2 then 'VARCHAR2' when 3 then 'DATE'
                    when 4 then 'CLOB' when 5 then 'CHAR' when 6 then 'TIMESTAMP WITH TIME ZONE' when 7 then 'RAW'
                    when 8 then 'BINARY_DOUBLE' when 9 then 'XMLTYPE' else 'BFILE' end as data_type,
               {_P} as data_precision, {_SC} as data_scale,
               case when p_partkey % 11 in (2, 5) then cast(p_size as int) else null end as char_length,
               p_size % 3 <> 0 as is_nullable,
               case when p_partkey % 11 = 0 and p_size % 5 = 1 then 'GENERATED ALWAYS AS IDENTITY' else null end as default_value
        from {{part}}""",
    "cat_tgt": f"""
        select lower({_KEY}) as schema_name, concat('t', cast({_T} as varchar(9))) as table_name, concat('c', cast({_C} as varchar(9))) as column_name,
               case when {_T} % 7 = 2 then 9 - ({_C} + 1) else {_C} + 1 end as column_id,
               case when p_partkey % 7 = 0 then
                    case p_partkey % 11 when 0 then 'integer' when 1 then 'integer' when 2 then 'varchar' when 3 then 'date' when 4 then 'varchar' when 5 then 'varchar'
                         when 6 then 'timestamp' when 7 then 'text' when 8 then 'real' when 9 then 'text' else 'bytea' end
               else case p_partkey % 11
                    when 0 then case when p_size % 18 + 1 <= 4 then 'smallint' when p_size % 18 + 1 <= 9 then 'int4' else 'bigint' end
                    when 1 then case when p_size % 4 = 0 then 'bigint' else 'numeric' end
                    when 2 then 'character varying' when 3 then 'timestamp' when 4 then 'text' when 5 then 'bpchar' when 6 then 'timestamptz'
                    when 7 then 'bytea' when 8 then 'double precision' when 9 then 'xml' else 'text' end end as data_type,
               case when p_partkey % 11 = 1 and p_partkey % 7 <> 0 and p_size % 4 <> 0 then case when p_partkey % 13 = 5 then 14 else 15 end else null end as data_precision,
               case when p_partkey % 11 = 1 and p_partkey % 7 <> 0 and p_size % 4 <> 0 then cast(p_size % 4 as int) else null end as data_scale,
               case when p_partkey % 11 in (2, 5) then case when p_partkey % 7 = 0 then cast(p_size - 1 as int) when p_partkey % 13 = 2 then cast(p_size * 2 as int) else cast(p_size as int) end
                    when p_partkey % 11 = 4 and p_partkey % 7 = 0 then 2000 else null end as char_length,
               p_size % 3 <> 0 as is_nullable,
               case when p_partkey % 11 = 0 and p_size % 10 = 1 then 'nextval(seq)' else null end as default_value
        from {{part}} where p_partkey % 53 <> 0
        union all
        select lower({_KEY}) as schema_name, concat('t', cast({_T} as varchar(9))) as table_name, 'rowid' as column_name, cast(9 as bigint) as column_id, 'bigint' as data_type,
               cast(null as int) as data_precision, cast(null as int) as data_scale, cast(null as int) as char_length, false as is_nullable, 'nextval(seq_rowid)' as default_value
        from {{part}} where p_partkey % 40 = 0""",
    "tables_src": f"""
        select schema_name, table_name, {_TNUM} as t, {_TNUM} % 6 = 0 as is_partitioned,
               case when {_TNUM} % 23 = 7 then -1 when {_TNUM} % 29 = 0 then 0 else {_TNUM} * 1000 + 137 end as row_count, count(*) as n_columns
        from {{cat_src}} group by schema_name, table_name
        union all
        select distinct schema_name, 'BIN$X1' as table_name, cast(-1 as bigint) as t, false as is_partitioned, cast(1 as bigint) as row_count, cast(1 as bigint) as n_columns from {{cat_src}}""",
    "tables_tgt": """
        select lower(schema_name) as schema_name, lower(table_name) as table_name, t, is_partitioned,
               case when t % 31 = 5 then -1 when t % 23 = 7 then case when t % 2 = 0 then -1 else 5 end when t % 7 = 1 then row_count + t * 130 when t % 11 = 3 then row_count + t * 30
                    when t % 13 = 5 then row_count + 1 else row_count end as row_count,
               n_columns
        from {tables_src} where t >= 0 and t % 17 <> 4
        union all
        select lower(schema_name) as schema_name, concat('t', cast(t as varchar(9)), '_audit') as table_name, t + 100000 as t, false as is_partitioned, t as row_count, cast(3 as bigint) as n_columns
        from {tables_src} where t >= 0 and t % 19 = 2
        union all
        select lower(schema_name) as schema_name, concat(lower(table_name), '_p', cast(k as varchar(9))) as table_name, t + 200000 as t, false as is_partitioned, cast(10 as bigint) as row_count, n_columns
        from {tables_src} cross join (select 1 as k union all select 2 as k) as two where t >= 0 and is_partitioned""",
    "partitions_tgt": """
        select lower(schema_name) as schema_name, lower(table_name) as parent_table, concat(lower(table_name), '_p', cast(k as varchar(9))) as partition_name,
               case t % 4 when 0 then 'RANGE (c0)' when 1 then 'LIST (c0, c1)' when 2 then 'HASH ( c2 )' else 'RANGE' end as definition,
               case t % 5 when 0 then 'r' when 1 then 'L' when 2 then 'hash' when 3 then 'LIST' else '' end as code
        from {tables_src} cross join (select 1 as k union all select 2 as k) as two where t >= 0 and is_partitioned""",
    "cons_src": """
        select schema_name, table_name, concat('PK_', table_name) as constraint_name, 'P' as kind, cast(null as varchar(20)) as ref_table, cast(null as varchar(20)) as on_delete, t % 13 <> 0 as is_enabled, cast(null as varchar(40)) as condition
        from {tables_src} where t >= 0 and t % 9 <> 4
        union all
        select schema_name, table_name, concat('FK_', table_name) as constraint_name, 'F' as kind, concat('T', cast(t - 1 as varchar(9))) as ref_table,
               case t % 4 when 0 then 'CASCADE' when 1 then 'SET NULL' else 'NO ACTION' end as on_delete, t % 13 <> 5 as is_enabled, cast(null as varchar(40)) as condition
        from {tables_src} where t > 0
        union all
        select schema_name, table_name, concat('UQ_', table_name) as constraint_name, 'U' as kind, cast(null as varchar(20)) as ref_table, cast(null as varchar(20)) as on_delete, true as is_enabled, cast(null as varchar(40)) as condition
        from {tables_src} where t >= 0 and t % 5 = 1
        union all
        select schema_name, table_name, case when t % 4 = 0 then concat('SYS_C', cast(t as varchar(9))) else concat('CK_', table_name) end as constraint_name, 'C' as kind, cast(null as varchar(20)) as ref_table, cast(null as varchar(20)) as on_delete, true as is_enabled,
               case when t % 6 = 2 then '"C2" IS NOT NULL' else 'C1 > 0' end as condition
        from {tables_src} where t >= 0 and t % 2 = 0""",
    "cons_tgt": """
        select lower(schema_name) as schema_name, lower(table_name) as table_name, lower(constraint_name) as constraint_name, kind, lower(ref_table) as ref_table,
               case when t8 = 1 then 'CASCADE' else on_delete end as on_delete, true as is_enabled, condition
        from (select *, try_cast(substring(table_name, 2, 9) as bigint) as t, try_cast(substring(table_name, 2, 9) as bigint) % 8 as t8 from {cons_src}) as c
        where (kind = 'P' and is_enabled and t % 10 <> 7) or (kind = 'F' and is_enabled and t % 12 <> 3) or (kind = 'U' and t % 25 <> 6) or kind = 'C'
        union all
        select lower(schema_name) as schema_name, lower(table_name) as table_name, concat('pk_', lower(table_name), '_rowid') as constraint_name, 'P' as kind, cast(null as varchar(20)) as ref_table, cast(null as varchar(20)) as on_delete, true as is_enabled, cast(null as varchar(40)) as condition
        from {tables_src} where t >= 0 and t % 9 = 4
        union all
        select lower(schema_name) as schema_name, lower(table_name) as table_name, concat('fk_', lower(table_name), '_self') as constraint_name, 'F' as kind, lower(table_name) as ref_table, 'NO ACTION' as on_delete, true as is_enabled, cast(null as varchar(40)) as condition
        from {tables_src} where t >= 0 and t % 15 = 2
        union all
        select schema_name, partition_name as table_name, concat('pk_', partition_name) as constraint_name, 'P' as kind, cast(null as varchar(20)) as ref_table, cast(null as varchar(20)) as on_delete, true as is_enabled, cast(null as varchar(40)) as condition
        from {partitions_tgt}""",
    "cons_cols_src": """
        select schema_name, table_name, constraint_name, kind, position, column_name, ref_column from (
        select schema_name, table_name, constraint_name, kind, 1 as position, case kind when 'P' then 'C0' when 'F' then 'C1' when 'U' then 'C2' else 'C3' end as column_name, 'C0' as ref_column from {cons_src}
        union all
        select schema_name, table_name, constraint_name, kind, 2 as position, case kind when 'P' then 'C1' else 'C4' end as column_name, 'C1' as ref_column from {cons_src}
        where kind in ('P', 'F') and try_cast(substring(table_name, 2, 9) as bigint) % 3 = 0) as two""",
    "cons_cols_tgt": """
        select schema_name, table_name, constraint_name, kind, 1 as position,
               case when constraint_name like '%rowid' then 'rowid' when kind = 'P' then 'c0' when kind = 'F' then 'c1' when kind = 'U' then 'c2' else 'c3' end as column_name from {cons_tgt}
        union all
        select schema_name, table_name, constraint_name, kind, 2 as position, 'c1' as column_name from {cons_tgt}
        where kind = 'P' and constraint_name not like '%rowid' and table_name not like '%p%' and try_cast(substring(table_name, 2, 9) as bigint) % 3 = 0 and try_cast(substring(table_name, 2, 9) as bigint) % 2 = 1""",
    "idx_src": """
        select schema_name, table_name, concat('IDX_', table_name, '_C2') as index_name, case when t % 7 = 3 then 'BITMAP' else 'NORMAL' end as kind, false as is_unique, 'C2' as columns from {tables_src} where t >= 0 and t % 3 = 0
        union all
        select schema_name, table_name, concat('IDX_', table_name, '_C1') as index_name, 'NORMAL' as kind, false as is_unique, 'C1' as columns from {tables_src} where t >= 0 and t % 5 = 0
        union all
        select schema_name, table_name, constraint_name as index_name, 'NORMAL' as kind, true as is_unique, 'C0' as columns from {cons_src} where kind in ('P', 'U')""",
    "idx_tgt": """
        select lower(schema_name) as schema_name, lower(table_name) as table_name, lower(index_name) as index_name, 'btree' as kind, is_unique, lower(columns) as columns from {idx_src}
        where is_unique or try_cast(substring(table_name, 2, 9) as bigint) % 12 <> 6
        union all
        select lower(schema_name) as schema_name, lower(table_name) as table_name, concat('idx_', lower(table_name), '_rowid') as index_name, 'btree' as kind, false as is_unique, 'rowid' as columns from {tables_src} where t >= 0 and t % 9 = 4
        union all
        select lower(schema_name) as schema_name, lower(table_name) as table_name, concat('ix_', lower(table_name), '_new') as index_name, 'btree' as kind, false as is_unique, 'c3' as columns from {tables_src} where t >= 0 and t % 16 = 1
        union all
        select schema_name, partition_name as table_name, concat('idx_', partition_name) as index_name, 'btree' as kind, false as is_unique, 'c2' as columns from {partitions_tgt}""",
    "objects_src": """
        select schema_name, 'sequence' as kind, concat(table_name, '_SEQ') as object_name, table_name from {tables_src} where t >= 0 and t % 2 = 0
        union all select schema_name, 'procedure' as kind, concat('SP_', table_name, '_INSERT') as object_name, table_name from {tables_src} where t >= 0 and t % 4 = 1
        union all select schema_name, 'function' as kind, concat('FN_', table_name) as object_name, table_name from {tables_src} where t >= 0 and t % 6 = 5
        union all select schema_name, 'view' as kind, concat('V_', table_name) as object_name, table_name from {tables_src} where t >= 0 and t % 3 = 1
        union all select schema_name, 'materialized_view' as kind, concat('MV_', table_name) as object_name, table_name from {tables_src} where t >= 0 and t % 10 = 2
        union all select schema_name, 'trigger' as kind, concat('TR_', table_name) as object_name, table_name from {tables_src} where t >= 0 and t % 5 = 4""",
    "objects_tgt": """
        select lower(schema_name) as schema_name, kind, lower(object_name) as object_name, lower(table_name) as table_name from {objects_src} where try_cast(substring(table_name, 2, 9) as bigint) % 14 <> 5
        union all
        select lower(schema_name) as schema_name, 'sequence' as kind, concat(lower(table_name), '_rowid_seq') as object_name, lower(table_name) as table_name from {tables_src} where t >= 0 and t % 9 = 4""",
    "runs": """
        select concat('S', cast(user_id % 4 as varchar(9))) as schema_name,
               concat(case user_id % 5 when 0 then 'table_count_' when 1 then 'table_sample_' when 2 then 'table_pk_lookup_' when 3 then 'table_ordered_' else 'list_index_' end, cast(user_id as varchar(9))) as query_name,
               case when event_id % 2 = 0 then 'source' else 'target' end as engine, event_id as run_id, cast(value as decimal(18,2)) as ms,
               case when user_id % 17 = 0 and event_id % 2 = 1 then user_id + 1 else user_id end as n_rows,
               event_type <> 'error' or user_id % 13 <> 0 as executed
        from {events}""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", SQL[name])


@cache
def _order(name: str) -> tuple[str, ...]:
    out: list[str] = []
    for n in _needs(name):
        if n in SQL:
            out += [x for x in _order(n) if x not in out]
    return (*out, name)


#: Catalogs that many others are derived from: written once for each query, so plans stay small.
_CUT = {"tables_src", "partitions_tgt", "cons_src", "cons_tgt", "idx_src", "objects_src"}


def fixture(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given table or a fixture; ``made`` holds what one query has derived already."""
    if name not in SQL:
        return table(spark, sf_dir, name)
    made = {} if made is None else made
    for n in _order(name):
        if n not in made:
            needs = {x: made[x] if x in made else table(spark, sf_dir, x) for x in dict.fromkeys(_needs(n))}
            df = spark.sql(SQL[n], **needs)
            made[n] = written(df, n) if n in _CUT else df
    return made[name]


def with_fixtures(sql: str, *names: str) -> str:
    """The query for the other engine: the fixtures it names, and what these need, as common table expressions before it."""
    every: list[str] = []
    for n in (x for x in names if x in SQL):
        every += [x for x in _order(n) if x not in every]
    ctes = ", ".join(f"{n} as ({re.sub(r'\{(\w+)\}', r'\1', SQL[n]).strip()})" for n in every)
    sql = sql.strip()
    if not every:
        return sql
    return f"with {ctes}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {ctes} {sql}"
