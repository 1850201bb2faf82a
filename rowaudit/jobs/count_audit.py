"""Are the row counts the same? Counts of the given tables and of the derived estate of schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts, filters, summary
from ..sources.fixtures import BASE, fixture
from .registry import ORACLE_SQL, QUERIES, query


def _table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.row_counts({n: fixture(spark, sf_dir, n) for n in BASE})


QUERIES["table_row_counts"] = _table_row_counts
ORACLE_SQL["table_row_counts"] = " union all ".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in BASE)


@query("partition_row_counts", "orders", "select cast(year(o_orderdate) as varchar) as partition_name, count(*) as row_count from orders group by 1")
def partition_row_counts(orders: DataFrame) -> DataFrame:
    return counts.partition_counts(orders, F.year("o_orderdate").cast("string"))


@query("table_count", "tables_tgt partitions_tgt", "select schema_name, count(*) as n_tables from tables_tgt t where not exists (select 1 from partitions_tgt p where p.schema_name = t.schema_name and p.partition_name = t.table_name) group by 1")
def table_count(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    return filters.logical_tables(tables, partitions).groupBy("schema_name").agg(F.count(F.lit(1)).alias("n_tables"))


_COMPARE = """
    s as (select upper(schema_name) as sn, upper(table_name) as tn, row_count as c from tables_src where table_name not like 'BIN$%'),
    t as (select upper(schema_name) as sn, upper(table_name) as tn, row_count as c from tables_tgt t where not exists (select 1 from partitions_tgt p where p.schema_name = t.schema_name and p.partition_name = t.table_name)),
    b as (select coalesce(s.sn, t.sn) as schema_name, coalesce(s.tn, t.tn) as table_name, s.c as source_count, t.c as target_count from s full outer join t on s.sn = t.sn and s.tn = t.tn),
    k as (select *, case when target_count is null then 'Missing Table' when source_count is null then 'Extra Table' when source_count < 0 and target_count < 0 then 'Query Error' when source_count < 0 then 'Source Query Error'
                         when target_count < 0 then 'Target Query Error' when source_count = target_count then 'Match' else 'Row Count Mismatch' end as issue_type from b),
    f as (select *, case when issue_type in ('Match', 'Row Count Mismatch') then abs(target_count - source_count) end as difference,
                 case when issue_type = 'Match' then 0.0 when issue_type = 'Row Count Mismatch' then case when source_count > 0 then cast(abs(target_count - source_count) as double) / source_count * 100 else 100.0 end end as percent from k),
    r as (select *, case when issue_type = 'Missing Table' then 'Critical' when issue_type = 'Extra Table' then 'Warning' when issue_type like '%Error' then 'Error' when issue_type = 'Match' then 'Info'
                         when percent > 10 then 'Critical' when percent > 1 then 'Error' else 'Warning' end as severity from f)"""
_NEEDS = "tables_src tables_tgt partitions_tgt"


def _findings(source: DataFrame, target: DataFrame, partitions: DataFrame) -> DataFrame:
    return counts.compare_counts(filters.filter_tables(source), filters.logical_tables(target, partitions))


@query("row_count_compare", _NEEDS, f"with {_COMPARE} select * from r")
def row_count_compare(source: DataFrame, target: DataFrame, partitions: DataFrame) -> DataFrame:
    return _findings(source, target, partitions)


@query(
    "row_count_schema_rollup", _NEEDS,
    f"""with {_COMPARE}, g as (select coalesce(schema_name, 'TOTAL') as schema_name, count(*) as tables, count(*) filter (issue_type = 'Match') as matching, count(*) filter (issue_type = 'Row Count Mismatch') as mismatched,
            count(*) filter (issue_type = 'Missing Table') as missing, count(*) filter (issue_type = 'Extra Table') as extra, cast(coalesce(sum(source_count) filter (source_count >= 0), 0) as bigint) as source_rows, cast(coalesce(sum(target_count) filter (target_count >= 0), 0) as bigint) as target_rows,
            count(*) filter (severity = 'Critical') as critical, count(*) filter (severity = 'Error') as error, count(*) filter (severity = 'Warning') as warning from r group by rollup(schema_name))
        select *, case when critical + error > 0 then 'FAILED' when warning > 0 then 'WARNING' else 'PASSED' end as status from g""",
)
def row_count_schema_rollup(source: DataFrame, target: DataFrame, partitions: DataFrame) -> DataFrame:
    return counts.count_rollup(_findings(source, target, partitions))


@query("top_row_count_gaps", _NEEDS, f"with {_COMPARE} select schema_name, table_name, source_count, target_count, difference, percent from r where severity in ('Critical', 'Error') and difference is not null order by difference desc, schema_name, table_name limit 10")
def top_row_count_gaps(source: DataFrame, target: DataFrame, partitions: DataFrame) -> DataFrame:
    return counts.top_gaps(_findings(source, target, partitions))


@query("issues_by_type", _NEEDS, f"with {_COMPARE} select issue_type, count(*) as total, count(*) filter (severity = 'Critical') as critical, count(*) filter (severity = 'Error') as error, count(*) filter (severity = 'Warning') as warning, count(*) filter (severity = 'Info') as info from r group by 1")
def issues_by_type(source: DataFrame, target: DataFrame, partitions: DataFrame) -> DataFrame:
    return summary.issue_counts(_findings(source, target, partitions), "issue_type")


#: Tables that users leave out here (fixed values): name patterns, and objects by kind.
PATTERNS = ("t1_", "S2.T3", "_AUDIT")
IGNORED = (("table", "T7"), ("table", "S1.T9"), ("sequence", "T4_SEQ"), ("view", "s3.v_t10"), ("trigger", "TR_T9"), ("fk", "FK_T3"), ("fk", "S2.FK_T5"))


@query("filter_tables", "tables_src", "select schema_name, table_name from tables_src where table_name not like 'BIN$%' and lower(schema_name || '.' || table_name) not like '%t1\\_%' escape '\\' and lower(schema_name || '.' || table_name) not like '%s2.t3%' and not (upper(table_name) = 'T7' or upper(schema_name || '.' || table_name) = 'S1.T9')")
def filter_tables(tables: DataFrame) -> DataFrame:
    return filters.filter_tables(tables, PATTERNS, IGNORED).select("schema_name", "table_name")


@query("filter_views", "objects_src", "select schema_name, object_name from objects_src where kind = 'view' and lower(schema_name || '.' || object_name) not like '%v_t2%' and not (upper(object_name) = 'S3.V_T10' or upper(schema_name || '.' || object_name) = 'S3.V_T10')".replace("'%v_t2%'", "'%v\\_t2%' escape '\\'"))
def filter_views(objects: DataFrame) -> DataFrame:
    return filters.filter_tables(objects.filter("kind = 'view'"), ["V_T2"], IGNORED, name="object_name", kind="view").select("schema_name", "object_name")


@query("filter_objects", "objects_src", "select schema_name, kind, object_name from objects_src where not (kind = 'sequence' and object_name = 'T4_SEQ') and not (kind = 'view' and schema_name = 'S3' and object_name = 'V_T10') and not (kind = 'trigger' and object_name = 'TR_T9')")
def filter_objects(objects: DataFrame) -> DataFrame:
    return filters.drop_ignored(objects, IGNORED, name="object_name", kind=F.col("kind")).select("schema_name", "kind", "object_name")


@query("logical_tables", "tables_tgt partitions_tgt", "select schema_name, table_name from tables_tgt t where not exists (select 1 from partitions_tgt p where p.schema_name = t.schema_name and p.partition_name = t.table_name)")
def logical_tables(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    return filters.logical_tables(tables, partitions).select("schema_name", "table_name")


@query(
    "filter_derived_objects", "objects_src tables_src",
    """select schema_name, kind, object_name from objects_src o
       where not (kind in ('sequence', 'procedure', 'function') and exists (select 1 from tables_src t where t.t >= 0 and t.t % 4 = 0 and t.schema_name = o.schema_name and t.table_name = o.table_name)
                  or kind in ('procedure', 'function') and exists (select 1 from tables_src t where t.t % 4 = 0 and t.t >= 0 and t.schema_name = o.schema_name and t.table_name = o.table_name))""",
)
def filter_derived_objects(objects: DataFrame, tables: DataFrame) -> DataFrame:
    """Every fourth table is left out here, and with it what is named after it."""
    return filters.drop_derived(objects, tables.filter("t >= 0 and t % 4 = 0")).select("schema_name", "kind", "object_name")


@query("common_tables", "tables_src tables_tgt", "select upper(s.schema_name) as schema_key, upper(s.table_name) as table_key, s.table_name as source_table, t.table_name as target_table from tables_src s join tables_tgt t on upper(s.schema_name) = upper(t.schema_name) and upper(s.table_name) = upper(t.table_name)")
def common_tables(source: DataFrame, target: DataFrame) -> DataFrame:
    return filters.common_tables(source, target)


@query("all_table_names", "tables_src tables_tgt", "select upper(schema_name) as schema_key, upper(table_name) as table_key from tables_src union select upper(schema_name), upper(table_name) from tables_tgt")
def all_table_names(source: DataFrame, target: DataFrame) -> DataFrame:
    return filters.all_names(source, target)


@query(
    "parse_mapping", "tables_src",
    """select distinct schema_name, upper(schema_name || '.' || table_name) as source, case when t % 2 = 0 then lower('db.' || table_name) else lower(schema_name || '.' || table_name) end as target from tables_src where t >= 0""",
)
def parse_mapping(tables: DataFrame) -> DataFrame:
    """Mapping texts of at most 100 of a schema's tables each, by their number, taken apart again."""
    full = F.concat_ws(".", "schema_name", "table_name")
    text = tables.filter("t >= 0").groupBy("schema_name", F.expr("t div 100").alias("part")).agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("t") % 2 == 0, F.concat(full, F.lit(" = DB."), F.col("table_name"))).otherwise(full))), ", ").alias("text"))
    return text.select("schema_name", F.explode(filters.parse_mapping(F.col("text"))).alias("x")).select("schema_name", "x.source", "x.target")
