"""Is every column's type mapped safely? Rules over the derived catalogs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fingerprint, summary, types
from ..sources import tables
from .registry import query

_PAIR = """
    p as (select s.schema_name, s.table_name, s.column_name, s.data_type as sd, s.data_precision as sp, s.data_scale as ss, s.char_length as sl, s.default_value as sv,
                 t.data_type as td, t.data_precision as tp, t.data_scale as ts, t.char_length as tl, t.default_value as tv
          from cat_src s join cat_tgt t on upper(s.schema_name) = upper(t.schema_name) and upper(s.table_name) = upper(t.table_name) and upper(s.column_name) = upper(t.column_name)),
    e as (select *, case sd when 'NUMBER' then case when ss = 0 and sp between 1 and 4 then 'smallint' when ss = 0 and sp between 5 and 9 then 'integer' when ss = 0 then 'bigint' when ss > 0 then 'numeric' end
                      when 'VARCHAR2' then 'character varying' when 'DATE' then 'timestamp' when 'CLOB' then 'text' when 'CHAR' then 'character' when 'TIMESTAMP WITH TIME ZONE' then 'timestamp with time zone'
                      when 'RAW' then 'bytea' when 'BINARY_DOUBLE' then 'double precision' when 'XMLTYPE' then 'xml' when 'BFILE' then 'text' end as expected_type,
                 case when sd = 'NUMBER' and ss > 0 then sp end as expected_precision, case when sd = 'NUMBER' and ss > 0 then ss end as expected_scale, case when sd in ('VARCHAR2', 'CHAR') then sl end as expected_length,
                 case td when 'varchar' then 'character varying' when 'bpchar' then 'character' when 'int4' then 'integer' when 'timestamptz' then 'timestamp with time zone' else td end as tn from p),
    c as (select *, case when not (expected_type = tn or (expected_type in ('bigint', 'integer', 'smallint') and tn = 'numeric') or (expected_type = 'timestamp' and tn like 'timestamp%')) then 'type: expected ' || expected_type || ', got ' || td
                         when expected_precision is not null and expected_precision is distinct from tp then 'precision' when expected_scale is not null and expected_scale is distinct from ts then 'scale'
                         when expected_type like 'character%' and expected_length is not null and expected_length is distinct from tl and coalesce(tl, 0) < sl then 'length: truncation risk' end as reason from e),
    q as (select *, reason is null as ok, sd || case when sp is not null and ss is not null then '(' || sp || ',' || ss || ')' when sp is not null then '(' || sp || ')' when sl is not null then '(' || sl || ')' else '' end as source_type,
                 td || case when td = 'numeric' and tp is not null and ts is not null then '(' || tp || ',' || ts || ')' when td in ('character varying', 'character', 'varchar', 'char') and tl is not null then '(' || tl || ')' else '' end as target_type from c)"""
#: The rules for the types that the fixture has: category, severity, condition.
_RULES = [
    ("Type Mapping Mismatch", "Error", "not ok"), ("Valid Mapping", "Info", "ok"),
    ("Numeric Overflow Risk", "Critical", "sd = 'NUMBER' and ss = 0 and sp > 9 and td = 'integer'"),
    ("Storage Optimization", "Info", "sd = 'NUMBER' and ss = 0 and sp <= 9 and td = 'bigint'"),
    ("Invalid Mapping", "Error", "sd = 'NUMBER' and ss = 0 and td not in ('integer', 'bigint', 'numeric', 'smallint')"),
    ("Precision/Scale Mismatch", "Error", "sd = 'NUMBER' and ss > 0 and td not like 'numeric%'"),
    ("Precision/Scale Mismatch", "Critical", "sd = 'NUMBER' and ss > 0 and td like 'numeric%' and (tp is distinct from sp or ts is distinct from ss)"),
    ("Float Type Mismatch", "Error", "sd = 'BINARY_DOUBLE' and td <> 'double precision'"), ("Valid Float Mapping", "Info", "sd = 'BINARY_DOUBLE' and td = 'double precision'"),
    ("Double Precision Float", "Error", "sd = 'BINARY_DOUBLE' and td <> 'double precision'"), ("Valid Binary Double Mapping", "Info", "sd = 'BINARY_DOUBLE' and td = 'double precision'"),
    ("Auto-Increment Missing", "Error", "sv like '%IDENTITY%' and coalesce(tv, '') not like '%nextval%'"), ("Auto-Increment OK", "Info", "sv like '%IDENTITY%' and tv like '%nextval%'"),
    ("Padding Behavior", "Warning", "sd = 'CHAR' and tn = 'character varying'"),
    ("Large Text Type Mismatch", "Error", "sd = 'CLOB' and td <> 'text'"), ("Text Truncation Risk", "Critical", "sd = 'CLOB' and tl < 4000"),
    ("Time Data Loss", "Warning", "sd = 'DATE' and td = 'date'"), ("Date Mapping OK", "Info", "sd = 'DATE' and td = 'timestamp'"),
    ("Timezone Type Mismatch", "Error", "sd = 'TIMESTAMP WITH TIME ZONE' and td <> 'timestamptz'"), ("UTC Conversion", "Warning", "sd = 'TIMESTAMP WITH TIME ZONE' and td = 'timestamptz'"),
    ("Binary Type Mismatch", "Error", "sd = 'RAW' and td <> 'bytea'"), ("Valid Binary Mapping", "Info", "sd = 'RAW' and td = 'bytea'"),
    ("Fixed Binary Type", "Error", "sd = 'RAW' and td <> 'bytea'"), ("Valid Binary Mapping", "Info", "sd = 'RAW' and td = 'bytea'"),
    ("XML Type Mismatch", "Error", "sd = 'XMLTYPE' and td not in ('xml', 'text')"), ("XML Features Lost", "Warning", "sd = 'XMLTYPE' and td = 'text'"),
    ("External File Pointer", "Critical", "sd = 'BFILE'"),
]
_ISSUES = _PAIR + ", i as (" + " union all ".join(
    f"""select schema_name, table_name, column_name, source_type, target_type, '{c}' as category, '{s}' as severity, {"reason" if c == "Type Mapping Mismatch" else "cast(null as varchar)"} as reason,
        {"case when sd like '%CHAR%' and tl > sl and sl > 0 then cast(tl - sl as double) / sl * 100 end" if c == "Valid Mapping" else "cast(null as double)"} as length_growth from q where {w}"""
    for c, s, w in _RULES
) + ")"
_CATS = "cat_src cat_tgt"


@query("column_pairs", _CATS, f"with {_PAIR} select schema_name, table_name, column_name, sd as source_data_type, td as target_data_type from p")
def column_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each column stands twice in the source here; the first one counts."""
    twice = source.unionByName(source.withColumns({"data_type": F.lit("ZZZ"), "column_id": F.col("column_id") + 100}))
    return types.pair_columns(twice, target).select(F.col("s_schema_name").alias("schema_name"), F.col("s_table_name").alias("table_name"), F.col("s_column_name").alias("column_name"), F.col("s_data_type").alias("source_data_type"), F.col("t_data_type").alias("target_data_type"))


@query("expected_types", _CATS, f"with {_PAIR} select schema_name, table_name, column_name, expected_type, expected_precision, expected_scale, expected_length from c")
def expected_types(source: DataFrame, target: DataFrame) -> DataFrame:
    return types.with_expected(types.pair_columns(source, target)).select(F.col("s_schema_name").alias("schema_name"), F.col("s_table_name").alias("table_name"), F.col("s_column_name").alias("column_name"), "expected_type", "expected_precision", "expected_scale", "expected_length")


@query("type_compat", _CATS, f"with {_PAIR} select schema_name, table_name, column_name, ok as compatible, reason from q")
def type_compat(source: DataFrame, target: DataFrame) -> DataFrame:
    return types.with_compat(types.pair_columns(source, target)).select(F.col("s_schema_name").alias("schema_name"), F.col("s_table_name").alias("table_name"), F.col("s_column_name").alias("column_name"), "compatible", "reason")


@query("type_issues", _CATS, f"with {_ISSUES} select * from i")
def type_issues(source: DataFrame, target: DataFrame) -> DataFrame:
    return types.type_issues(source, target)


@query("issue_listing", _CATS, f"with {_ISSUES} select * from i")
def issue_listing(source: DataFrame, target: DataFrame) -> DataFrame:
    return summary.listing(types.type_issues(source, target))


@query("written_issues", _CATS, f"with {_ISSUES} select * from i")
def written_issues(source: DataFrame, target: DataFrame) -> DataFrame:
    """Issues written by schema, and read again."""
    issues = types.type_issues(source, target)
    path = f"{tables.shared_dir(source.sparkSession)}/issues-{uuid.uuid4().hex}"
    tables.write_results(issues, path)
    return source.sparkSession.read.schema(issues.schema).parquet(path)


@query("format_types", _CATS, f"with {_PAIR} select schema_name, table_name, column_name, source_type, target_type, tn as normal_target from q")
def format_types(source: DataFrame, target: DataFrame) -> DataFrame:
    p = types.pair_columns(source, target)
    shown = lambda f, side: f(*(F.col(f"{side}_{c}") for c in ("data_type", "data_precision", "data_scale", "char_length")))
    return p.select(F.col("s_schema_name").alias("schema_name"), F.col("s_table_name").alias("table_name"), F.col("s_column_name").alias("column_name"), shown(types.format_source, "s").alias("source_type"), shown(types.format_target, "t").alias("target_type"), types.normal_type(F.col("t_data_type")).alias("normal_target"))


@query(
    "type_schema_rollup", _CATS,
    f"""with {_ISSUES}, g as (select coalesce(schema_name, 'TOTAL') as schema_name, count(distinct schema_name || '.' || table_name || '.' || column_name) as columns, count(*) as issues,
            count(*) filter (severity = 'Critical') as critical, count(*) filter (severity = 'Error') as error, count(*) filter (severity = 'Warning') as warning, count(*) filter (severity = 'Info') as info from i group by rollup(schema_name))
        select *, case when critical > 0 then 'CRITICAL' when error > 0 then 'FAILED' when warning > 0 then 'WARNING' else 'PASSED' end as status from g""",
)
def type_schema_rollup(source: DataFrame, target: DataFrame) -> DataFrame:
    return types.type_rollup(types.type_issues(source, target))


@query("issues_by_category", _CATS, f"with {_ISSUES} select category, count(*) as total, count(*) filter (severity = 'Critical') as critical, count(*) filter (severity = 'Error') as error, count(*) filter (severity = 'Warning') as warning, count(*) filter (severity = 'Info') as info from i group by 1")
def issues_by_category(source: DataFrame, target: DataFrame) -> DataFrame:
    return summary.issue_counts(types.type_issues(source, target), "category")


@query(
    "top_type_issues", _CATS,
    f"""with {_ISSUES} select category, severity, source_type, target_type, count(distinct schema_name) as schemas, count(*) as columns, string_agg(distinct schema_name, ',' order by schema_name) as schema_names from i where severity <> 'Info' group by 1, 2, 3, 4
        order by schemas desc, case severity when 'Critical' then 0 when 'Error' then 1 when 'Warning' then 2 else 3 end, columns desc, category, source_type, target_type limit 10""",
)
def top_type_issues(source: DataFrame, target: DataFrame) -> DataFrame:
    return types.top_issues(types.type_issues(source, target))


@query("lob_columns", "cat_src", "select schema_name, table_name, column_name, data_type from cat_src where data_type in ('CLOB', 'RAW', 'XMLTYPE', 'BFILE')")
def lob_columns(catalog: DataFrame) -> DataFrame:
    return catalog.filter(fingerprint.is_lob(F.col("column_name"), F.col("data_type"))).select("schema_name", "table_name", "column_name", "data_type")


_KEYED_CATALOG = """
    o as (select schema_name, table_name, column_name, data_type, column_name = 'C0' as is_key, data_type in ('NUMBER', 'DATE', 'TIMESTAMP WITH TIME ZONE', 'BINARY_DOUBLE') as is_number from cat_src
          where data_type not in ('CLOB', 'RAW', 'XMLTYPE', 'BFILE')),
    n as (select *, count(*) over (partition by schema_name, table_name) as orderable from o)"""


@query(
    "order_key_choice", "cat_src",
    f"""with {_KEYED_CATALOG}, r as (select *, row_number() over (partition by schema_name, table_name order by case when orderable <= 3 then 0 when is_key then 0 when is_number then 1 else 2 end, lower(column_name)) as place from n)
        select schema_name, table_name, column_name, cast(place as int) as place from r where place <= 3""",
)
def order_key_choice(catalog: DataFrame) -> DataFrame:
    return summary.order_keys(catalog.withColumn("is_key", F.col("column_name") == "C0"), cap=3)


@query(
    "order_key_rank", "cat_src",
    f"""with {_KEYED_CATALOG}, s as (select *, length(data_type) * 7 % 5 as n_distinct, length(column_name) % 2 as n_null, data_type in ('DATE', 'TIMESTAMP WITH TIME ZONE') as is_time from n),
        a as (select *, case when is_number then row_number() over (partition by schema_name, table_name, is_number order by case when is_time then 0 else 1 end, case when is_key then 0 else 1 end, n_distinct desc, lower(column_name)) end as first_place from s),
        b as (select *, case when first_place <= 3 then 0 else 1 end as later from a),
        r as (select *, row_number() over (partition by schema_name, table_name order by later, case when later = 0 then first_place end, n_distinct desc, n_null, lower(column_name)) as place from b)
        select schema_name, table_name, column_name, cast(place as int) as place from r where place <= 4""",
)
def order_key_rank(catalog: DataFrame) -> DataFrame:
    stats = catalog.withColumns({"is_key": F.col("column_name") == "C0", "n_distinct": F.length("data_type") * 7 % 5, "n_null": F.length("column_name") % 2})
    return summary.order_keys_by_stats(stats, target=4)
