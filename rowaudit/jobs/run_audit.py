"""Do paired queries agree in rows and time? The log of runs derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import runs
from .registry import query

_M = "m as (select schema_name, query_name, engine, round(median(cast(ms as double)), 4) as median_ms, max_by(n_rows, run_id) as n_rows, bool_and(executed) as executed, count(*) as runs from runs group by 1, 2, 3)"
_C = f"""{_M}, b as (select schema_name, query_name, any_value(median_ms) filter (engine = 'source') as source_ms, any_value(median_ms) filter (engine = 'target') as target_ms, any_value(n_rows) filter (engine = 'source') as source_rows, any_value(n_rows) filter (engine = 'target') as target_rows,
            coalesce(any_value(executed) filter (engine = 'source'), false) and coalesce(any_value(executed) filter (engine = 'target'), false) as ran from m group by 1, 2),
    g as (select *, case when source_ms > 0 then (target_ms - source_ms) / source_ms * 100 else 0.0 end as off, query_name like 'list_index%' and target_rows > source_rows as excused from b),
    c as (select schema_name, query_name, case when query_name like 'table_count%' then 'count' when query_name like 'table_sample%' then 'sample' when query_name like 'table_pk_lookup%' then 'lookup' when query_name like 'table_ordered%' then 'ordered' else 'custom' end as probe,
            source_ms, target_ms, source_rows, target_rows, case when ran and source_rows is not distinct from target_rows then off end as diff_percent,
            case when not ran then 'Failed' when source_rows is distinct from target_rows then case when excused then 'Passed' else 'RowCountMismatch' end when off < 50 then 'Passed' else 'Warning' end as status from g)"""
_COUNTS = "count(*) as queries, count(*) filter (status = 'Passed') as passed, count(*) filter (status = 'Warning') as warnings, count(*) filter (status = 'RowCountMismatch') as mismatches, count(*) filter (status = 'Failed') as failed"


def _compared(log: DataFrame) -> DataFrame:
    """Index listings count as excused here: everything extra in them is expected."""
    return runs.compare(log, log.filter("query_name like 'list_index%'").select("schema_name", "query_name").distinct())


@query("run_medians", "runs", f"with {_M} select * from m")
def run_medians(log: DataFrame) -> DataFrame:
    return runs.medians(log)


@query("run_compare", "runs", f"with {_C} select * from c")
def run_compare(log: DataFrame) -> DataFrame:
    return _compared(log)


@query("run_status_by_kind", "runs", f"with {_C} select probe, {_COUNTS} from c group by 1")
def run_status_by_kind(log: DataFrame) -> DataFrame:
    return runs.status_by_probe(_compared(log))


_MEAN = ", ".join(f"cast(sum(cast(round({c}, 4) as decimal(28,4))) as double) / count({c}) as mean_{c}" for c in ("source_ms", "target_ms", "diff_percent"))


@query("run_schema_rollup", "runs", f"with {_C} select coalesce(schema_name, 'TOTAL') as schema_name, {_COUNTS}, {_MEAN} from c group by rollup(schema_name)")
def run_schema_rollup(log: DataFrame) -> DataFrame:
    return runs.rollup(_compared(log))


@query("slowest_queries", "runs", f"with {_C} select schema_name, query_name, greatest(source_ms, target_ms) as worst_ms from c order by worst_ms desc nulls last, schema_name, query_name limit 10")
def slowest_queries(log: DataFrame) -> DataFrame:
    return runs.slowest(_compared(log))


@query("top_improvements", "runs", f"with {_C} select schema_name, query_name, diff_percent from c where diff_percent < 0 order by diff_percent, schema_name, query_name limit 10")
def top_improvements(log: DataFrame) -> DataFrame:
    return runs.extremes(_compared(log), faster=True)


@query("top_regressions", "runs", f"with {_C} select schema_name, query_name, diff_percent from c where diff_percent > 0 order by diff_percent desc, schema_name, query_name limit 10")
def top_regressions(log: DataFrame) -> DataFrame:
    return runs.extremes(_compared(log), faster=False)


@query(
    "probe_gap_topk", "runs",
    f"""with {_C}, d as (select *, target_ms - source_ms as gap_ms, case when target_ms > source_ms then 'slower' else 'faster' end as direction from c where probe <> 'custom' and diff_percent is not null and diff_percent <> 0),
        r as (select schema_name, direction, cast(row_number() over (partition by schema_name, direction order by abs(gap_ms) desc, query_name) as int) as rank, query_name, gap_ms from d) select * from r where rank <= 10""",
)
def probe_gap_topk(log: DataFrame) -> DataFrame:
    return runs.probe_gaps(_compared(log))
