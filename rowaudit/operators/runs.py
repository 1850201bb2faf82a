"""Do paired queries give the same rows in comparable time? Analysis of a log of their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a query probes, by the start of its name (fixed values).
PROBES = {"table_count_": "count", "table_sample_": "sample", "table_pk_lookup_": "lookup", "table_ordered_": "ordered"}


def probe_kind(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for start, kind in PROBES.items():
        out = out.when(name.startswith(start), kind)
    return out.otherwise("custom")


def medians(runs: DataFrame) -> DataFrame:
    """For each query and engine: the median time of its runs (of an even number, the mean of the two middle ones), the rows of the last run, whether all ran."""
    return runs.groupBy("schema_name", "query_name", "engine").agg(F.round(F.median(F.col("ms").cast("double")), 4).alias("median_ms"), F.max_by("n_rows", "run_id").alias("n_rows"), F.bool_and("executed").alias("executed"), F.count(F.lit(1)).alias("runs"))


def compare(runs: DataFrame, forgiven: DataFrame | None = None, *, threshold: float = 50.0) -> DataFrame:
    """Both engines side by side: ``diff_percent`` and ``status``.

    Failed unless both ran; RowCountMismatch if the rows differ, unless ``forgiven`` (schema_name, query_name) holds the
    query because everything extra was expected; then Warning from ``threshold`` percent slower, else Passed. A source
    time of 0 counts as no difference."""
    m = medians(runs)
    both = m.groupBy("schema_name", "query_name").agg(*(F.first(F.when(F.col("engine") == e, F.col(c)), ignorenulls=True).alias(f"{e}_{k}") for e in ("source", "target") for c, k in (("median_ms", "ms"), ("n_rows", "rows"), ("executed", "executed"))))
    both = both.withColumns({f"{e}_executed": F.coalesce(f"{e}_executed", F.lit(False)) for e in ("source", "target")})
    excused = F.lit(False)
    if forgiven is not None:
        both = both.join(forgiven.select("schema_name", "query_name", F.lit(True).alias("_ok")), ["schema_name", "query_name"], "left")
        excused = F.coalesce("_ok", F.lit(False)) & (F.col("target_rows") > F.col("source_rows"))
    off = F.when(F.col("source_ms") > 0, (F.col("target_ms") - F.col("source_ms")) / F.col("source_ms") * 100).otherwise(0.0)
    ran = F.col("source_executed") & F.col("target_executed")
    same = F.col("source_rows").eqNullSafe(F.col("target_rows"))
    status = F.when(~ran, "Failed").when(~same & excused, "Passed").when(~same, "RowCountMismatch").when(off < threshold, "Passed").otherwise("Warning")
    return both.select("schema_name", "query_name", probe_kind(F.col("query_name")).alias("probe"), "source_ms", "target_ms", "source_rows", "target_rows", F.when(ran & same, off).alias("diff_percent"), status.alias("status"))


def _statuses() -> list[Column]:
    return [F.count(F.lit(1)).alias("queries"), *(F.count_if(F.col("status") == s).alias(c) for s, c in (("Passed", "passed"), ("Warning", "warnings"), ("RowCountMismatch", "mismatches"), ("Failed", "failed")))]


def status_by_probe(compared: DataFrame) -> DataFrame:
    return compared.groupBy("probe").agg(*_statuses())


def rollup(compared: DataFrame) -> DataFrame:
    """A row for each schema and one for all: queries by status, mean times and mean difference."""
    mean = lambda c: (F.sum(F.round(c, 4).cast("decimal(28,4)")).cast("double") / F.count(c)).alias(f"mean_{c}")
    out = compared.rollup("schema_name").agg(*_statuses(), *(mean(c) for c in ("source_ms", "target_ms", "diff_percent")))
    return out.withColumn("schema_name", F.coalesce("schema_name", F.lit("TOTAL")))


def slowest(compared: DataFrame, n: int = 10) -> DataFrame:
    return compared.withColumn("worst_ms", F.greatest("source_ms", "target_ms")).select("schema_name", "query_name", "worst_ms").orderBy(F.desc("worst_ms"), "schema_name", "query_name").limit(n)


def extremes(compared: DataFrame, *, faster: bool, n: int = 10) -> DataFrame:
    """The greatest improvements or regressions in percent."""
    kept = compared.filter(F.col("diff_percent") < 0 if faster else F.col("diff_percent") > 0).select("schema_name", "query_name", "diff_percent")
    return kept.orderBy(F.col("diff_percent").asc() if faster else F.desc("diff_percent"), "schema_name", "query_name").limit(n)


def probe_gaps(compared: DataFrame, n: int = 10) -> DataFrame:
    """In each schema, the ``n`` greatest slow-downs and speed-ups of table probes in milliseconds."""
    gap = compared.filter("probe <> 'custom' and diff_percent is not null and diff_percent <> 0").withColumn("gap_ms", F.col("target_ms") - F.col("source_ms"))
    gap = gap.withColumn("direction", F.when(F.col("gap_ms") > 0, "slower").otherwise("faster"))
    w = W.partitionBy("schema_name", "direction").orderBy(F.desc(F.abs("gap_ms")), "query_name")
    return gap.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("schema_name", "direction", "rank", "query_name", "gap_ms")
