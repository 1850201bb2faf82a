"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..sources.tables import written
from .failures import stacked

#: Bits of a row's place within its range, as ``monotonically_increasing_id`` has them (fixed value).
_WITHIN = 33
#: Bits of that place which equal rows share: as many neighbours stay in one range together, and the others may lie in the next.
_TOGETHER = 12
#: The most stretches that two sides are paired in, the fewest rows of one, and the most, which comes first.
_STRETCHES, _LEAST, _MOST = 128, 100_000, 4_000_000


@dataclass(frozen=True)
class Range:
    """A range of a numbered table as it was written: its number, how many rows stand before it, how many it has, and its files."""

    number: int
    before: int
    size: int
    files: tuple[str, ...]


def numbered(df: DataFrame, order: list[Column | str], *, into: str = "row_id", keep: list[str] | None = None, partitions: int | None = None, staged: bool = False, ranges: list[Range] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with row numbers from 1 over ``order``; equal rows get numbers in any order. A column ``into`` is replaced.

    Rows are dealt by ranges of the order, sorted once there and written with their place: the number of their range and that
    within it. Then the order isn't needed any more. The sizes of the ranges (a row for each on the driver) give what stands
    before each. A number that a few thousand neighbouring rows share breaks ties, so equal rows spread over ranges like others.
    Sorting is never in one task. ``ranges`` takes what was written, for ``paired``.

    A row is shuffled once and written once; a name in ``order`` that is kept too isn't carried twice. Sampling for the ranges
    computes ``df`` a second time: ``staged`` writes it first, for one that costs more than its rows do."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    *names, tie, place, of_range, before = fresh([*df.columns, into], *(f"o{k}" for k in range(len(order))), "tie", "place", "of_range", "before")
    there = {c.lower(): c for c in kept}
    by, extra = [], []
    for o, x in zip(order, names, strict=True):
        if isinstance(o, str) and o.lower() in there:
            by.append(there[o.lower()])
        else:
            by.append(x)
            extra.append((F.col(f"`{o}`") if isinstance(o, str) else o).alias(x))
    base = df.select(*(F.col(f"`{c}`") for c in kept), *extra, F.shiftright(F.monotonically_increasing_id(), _TOGETHER).alias(tie))
    if staged:
        base = written(base, "rows")
    by = [F.asc_nulls_first(F.col(f"`{x}`")) for x in (*by, tie)]
    sorted_ = base.repartitionByRange(n, *by).sortWithinPartitions(*by).select(*(F.col(f"`{c}`") for c in kept), F.monotonically_increasing_id().alias(place))
    dealt = written(sorted_, "ranges", compression="zstd").withColumn(of_range, F.shiftright(place, _WITHIN))
    upto, starts = 0, []
    sizes = dealt.groupBy(of_range).agg(F.count(F.lit(1)), F.collect_set("_metadata.file_path"))
    for k, size, files in sorted(map(tuple, sizes.collect())):
        starts.append((k, upto))
        if ranges is not None:
            ranges.append(Range(k, upto, size, tuple(sorted(map(unquote, files)))))
        upto += size
    offsets = F.broadcast(spark.createDataFrame(starts, f"{of_range} long, {before} long"))
    within = F.col(place).bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return dealt.join(offsets, of_range).select(*(F.col(f"`{c}`") for c in kept), (F.col(before) + within + 1).alias(into))


def paired(source: tuple[DataFrame, list[Range]], target: tuple[DataFrame, list[Range]], column: str, names: tuple[str, str], *, partitions: int | None = None) -> DataFrame:
    """Rows of the same number on two sides, each side what ``numbered`` gave and its ``ranges``: ``row_id`` from 1 and the sides'
    ``column`` by the two names, null where a side has no such row.

    The files lie in the order of the numbers, so nothing is shuffled again: numbers are cut into stretches, and one task reads
    a stretch of both sides from the files that hold it, mostly one or two of each. There are as many stretches as shuffle partitions, but
    each is a part of the plan: so not more than 128, and none of a few rows, unless it had more rows than a task should sort."""
    spark = source[0].sparkSession
    whole = max((r.before + r.size for _, ranges in (source, target) for r in ranges), default=0)
    n = max(1, min(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), _STRETCHES, whole // _LEAST), whole // _MOST)
    step = max(1, -(-whole // n))
    kind = source[0].schema[column].dataType.simpleString()

    def side(ranges: list[Range], name: str, low: int, high: int) -> DataFrame:
        there = [r for r in ranges if r.before < high and r.before + r.size > low]
        if not there:
            return spark.createDataFrame([], f"row_id long, `{name}` {kind}")
        # bounds come from a map: as numbers in the code they would have it compiled for each stretch
        of = ", ".join(f"{r.number}L, named_struct('first', {r.before + 1}L, 'low', {low + 1}L, 'high', {high}L)" for r in there)
        rows = spark.read.schema(f"`{column}` {kind}, place long").parquet(*(f for r in there for f in r.files))
        rows = rows.selectExpr(f"element_at(map({of}), shiftright(place, {_WITHIN})) as of", f"place & {(1 << _WITHIN) - 1}L as m", f"`{column}` as `{name}`")
        return rows.filter("of.first + m between of.low and of.high").selectExpr("of.first + m as row_id", f"`{name}`").coalesce(1)

    stretches = ((low, low + step) for low in range(0, max(1, whole), step))
    return stacked([side(source[1], names[0], *x).join(side(target[1], names[1], *x), "row_id", "full_outer") for x in stretches])
