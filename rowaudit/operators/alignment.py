"""Alignment of ordered tables without a key: a lost row doesn't make all later ones a mismatch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.canonical import comparable, row_text
from ..sources.tables import tidy, written
from .numbering import numbered

#: Anchors that are chained at once; blocks that are joined to one at each level; rows that are numbered together, and
#: stretches of rows that the driver sums up, at most.
BLOCK, FAN, STRETCH, STRETCHES = 1 << 16, 16, 1 << 17, 100_000
_ROW = ("pos", "gap", "h1", "h2")


def heaviest_chain(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The places of an increasing subsequence of distinct ``value`` with the greatest sum of ``weight``."""
    if not len(value) or (np.diff(value) > 0).all():
        return np.arange(len(value))
    rank = np.empty(len(value), np.int64)
    rank[np.argsort(value)] = np.arange(1, len(value) + 1)
    n = len(value)
    best, who = [0] * (n + 1), [-1] * (n + 1)  # greatest weight of chains that end at or below a rank, in a tree of prefixes
    before = [-1] * n
    for k, (r, w) in enumerate(zip(rank.tolist(), weight.tolist(), strict=True)):
        total, last, i = 0, -1, r - 1
        while i > 0:
            if best[i] > total:
                total, last = best[i], who[i]
            i -= i & -i
        before[k], total, i = last, total + w, r
        while i <= n:
            if total > best[i]:
                best[i], who[i] = total, k
            i += i & -i
    end, top, i = -1, 0, n
    while i > 0:
        if best[i] > top:
            top, end = best[i], who[i]
        i -= i & -i
    out = []
    while end >= 0:
        out.append(end)
        end = before[end]
    return np.array(out[::-1], np.int64)


_SEGMENT = "block long, a long, b long, n long"


def _segments(part: pa.Table) -> pa.Table:
    """Of a block of anchors, numbered by both sides' order: stretches that run on in both, thinned to a chain."""
    a = part.column("a").to_numpy()
    by = np.argsort(a)
    a, b = a[by], part.column("b").to_numpy()[by]
    cut = np.flatnonzero((np.diff(a) != 1) | (np.diff(b) != 1)) + 1
    first = np.concatenate([[0], cut]).astype(np.int64)
    size = np.diff(np.append(first, len(a)))
    kept = heaviest_chain(b[first], size)
    return pa.table({"block": np.full(len(kept), part.column("block")[0].as_py()), "a": a[first[kept]], "b": b[first[kept]], "n": size[kept]})


def _thinned(part: pa.Table) -> pa.Table:
    part = part.select(["block", "a", "b", "n"]).sort_by("a")
    return part.take(pa.array(heaviest_chain(part.column("b").to_numpy(), part.column("n").to_numpy())))


def _inside(anchors: pa.Table, segments: pa.Table) -> pa.Table:
    a, kept = anchors.column("a").to_numpy(), np.zeros(len(anchors), bool)
    if len(segments):
        segments = segments.sort_by("a")
        start = segments.column("a").to_numpy()
        at = np.searchsorted(start, a, "right") - 1
        kept = (at >= 0) & (a < start[at] + segments.column("n").to_numpy()[at])
    return anchors.filter(pa.array(kept)).select(["s", "t"])


def _chain(anchors: DataFrame) -> DataFrame:
    """Anchors ``(s, t)`` that stand in the same order on both sides, as many as can be found.

    They are numbered by both orders and cut into blocks; each block becomes stretches that run on in both orders, a few
    rows where nothing moved, and keeps the heaviest chain of them. Then blocks are joined, some at a time, and their
    stretches thinned to a chain again, until one is left. With one block of anchors the chain is the longest there is; with
    more, it is a chain of the blocks' chains, which may be a little shorter: then more rows count as moved, none wrongly as equal."""
    both = written(numbered(numbered(anchors, ["s"], into="a", staged=True), ["t"], into="b").withColumn("block", F.floor(F.col("a") / BLOCK)), "anchors")
    blocks = (both.agg(F.max("block")).first()[0] or 0) + 1
    segments = written(both.groupBy("block").applyInArrow(_segments, _SEGMENT), "segments")
    width = 1
    while width < blocks:
        width *= FAN
        segments = written(segments.groupBy(F.floor(F.col("block") / width).alias("wide")).applyInArrow(_thinned, _SEGMENT), "segments")
    return written(both.groupBy("block").cogroup(segments.groupBy("block")).applyInArrow(_inside, "s long, t long"), "chain")


def _stretch(n: int) -> Column:
    """The number of a row's stretch of the table: these are as long as it takes for them to be few."""
    return F.floor(F.col("pos") / max(STRETCH, -(-n // STRETCHES)))


def _with_gap(rows: DataFrame, chain: DataFrame, side: str, n: int) -> DataFrame:
    """Rows that aren't in the chain with ``gap``, how many rows of the chain stand before them.

    Stretches are summed up alone and a row for each gives what stands before it; no window spans the table."""
    marked = rows.join(chain.select(F.col(side).alias("pos"), F.lit(1).alias("one")), "pos", "left").withColumn("stretch", _stretch(n))
    marked = written(marked.withColumn("one", F.coalesce("one", F.lit(0))), "marked")
    sums = marked.groupBy("stretch").agg(F.sum("one").alias("here"))
    before = sums.select("stretch", (F.sum("here").over(W.orderBy("stretch")) - F.col("here")).alias("before"))  # a row for each stretch
    within = F.sum("one").over(W.partitionBy("stretch").orderBy("pos"))
    return marked.withColumn("within", within).filter("one = 0").join(F.broadcast(before), "stretch").select("pos", (F.col("before") + F.col("within")).alias("gap"), "h1", "h2")


def _numbered_within(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """``rows`` with ``nth``, their number among rows of the same ``by``, in order. A group is numbered by stretches, so one that
    holds a third of all rows is many small windows."""
    rows = rows.withColumn("stretch", _stretch(n))
    sums = rows.groupBy(*by, "stretch").agg(F.count(F.lit(1)).alias("here"))
    before = sums.withColumn("before", F.sum("here").over(W.partitionBy(*by).orderBy("stretch")) - F.col("here")).drop("here")
    own = rows.withColumn("within", F.row_number().over(W.partitionBy(*by, "stretch").orderBy("pos")))
    return own.join(before, [*by, "stretch"]).withColumn("nth", F.col("before") + F.col("within"))


def _paired(s: DataFrame, t: DataFrame, by: list[str], n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``(source_row, target_row)`` of rows that are the n-th of their group on both sides, and the rest of either side."""
    a, b = (_numbered_within(x, by, n).select(*by, "nth", F.struct(*_ROW).alias(name)) for x, name in ((s, "s"), (t, "t")))
    both = written(a.join(b, [*by, "nth"], "full_outer").select("s", "t"), "paired")
    return both.filter("s is not null and t is not null").select(F.col("s.pos").alias("source_row"), F.col("t.pos").alias("target_row")), both.filter("t is null").select("s.*"), both.filter("s is null").select("t.*")


@tidy
def aligned_diff(source: DataFrame, target: DataFrame, order: list[str], *, columns: list[str] | None = None, **options) -> DataFrame:
    """Rows of two ordered tables aligned: ``source_row`` and ``target_row``, their numbers in the order of ``order``, then of their
    hash, and ``category``: ``matching``, ``moved`` (equal, but elsewhere), ``mismatched``, ``missing``, ``extra``.

    1. Rows that occur once on either side are anchors. Those that stand in the same order on both sides, as many as
       possible, match, and cut both tables into gaps.
    2. Equal rows of the same gap match, copies one by one.
    3. Equal rows that are left have moved.
    4. Of what is left in a gap, the first row of one side is a mismatch of the first of the other, and so on; the
       surplus is missing or extra.

    ``columns`` are those that are compared (all, if not given); the order's may be left out. Every row of both sides is in
    just one row of the result. Nothing is collected but a number for each range; a row that fills a third of the table is
    numbered in pieces. Empty sides are fine; null order values come first; names don't matter."""
    source, target = comparable(source, target)

    def side(df: DataFrame) -> DataFrame:
        text = row_text(df, columns, **{"safe": True, **options})
        hashed = df.select(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"))
        return numbered(hashed, [*(f"o{i}" for i in range(len(order))), "h1", "h2"], into="pos", keep=["h1", "h2"])

    s, t = side(source), side(target)
    n = max(s.count(), t.count())
    seen = s.select("h1", "h2", F.col("pos").alias("s"), F.lit(None).cast("long").alias("t")).union(t.select("h1", "h2", F.lit(None).cast("long"), "pos"))
    once = seen.groupBy("h1", "h2").agg(F.count("s").alias("ns"), F.count("t").alias("nt"), F.max("s").alias("s"), F.max("t").alias("t")).filter("ns = 1 and nt = 1")
    chain = _chain(once.select("s", "t"))
    left = [_with_gap(x, chain, name, n) for x, name in ((s, "s"), (t, "t"))]
    here, *left = _paired(*left, ["gap", "h1", "h2"], n)
    moved, *left = _paired(*left, ["h1", "h2"], n)
    changed, gone, new = _paired(*left, ["gap"], n)
    none = F.lit(None).cast("long")
    parts = [(chain.select("s", "t"), "matching"), (here, "matching"), (moved, "moved"), (changed, "mismatched"), (gone.select("pos", none), "missing"), (new.select(none, "pos"), "extra")]
    out = [p.toDF("source_row", "target_row").withColumn("category", F.lit(c)) for p, c in parts]
    whole = out[0]
    for p in out[1:]:
        whole = whole.union(p)
    return whole
