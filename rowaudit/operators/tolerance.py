"""Tables without a key whose numbers may differ a little: rows are paired one to one within a tolerance."""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import comparable, row_text
from ..sources.tables import tidy, written
from .fingerprint import hash_of

#: Bits of a row's place within its range, as ``monotonically_increasing_id`` has them (fixed value).
_WITHIN = 33
_NOTHING = hashlib.sha256(b"").hexdigest()
_TOLD = "of_range long, kind string, row_hash string, value double, n long, digest string"


def near(a: float, b: float, absolute: float, relative: float) -> bool:
    return abs(a - b) <= max(absolute, relative * max(abs(a), abs(b)))


def sweep(rows: Iterable[tuple[str, float, int]], waiting: deque, absolute: float, relative: float) -> Iterator[tuple[str, float, int]]:
    """Pairs along ``(group, value, n)`` in order, ``n`` copies of the source or, below 0, of the target: yields ``(group, value, copies
    paired)`` for both members. ``waiting`` holds the unpaired ``[group, value, n]`` before, all of one side, and then those after.

    The smallest of one side is paired with the smallest of the other if they are near. That gives as many pairs as there can
    be: whenever two values are near, so are any two between them."""
    for group, value, n in rows:
        while waiting and (waiting[0][0] != group or not near(waiting[0][1], value, absolute, relative)):
            waiting.popleft()
        while n and waiting and (waiting[0][2] > 0) != (n > 0):
            first = waiting[0]
            k = min(abs(n), abs(first[2]))
            yield group, value, k
            yield group, first[1], k
            n -= k if n > 0 else -k
            first[2] -= k if first[2] > 0 else -k
            if not first[2]:
                waiting.popleft()
        if n:
            waiting.append([group, value, n])


def _swept(left: DataFrame, before: DataFrame, absolute: float, relative: float) -> DataFrame:
    """The ranges of ``left``, each swept with what waits before it: pairs, what waits after it, and a digest of that."""

    def run(key: tuple, rows: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["of_range", "kind", "row_hash", "value", "n", "digest"])
        listed = lambda x: x.sort_values(["row_hash", "value"])[["row_hash", "value", "n"]].itertuples(index=False, name=None)
        waiting = deque([g, float(v), int(n)] for g, v, n in listed(earlier))
        paired = [("pair", *x) for x in sweep(((g, float(v), int(n)) for g, v, n in listed(rows)), waiting, absolute, relative)]
        after = [("waits", *x) for x in waiting]
        said = hashlib.sha256("\n".join(f"{g} {v!r} {n}" for _, g, v, n in after).encode()).hexdigest()
        out = pd.DataFrame([*((key[0], *x, None) for x in paired + after), (key[0], "digest", None, math.nan, 0, said)], columns=["of_range", "kind", "row_hash", "value", "n", "digest"])
        return out.astype({"n": "int64"})

    return left.groupBy("of_range").cogroup(before.groupBy("of_range")).applyInPandas(run, _TOLD)


def _paired(left: DataFrame, absolute: float, relative: float, partitions: int) -> DataFrame:
    """``row_hash``, ``value``, ``paired`` copies of the rows ``(row_hash, value, n)``.

    They are dealt by ranges of both, so a large group spreads. A range is swept as if nothing waited before it; where
    something does, the next range is swept again with it, until no range hears anything new. What waits changes what comes
    after it only as far as the sweep doesn't fall back in step; at worst there are as many rounds as ranges. The driver
    holds a digest a range."""
    spark = left.sparkSession
    dealt = left.repartitionByRange(partitions, "row_hash", "value").sortWithinPartitions("row_hash", "value").withColumn("of_range", F.shiftright(F.monotonically_increasing_id(), _WITHIN))
    dealt = written(dealt, "ranges")
    ranges = sorted(r[0] for r in dealt.select("of_range").distinct().collect())
    following = dict(zip(ranges, ranges[1:], strict=False))
    before = spark.createDataFrame([], "of_range long, row_hash string, value double, n long")
    heard, latest, rounds, now = dict.fromkeys(ranges, _NOTHING), {}, [], ranges
    while now:
        swept = written(_swept(dealt.filter(F.col("of_range").isin(now)), before, absolute, relative), "swept")
        latest |= dict.fromkeys(now, len(rounds))
        rounds.append(swept)
        news = {r[0]: r[1] for r in swept.filter("kind = 'digest'").select("of_range", "digest").collect()}
        now = sorted(following[r] for r, said in news.items() if r in following and heard[r] != said)
        heard |= news
        if now:
            to = F.broadcast(spark.createDataFrame([(r, f) for r, f in following.items() if f in set(now)], "of_range long, next long"))
            before = swept.filter("kind = 'waits'").join(to, "of_range").select(F.col("next").alias("of_range"), "row_hash", "value", "n")
    pairs = None
    for k, swept in enumerate(rounds):
        final = swept.filter((F.col("kind") == "pair") & F.col("of_range").isin([r for r in ranges if latest[r] == k])).select("row_hash", "value", "n")
        pairs = final if pairs is None else pairs.union(final)
    if pairs is None:
        pairs = left.select("row_hash", "value", "n").filter("false")
    return pairs.groupBy("row_hash", "value").agg(F.sum("n").alias("paired"))


@tidy
def tolerant_diff(source: DataFrame, target: DataFrame, column: str, *, absolute: float = 0.0, relative: float = 0.0, partitions: int | None = None, **options) -> DataFrame:
    """The multiset difference of tables whose numbers in ``column`` may differ by ``absolute``, or by ``relative`` (below 1) times the larger size.

    One row for each ``row_hash`` (of all other columns) and ``value`` (of ``column``): copies ``n_source`` and ``n_target``, those that are
    ``exact`` on both sides, those of the rest that are ``within`` the tolerance of one on the other side, and ``missing`` or
    ``extra``. Equal rows are paired first; of the rest, rows equal in all other columns are paired one to one, as many as can be.

    Numbers are compared as doubles, in any numeric types. Nulls match nulls, NaN matches NaN and an infinity itself, exactly and
    nothing else. ``column`` is named in any case; it may be the only one. Empty tables are fine.

    Copies are folded before the shuffle, and only what isn't equal on both sides is sorted and swept (see ``_paired``)."""
    if not 0 <= relative < 1 or not 0 <= absolute < math.inf:
        raise ValueError("a relative tolerance lies from 0 to below 1, an absolute one from 0 on")
    source, target = comparable(source, target)

    def side(df: DataFrame, s: int) -> DataFrame:
        (own,) = (c for c in df.columns if c.lower() == column.lower())
        others = [c for c in df.columns if c != own]
        text = row_text(df, others, **options) if others else F.lit("")
        return df.select(hash_of(text).alias("row_hash"), F.col(f"`{own}`").cast("double").alias("value"), F.lit(s).alias("s"), F.lit(1 - s).alias("t"))

    folded = side(source, 1).union(side(target, 0)).groupBy("row_hash", "value").agg(F.sum("s").alias("n_source"), F.sum("t").alias("n_target"))
    folded = written(folded, "folded")
    off = F.col("n_source") - F.col("n_target")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < math.inf)
    left = folded.filter((off != 0) & finite).select("row_hash", "value", off.alias("n"))
    pairs = _paired(left, absolute, relative, partitions or int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    paired = F.coalesce("paired", F.lit(0))
    return folded.join(pairs, ["row_hash", "value"], "left").select(
        "row_hash", "value", "n_source", "n_target", F.least("n_source", "n_target").alias("exact"), paired.alias("within"),
        F.greatest(off - paired, F.lit(0)).alias("missing"), F.greatest(-off - paired, F.lit(0)).alias("extra"),
    )


def tolerant_parity(source: DataFrame, target: DataFrame, column: str, **options) -> DataFrame:
    """Whether two tables or queries give the same rows within a tolerance: totals of ``tolerant_diff`` and the verdict."""
    total = lambda c, to: F.coalesce(F.sum(c), F.lit(0)).alias(to)
    d = tolerant_diff(source, target, column, **options)
    # a pair has one member on either side
    return d.agg(total("n_source", "source_rows"), total("n_target", "target_rows"), total("exact", "exact"), total(F.when(F.col("n_source") > F.col("n_target"), F.col("within")), "within"), total("missing", "missing"), total("extra", "extra")).withColumn("same", (F.col("missing") == 0) & (F.col("extra") == 0))
