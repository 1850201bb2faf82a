"""Positional differences under an order that gets more columns: what is in order already isn't sorted again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.canonical import comparable
from ..sources.tables import tidy, written
from .diff import category, surely_differ
from .fingerprint import fingerprint, packed, unpacked

#: Bits of a row's place within its range, as ``monotonically_increasing_id`` has them (fixed value).
_WITHIN = 33


def ordered(df: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """``df``, which has ``row_hash`` and ``before``, sorted by ``keys``, then the hash, with numbers: ``row_id`` is ``before`` and the
    number in this order, from 1. Rows equal in ``keys`` are a run: ``run`` is its place, ``tied`` says whether it has several
    rows, and ``before`` grows by the rows of the order before it that aren't tied. So the tied rows, sorted among themselves
    by ``run`` and more columns, get their final numbers from here again, and nothing else moves.

    As in ``numbering.numbered``, rows are dealt by ranges, ties by a number of each row, and written with their place. A window
    over each range finds where keys change; the driver joins the ranges up from one row of each."""
    spark = df.sparkSession
    by = [F.asc_nulls_first(k) for k in (*keys, "row_hash", "tie")]
    sorted_ = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions, *by).sortWithinPartitions(*by).drop("tie").withColumn("place", F.monotonically_increasing_id())
    dealt = written(sorted_, "ranges", compression="zstd")
    key, within = F.struct(*keys), W.partitionBy("of_range").orderBy("place")
    so_far = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    flagged = dealt.withColumns({"of_range": F.shiftright("place", _WITHIN), "m": F.col("place").bitwiseAND(F.lit((1 << _WITHIN) - 1))})
    flagged = flagged.withColumn("new", ~key.eqNullSafe(F.lag(key).over(within)))
    flagged = flagged.withColumn("single", F.col("new") & F.coalesce(F.lead("new").over(within), F.lit(True)))
    flagged = flagged.withColumns({"start": F.max(F.when(F.col("new"), F.col("m"))).over(so_far), "singles": F.sum(F.col("single").cast("long")).over(so_far)})
    flagged = written(flagged, "runs", compression="zstd")
    edges = flagged.groupBy("of_range").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(key, "m").alias("first"), F.max_by(key, "m").alias("last"), F.max("start").alias("last_start"), F.max("singles").alias("n_single"),
        F.min_by("single", "m").alias("first_single"), F.max_by("single", "m").alias("last_single"),
    )
    edges = edges.withColumn("goes_on", F.col("first").eqNullSafe(F.lag("last").over(W.orderBy("of_range")))).drop("first", "last")  # one row a range
    found = sorted(edges.collect(), key=lambda r: r["of_range"])
    offsets, rows, singles, carried = [], 0, 0, 0
    for r, following in zip(found, [*found[1:], None], strict=False):
        goes_on, on = r["goes_on"], following is not None and following["goes_on"]
        wrong_first = goes_on and r["first_single"]
        wrong_last = on and r["last_single"] and not (wrong_first and r["n"] == 1)
        offsets.append((r["of_range"], rows, singles, carried, goes_on, on, wrong_first, wrong_last, r["n"] - 1))
        if not (goes_on and r["last_start"] == 0):
            carried = rows + r["last_start"]
        rows, singles = rows + r["n"], singles + r["n_single"] - wrong_first - wrong_last
    told = F.broadcast(spark.createDataFrame(offsets, "of_range long, rows long, earlier long, carried long, goes_on boolean, on boolean, wrong_first boolean, wrong_last boolean, last_m long"))
    first, last = F.col("m") == 0, F.col("m") == F.col("last_m")
    out = flagged.join(told, "of_range").withColumns({
        "row_id": F.col("before") + F.col("rows") + F.col("m") + 1,
        "run": F.when(F.col("goes_on") & (F.col("start") == 0), F.col("carried")).otherwise(F.col("rows") + F.col("start")),
        "tied": ~F.col("single") | (first & F.col("goes_on")) | (last & F.col("on")),
        "before": F.col("before") + F.col("earlier") + F.col("singles") - F.col("wrong_first").cast("int") - (last & F.col("wrong_last")).cast("int"),
    })
    return out.select("row_id", "row_hash", "run", "tied", "before", *(c for c in df.columns if c not in ("row_hash", "run", "before")))


@tidy
def diff_refined(source: DataFrame, target: DataFrame, order: list[str], more: list[str], *, steps: tuple[int, ...] = (0, 2, 4, 6), partitions: int | None = None, **options) -> tuple[DataFrame, int]:
    """What ``diff.diff_with_retry`` gives, with one whole sort.

    1. Both sides are read and hashed once; hashes and order columns are written.
    2. The first pass sorts all rows and pairs all numbers.
    3. Each further pass sorts only rows that were equal in all order columns so far, within their run, and pairs only numbers
       that such a row holds on either side; all other numbers have their final rows.

    The first pass orders text as it is, later ones by its trimmed upper case. Where these differ for any value, the second
    pass sorts all rows once more. A pass without new columns is not run. Nulls come first; empty tables are fine.

    Where sums of hashes show that no order can pair all rows, passes whose order leaves most rows tied are left out: each would end
    in mismatches, and the next sort all its rows again."""
    source, target = comparable(source, target)
    n = partitions or int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def hashed(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
        kinds = {c.lower(): k for c, k in df.dtypes}
        text = [kinds[c.lower()] == "string" for c in order]
        folded = {f"a{i}": F.upper(F.trim(F.col(f"`{c}`"))) if kinds[c.lower()] == "string" else F.col(f"`{c}`") for i, c in enumerate([*order, *more])}
        plain = {f"p{i}": F.col(f"`{c}`") for i, c in enumerate(order) if text[i]}
        out = written(fingerprint(df, also=folded | plain, **options).withColumns({"row_hash": packed("row_hash"), "before": F.lit(0).cast("long")}), name, compression="zstd")
        off = reduce(lambda x, y: x | y, (~F.col(p).eqNullSafe(F.col("a" + p[1:])) for p in plain), F.lit(False))
        return out, not plain or out.filter(off).isEmpty()

    sides = [hashed(source, "source"), hashed(target, "target")]
    alike = all(x for _, x in sides)
    whole = [x for x, _ in sides]
    if len(steps) > 1 and surely_differ(whole):
        uptos = [len(order) + len(more[:k]) for k in steps]
        coarse = whole[0].agg(F.count(F.lit(1)), *(F.approx_count_distinct(F.xxhash64(*(f"a{i}" for i in range(upto)))) for upto in uptos)).first()
        steps = steps[next((i for i, n_kinds in enumerate(coarse[1:]) if 2 * n_kinds >= coarse[0]), len(steps) - 1) :]
    state, known, settled, kept, used = None, 0, [None, None], [], 0
    both = None
    for k in steps:
        upto, used = len(order) + len(more[:k]), k
        if state is not None and upto == known:
            continue
        if state is None:
            plain = k == 0 and not alike
            keys = [f"p{i}" if plain and f"p{i}" in whole[0].columns else f"a{i}" for i in range(upto)]
            now, kept, settled = [ordered(x, keys, n) for x in whole], [], [None, None]
        else:
            now = [ordered(x.filter("tied").drop("row_id", "tied"), ["run", *(f"a{i}" for i in range(known, upto))], n) for x in state]
        s, t = (x.select("row_id", "row_hash", "tied") if y is None else x.select("row_id", "row_hash", "tied").union(y) for x, y in zip(now, settled, strict=True))
        s, t = s.toDF("row_id", "source_hash", "source_tied"), t.toDF("row_id", "target_hash", "target_tied")
        both = written(s.join(t, "row_id", "full_outer"), "both", compression="zstd")
        told = category(F.col("source_hash"), F.col("target_hash"), F.col("source_hash").isNotNull(), F.col("target_hash").isNotNull()).alias("category")
        shown = both.select("row_id", told, unpacked("source_hash").alias("source_hash"), unpacked("target_hash").alias("target_hash"))
        diff = reduce(DataFrame.union, [*kept, shown])
        counts = {r[0]: r[1] for r in diff.groupBy("category").count().collect()}
        if counts.get("missing") or counts.get("extra") or not counts.get("mismatched"):
            break
        if k == 0 and not alike:
            continue
        still = F.coalesce("source_tied", F.lit(False)) | F.coalesce("target_tied", F.lit(False))
        kept.append(shown.filter(~(F.coalesce(both["source_tied"], F.lit(False)) | F.coalesce(both["target_tied"], F.lit(False)))))
        rest = both.filter(still)
        settled = [rest.filter(f"not {x}_tied").select("row_id", f"{x}_hash", F.lit(False).alias("tied")) for x in ("source", "target")]
        state, known = now, upto
    return diff, used
