"""Keyless comparison within a tolerance, against a largest matching by brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from rowaudit.operators import tolerance


def _largest(a: list[float], b: list[float], absolute: float, relative: float) -> int:
    """The largest one-to-one matching, by augmenting paths."""
    of_b: dict[int, int] = {}

    def free(i: int, seen: set[int]) -> bool:
        for j, y in enumerate(b):
            if j not in seen and tolerance.near(a[i], y, absolute, relative):
                seen.add(j)
                if j not in of_b or free(of_b[j], seen):
                    of_b[j] = i
                    return True
        return False

    return sum(free(i, set()) for i in range(len(a)))


def _want(source, target, absolute, relative):
    within = 0
    for g in {x for x, _ in source + target}:
        a, b = (Counter(v for h, v in side if h == g and v is not None and math.isfinite(v)) for side in (source, target))
        within += _largest(sorted((a - b).elements()), sorted((b - a).elements()), absolute, relative)
    return within


def _frames(spark, source, target):
    return (spark.createDataFrame(x, "g string, v double") for x in (source, target))


@pytest.mark.parametrize(("absolute", "relative"), [(0.5, 0.0), (0.0, 0.125), (0.25, 0.25), (0.0, 0.0), (40.0, 0.0)])
@pytest.mark.parametrize("partitions", [1, 7])
def test_pairs_are_as_many_as_can_be(spark, absolute, relative, partitions):
    dice = random.Random(f"{absolute} {relative}")
    side = lambda n: [(dice.choice("aab"), dice.randrange(-80, 80) / 8) for _ in range(n)]
    source, target = side(150), side(130)
    got = tolerance.tolerant_diff(*_frames(spark, source, target), "V", absolute=absolute, relative=relative, partitions=partitions).toPandas()
    assert (got.n_source == got.exact + got.within.where(got.n_source > got.n_target, 0) + got.missing).all()
    assert (got.n_target == got.exact + got.within.where(got.n_target > got.n_source, 0) + got.extra).all()
    of_source = int(got.within[got.n_source > got.n_target].sum())
    assert of_source == int(got.within[got.n_source < got.n_target].sum()) == _want(source, target, absolute, relative)


def test_a_chain_through_all_ranges(spark):
    """Each row's partner is the next one along, so what waits goes through every range."""
    source, target = [("a", float(2 * k)) for k in range(200)], [("a", 2 * k + 1.5) for k in range(200)]
    got = [tolerance.tolerant_parity(*_frames(spark, source, target), "v", absolute=1.5, partitions=p).first().asDict() for p in (1, 6)]
    assert got[0] == got[1] == {"source_rows": 200, "target_rows": 200, "exact": 0, "within": 200, "missing": 0, "extra": 0, "same": True}
    wide = tolerance.tolerant_parity(*_frames(spark, [("a", float(k)) for k in range(100)], [("a", 100.0 + k) for k in range(100)]), "v", absolute=100.0, partitions=5).first()
    assert (wide["within"], wide["same"]) == (100, True)


def test_nulls_nan_infinities_zeros_and_copies(spark):
    nan, inf = math.nan, math.inf
    source = [("a", None), ("a", nan), ("a", inf), ("a", -inf), ("a", 0.0), (None, 1.0), ("b", 5.0), ("b", 5.0), ("b", 5.0)]
    target = [("a", None), ("a", nan), ("a", inf), ("a", 1e308), ("a", -0.0), (None, 1.25), ("b", 5.0), ("b", 5.25), ("c", 5.0)]
    row = tolerance.tolerant_parity(*_frames(spark, source, target), "v", absolute=0.25).first()
    assert (row["exact"], row["within"], row["missing"], row["extra"], row["same"]) == (5, 2, 2, 2, False)


def test_types_one_column_names_and_empty_tables(spark):
    s = spark.createDataFrame([(1,), (2,), (9,)], "n int")
    t = s.selectExpr("cast(n + 0.1 as decimal(20,3)) as N")
    assert tolerance.tolerant_parity(s, t, "n", absolute=0.125).first()["within"] == 3
    odd = s.selectExpr("n", "n % 2 as `row_hash`", "'x' as `of range.`", "n as value")
    moved = odd.selectExpr("n + 1 as n", "`row_hash`", "`of range.`", "value")
    assert tolerance.tolerant_parity(odd, moved, "n", absolute=1).first()["same"]
    none = tolerance.tolerant_parity(s.limit(0), t.limit(0), "n", absolute=1).first()
    assert (none["source_rows"], none["within"], none["same"]) == (0, 0, True)
    assert tolerance.tolerant_diff(s.limit(0), t, "n", absolute=1).agg({"extra": "sum"}).first()[0] == 3
    with pytest.raises(ValueError, match="relative"):
        tolerance.tolerant_diff(s, t, "n", relative=1.0)
