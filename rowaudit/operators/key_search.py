"""Keys found in the data: the smallest sets of columns whose values tell all rows apart."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import text_of

#: One in so many hashes is looked at first: a set with a repeated one among them is no key.
SLICE = 64
#: Relative error of the sketches, and how many of these a set may lack before it is given up.
ERROR, MARGIN = 0.03, 4
_PLAIN = (T.NumericType, T.StringType, T.CharType, T.VarcharType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def minimal_keys(df: DataFrame, *, most: int = 3, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (names in alphabetical order, joined by a comma) and ``size`` of each minimal set of at most ``most`` columns that is unique and without nulls.

    The lattice of sets is searched from the bottom, a level at a time, and no superset of a key is looked at.

    1. One pass counts rows and nulls and sketches the distinct values of all sets of a level. A set that stays clearly below
       the number of rows is no key; nor is one whose columns, by their sketches, have too few combinations.
    2. Of the sets that are left, one in ``SLICE`` hashes is looked at: equal rows fall into it together, so a set with a hash
       that occurs twice there is no key, and most of those that the sketches couldn't rule out end here.
    3. The others are counted exactly, all in one job: rows become (set, hash of its values), folded in each task, and a set
       with a hash that occurs twice falls out. Hashes have 128 bits; a value is printed once, not for each set that holds it.

    The driver holds names of columns and a number for each set. A table of one row or none has every column as a key."""
    kinds = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, _PLAIN)}
    names = sorted(c for c in kinds if columns is None or c in columns)
    first = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null{i}") for i, c in enumerate(names)), *(F.approx_count_distinct(F.col(f"`{c}`"), ERROR).alias(f"kinds{i}") for i, c in enumerate(names))).first()
    rows = first["n"]
    names_, kinds_of = [], {}
    for i, c in enumerate(names):
        if not first[f"null{i}"]:
            names_.append(c)
            kinds_of[c] = first[f"kinds{i}"]
    framed = {c: F.concat(F.length(text_of(c, kinds[c])).cast("string"), F.lit(":"), text_of(c, kinds[c])) for c in names_}
    at = {c: i for i, c in enumerate(names_)}

    def repeated(sets: list[tuple[str, ...]], slice_: int) -> set[tuple[str, ...]]:
        """The sets of which a hash occurs twice, among one in ``slice_`` hashes."""
        used = sorted({c for s in sets for c in s})
        hashed = df.select(*(F.xxhash64(F.lit(k), framed[c]).alias(f"h{k}_{at[c]}") for c in used for k in (1, 2)))
        of_set = [F.struct(F.lit(i).alias("set"), *(F.xxhash64(F.lit(k), *(f"h{k}_{at[c]}" for c in s)).alias(f"h{k}") for k in (1, 2))) for i, s in enumerate(sets)]
        each = hashed.select(F.explode(F.array(*of_set)).alias("x")).select("x.*")
        if slice_ > 1:
            each = each.filter(F.pmod("h1", F.lit(slice_)) == 0)
        twice = each.groupBy("set", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("set").distinct()
        return {sets[r[0]] for r in twice.collect()}  # a number for each set

    enough = rows * (1 - MARGIN * ERROR)
    keys: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        level = [s for s in combinations(names_, size) if not any(set(k) <= set(s) for k in keys)]
        level = [s for s in level if _product(kinds_of[c] * (1 + MARGIN * ERROR) for c in s) >= rows]
        if size > 1 and level:
            seen = df.agg(*(F.approx_count_distinct(F.xxhash64(*(F.col(f"`{c}`") for c in s)), ERROR).alias(f"s{i}") for i, s in enumerate(level))).first()
            level = [s for i, s in enumerate(level) if seen[i] >= enough]
        elif size == 1:
            level = [s for s in level if kinds_of[s[0]] >= enough]
        if not level:
            continue
        for slice_ in (SLICE, 1):
            bad = repeated(level, slice_) if level else set()
            level = [s for s in level if s not in bad]
        keys += level
    return df.sparkSession.createDataFrame([(",".join(k), len(k)) for k in keys], "columns string, size int")


def _product(values) -> float:
    out = 1.0
    for v in values:
        out *= v
    return out
