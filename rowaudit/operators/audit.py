"""Audits of many table pairs at once; what can't be read becomes a row, not a stop."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import comparable, shared_kind, text_of, values_of
from ..sources.tables import tidy, written
from . import counts
from .failures import reason, stacked, together

TOTALS = ("source_rows", "target_rows", "matching", "mismatched", "missing", "extra")
RESULT = (
    "schema_name string, table_name string, object_type string, compared_by string, source_rows long, target_rows long, matching long, mismatched long, missing long, extra long, "
    "duplicate_keys long, error string"
)
#: Reasons of pairs that are read but can't be compared.
NO_KEY, OTHER_COLUMNS = "KEY_NOT_FOUND", "COLUMNS_DIFFER"


@dataclass(frozen=True)
class Pair:
    """A table or view on both sides. Without ``keys``, rows are compared as multisets; so they are where the target's own
    key, ``target_keys``, is another list (in any case), or where a key occurs twice on a side."""

    schema_name: str
    table_name: str
    source: Callable[[], DataFrame]
    target: Callable[[], DataFrame]
    keys: tuple[str, ...] = ()
    object_type: str = "Table"
    target_keys: tuple[str, ...] | None = None

    def keyed(self) -> bool:
        return bool(self.keys) and (self.target_keys is None or [k.lower() for k in self.keys] == [k.lower() for k in self.target_keys])


@dataclass(frozen=True)
class _Open:
    """A pair whose sides could be opened; ``number`` is its place in the list. ``equal`` says that both sides have the same rows:
    then one side tells all. ``sides`` are numbers of its tables, the same where another pair has the same table."""

    number: int
    source: DataFrame
    target: DataFrame
    keys: tuple[str, ...]
    equal: bool = False
    sides: tuple[int, int] = (-1, -1)

    def what(self) -> tuple:
        """The same for pairs that have the same result."""
        return (self.sides, tuple(k.lower() for k in self.keys), self.equal)


def _sided(opened: list[_Open]) -> list[_Open]:
    """The pairs with ``sides``: tables read in the same way have one number, however many pairs they are in."""
    found: dict[int, list[tuple[DataFrame, int]]] = {}
    n = 0

    def number(df: DataFrame) -> int:
        nonlocal n
        alike = found.setdefault(df.semanticHash(), [])
        for other, k in alike:
            if df.sameSemantics(other):
                return k
        alike.append((df, n))
        n += 1
        return n - 1

    return [replace(p, sides=(number(p.source), number(p.target))) for p in opened]


def _opened(number: int, pair: Pair) -> _Open | str:
    """The pair's sides, or why they can't be compared. Nothing but names, types and keys is looked at; no row is read."""
    try:
        source, target = comparable(pair.source(), pair.target())
        mine, other = ({c.lower() for c in df.columns} for df in (source, target))
    except Exception as e:  # noqa: BLE001 - callbacks and drivers raise what they like
        return reason(e)
    if mine != other:
        return OTHER_COLUMNS
    if not {k.lower() for k in pair.keys} <= mine:
        return NO_KEY
    return _Open(number, source, target, pair.keys if pair.keyed() else ())


def _two(values: list[list[Column]], into: str) -> list[Column]:
    """128 bits of a list of values in two longs, which Spark's hash aggregation can keep in place. What a column is hashed by never
    runs into the next one's, so no two lists give the same."""
    return [F.xxhash64(F.lit(k), *(x for v in values for x in v)).alias(f"{into}{k}") for k in (1, 2)]


def _shared(p: _Open) -> tuple[T.DataType | None, ...]:
    """For each column, by name, the type as which both sides' values are hashed; None: by their text."""
    kinds = ([f.dataType for f in sorted(df.schema.fields, key=lambda f: f.name.lower())] for df in (p.source, p.target))
    return tuple(shared_kind(a, b) for a, b in zip(*kinds, strict=True))


def _tagged(opened: list[_Open], *, whole: bool = False) -> DataFrame:
    """Both sides of all pairs (of one that is equal, the source's only) as one stream: the pair's number, whether it has no key
    (``as_rows``), a 1 for the side that a row is of in ``s`` or ``t``, the hashes ``k1, k2`` of its key, or of the row if it has none,
    ``h1, h2`` of the row, and the key's text. Where ``h1, h2`` tell nothing more they are 0, if not ``whole``.

    Values are hashed as they are where both sides have them in one type, as text only where they haven't. Tables of the same
    columns and keys are put together first and hashed by one projection. It reads the partition's number, which keeps it above
    the union: below it, code would be made and compiled for each table. Tables small and large share the shuffle that follows:
    it deals rows by pair and key, so small tables lie together in a partition and large ones are spread over all. A task reads
    a table for one pair only, so that what it folds before the shuffle fits its memory as one pair's rows do."""
    alike: dict[tuple, list[DataFrame]] = {}
    for p in opened:
        for s, df in ((1, p.source), (0, p.target))[: 1 if p.equal else 2]:
            fields = sorted(df.schema.fields, key=lambda f: f.name.lower())
            at = [f.name.lower() for f in fields]
            kind = (tuple((n, f.dataType) for n, f in zip(at, fields, strict=True)), _shared(p), tuple(at.index(k.lower()) for k in p.keys), p.equal)
            quoted = (f.name.replace("`", "``") for f in fields)
            alike.setdefault(kind, []).append(df.selectExpr(f"{p.number} as pair", f"{s}L as s", *(f"`{c}` as c{i}" for i, c in enumerate(quoted))))
    streams = []
    for (fields, shared, keys, equal), frames in alike.items():
        row = [values_of(f"c{i}", kind, shared[i]) for i, (_, kind) in enumerate(fields)]
        h = _two(row, "h") if whole or keys and not equal else [F.lit(0).cast("long").alias(f"h{k}") for k in (1, 2)]
        pair = F.when(F.spark_partition_id() >= 0, F.col("pair")).alias("pair")
        key_text = F.concat_ws("|", *(text_of(f"c{i}", fields[i][1]) for i in keys)).alias("key_text")
        streams.append(stacked(frames).select(pair, F.lit(not keys).alias("as_rows"), "s", (1 - F.col("s")).alias("t"), *_two([row[i] for i in keys] if keys else row, "k"), *h, key_text))
    return stacked(streams)


def _counts(tables: list[tuple[int, DataFrame]]) -> dict[int, int]:
    """Rows of tables by their number. No column is read that a count doesn't need, so a file that is none is found at little cost."""
    n = {r[0]: r[1] for r in stacked([df.selectExpr(f"{k} as side") for k, df in tables]).groupBy("side").count().collect()}  # a row for each table
    return {k: n.get(k, 0) for k, _ in tables}


def _equal(opened: list[_Open]) -> dict[int, _Open]:
    """The pairs by number, and whether both sides have the same rows: as many, with the same sums of hashes. All tables are read in
    one job, each once for all pairs that hash it alike; it shuffles a row of each task and table."""
    halves = [half for h in ("h1", "h2") for half in (F.shiftright(h, 32), F.shiftright(F.shiftleft(h, 32), 32))]
    units: dict[tuple, _Open] = {}
    of: dict[int, list[int]] = {}
    for p in opened:
        hashed_as = _shared(p)
        for side, df, other in ((p.sides[0], p.source, p.target), (p.sides[1], p.target, p.source)):
            u = units.setdefault((side, hashed_as), _Open(len(units), df, other, (), True))
            of.setdefault(p.number, []).append(u.number)
    sums = _tagged(list(units.values()), whole=True).groupBy("pair").agg(F.count(F.lit(1)), F.bit_xor("h1"), F.bit_xor("h2"), *(F.try_sum(x).alias(f"sum{i}") for i, x in enumerate(halves)))
    found = {r["pair"]: tuple(r)[1:] for r in sums.collect()}  # a row for each table
    return {p.number: replace(p, equal=found.get(of[p.number][0]) == found.get(of[p.number][1])) for p in opened}


def _ruled(opened: list[_Open]) -> tuple[list[_Open], dict[int, str]]:
    """The pairs that can be read, with whether their sides are equal, and by number why others can't be. Rows aren't shuffled yet:
    counts find what has no readable file, so what is done again by halves for it is counting only; hashes are summed up of
    pairs with equal counts alone, as no others can be equal."""
    opened = _sided(opened)
    sides = list({k: df for p in opened for k, df in zip(p.sides, (p.source, p.target), strict=True)}.items())
    n, broken = together(_counts, sides)
    bad = {sides[k][0]: why for k, why in broken.items()}
    errors = {p.number: next(bad[k] for k in p.sides if k in bad) for p in opened if bad.keys() & {*p.sides}}
    alike = [p for p in opened if p.number not in errors and n[p.sides[0]] == n[p.sides[1]]]
    told, off = together(_equal, alike)
    errors |= {alike[k].number: why for k, why in off.items()}
    return [told.get(p.number, p) for p in opened if p.number not in errors], errors


def _compared(opened: list[_Open]) -> dict[int, tuple]:
    """By pair the totals and how many keys occur twice on a side: all pairs in one job, and those of the same two tables and keys once.

    Rows are folded by pair and key in each task first, so a key or a row that makes up a third of a table is a few rows
    in the shuffle. Hashes of a key fold by exclusive or: of two rows with one key they are equal just if nothing is left."""
    first = {p.what() if min(p.sides) >= 0 else p.number: p for p in reversed(opened)}
    by_key = _tagged(list(first.values())).groupBy("pair", "as_rows", "k1", "k2").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    s, t, rows = F.col("s"), F.col("t"), F.col("as_rows")
    once = ~rows & (s == 1) & (t == 1)
    same = (F.col("h1") == 0) & (F.col("h2") == 0)
    n = lambda which, value: F.coalesce(F.sum(F.when(which, value)), F.lit(0))
    one = F.lit(1)
    out = by_key.groupBy("pair").agg(
        F.sum("s").alias("source_rows"), F.sum("t").alias("target_rows"), (n(rows, F.least("s", "t")) + n(once & same, one)).alias("matching"), n(once & ~same, one).alias("mismatched"),
        (n(rows & (s > t), s - t) + n(~rows & (t == 0), s)).alias("missing"), (n(rows & (t > s), t - s) + n(~rows & (s == 0), t)).alias("extra"), n(~rows & (F.greatest("s", "t") > 1), one).alias("duplicate_keys"),
    )
    found = {r["pair"]: tuple(r)[1:] for r in out.collect()}  # a row for each pair
    totals = {what: found.get(p.number, (0,) * 7) for what, p in first.items()}
    got = {p.number: totals[p.what() if min(p.sides) >= 0 else p.number] for p in opened}
    return {p.number: _both(got[p.number]) if p.equal else got[p.number] for p in opened}


def _both(one: tuple) -> tuple:
    """Totals of a pair with the same rows on both sides from those of its source alone."""
    return (one[0], one[0], one[0], 0, 0, 0, one[-1])


def audit_pairs(spark: SparkSession, pairs: Iterable[Pair]) -> DataFrame:
    """One row for each pair: how it was compared (``keys`` or ``rows``), its totals, how many keys occur more than once on a
    side, and ``error``, the reason why it couldn't be read or compared (its totals are 0 then).

    1. Each pair's sides are opened alone: a missing path, driver, key or column, or a callback that raises, is its error.
    2. One job counts all pairs that are left, another sums up the hashes of those with as many rows on both sides. If one fails on
       rows (a broken file, a lost connection), it is done again by halves until the pairs that fail stand alone. Rows aren't shuffled yet.
    3. All pairs that could be read are compared in one job; of pairs whose sums are equal, only one side's keys, for those that repeat.
       What fails only here, in a column that a count doesn't read, is found by halves too.
    4. Pairs with keys that occur twice are compared once more, all in one job, as multisets of rows.

    A table that several pairs have is counted and summed up once, and what two tables give by the same keys, or by rows, is found once. So the number of jobs doesn't grow with the number of pairs, and the driver gets a row for each. No pairs give no rows."""
    pairs = list(pairs)
    tried = [_opened(k, p) for k, p in enumerate(pairs)]
    errors = {k: x for k, x in enumerate(tried) if isinstance(x, str)}
    opened = [x for x in tried if isinstance(x, _Open)]
    opened, broken = _ruled(opened)
    errors |= broken
    found, failed = together(_compared, opened)
    again = {p.number: found[p.number] for p in opened if p.equal and p.number in found}
    by_rows = {p.what(): found[p.number] for p in opened if not p.keys and p.number in found}
    twice = [replace(p, keys=()) for p in opened if not p.equal and found.get(p.number, (0,) * 7)[-1]]
    again |= {p.number: by_rows[p.what()] for p in twice if p.what() in by_rows}
    twice = [p for p in twice if p.number not in again]
    more, too = together(_compared, twice)
    again |= more
    errors |= {opened[k].number: why for k, why in failed.items()} | {twice[k].number: why for k, why in too.items()}
    keyed = {p.number for p in opened if p.keys and not found.get(p.number, (0,) * 7)[-1]}
    rows = []
    for k, p in enumerate(pairs):
        *totals, duplicates = (0,) * 7 if k in errors else (*again[k][:6], found[k][6]) if k in again else found[k]
        rows.append((p.schema_name, p.table_name, p.object_type, None if k in errors else "keys" if k in keyed else "rows", *totals, duplicates, errors.get(k)))
    return spark.createDataFrame(rows, RESULT)


def _named(spark: SparkSession, pairs: list[Pair], numbers: Iterable[int]) -> DataFrame:
    """Names of pairs by number; the list of pairs is the caller's, so it is sent to all tasks."""
    return F.broadcast(spark.createDataFrame([(k, pairs[k].schema_name, pairs[k].table_name) for k in numbers], "pair int, schema_name string, table_name string"))


def _written_parts(opened: list[_Open], plan: Callable[[list[_Open]], DataFrame], name: str) -> tuple[list[DataFrame], dict[int, str]]:
    """What ``plan`` gives for all pairs, written in one job, or in a few where some fail; and the reasons, by place."""
    parts, failed = together(lambda some: {tuple(p.number for p in some): written(plan(some), name)}, opened)
    return list(parts.values()), failed


@tidy
def count_drill_down(spark: SparkSession, pairs: Iterable[Pair]) -> tuple[DataFrame, DataFrame]:
    """Row counts of all pairs as findings, then for each pair that has one key on both sides and was counted with different
    results, its keys that are ``missing`` or ``extra``, or a ``duplicate`` on a side: ``(schema_name, table_name, side, key_text)``.

    Both counts of all pairs are one job, and so are the keys of all pairs that are looked into. Failed counts, other key
    lists and keys that can't be read are not looked into. Names may hold dots."""
    pairs = list(pairs)
    sides = [counts.counted(spark, [(p.schema_name, p.table_name, side(p)) for p in pairs]) for side in (lambda p: p.source, lambda p: p.target)]
    found = counts.compare_counts(*sides)
    off = {(r["schema_name"], r["table_name"]) for r in found.filter("issue_type = 'Row Count Mismatch'").collect()}  # names of tables
    tried = [_opened(k, p) for k, p in enumerate(pairs) if p.keyed() and (p.schema_name.upper(), p.table_name.upper()) in off]
    opened = [x for x in tried if isinstance(x, _Open)]

    def keys_of(some: list[_Open]) -> DataFrame:
        n = _tagged(some).groupBy("pair", "k1", "k2", "key_text").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
        side = F.array_compact(F.array(F.when(F.col("t") == 0, "missing"), F.when(F.col("s") == 0, "extra"), F.when(F.greatest("s", "t") > 1, "duplicate")))
        return n.filter("s <> 1 or t <> 1").select("pair", F.explode(side).alias("side"), "key_text")

    parts, _ = _written_parts(opened, keys_of, "keys")
    none = spark.createDataFrame([], "pair int, side string, key_text string")
    keys = reduce(DataFrame.union, parts, none).join(_named(spark, pairs, [p.number for p in opened]), "pair")
    return found, keys.select("schema_name", "table_name", "side", "key_text")


@tidy
def pair_samples(spark: SparkSession, pairs: Iterable[Pair], n: int = 5) -> DataFrame:
    """For each pair that is compared by keys, the first ``n`` keys, by text, of each kind of difference: ``(schema_name, table_name,
    category, rank, key_text)``; all pairs in one job, after those that find which can't be read or have the same rows on both
    sides (``audit_pairs``). Keys that occur twice on a side are in no category."""
    pairs = list(pairs)
    readable, _ = _ruled([x for k, p in enumerate(pairs) if p.keyed() and isinstance(x := _opened(k, p), _Open)])
    opened = [p for p in readable if not p.equal]

    def first(some: list[_Open]) -> DataFrame:
        both = _tagged(some).groupBy("pair", "k1", "k2", "key_text")
        each = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")).filter("s <= 1 and t <= 1 and (s <> t or h1 <> 0 or h2 <> 0)")
        kind = F.when(F.col("t") == 0, "missing").when(F.col("s") == 0, "extra").otherwise("mismatched")
        order = W.partitionBy("pair", "category").orderBy("key_text", "k1", "k2")
        return each.select("pair", kind.alias("category"), "key_text", "k1", "k2").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("pair", "category", "rank", "key_text")

    parts, _ = _written_parts(opened, first, "samples")
    none = spark.createDataFrame([], "pair int, category string, rank int, key_text string")
    return reduce(DataFrame.union, parts, none).join(_named(spark, pairs, [p.number for p in opened]), "pair").select("schema_name", "table_name", "category", "rank", "key_text")
