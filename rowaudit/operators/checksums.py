"""Checksum trees: tables are compared by sums over ranges of keys, and only ranges that differ are opened to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import comparable, row_text, text_of
from ..functions.names import fresh
from ..sources.tables import tidy, written
from . import diff

#: Bits of a node's number at each level of the tree: 4,096 nodes, then 256 below each of these that differs.
LEVELS = (12, 20)
_LOW = 0x7FFFFFFF


def _leaf_by_hash(df: DataFrame, keys: list[str], bits: int) -> Column:
    kinds = {f.name.lower(): f for f in df.schema.fields}
    texts = [text_of(kinds[k.lower()].name, kinds[k.lower()].dataType) for k in keys]
    framed = F.concat(*(F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in texts))
    return F.shiftrightunsigned(F.xxhash64(framed), 64 - bits)


def _leaf_by_range(key: str, low: float, high: float, bits: int) -> Column:
    place = F.floor((F.col(f"`{key}`").cast("double") - low) / max(high - low, 1e-300) * (1 << bits))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), place)), F.lit(0)).cast("long")


def _leaves(source: DataFrame, target: DataFrame, keys: list[str], by: str, bits: int) -> tuple[Column, Column]:
    """The number of each row's leaf at the finest level, for both sides."""
    if by == "hash":
        return _leaf_by_hash(source, keys, bits), _leaf_by_hash(target, keys, bits)
    key = F.col(f"`{keys[0]}`").cast("double")
    both = source.select(key.alias("x")).union(target.select(key.alias("x"))).agg(F.min("x"), F.max("x")).first()
    low, high = (float(x) if x is not None else 0.0 for x in both)
    leaf = _leaf_by_range(keys[0], low, high, bits)
    return leaf, leaf


def _open(df: DataFrame, leaf: Column, nodes: DataFrame | None, shift: int, how: str) -> DataFrame:
    """``df`` with its rows in the nodes, or outside them; a level has few nodes, so they go to all tasks."""
    if nodes is None:
        return df
    (name,) = fresh(df.columns, "node")
    return df.withColumn(name, F.shiftright(leaf, shift)).join(F.broadcast(nodes.select(F.col("node").alias(name))), name, how).drop(name)


def _differing(source: DataFrame, target: DataFrame, leaves: tuple[Column, Column], levels: tuple[int, ...], options: dict) -> tuple[DataFrame, int]:
    """The nodes of the last level whose sums differ, ``(node, n_source, n_target)``, and by how much its numbers are shifted.

    A row adds 1 to its side's count, its hash by exclusive or, and parts of it to a sum that the other side subtracts: of
    equal sets of rows, however ordered, nothing is left. Sums are folded in each task; no row is shuffled."""
    nodes, finest = None, levels[-1]
    for bits in levels:
        sides = []
        for df, leaf, sign in ((source, leaves[0], 1), (target, leaves[1], -1)):
            text = row_text(df, **options)
            inside = _open(df, leaf, nodes, finest - previous if nodes is not None else 0, "left_semi")
            h = inside.select(F.shiftright(leaf, finest - bits).alias("node"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"))
            sides.append(h.select("node", "h1", "h2", F.lit(int(sign > 0)).alias("s"), F.lit(int(sign < 0)).alias("t"), (F.col("h1").bitwiseAND(F.lit(_LOW)) * sign).alias("l1"), (F.col("h2").bitwiseAND(F.lit(_LOW)) * sign).alias("l2")))
        sums = sides[0].union(sides[1]).groupBy("node").agg(F.sum("s").alias("n_source"), F.sum("t").alias("n_target"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("l1").alias("l1"), F.sum("l2").alias("l2"))
        nodes = written(sums.filter("n_source <> n_target or h1 <> 0 or h2 <> 0 or l1 <> 0 or l2 <> 0").select("node", "n_source", "n_target"), "nodes")
        previous = bits
    return nodes, 0


@tidy
def differing_ranges(source: DataFrame, target: DataFrame, keys: list[str], *, by: str = "range", levels: tuple[int, ...] = LEVELS, **options) -> DataFrame:
    """The nodes of the finest level that differ: ``node``, ``n_source``, ``n_target`` rows; of equal tables none.

    By ``range``, a node is a stretch of the first key's values, which must be numbers, dates or times: of 2^bits equal ones from the
    smallest value of both sides to the greatest; nulls are in the first. By ``hash``, it is a prefix of the key's hash."""
    source, target = comparable(source, target)
    return _differing(source, target, _leaves(source, target, keys, by, levels[-1]), levels, options)[0]


@tidy
def checksum_diff(source: DataFrame, target: DataFrame, keys: list[str], *, by: str = "hash", levels: tuple[int, ...] = LEVELS, **options) -> DataFrame:
    """What ``diff.keyed_diff`` gives for unique keys, by way of a checksum tree.

    1. Both sides are summed by the nodes of the first level; the nodes that differ are summed again by those below.
    2. Rows outside the nodes of the last level that differ are the same on both sides: those of the source are listed as
       matching, straight from the scan.
    3. Rows inside are paired by key.

    So equal tables cost a scan a side and a shuffle of 4,096 sums a task; each level that differs costs one more scan of both.
    It is the way to compare large tables that hardly differ, or (by ``range``) differ in places; where differences lie in
    most nodes, ``keyed_diff`` reads less. Nulls and clashing names as there; rows that repeat a key, and do so equally on both
    sides, match one by one. Empty tables are fine."""
    source, target = comparable(source, target)
    leaves = _leaves(source, target, keys, by, levels[-1])
    nodes, shift = _differing(source, target, leaves, levels, options)
    hash_ = diff.hash_of(row_text(source, **options))
    names = fresh(["category", "source_hash", "target_hash"], *keys)
    same = _open(source, leaves[0], nodes, shift, "left_anti").select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)), F.lit("matching").alias("category"), hash_.alias("source_hash"), hash_.alias("target_hash"))
    inside = [_open(df, leaf, nodes, shift, "left_semi") for df, leaf in zip((source, target), leaves, strict=True)]
    return same.union(diff.keyed_diff(*inside, keys, **options))


@tidy
def checksum_totals(source: DataFrame, target: DataFrame, keys: list[str], *, by: str = "hash", levels: tuple[int, ...] = LEVELS, **options) -> DataFrame:
    """``diff.diff_totals`` by way of a checksum tree: rows outside the nodes that differ are only counted."""
    source, target = comparable(source, target)
    leaves = _leaves(source, target, keys, by, levels[-1])
    nodes, shift = _differing(source, target, leaves, levels, options)
    inside = [_open(df, leaf, nodes, shift, "left_semi") for df, leaf in zip((source, target), leaves, strict=True)]
    found = diff.keyed_diff(*inside, keys, **options).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    same = source.agg(F.count(F.lit(1)).alias("n")).union(nodes.agg(-F.coalesce(F.sum("n_source"), F.lit(0)))).select(F.lit("matching").alias("category"), "n")
    each = found.union(same)
    n = lambda c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).alias(c)
    return diff.with_totals(each.agg(*(n(c) for c in diff.CATEGORIES)))
