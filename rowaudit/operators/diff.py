"""Differences between a source and a target table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.canonical import comparable, row_text, text_of
from ..functions.names import fresh
from ..sources.tables import attempt, gathered, tidy
from .fingerprint import fingerprint, hash_of, is_lob, packed, unpacked  # noqa: F401
from .numbering import Range, numbered, paired


def _all_equal(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, (x.eqNullSafe(y) for x, y in zip(a, b, strict=True)))


def category(source_hash: Column, target_hash: Column, in_source: Column, in_target: Column) -> Column:
    return F.when(~in_target, "missing").when(~in_source, "extra").when(source_hash == target_hash, "matching").otherwise("mismatched")


def keyed_diff(source: DataFrame, target: DataFrame, keys: list[str], **options) -> DataFrame:
    """Pairs rows by key: the keys, ``category`` (matching, mismatched, missing, extra), ``source_hash``, ``target_hash``.

    Only keys and hashes are shuffled, once a side; null keys pair with null keys. Keys should be unique (``duplicate_keys``).
    A key that is named like one of the three other columns gets an underscore before its name."""

    source, target = comparable(source, target)
    algorithm, columns = options.pop("algorithm", "SHA256"), options.pop("columns", None)
    hashed = [df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)), hash_of(row_text(df, columns, **options), algorithm).alias("row_hash")) for df in (source, target)]
    out = paired_hashes(*hashed, [f"k{i}" for i in range(len(keys))])
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(fresh(["category", "source_hash", "target_hash"], *keys))), "category", "source_hash", "target_hash")


def paired_hashes(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """``keyed_diff`` of rows that are hashed already: keys and ``row_hash`` on both sides."""

    def side(df: DataFrame, key: str, hash_name: str, there: str) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(f"{key}{i}") for i, c in enumerate(keys)), F.col("row_hash").alias(hash_name), F.lit(True).alias(there))

    n = range(len(keys))
    both = side(source, "s", "source_hash", "in_source").join(side(target, "t", "target_hash", "in_target"), _all_equal([F.col(f"s{i}") for i in n], [F.col(f"t{i}") for i in n]), "full_outer")
    in_s, in_t = F.col("in_source").isNotNull(), F.col("in_target").isNotNull()
    return both.select(*(F.when(in_s, F.col(f"s{i}")).otherwise(F.col(f"t{i}")).alias(c) for i, c in enumerate(keys)), category(F.col("source_hash"), F.col("target_hash"), in_s, in_t).alias("category"), "source_hash", "target_hash")


def positional_diff(source: DataFrame, target: DataFrame, order: list[str], *, aggressive: bool = False, **options) -> DataFrame:
    """Pairs row n with row n in the order of ``order``, then of the hash: ``row_id``, ``category`` and both hashes.

    ``aggressive`` orders text by its trimmed upper case. Order and hash are shuffled and sorted once, then only hashes, as bytes, are
    written, with their places. The result pairs these as they lie when it is read, and isn't written itself; so they stay as long as it."""

    def side(df: DataFrame) -> tuple[DataFrame, list[Range]]:
        kinds = {c.lower(): k for c, k in df.dtypes}
        by = [F.upper(F.trim(F.col(f"`{c}`"))) if aggressive and kinds[c.lower()] == "string" else F.col(f"`{c}`") for c in order]
        hashed = fingerprint(df, columns=options.get("columns"), **{k: v for k, v in options.items() if k != "columns"}, also={f"o{i}": x for i, x in enumerate(by)})
        ranges: list[Range] = []
        return numbered(hashed.withColumn("row_hash", packed("row_hash")), [*(f"o{i}" for i in range(len(order))), "row_hash"], keep=["row_hash"], ranges=ranges), ranges

    source, target = comparable(source, target)
    with gathered(source.sparkSession, "positions"):
        both = paired(side(source), side(target), "row_hash", ("source_hash", "target_hash"))
    told = category(F.col("source_hash"), F.col("target_hash"), F.col("source_hash").isNotNull(), F.col("target_hash").isNotNull())
    return both.select("row_id", told.alias("category"), unpacked("source_hash").alias("source_hash"), unpacked("target_hash").alias("target_hash"))


def multiset_diff(source: DataFrame, target: DataFrame, **options) -> DataFrame:
    """For tables without a key: each hash with ``n_source``, ``n_target``, ``matching``, ``missing`` and ``extra`` copies.

    Copies are folded before the shuffle, so one very common row costs no more than another."""
    source, target = comparable(source, target)
    tagged = fingerprint(source, **options).withColumns({"s": F.lit(1), "t": F.lit(0)}).unionByName(fingerprint(target, **options).withColumns({"s": F.lit(0), "t": F.lit(1)}))
    n = tagged.groupBy("row_hash").agg(F.sum("s").alias("n_source"), F.sum("t").alias("n_target"))
    return n.select("*", F.least("n_source", "n_target").alias("matching"), F.greatest(F.col("n_source") - F.col("n_target"), F.lit(0)).alias("missing"), F.greatest(F.col("n_target") - F.col("n_source"), F.lit(0)).alias("extra"))


def surely_differ(hashed: list[DataFrame]) -> bool:
    """Whether two tables of ``row_hash`` have as many rows and yet not the same: their sums of hashes differ. Then rows paired in
    any order have a mismatch. Nothing is shuffled but a row of each task; equal sums prove nothing."""
    h = F.xxhash64("row_hash")
    s, t = (df.agg(F.count(F.lit(1)), F.bit_xor(h), F.try_sum(F.shiftright(h, 32))).first() for df in hashed)
    return s[0] == t[0] and (s[1] != t[1] or None not in (s[2], t[2]) and s[2] != t[2])


def diff_with_retry(source: DataFrame, target: DataFrame, order: list[str], more: list[str], *, steps: tuple[int, ...] = (0, 2, 4, 6), **options) -> tuple[DataFrame, int]:
    """Positional differences; while both sides have as many rows and all differences are mismatches, again with more
    order columns. The last differences, and how many columns were added. At most ``len(steps)`` passes.

    Where sums of hashes show that no order can pair all rows, every pass but the last would end in mismatches, so only the last is run."""
    if len(steps) > 1 and surely_differ([fingerprint(df, **options) for df in comparable(source, target)]):
        steps = steps[-1:]
    diff, used = None, 0
    for k in steps:
        used = k
        with attempt(source.sparkSession) as keep:
            diff = positional_diff(source, target, order + more[:k], aggressive=k > 0, **options)
            n = {} if k == steps[-1] else {r[0]: r[1] for r in diff.groupBy("category").count().collect()}
            if k == steps[-1] or n.get("missing") or n.get("extra") or not n.get("mismatched"):
                keep()
                break
    return diff, used


def missing_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the source that the target lacks, and ``key_text``; swap the sides for extra keys. Only keys are shuffled."""
    own = fresh(keys, *(f"t{i}" for i in range(len(keys))))
    s, t = source.select(*keys), target.select(*(F.col(k).alias(x) for k, x in zip(keys, own, strict=True)))
    gone = s.join(t, _all_equal([F.col(k) for k in keys], [F.col(x) for x in own]), "left_anti")
    return gone.withColumn("key_text", key_text(keys))


def keys_exist(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``wanted`` that ``table`` holds."""
    return wanted.select(*keys).distinct().join(table.select(*keys), keys, "left_semi")


def key_text(keys: list[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys))


def key_display(keys: list[str]) -> Column:
    return F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in keys))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; such tables want the multiset difference."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def column_diff(source: DataFrame, target: DataFrame, keys: list[str], *, first: int = 10, share: float = 0.8) -> DataFrame:
    """One row per mismatched row: keys, ``n_differing``, ``differing`` (the first names), null counts of both sides,
    ``ordering_problem`` (one side nearly all null while the other has none) and ``absent`` (columns that one side lacks).

    Null keys pair with null keys. Each side's values are printed by its own types; columns are paired by name in any
    case, and those of one side only aren't compared but listed. Columns may have any names."""
    source, target = comparable(source, target)
    kinds = [{f.name.lower(): f for f in df.schema.fields} for df in (source, target)]
    of_key = {k.lower() for k in keys}
    names = sorted(c for c in kinds[0] if c in kinds[1] and c not in of_key)
    absent = sorted(c for c in {*kinds[0], *kinds[1]} if (c in kinds[0]) != (c in kinds[1]))
    there = lambda df: [F.col(f"`{c}`") for c in df.columns if c.lower() not in absent]
    numbers = range(len(keys))
    found = keyed_diff(source.select(*there(source)), target.select(*there(target)), keys).filter("category = 'mismatched'")
    bad = found.select(*(F.col(f"`{k}`").alias(f"bad{i}") for i, k in enumerate(found.columns[: len(keys)])))

    def texts(df: DataFrame, side: int, to: str) -> DataFrame:
        fields = [kinds[side][n] for n in names]
        own = df.select(*(F.col(f"`{k}`").alias(f"{to}{i}") for i, k in enumerate(keys)), F.array(*(text_of(f.name, f.dataType) for f in fields)).alias(to), F.array(*(F.col(f"`{f.name}`").isNull() for f in fields)).alias(f"{to}_null"))
        return own.join(bad, _all_equal([F.col(f"{to}{i}") for i in numbers], [F.col(f"bad{i}") for i in numbers]), "left_semi")

    both = texts(source, 0, "a").join(texts(target, 1, "b"), _all_equal([F.col(f"a{i}") for i in numbers], [F.col(f"b{i}") for i in numbers]))
    pairs = F.arrays_zip(F.array(*(F.lit(kinds[0][n].name) for n in names)).alias("name"), F.col("a"), F.col("b"))
    off = F.filter(pairs, lambda x: x["a"] != x["b"])
    nulls = lambda c: F.size(F.filter(c, lambda x: x))
    out = both.withColumns({"off": off, "source_nulls": nulls("a_null"), "target_nulls": nulls("b_null")})
    mostly = lambda a, b: (F.col(a) >= share * len(names)) & (F.col(b) == 0)
    told = ["n_differing", "differing", "source_nulls", "target_nulls", "ordering_problem", "absent"]
    return out.select(
        *(F.col(f"a{i}").alias(k) for i, k in enumerate(fresh(told, *keys))), F.size("off").alias("n_differing"), F.array_join(F.transform(F.slice("off", 1, first), lambda x: x["name"]), ",").alias("differing"), "source_nulls", "target_nulls",
        (mostly("source_nulls", "target_nulls") | mostly("target_nulls", "source_nulls")).alias("ordering_problem"), F.lit(",".join(absent)).alias("absent"),
    )


@tidy
def positional_column_diff(source: DataFrame, target: DataFrame, order: list[str], **options) -> DataFrame:
    """``column_diff`` of rows paired by their place in the order of ``order``, then of their hash: keyed by ``row_id``."""
    (place,) = fresh([*source.columns, *target.columns], "row_id")

    def side(df: DataFrame) -> DataFrame:
        return numbered(df, [*order, packed(hash_of(row_text(df)))], into=place)

    source, target = comparable(source, target)
    return column_diff(side(source), side(target), [place], **options).withColumnRenamed(place, "row_id")


CATEGORIES = ("matching", "mismatched", "missing", "extra")


def diff_totals(diff: DataFrame, *by: str) -> DataFrame:
    """Counts by category, ``match_percent`` (of source rows; 0 if there are none) and ``is_match``."""
    return with_totals(diff.groupBy(*by).agg(*(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES)))


def with_totals(counts: DataFrame) -> DataFrame:
    """Counts by category with both sides' rows, ``match_percent`` and ``is_match``."""
    source = F.col("matching") + F.col("mismatched") + F.col("missing")
    return counts.select(
        "*", source.alias("source_rows"), (F.col("matching") + F.col("mismatched") + F.col("extra")).alias("target_rows"),
        F.when(source > 0, F.col("matching") * 100.0 / source).otherwise(0.0).cast("double").alias("match_percent"), (F.col("mismatched") + F.col("missing") + F.col("extra") == 0).alias("is_match"),
    )


def samples(diff: DataFrame, by: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each group of differences."""
    return diff.filter("category <> 'matching'").withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*(F.asc_nulls_first(c) for c in order)))).filter(F.col("rank") <= n)


def query_parity(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two queries give the same rows, in any order and each as often: row counts, rows of one side only, verdict."""
    d = multiset_diff(first, second)
    return d.agg(
        F.coalesce(F.sum("n_source"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("n_target"), F.lit(0)).alias("target_rows"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.coalesce(F.sum("extra"), F.lit(0)).alias("extra")
    ).withColumn("same", (F.col("missing") == 0) & (F.col("extra") == 0))
