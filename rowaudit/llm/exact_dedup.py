"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import tidy, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: F.Column) -> F.Column:
    """Lower-cases A-Z and nothing else; a text of one byte a character takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def content_hash(norm: F.Column) -> F.Column:
    """128 bits of a normalised text."""
    return F.unhex(F.md5(F.encode(norm, "UTF-8")))


def _fresh(taken: list[str], name: str) -> str:
    while name in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


#: The bitmap of shared hashes has SLOTS slots for each of them, and 2^MOST_BITS (128 MB) at most.
SLOTS, MOST_BITS = 16, 30


def _marked(docs: DataFrame, digest: str, shared: DataFrame, into: str) -> DataFrame:
    """``docs`` with whether their hash is among ``shared``, or looks so.

    A bitmap with a slot for each hash, in pages of 4 KB, goes to all tasks; its size follows the number of shared hashes and
    is bounded. Rows need no shuffle for it. A slot that two hashes have marks a row too many, never one too few; the share
    of these is a sixteenth at most, up to 67 million shared hashes, and grows beyond that."""
    n = shared.count()
    slots = 1 << min(MOST_BITS, max(15, (SLOTS * n).bit_length()))
    page, bits, at = _fresh(docs.columns, "page"), _fresh(docs.columns, "bits"), _fresh(docs.columns, "slot")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)) + 1
    of_page = shared.select(slot(F.col(shared.columns[0])).alias(at)).groupBy(F.bitmap_bucket_number(at).alias(page)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    place = F.bitmap_bit_position(slot(F.col(digest))).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1
    return docs.withColumn(page, F.bitmap_bucket_number(slot(F.col(digest)))).join(F.broadcast(of_page), page, "left").withColumn(into, F.coalesce(is_set, F.lit(False))).drop(page, bits)


@tidy
def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of=content_hash) -> DataFrame:
    """One row per input row: its id, ``keep_id`` (the smallest id of its group, or the largest with ``keep="max"``),
    ``group_size``, ``kept`` and ``text_sha256`` of the normalised text.

    Texts are equal when identical after lower-casing A-Z.

    1. Each row becomes its id and hashes; rows are grouped by the 128-bit hash, each task folding its own copies first.
    2. A bitmap of the hashes that more than one row has goes to the texts where they are stored. Those that it marks are
       compared byte by byte: they are grouped by hash and whole text, again folded in each task, so a text that holds a
       third of all rows is shuffled once a task. All others stay where they are, however large the table is.
    3. Where a hash has two texts, its rows are grouped by their texts; no such case is known, and tests force it.

    A null text counts as empty. A row with a null id is in its group but is never the one that stays, unless all ids of
    the group are null: then ``keep_id`` is null and ``kept`` false. Of rows that repeat the id that stays, each is kept.
    Other columns are not read. An empty table gives an empty result.
    """
    pick = F.min if keep == "min" else F.max
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    sha = F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("sha")
    hashed = written(base.select("doc_id", hash_of(F.col("norm")).alias("hash"), sha), "exact-hashes")
    groups = written(hashed.groupBy("hash").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    texts = _marked(base.withColumn("hash", hash_of(F.col("norm"))), "hash", groups.filter("group_size > 1").select("hash"), "marked").filter("marked")
    compared = texts.groupBy("hash", "norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clashes = written(compared.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("hash"), "exact-clashes")
    joined = hashed.join(groups, "hash")
    if clashes.limit(1).count():
        apart = texts.join(clashes, "hash", "left_semi").select("doc_id", "hash", "norm", sha)
        joined = joined.join(clashes, "hash", "left_anti").unionByName(apart.join(compared.join(clashes, "hash", "left_semi"), ["hash", "norm"]).drop("norm"))
    return joined.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


@tidy
def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the rows that repeat another row's text; all columns stay as they are.

    Each group of equal texts, as in ``exact_groups``, keeps one row: that of the smallest or largest id, one without an id
    only where all ids are null, any one where several rows have the id. Rows are told apart by their texts, never by
    their ids. Null texts count as empty and are copies of each other. Helper columns take names that ``docs`` doesn't have.
    An empty table gives an empty result.

    Rows that the bitmap of shared hashes doesn't mark pass where they are, without a shuffle; the others are ranked by hash
    and whole text, in each task first, so a hot text reaches the shuffle once a task."""
    text, digest, rank, marked = (_fresh(docs.columns, n) for n in ("norm", "hash", "rank", "marked"))
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    hashed = docs.withColumn(digest, content_hash(norm))
    shared = written(hashed.groupBy(digest).agg(F.count(F.lit(1)).alias(rank)).filter(F.col(rank) > 1).select(digest), "exact-shared")
    told = _marked(hashed, digest, shared, marked)
    order = F.asc_nulls_last(id_col) if keep == "min" else F.desc_nulls_last(id_col)
    ranked = told.filter(F.col(marked)).withColumn(text, norm).withColumn(rank, F.row_number().over(W.partitionBy(digest, text).orderBy(order)))
    return told.filter(~F.col(marked)).select(docs.columns).unionByName(ranked.filter(F.col(rank) == 1).select(docs.columns))
