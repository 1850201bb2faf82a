"""Variable-capacity best-fit packing of texts into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_counts, words
from .scratch import tidy, written

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces that one group packs, about.
SHARD = 20_000


def bin_cost(length: int, *, fixed: float = 32.0, linear: float = 1.0, square: float = 1 / 16384) -> float:
    """What a sequence costs to train on: an overhead, its tokens, and attention over them."""
    return fixed + linear * length + square * length * length


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost=bin_cost) -> tuple[list[int], list[int], list[int]]:
    """The bin and the place in it for each item, and the length of each bin.

    Largest items first. An item goes to the open bin that it leaves the least room in. Where none has room, a bin is
    opened, and all permitted lengths that hold the item compete for it: each is filled, on trial, with the largest items
    still unpacked that fit, again and again, then shrunk to the least length that holds these. The length whose trial
    costs least for each token opens the bin; of equal ones, the shorter. At the end each bin shrinks to the least length
    that holds its contents. Items must not exceed the greatest length; ties are broken by the items' order."""
    lengths, room = tuple(sorted(lengths)), []
    where, start, used = [0] * len(sizes), [0] * len(sizes), []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = [-sizes[i] for i in order]
    for at, i in enumerate(order):
        size = sizes[i]
        k = bisect_left(room, (size, -1))
        if k < len(room):
            gap, b = room.pop(k)
        else:
            gap = min((c for c in lengths if c >= size), key=lambda c: (_trial(size, c, falling, at + 1, lengths, cost), c))
            b = len(used)
            used.append(0)
        where[i], start[i] = b, used[b]
        used[b] += size
        if gap > size:
            insort(room, (gap - size, b))
    return where, start, [next(c for c in lengths if c >= u) for u in used]


def _trial(size: int, length: int, falling: list[int], at: int, lengths: tuple[int, ...], cost) -> float:
    """What a token costs in a bin of ``length`` with an item of ``size`` and what fits of the items from ``at`` on (negative sizes, rising)."""
    left = length - size
    while left and (at := bisect_left(falling, -left, at)) < len(falling) and falling[at]:
        left += falling[at]
        at += 1
    held = length - left
    return cost(next(c for c in lengths if c >= held)) / max(1, held)


@tidy
def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, lengths: tuple[int, ...] = LENGTHS, shard: int = SHARD) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece`` (0, 1, ...), ``from_token``, ``n_tokens``, ``bin_id``, ``bin_start``, ``bin_length``.

    With a ``tokenizer`` (the path of its vocabulary file on every machine), a text has the tokens that longest match
    finds, as in ``token_counts``; without one, a token is a word. Each text ends with one more for its end. A text longer
    than the greatest length is cut into pieces of that length and a rest, so every token of every text is in exactly one
    bin. Pieces are dealt by a hash into groups of about ``shard`` pieces, which grow in number with the input and not in
    size; each is packed on its own, so a bin that stays part-filled is one or a few in a group. The result doesn't depend
    on the number of partitions.

    A null or empty text is one token (its end). Null ids are allowed and dealt by their text; repeated rows are packed
    each. Columns other than the two named are not read. An empty table gives an empty result.
    """
    top = max(lengths)

    counter = docs.sparkSession.sparkContext.broadcast(token_counts.Automaton(token_counts.pieces_of(tokenizer))) if tokenizer else None

    def measured(batches):
        for b in words.slices(batches):
            n = token_counts.text_tokens(b.column("text"), counter.value) if counter else np.diff(words.split(b.column("text"), lower=False)[1])
            yield pa.record_batch([b.column("doc_id"), b.column("key"), pa.array(n + 1)], names=["doc_id", "key", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("key"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.col("key")))
    sized = written(rows.mapInArrow(measured, "doc_id long, key long, n long"), "pack-sizes")
    pieces = sized.select("doc_id", "key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / top) - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "key", "piece", (F.col("piece") * top).alias("from_token"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("n_tokens"))
    total = sized.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, -(-total // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "piece", F.lit(3)), F.lit(shards)))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("n_tokens", "ascending"), ("key", "ascending")])
        where, start, size = pack(table.column("n_tokens").to_pylist(), lengths)
        where = np.array(where, np.int64)
        return pa.table(
            {
                "doc_id": table.column("doc_id"), "piece": table.column("piece"), "from_token": table.column("from_token"), "n_tokens": table.column("n_tokens"),
                "bin_id": pa.array((key[0].as_py() << 32) + where), "bin_start": pa.array(start, pa.int64()), "bin_length": pa.array(np.array(size, np.int64)[where]),
            }
        )

    return dealt.groupBy("shard").applyInArrow(packed, "doc_id long, piece long, from_token long, n_tokens long, bin_id long, bin_start long, bin_length long")
