"""Texts as word numbers in blocks of bounded size, and the blocks' distinct words in buckets by hash.

What is learnt about a word must reach every place where it stands. Sending a row for each word of each block costs more
than the texts themselves. So a block sends one compressed row to each bucket instead, with all its words of that bucket
in a fixed order; a bucket answers with one row, values in the same order.

A row for each block and bucket would be too many where both grow with the input. So a block knows FAN buckets only, and
where there are more than FAN blocks they meet in levels: about FAN of them become one wider block, whose distinct words
of each bucket are dealt to FAN finer buckets, and so on until FAN wide blocks are left. Each level has about as many rows as the
first, FAN for each block; what is learnt comes down the same way.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import bucketed, written

#: A block ends behind the text that brings it to so many bytes or distinct words; buckets of a block, and blocks that meet in a wider one.
BLOCK_BYTES, BLOCK_WORDS, FAN = 12 << 20, 400_000, 256
#: Parts that the blocks' texts are stored in at most.
MOST_PARTS = 50_000
#: The bucket of rows that hold a block's texts.
TEXTS = -1
SCHEMA = "block long, bucket long, data binary"
#: Rows of a level: kind 0 words of a wide block, 1 places of a block's words in them, 2 how these are cut to finer buckets.
_LEVEL = "kind int, wide long, block long, bucket long, data binary"


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each byte of the numbers in a plane of its own: small numbers leave planes of zeros."""
    out = io.BytesIO()
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T) if len(a) else np.zeros(0, np.uint8)
        np.save(out, planes.ravel())
    return pa.compress(out.getvalue(), codec="zstd", asbytes=True) + len(out.getvalue()).to_bytes(8, "little")


def unsqueezed(data: bytes, *kinds: type) -> list[np.ndarray]:
    plain = io.BytesIO(pa.decompress(data[:-8], int.from_bytes(data[-8:], "little"), codec="zstd", asbytes=True))
    out = []
    for kind in kinds:
        planes = np.load(plain)
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel() if len(planes) else np.zeros(0, kind))
    return out


def packed_words(flat: pa.Array) -> np.ndarray:
    """Words as the bytes of one text; none of them holds a line break."""
    return np.frombuffer("\n".join(flat.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)


def unpacked_words(data: np.ndarray) -> list[str]:
    return bytes(data).decode("utf-8", "surrogatepass").split("\n") if len(data) else []


class _Block:
    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.at: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.flags: list[np.ndarray] = []
        self.bytes = 0

    def add(self, b: pa.RecordBatch, lower: bool) -> None:
        flat, ends = words.split(b.column("text"), lower=lower)
        at, distinct = words.numbered(flat)
        number = self.number
        place = np.fromiter((number.setdefault(w, len(number)) for w in distinct.to_pylist()), np.uint32, len(distinct))
        self.at.append(place[at])
        self.size.append(np.diff(ends))
        self.ids.append(b.column("doc_id"))
        self.flags.append(b.column("flag").to_numpy(zero_copy_only=False).astype(np.uint8))
        self.bytes += pc.sum(pc.binary_length(b.column("text"))).as_py() or 0

    def rows(self, block: int, buckets: int) -> pa.RecordBatch:
        at, size = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (self.at, self.size))
        flag = np.concatenate(self.flags) if self.flags else np.zeros(0, np.uint8)
        ids = pa.concat_arrays(self.ids)
        flat, n = pa.array(list(self.number), pa.string()), len(self.number)
        # frequent words get small numbers; behind ``order`` they stand by bucket and alphabet
        by_count = np.argsort(-np.bincount(at, minlength=n), kind="stable")
        rank = np.empty(n, np.uint32)
        rank[by_count] = np.arange(n, dtype=np.uint32)
        at = rank[at]
        flat = flat.take(pa.array(by_count))
        bucket = hashed(flat.to_pylist(), buckets)
        order = pc.sort_indices(pa.table({"b": pa.array(bucket), "w": flat}), sort_keys=[("b", "ascending"), ("w", "ascending")]).to_numpy()
        trained = np.bincount(at[np.repeat(flag == 0, size)], minlength=n).astype(np.uint64)[order]
        flat, bucket = flat.take(pa.array(order)), bucket[order]
        named, first, last = _cut(bucket)
        null, known = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8), pc.fill_null(ids, 0).to_numpy().astype(np.int64)
        data = [squeezed(known, null, flag, size.astype(np.int64), at, order.astype(np.uint32), named, (last - first).astype(np.uint32))]
        data += [squeezed(packed_words(flat.slice(i, j - i)), trained[i:j]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        return pa.record_batch([pa.array(np.full(len(data), block)), pa.array(np.append([TEXTS], named).astype(np.int64)), pa.array(data, pa.binary())], names=["block", "bucket", "data"])


def hashed(distinct: list[str], modulus: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % modulus for w in distinct), np.int64, len(distinct))


def _cut(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted buckets: those that occur, where each starts and ends."""
    named, first = np.unique(bucket, return_index=True)
    return named, first, np.append(first, len(bucket))[1:]


class Texts:
    """Texts in blocks, written, and what leads from them to the buckets of their words.

    ``texts`` has a row for each block (``BlockTexts`` reads it). ``words`` has rows ``(block, bucket, data)`` for ``WordRows``: the words of
    a block, or of a wide one where there are many, in one of ``buckets``, and how often they occur in texts that aren't flagged."""

    def __init__(self, texts: DataFrame, words_: DataFrame, fan: int) -> None:
        self.texts, self.words, self.levels, self.buckets, self.fan = texts, words_, [], fan, fan
        n = self.blocks = texts.count()
        while n > fan:
            n = -(-n // fan)
            wide = F.floor(F.col("block") / fan) if self.levels else F.pmod(F.xxhash64("block"), F.lit(n))
            grouped = self.words.select(wide.alias("wide"), "block", "bucket", "data").repartition(self._tasks(n * self.buckets), "wide", "bucket").groupBy("wide", "bucket")
            level = written(grouped.applyInArrow(self._merge(self.buckets * fan), _LEVEL), "level")
            self.levels.append(level.filter("kind > 0"))
            self.words = level.filter("kind = 0").select(F.col("wide").alias("block"), "bucket", "data")
            self.buckets *= fan
        self.partitions = self._tasks(self.buckets)

    def _tasks(self, groups: int) -> int:
        return int(min(groups, max(self.fan, self.blocks), MOST_PARTS))

    @staticmethod
    def _merge(finer: int) -> Callable[[pa.Table], pa.Table]:
        def merge(part: pa.Table) -> pa.Table:
            seen, wide, bucket = WordRows(part), part.column("wide")[0].as_py(), part.column("bucket")[0].as_py()
            fine = hashed(seen.distinct, finer)
            order = np.argsort(fine, kind="stable")  # by finer bucket and alphabet
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            flat, n = pa.array(seen.distinct, pa.string()).take(pa.array(order)), seen.counts()[order]
            named, first, last = _cut(fine[order])
            cuts = list(zip(first.tolist(), last.tolist(), strict=True))
            data = [squeezed(packed_words(flat.slice(i, j - i)), n[i:j]) for i, j in cuts] + [squeezed(rank[at]) for at in seen.places] + [squeezed(named, (last - first).astype(np.uint32))]
            kind = [0] * len(cuts) + [1] * len(seen.places) + [2]
            return pa.table({"kind": pa.array(kind, pa.int32()), "wide": pa.array([wide] * len(kind)), "block": pa.array([-1] * len(cuts) + seen.block + [-1], pa.int64()), "bucket": pa.array(named.tolist() + [bucket] * (len(kind) - len(cuts)), pa.int64()), "data": pa.array(data, pa.binary())})

        return merge

    def _met(self, level: DataFrame, rows: DataFrame, coarse: F.Column, wide: F.Column, f: Callable[[dict[int, np.ndarray], tuple[np.ndarray, np.ndarray], list[tuple[int, int, bytes]]], list[tuple[int, int, bytes]]]) -> DataFrame:
        """Rows of a level's groups together with the places of their blocks' words and the cuts to finer buckets."""

        def run(places: pa.Table, rows: pa.Table) -> pa.Table:
            at, cuts = {}, None
            for kind, block, data in zip(places.column("kind").to_pylist(), places.column("block").to_pylist(), places.column("data").to_pylist(), strict=True):
                if kind == 1:
                    at[block] = unsqueezed(data, np.uint32)[0]
                else:
                    cuts = tuple(unsqueezed(data, np.int64, np.uint32))
            wide, bucket = (places.column(c)[0].as_py() for c in ("wide", "bucket"))
            out = f(at, cuts, list(zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), rows.column("data").to_pylist(), strict=True)))
            block, bucket, data = ([wide if x[0] is None else x[0] for x in out], [bucket if x[1] is None else x[1] for x in out], [x[2] for x in out])
            return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "data": pa.array(data, pa.binary())})

        rows = rows.select("block", "bucket", "data").withColumns({"wide": wide, "coarse": coarse})
        return level.withColumn("coarse", F.col("bucket")).groupBy("wide", "coarse").cogroup(rows.groupBy("wide", "coarse")).applyInArrow(run, SCHEMA)

    def lowered(self, answers: DataFrame, join: Callable[[list[bytes]], tuple], take: Callable[[tuple, np.ndarray], bytes]) -> DataFrame:
        """Answers ``(block, bucket, data)`` to wide blocks, as answers to the blocks they are made of. ``join`` puts answers of
        several buckets together, ``take`` the values at some places."""
        buckets = self.buckets
        for level in reversed(self.levels):
            buckets //= self.fan

            def spread(at, cuts, rows):
                values = join([data for _, _, data in sorted(rows, key=lambda r: r[1])])
                return [(block, None, take(values, own)) for block, own in at.items()]

            answers = self._met(level, answers, F.col("bucket") % buckets, F.col("block"), spread)
        return answers

    def raised(self, rows: DataFrame, add: Callable[[list[tuple[np.ndarray, bytes]], int], Callable[[int, int], bytes]]) -> DataFrame:
        """What blocks say of their words, ``(block, bucket, data)``, as what wide blocks say. ``add`` gets the places of words and what is
        said of them for each block, and the number of words, and returns a function for the sum over words i to j."""
        for k, level in enumerate(self.levels):
            n = -(-self.blocks // self.fan ** (k + 1))
            wide = F.floor(F.col("block") / self.fan) if k else F.pmod(F.xxhash64("block"), F.lit(n))

            def gather(at, cuts, rows):
                stop = np.cumsum(cuts[1].astype(np.int64))
                total = add([(at[block], data) for block, _, data in rows], int(stop[-1]) if len(stop) else 0)
                return [(None, b, total(i, j)) for b, i, j in zip(cuts[0].tolist(), (stop - cuts[1]).astype(np.int64).tolist(), stop.tolist(), strict=True)]

            rows = self._met(level, rows, F.col("bucket"), wide, gather)
        return rows


def text_blocks(texts: DataFrame, *, lower: bool) -> Texts:
    """Texts ``(doc_id, flag, text)`` in blocks, written. A block's row of texts is stored by block, so what is learnt about its
    words joins it without moving it. Results must not depend on which texts share a block: that follows the input's
    partitions."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    fan, most_bytes, most_words = FAN, BLOCK_BYTES, BLOCK_WORDS

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = TaskContext.get().partitionId() << 24, _Block()
        for b in words.slices(batches, size=min(4 << 20, most_bytes)):
            if b.num_rows:
                now.add(b, lower)
            if now.bytes >= most_bytes or len(now.number) >= most_words:
                yield now.rows(block, fan)
                block, now = block + 1, _Block()
        if now.ids:
            yield now.rows(block, fan)

    whole = texts.mapInArrow(cut, SCHEMA).withColumn("is_text", F.col("bucket") == TEXTS)
    whole = bucketed(whole, "blocks", "block", min(MOST_PARTS, 1 + total // BLOCK_BYTES), apart="is_text")
    return Texts(whole.filter("is_text").drop("is_text"), whole.filter("not is_text").drop("is_text"), fan)


def per_block(texts: DataFrame, answers: DataFrame, f: Callable[[BlockTexts, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """``f`` of each block's texts and the answers of its buckets; only the answers are shuffled."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by = np.argsort(right.column("bucket").to_numpy(), kind="stable")
        data = right.column("data")
        return f(BlockTexts(left.column("data")[0].as_py(), left.column("block")[0].as_py()), [data[int(k)].as_py() for k in by])

    return texts.groupBy("block").cogroup(answers.select("block", "bucket", "data").groupBy("block")).applyInArrow(run, schema)


class BlockTexts:
    """A block's texts: its ``id``, ``doc_id`` (Arrow), ``flag``, ``ends`` of the texts in ``at``, the words' numbers."""

    def __init__(self, data: bytes, block: int = 0) -> None:
        self.id = block
        known, null, self.flag, size, self.at, self.order, self.named, self.counts = unsqueezed(data, np.int64, np.uint8, np.uint8, np.int64, np.uint32, np.uint32, np.int64, np.uint32)
        self.doc_id = pa.array(known, pa.int64(), mask=null.astype(bool))
        self.ends = np.concatenate([[0], np.cumsum(size)])

    def by_number(self, by_order: np.ndarray) -> np.ndarray:
        """Values of the words by bucket and alphabet, as values by number."""
        out = np.empty(len(by_order), by_order.dtype)
        out[self.order] = by_order
        return out

    def by_bucket(self, by_number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Values by number, cut to those of each bucket in its order."""
        values = by_number[self.order]
        stop = np.cumsum(self.counts)
        for b, i, j in zip(self.named.tolist(), (stop - self.counts).tolist(), stop.tolist(), strict=True):
            yield b, values[i:j]


class WordRows:
    """All rows of words of one bucket: the distinct words, and for each row its block and the places of its words in them."""

    def __init__(self, table: pa.Table) -> None:
        self.block = table.column("block").to_pylist()
        each = [unsqueezed(d, np.uint8, np.uint64) for d in table.column("data").to_pylist()]
        self.trained = [n for _, n in each]
        self.distinct: list[str] = sorted({w for data, _ in each for w in unpacked_words(data)})
        place = {w: k for k, w in enumerate(self.distinct)}
        self.places = [np.fromiter((place[w] for w in unpacked_words(data)), np.uint32) for data, _ in each]

    def counts(self) -> np.ndarray:
        """How often each distinct word occurs in all rows together."""
        n = np.zeros(len(self.distinct), np.uint64)
        for at, own in zip(self.places, self.trained, strict=True):
            n[at] += own
        return n
