"""How quality filters act on each other: what each removes in every order, and what only it removes."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words

#: What the transducer puts out at a byte; INSIDE is its next state as well.
BEGIN, CAPITAL, POINT, SYMBOL, INSIDE = 1, 2, 4, 8, 16
SYMBOLS = b"#$%&*|"


def _transducer() -> np.ndarray:
    """Output by state (0: between words, 1: in one) and byte of UTF-8."""
    byte = np.arange(256)
    word = (byte != 0x20) & ((byte < 0x09) | (byte > 0x0D))
    out = np.zeros((2, 256), np.uint8)
    out[0, word] |= BEGIN
    out[:, word] |= INSIDE
    out[:, (byte >= ord("A")) & (byte <= ord("Z"))] |= CAPITAL
    out[:, byte & 0xC0 != 0x80] |= POINT  # any byte but a continuation
    out[:, list(SYMBOLS)] |= SYMBOL
    return out


_OUT = _transducer()


def text_counts(text: pa.Array) -> dict[str, np.ndarray]:
    """For each text ``n_words``, ``n_distinct`` words, ``n_capitals`` (A-Z), ``n_points`` (code points) and ``n_symbols``.

    One pass of a finite-state transducer over the bytes of all texts. Its state is known from the byte before, so a look-up
    in the table by state and byte is a step of all texts at once; each text starts between words. The spans of words go
    to a hash table that compares bytes (Arrow's dictionary encoding), so two words of one hash stay two."""
    text = text.fill_null("").cast(pa.large_string())
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    byte = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    state = np.zeros(len(byte) + 1, np.intp)
    state[1:] = _OUT[0, byte] & INSIDE > 0
    state[ends] = 0
    out = _OUT[state[:-1], byte]

    def per_text(bit: int) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(out & bit > 0)])[ends]
        return np.diff(upto)

    n_words = per_text(BEGIN)
    inside = out & INSIDE > 0
    before = np.concatenate([[0], np.cumsum(inside)])
    spans = np.append(before[:-1][out & BEGIN > 0], before[-1]).astype(np.int32)
    table = pa.Array.from_buffers(pa.binary(), len(spans) - 1, [None, pa.py_buffer(spans.tobytes()), pa.py_buffer(byte[inside].tobytes())]).dictionary_encode()
    kinds = max(1, len(table.dictionary))
    seen = np.unique(np.repeat(np.arange(len(text)), n_words) * kinds + table.indices.to_numpy())
    n_distinct = np.bincount(seen // kinds, minlength=len(text))
    return {"n_words": n_words, "n_distinct": n_distinct, "n_capitals": per_text(CAPITAL), "n_points": per_text(POINT), "n_symbols": per_text(SYMBOL)}


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def profiled(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the text but with its ``COUNTS``; a null text counts as empty. Where ``docs`` has a column of such a
    name, in any case, it is replaced. Nothing is shuffled."""
    kept = [c for c in docs.columns if c.lower() not in {*COUNTS, text_col.lower()}]
    text = "text"
    while text in {c.lower() for c in kept}:
        text = f"_{text}"
    docs = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(text))

    def counted(batches):
        for b in words.slices(batches, text, size=4 << 20):
            counts = text_counts(b.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], names=[*kept, *COUNTS])

    schema = docs.drop(text).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return docs.mapInArrow(counted, schema)


#: Failure conditions of texts by the letters of their filters; E, copies of texts with smaller ids, needs all texts.
TEXT_FILTERS: dict[str, Column | str] = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_points",
    "D": "n_symbols > 0",
}


def failures(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict[str, str] = TEXT_FILTERS) -> DataFrame:
    """``(part, mask, n, good, toxic)``: how many documents of a part fail just the filters in ``mask``, how many of these
    are labelled of quality, and toxic. Bit k stands for the k-th of ``filters``, the next one for copies.

    A copy's text is identical to that of a smaller id, known by its SHA-256. Copies need no row for each pair and no list
    of a group: rows of one text, part and label are folded in each task first, then hold their smallest id and how many
    have it; all but the rows of the text's smallest id are copies. So a text that a third of all rows hold is a few rows.
    A null id is no copy and has none. A null text counts as empty, a null part as the empty string. Of repeated labels of
    an id, any 1 counts. An empty table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("hash"), F.col(text_col).alias("text"))
    mask = F.lit(0)
    for k, failing in enumerate(filters.values()):
        mask = mask + F.when(F.expr(failing), 1 << k).otherwise(0)
    rows = profiled(rows).select("doc_id", "part", "hash", mask.alias("mask"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    no = F.lit(False)
    rows = rows.join(known, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    same = ["hash", "part", "mask", "good", "toxic"]
    of_id = rows.groupBy("doc_id", *same).agg(F.count(F.lit(1)).alias("n"))
    has_id = F.col("doc_id").isNotNull()
    folded = of_id.groupBy(*same).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("with_id"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(W.partitionBy("hash"))
    copies = F.col("with_id") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = folded.withColumn("least", least).withColumn("copies", copies)
    bit = 1 << len(filters)
    cases = split.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + bit).alias("mask"), F.col("copies").alias("n")))).alias("case"))
    n = lambda c: F.sum(F.when(c, F.col("case.n")).otherwise(0))
    return cases.groupBy("part", F.col("case.mask").alias("mask")).agg(n(F.lit(True)).alias("n"), n(F.col("good")).alias("good"), n(F.col("toxic")).alias("toxic"))


def interactions(cells: DataFrame, names: str) -> DataFrame:
    """For each part, each order of the filters and each step: documents ``kept`` after it, ``removed`` by it, ``redundant``
    (failing it, but removed before), ``unique_fails`` (failing nothing else), ``good_lost``, ``toxic_lost``, and ``shapley``, what
    its filter removes in all orders together.

    ``cells`` is the table of ``failures``: at most a row for each part and set of filters, and from it alone all orders
    follow. Of documents that fail s filters, each of these is the first one in the s-th part of the orders."""
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "bit": 1 << names.index(order[k]), "before": sum(1 << names.index(x) for x in order[:k])}
        for order in itertools.permutations(names) for k in range(len(names))
    ]
    at = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).select("part", "cells", F.explode(at).alias("at"))
    bit, before, orders = F.col("at.bit"), F.col("at.before"), math.factorial(len(names))

    def total(which, value) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda a, x: a + value(x))

    n = lambda x: x["n"]
    fails = lambda x: x["mask"].bitwiseAND(bit) != 0
    reaches = lambda x: x["mask"].bitwiseAND(before) == 0
    removed = lambda x: fails(x) & reaches(x)
    return rows.select(
        "part", "at.filter_order", "at.step", total(lambda x: ~fails(x) & reaches(x), n).alias("kept"), total(removed, n).alias("removed"), total(lambda x: fails(x) & ~reaches(x), n).alias("redundant"),
        total(lambda x: x["mask"] == bit, n).alias("unique_fails"), total(removed, lambda x: x["good"]).alias("good_lost"), total(removed, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: x["n"] * (F.lit(orders) / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``interactions`` of the four text filters and the copies filter (E), by language. See ``failures`` for odd rows."""
    return interactions(failures(docs, labels, **options), "".join([*TEXT_FILTERS, "E"]))
