"""Runs of periodically repeated words, by a dictionary of basic factors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

RUN = "struct<start: long, length: long, period: long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"


def find_runs(word: np.ndarray, ends: np.ndarray, *, least: int = 24, power: int = 3) -> np.ndarray:
    """All runs of several texts: rows ``(text, start, length, period)``, sorted.

    ``word`` has the words' numbers, ``ends`` the texts' bounds in them. A run has its smallest period, at least
    ``max(least, power * period)`` words, and no neighbouring word continues it.

    The dictionary names each factor of 1, 2, 4, ... words, so that equal factors of a text have one name; a name of
    2w words is that of two names of w words. A factor that occurs once in its text has no longer one that occurs twice,
    so it is left out from then on. Occurrences of a factor of w words that follow each other within 2w words (so at
    most w apart) form arithmetic progressions whose difference is a period. In a run of period q, the first w with
    q <= w < 2q fits ``power`` periods with room to spare, each of its places sees its successor exactly q further on,
    and places side by side with one difference extend to the whole run: from the first place to the end of the last
    successor. Longer factors propose the same run again, so equal ones are folded."""
    if power < 3:
        raise ValueError("runs have three periods at least")
    size = np.diff(ends)
    longest = int(size.max(initial=0))
    text = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.repeat(size >= least, size))
    key = text[at] * (int(word.max(initial=0)) + 1) + word[at]
    name = np.full(len(word) + 1, -1, np.int64)
    found, width = [np.zeros((0, 4), np.int64)], 1
    while len(at) and width * power < 2 * longest:
        order = np.argsort(key, kind="stable")
        by_name = key[order]
        same = by_name[1:] == by_name[:-1]
        first, gap = at[order[:-1][same]], (at[order[1:]] - at[order[:-1]])[same]
        near = gap <= width
        first, gap = first[near], gap[near]
        by = np.lexsort((first, gap))
        first, gap = first[by], gap[by]
        cut = np.flatnonzero((gap[1:] != gap[:-1]) | (first[1:] != first[:-1] + 1)) + 1
        begin, last = np.concatenate([[0], cut])[: len(first)], np.concatenate([cut, [len(first)]])[: len(cut) + (len(first) > 0)] - 1
        start, period = first[begin], gap[begin]
        length = first[last] - start + width + period
        long = length >= np.maximum(least, power * period)
        start, length, period = start[long], length[long], period[long]
        found.append(np.stack([text[start], start - ends[text[start]], length, period], axis=1))
        # names of the next width, for places where both halves occur twice
        again = np.zeros(len(at), bool)
        again[order[:-1][same]] = again[order[1:][same]] = True
        named = np.empty(len(at), np.int64)
        named[order] = np.cumsum(np.concatenate([[0], ~same]))
        name[:] = -1
        name[at[again]] = named[again]
        at = at[again]
        at = at[at + 2 * width <= ends[text[at] + 1]]
        at = at[name[at + width] >= 0]
        key = name[at] * (len(order) + 1) + name[at + width]
        width *= 2
    return np.unique(np.concatenate(found), axis=0)


def _strongest(runs: np.ndarray) -> int:
    """The run of the greatest length by period, compared exactly; of equal ones that of the smallest start, then period."""
    best = 0
    for k in range(1, len(runs)):
        if int(runs[k, 2]) * int(runs[best, 3]) > int(runs[best, 2]) * int(runs[k, 3]):
            best = k
    return best


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 24, power: int = 3) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``runs``, the ``strongest`` of them, and the text ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` are those of ``find_runs``, by start, then period. The
    strongest has the greatest length by period (ties: smallest start, then period); it is null where there is no run.
    ``collapsed`` holds the words but for those that lie in a run behind its first period, joined by one blank.

    Nothing is shuffled. A task works on texts of some megabytes together, so that short ones cost no call each; a longer
    text comes alone, whole. A null or empty text has no words, no runs and collapses to the empty text. Ids may be null or
    repeat; other columns are not read. An empty table gives an empty result."""

    def found(batches):
        for b in words.slices(batches, size=4 << 20):
            flat, ends = words.split(b.column("text"), lower=False)
            at, _ = words.numbered(flat)
            runs = find_runs(at.astype(np.int64), ends, least=least, power=power)
            bounds = np.searchsorted(runs[:, 0], np.arange(b.num_rows + 1))
            gone = np.zeros(len(flat) + 1, np.int64)
            begin = ends[runs[:, 0]] + runs[:, 1]
            np.add.at(gone, begin + runs[:, 3], 1)
            np.add.at(gone, begin + runs[:, 2], -1)
            keep = np.cumsum(gone)[:-1] == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[ends]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), flat.filter(pa.array(keep))), " ")
            parts = [pa.array(runs[:, k]) for k in (1, 2, 3)]
            names = ["start", "length", "period"]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(parts, names))
            best = [int(i) + _strongest(runs[i:j]) if j > i else None for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            strongest = pa.StructArray.from_arrays(parts, names).take(pa.array(best, pa.int64()))
            yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(ends)), lists, strongest, collapsed], names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(found, SCHEMA)
