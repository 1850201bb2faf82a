"""Words of whole texts, split and numbered by Arrow inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a column, and row offsets into them. A null is an empty text; ``lower`` maps A-Z only."""
    text = pc.fill_null(text, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat = lists.flatten()
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=ends[1:])
    full = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(full).as_py():
        kept = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(full.to_numpy(zero_copy_only=False), out=kept[1:])
        flat, ends = flat.filter(full), kept[ends]
    return flat, ends


def numbered(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each word in the distinct words, and these."""
    if not len(flat):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


#: Bytes of text that a task works on at once, about.
SLICE = 8 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes of text, so memory depends on neither the batch nor the texts' lengths; a longer text comes alone."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            upto = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, upto + size, "right")))
            yield b.slice(start, stop - start)
            start = stop
