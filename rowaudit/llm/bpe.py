"""BPE encoding and decoding of whole texts through a table of distinct words."""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .scratch import tidy


@functools.cache
def _encoder(tokenizer: str):
    """Read once in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer)
    encoder.no_truncation()
    encoder.no_padding()
    return encoder


@functools.cache
def _shown(tokenizer: str) -> tuple[pa.Array, pa.Array]:
    """Each id as text and its piece, both with a blank behind them."""
    encoder = _encoder(tokenizer)
    n = encoder.get_vocab_size(with_added_tokens=True)
    return pa.array([f"{i} " for i in range(n)]), pa.array([f"{encoder.id_to_token(i)} " for i in range(n)])


def _joined(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    each = [blocks.unsqueezed(d, np.uint32, np.uint32) for d in data]
    sizes, ids = (np.concatenate([x[k] for x in each]) if each else np.zeros(0, np.uint32) for k in range(2))
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), ids


def _answer(values: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> bytes:
    return blocks.squeezed(*(x.astype(np.uint32) for x in _taken(*values, at)))


def encoded_words(encoder, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids in turn."""
    sizes, ids = [], []
    for k in range(0, len(distinct), 5000):
        for e in encoder.encode_batch(distinct[k : k + 5000], add_special_tokens=False):
            own = e.ids
            sizes.append(len(own))
            ids += own
    return np.array(sizes, np.uint32), np.array(ids, np.uint32)


def _taken(ends: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that stand in turn in ``values``, those at ``at``: their sizes and values."""
    size = (ends[1:] - ends[:-1])[at]
    upto = np.cumsum(size)
    return size, values[np.repeat(ends[at] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]


def _sha(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts)[:-1].encode()).hexdigest()


@tidy
def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the text's ids and of their decoding.

    For a tokenizer that drops white space before it looks for pieces, and decodes by joining pieces with blanks, a
    text's ids are those of its words in turn.

    1. Words are split in Spark; a block of texts keeps its distinct words and the texts as numbers of these.
    2. The blocks' words meet by hash bucket, so all occurrences of a word in all blocks are in one bucket. There each
       distinct word of the corpus is encoded once, whether frequent or not.
    3. The ids go back to the blocks, which stay where they are stored, and join the words by position. Ids join the table of pieces (id, piece), which
       every task holds as it has the vocabulary's size, once for each distinct word of a block; texts are put together.

    ``tokenizer`` is the path of its file on every machine. A null text counts as empty: no tokens, and both digests of
    the empty string. Ids may be null or repeat; other columns are not read; very long texts are a block of their own.
    An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("flag"), F.col(text_col).alias("text"))
    parts = blocks.text_blocks(texts, lower=False)

    def encoded(table: pa.Table) -> pa.Table:
        seen = blocks.WordRows(table)
        sizes, ids = encoded_words(_encoder(tokenizer), seen.distinct)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        answers = [_answer((ends, ids), at) for at in seen.places]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array(answers, pa.binary())})

    answers = parts.words.repartition(parts.partitions, "bucket").groupBy("bucket").applyInArrow(encoded, blocks.SCHEMA)
    answers = parts.lowered(answers, _joined, _answer)

    def joined(block: blocks.BlockTexts, data: list[bytes]) -> pa.Table:
        ends, ids = _joined(data)
        place = block.by_number(np.arange(len(ends) - 1))  # of each word by number, among those by bucket
        size, ids = _taken(ends, ids, place)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        shown = [pc.binary_join(pa.ListArray.from_arrays(offsets, x.take(pa.array(ids))), "").to_pylist() for x in _shown(tokenizer)]
        tokens = np.concatenate([[0], np.cumsum(size[block.at])])[block.ends]
        sha: tuple[list[str], list[str]] = ([], [])
        for i, j in zip(block.ends[:-1].tolist(), block.ends[1:].tolist(), strict=True):
            own = block.at[i:j].tolist()
            for out, text in zip(sha, shown, strict=True):
                out.append(_sha([text[k] for k in own]))
        return pa.table({"doc_id": block.doc_id, "n_tokens": pa.array(np.diff(tokens)), "ids_sha256": pa.array(sha[0], pa.string()), "decoded_sha256": pa.array(sha[1], pa.string())})

    return blocks.per_block(parts.texts, answers, joined, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
