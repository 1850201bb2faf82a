"""Word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

class Automaton:
    """A trie of pieces with failure links and the number of pieces that each link pops.

    Greedy longest match of a word takes the longest piece that starts at its left end, then goes on behind it. Where the
    trie has no edge for the next symbol, the failure link of the node leads to the node where that greedy match would
    stand, and ``pops`` tells how many pieces it would have cut off on the way; so each symbol is read once and the
    pieces themselves are never built."""

    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            v = 0
            for s in piece:
                to = self.next[v].get(s)
                if to is None:
                    to = self.next[v][s] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                v = to
            ends[v] = v > 0
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for s, to in self.next[v].items():
                queue.append(to)
                if ends[to]:
                    self.fail[to], self.pops[to] = 0, 1
                    continue
                z, popped = self.fail[v], self.pops[v]
                while z >= 0 and s not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[to], self.pops[to] = self.next[z][s], popped

    def count(self, symbols) -> int:
        """How many pieces the word has; -1 if the pieces can't spell it by longest match."""
        node, n, edges, fail, pops = 0, 0, self.next, self.fail, self.pops
        for s in symbols:
            to = edges[node].get(s)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
                to = edges[node].get(s)
            node = to
        while node > 0:
            n += pops[node]
            node = fail[node]
        return n if node == 0 else -1


def byte_symbols() -> dict[str, int]:
    """The byte for each character of byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces_of(tokenizer: str, suffix: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file as bytes; the suffix that marks a word's end is taken off."""
    with open(tokenizer, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back, out = byte_symbols(), []
    for piece in vocab:
        body = piece[: -len(suffix)] if suffix and piece.endswith(suffix) else piece
        if body and all(c in back for c in body):
            out.append(tuple(back[c] for c in body))
    return out


def word_tokens(text: pa.Array, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each word in the distinct words, the texts' bounds, and each word's pieces (-1 if it can't be spelled); each distinct word is counted once."""
    flat, ends = words.split(text)
    at, distinct = words.numbered(flat)
    n = np.fromiter((automaton.count(w.encode()) for w in distinct.to_pylist()), np.int64, len(distinct))
    return at, ends, n[at]


def _per_text(each: np.ndarray, ends: np.ndarray) -> np.ndarray:
    run = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=run[1:])
    return run[ends[1:]] - run[ends[:-1]]


def text_tokens(text: pa.Array, automaton: Automaton) -> np.ndarray:
    """The pieces of each text; a word that can't be spelled is one."""
    _, ends, n = word_tokens(text, automaton)
    return _per_text(np.abs(n), ends)


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_pieces`` and ``n_unknown``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a word's bytes are cut by greedy longest match over the
    vocabulary's pieces. A word that can't be spelled counts as one piece, and in ``n_unknown``. The automaton is built
    once from the vocabulary (of fixed size) and sent to the tasks; a batch counts each distinct word once. A null or empty
    text has zeros; ids may be null or repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces_of(tokenizer)))

    def counted(batches):
        for b in words.slices(batches):
            _, ends, n = word_tokens(b.column("text"), shared.value)
            yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(ends)), *(pa.array(_per_text(x, ends)) for x in (np.abs(n), (n < 0).astype(np.int64)))], names=["doc_id", "n_words", "n_pieces", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_words long, n_pieces long, n_unknown long")
