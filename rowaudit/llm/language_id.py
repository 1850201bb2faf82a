"""Language identification by unigrams over a fixed vocabulary, with all segmentations of a word summed."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import tidy, written
from .token_counts import byte_symbols

#: The symbol behind a word's last byte.
END = 256
#: Passes of expectation and maximisation; counts are whole numbers of 1/UNIT; what is added to each piece's count.
SWEEPS, UNIT, ADDED = 2, 1024, 0.1
#: Words that are looked at together; scores of words that a task remembers at most.
GROUP, REMEMBERED = 50_000, 2_000_000


class Vocabulary:
    """Pieces of a byte-level vocabulary in a trie; a piece with the suffix matches only where the word ends.

    Each single byte, inside a word or at its end, is a piece, whatever the file holds: every word can be spelled."""

    def __init__(self, tokenizer: str, suffix: str = "</w>") -> None:
        with open(tokenizer, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = byte_symbols()
        pieces = {(b,) for b in range(256)} | {(b, END) for b in range(256)}
        for piece in vocab:
            ends = piece.endswith(suffix)
            body = piece[: -len(suffix)] if ends else piece
            if body and all(c in back for c in body):
                pieces.add((*(back[c] for c in body), END) if ends else tuple(back[c] for c in body))
        self.pieces = sorted(pieces)
        nodes, edges, numbers = 1, {}, [-1]
        for number, piece in enumerate(self.pieces):
            v = 0
            for s in piece:
                key = v * (END + 1) + s
                to = edges.get(key)
                if to is None:
                    to = edges[key] = nodes
                    nodes += 1
                    numbers.append(-1)
                v = to
            numbers[v] = number
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.to, self.number = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order], np.array(numbers)

    def lattice(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words: where each starts and ends among all their symbols, and every piece that stands in them: its start, its size, its number.

        All places walk down the trie at once, a symbol at a time."""
        flat = flat.cast(pa.large_string())
        _, offsets, data = flat.buffers()
        bounds = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
        byte = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        stop = bounds[1:] - bounds[0] + np.arange(1, len(flat) + 1)  # behind the end symbol
        symbol = np.full(len(byte) + len(flat), END, np.int64)
        inside = np.ones(len(symbol), bool)
        inside[stop - 1] = False
        symbol[inside] = byte
        start = np.concatenate([[0], stop[:-1]])
        at = np.flatnonzero(inside)
        node, size = np.zeros(len(at), np.int64), 0
        limit = np.repeat(stop, stop - start)[inside]
        found: list[list[np.ndarray]] = [[], [], []]
        while len(at):
            key = node * (END + 1) + symbol[at + size]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            at, node, limit, size = at[there], self.to[edge[there]], limit[there], size + 1
            number = self.number[node]
            full = number >= 0
            for out, x in zip(found, (at[full], np.full(int(full.sum()), size), number[full]), strict=True):
                out.append(x)
            more = at + size < limit
            at, node, limit = at[more], node[more], limit[more]
        return start, stop, *(np.concatenate(x) for x in found)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward(start: np.ndarray, stop: np.ndarray, first: np.ndarray, size: np.ndarray, value: np.ndarray, *, back: bool = False) -> np.ndarray:
    """For each place, the log of the summed probability of all ways to spell the word up to it (``back``: from it to the word's end).

    ``value`` holds the log probability of each piece found, for one language a column. Pieces are taken by their distance
    from the word's start (end) and their size: of these each word has one at most, so a step is a sum over all words at once.
    A word's places are those of its symbols and one behind it; that one is the next word's first, so words get one more."""
    word = np.searchsorted(stop, first, "right")
    out = np.full((int(stop[-1]) + len(stop), value.shape[1]), -np.inf)
    shift = word  # places of words that come later stand one further each
    frm, to = first + shift, first + size + shift
    if back:
        out[stop + np.arange(len(stop))] = 0.0
        step = stop[word] - first
    else:
        out[start + np.arange(len(start))] = 0.0
        step = first + size - start[word]
    order = np.lexsort((size, step))
    step, size = step[order], size[order]
    cuts = np.flatnonzero((step[1:] != step[:-1]) | (size[1:] != size[:-1])) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
        own = order[i:j]
        a, b = (to[own], frm[own]) if back else (frm[own], to[own])
        out[b] = _add(out[b], out[a] + value[own])
    return out


@dataclass
class Model:
    """Languages in order, log probability of each piece by language, and of each language."""

    langs: list[str]
    log_p: np.ndarray
    prior: np.ndarray


def word_scores(vocabulary: Vocabulary, distinct: pa.Array, log_p: np.ndarray) -> np.ndarray:
    """The log probability of each word by language, all its segmentations summed."""
    out = np.zeros((len(distinct), log_p.shape[1]))
    for k in range(0, len(distinct), GROUP):
        start, stop, first, size, number = vocabulary.lattice(distinct.slice(k, GROUP))
        out[k : k + GROUP] = forward(start, stop, first, size, log_p[number])[stop + np.arange(len(stop))]
    return out


class _Remembered:
    """Scores of the words that a task has met: each is spelled once, until there are too many to remember."""

    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray) -> None:
        self.vocabulary, self.log_p = vocabulary, log_p
        self.most = max(GROUP, REMEMBERED // max(1, log_p.shape[1]))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, self.log_p.shape[1]))

    def of(self, distinct: list[str]) -> np.ndarray:
        new = [w for w in distinct if w not in self.place]
        if len(self.place) + len(new) > self.most:
            self._forget()
            new = distinct
        if new:
            self.scores = np.concatenate([self.scores, word_scores(self.vocabulary, pa.array(new, pa.string()), self.log_p)])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        return self.scores[np.fromiter((self.place[w] for w in distinct), np.int64, len(distinct))]


def expected_pieces(vocabulary: Vocabulary, distinct: pa.Array, lang: np.ndarray, n: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur ``n`` times in a language, by piece and language, in whole 1/UNIT.

    Each word's share is rounded on its own, so sums don't depend on how the words are dealt."""
    out = np.zeros(log_p.shape, np.int64)
    for k in range(0, len(distinct), GROUP):
        start, stop, first, size, number = vocabulary.lattice(distinct.slice(k, GROUP))
        word = np.searchsorted(stop, first, "right")
        own = lang[k : k + GROUP][word]
        value = log_p[number, own][:, None]
        ahead, behind = forward(start, stop, first, size, value)[:, 0], forward(start, stop, first, size, value, back=True)[:, 0]
        whole = ahead[stop + np.arange(len(stop))]
        share = np.exp(ahead[first + word] + value[:, 0] + behind[first + size + word] - whole[word])
        np.add.at(out, (number, own), np.rint(share * n[k : k + GROUP][word] * UNIT).astype(np.int64))
    return out


def letters(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in lower case, runs of letters and their marks, and the texts' bounds in them."""
    return words.split(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), r"[^\p{L}\p{M}]+", " "), lower=False)


def _piece_table(counts: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.float64) / UNIT + ADDED
    return np.log(counts / counts.sum(axis=0))


@tidy
def train(docs: DataFrame, tokenizer: str, *, text_col: str = "text", lang_col: str = "lang", sweeps: int = SWEEPS) -> Model:
    """Learns from all rows with a language; others, and null texts, say nothing.

    Words are counted by language, in each task first; then each sweep spells every distinct word in all ways and sums how
    often each piece is expected. The driver holds a number for each piece of the vocabulary and language, no words.
    A language's prior is its share of the rows. ``tokenizer`` is the path of the vocabulary's file on every machine."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    langs = sorted(shares)
    vocabulary = Vocabulary(tokenizer)
    log_p = np.full((len(vocabulary.pieces), len(langs)), -np.log(len(vocabulary.pieces)))
    if not langs:
        return Model([], log_p, np.zeros(0))

    def counted(batches):
        seen: dict[tuple[str, str], int] = {}

        def rest():
            keys, n = list(seen), list(seen.values())
            seen.clear()
            return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for b in words.slices(batches, size=4 << 20):
            flat, ends = letters(b.column("text"))
            at, distinct = words.numbered(flat)
            of_lang, kinds = words.numbered(b.column("lang"))
            key, n = np.unique(np.repeat(of_lang.astype(np.int64), np.diff(ends)) * max(1, len(distinct)) + at, return_counts=True)
            names, kinds = distinct.to_pylist(), kinds.to_pylist()
            for lang, word, m in zip((key // max(1, len(distinct))).tolist(), (key % max(1, len(distinct))).tolist(), n.tolist(), strict=True):
                pair = (kinds[lang], names[word])
                seen[pair] = seen.get(pair, 0) + m
            if len(seen) > 400_000:
                yield rest()
        yield rest()

    table = written(rows.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    number = {lang: k for k, lang in enumerate(langs)}

    def expected(batches):
        total = None
        for b in batches:
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            seen = expected_pieces(held_vocabulary.value, b.column("word"), lang, b.column("n").to_numpy().astype(np.float64), held.value)
            total = seen if total is None else total + seen
        if total is not None:
            piece, lang = np.nonzero(total)
            yield pa.record_batch([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

    held_vocabulary = spark.sparkContext.broadcast(vocabulary)  # of the vocabulary's size
    for _ in range(sweeps):
        held = spark.sparkContext.broadcast(log_p)
        found = table.mapInArrow(expected, "piece long, lang long, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()  # a row for each piece and language at most
        counts = np.zeros(log_p.shape, np.int64)
        counts[found.column("piece").to_numpy(), found.column("lang").to_numpy()] = found.column("n").to_numpy()
        log_p = _piece_table(counts)
    prior = np.array([shares[x] for x in langs], np.float64)
    return Model(langs, log_p, np.log(prior / prior.sum()))


#: What texts without a letter get.
UNKNOWN = "und"


def predict(docs: DataFrame, model: Model, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``lang_pred`` and ``score``, the probability of that language among those learnt.

    A text's score under a language is the log of its prior and of all its words' probabilities, each over all
    segmentations into pieces. Ties fall to the first language in order. A null or empty text, one without a letter, or a
    model without languages gives ``und`` and 0. Whole texts are read; a task spells each distinct word
    once, as long as it remembers it (a bounded number). Ids may be null or repeat; other columns are not read; an empty table gives an empty result."""
    sc = docs.sparkSession.sparkContext
    held, vocabulary = sc.broadcast(model), sc.broadcast(Vocabulary(tokenizer))

    def told(batches):
        m, langs = held.value, np.array([*held.value.langs, UNKNOWN], object)
        spelled = _Remembered(vocabulary.value, m.log_p)
        for b in words.slices(batches, size=4 << 20):
            flat, ends = letters(b.column("text"))
            at, distinct = words.numbered(flat)
            none = ~pc.fill_null(pc.match_substring_regex(b.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if not m.langs:
                none[:] = True
            total = np.tile(m.prior, (b.num_rows, 1))
            if m.langs and len(flat):
                each = spelled.of(distinct.to_pylist())
                full = np.flatnonzero(np.diff(ends))
                total[full] += np.add.reduceat(each[at], ends[full], axis=0)
            best, score = np.full(b.num_rows, len(m.langs)), np.zeros(b.num_rows)
            if m.langs:
                best = np.where(none, len(m.langs), total.argmax(axis=1))
                score = np.where(none, 0.0, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1))
            yield pa.record_batch([b.column("doc_id"), pa.array(langs[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(told, "doc_id long, lang_pred string, score double")
