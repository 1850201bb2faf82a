"""Class-based bigram language model: exchange clustering puts words into classes; transitions and emissions score texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .scratch import tidy, written

#: The most frequent words, which are exchanged one by one on the driver at first; classes; sweeps over all words after that.
CORE, CLASSES, SWEEPS = 1024, 60, 2
#: Class codes beyond the classes: a word not seen in training, and the end of a text. A word seen once has ONCE added.
UNSEEN, END, ONCE = 126, 127, 128
#: Neighbours of a word: its class (the end of a text behind all classes), and 64 more if it stands behind the word.
BEHIND = 64


def exchange(pairs: np.ndarray, n_words: int, classes: int, sweeps: int = 12) -> np.ndarray:
    """The class of each of the first ``n_words`` words, from bigram counts over these words and further fixed symbols.

    Each word in turn leaves its class and enters the one that gains most likelihood of the class bigram model (the sum of
    x log x over class bigrams, less that over both margins), until a sweep moves nothing."""
    extra = len(pairs) - n_words
    total = classes + extra
    cls = np.concatenate([np.arange(n_words) % classes, classes + np.arange(extra)])
    hot = np.zeros((len(pairs), total))
    hot[np.arange(len(pairs)), cls] = 1
    right, left = pairs @ hot, pairs.T @ hot  # by word: counts of the class behind it, before it
    m = hot.T @ right
    g = lambda x: x * np.log(np.maximum(x, 1e-12))
    for _ in range(sweeps):
        moved = 0
        for w in range(n_words):
            a, self_n = cls[w], pairs[w, w]
            r, lf = right[w].copy(), left[w].copy()
            r[a] -= self_n
            lf[a] -= self_n
            m[a] -= r
            m[:, a] -= lf
            m[a, a] -= self_n
            rows, cols = m.sum(axis=1), m.sum(axis=0)
            gain = (g(m + r) - g(m)).sum(axis=1) + (g(m + lf[:, None]) - g(m)).sum(axis=0)
            d = np.diag(m)
            gain += g(d + r + lf + self_n) + g(d) - g(d + r) - g(d + lf)
            n_r, n_l = r.sum() + self_n, lf.sum() + self_n
            gain -= g(rows + n_r) - g(rows) + g(cols + n_l) - g(cols)
            b = int(gain[:classes].argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            m[b] += r
            m[:, b] += lf
            m[b, b] += self_n
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return cls[:n_words]


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def _contexts(codes: np.ndarray, ends: np.ndarray, flag: np.ndarray, at: np.ndarray, end: int, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(word, neighbour, count)`` over texts that aren't flagged, sorted; and the codes of these texts with ``end`` before, between and behind them.
    ``codes`` are the words' by number; a neighbour of code ``none`` is left out."""
    train = np.repeat(flag == 0, np.diff(ends))
    size = np.diff(ends)[flag == 0]
    own = at[train].astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    symbols = np.full(len(own) + len(size) + 1, end, np.int64)
    where = np.arange(len(own)) + row + 1  # one end before each text
    symbols[where] = codes[own]
    before, behind = symbols[where - 1], symbols[where + 1]
    keys = np.concatenate([(own * 128 + before)[before != none], (own * 128 + BEHIND + behind)[behind != none]])
    keys, n = np.unique(keys, return_counts=True)
    return keys // 128, keys % 128, n, symbols


def best_classes(word: np.ndarray, neighbour: np.ndarray, n: np.ndarray, cls: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class for each word that gains most likelihood of the class bigram model, from its counts of neighbours.

    ``(word, neighbour, n)`` is sorted by word; ``cls`` is each word's class, or the number of classes where it has none
    yet; ``joint`` counts class bigrams, the end of a text last. A word's own counts are taken out of its class first.
    All words are moved at once against one matrix."""
    classes, words = len(joint) - 1, len(cls)
    gain = np.zeros((words, classes))
    if not len(word):
        return cls.copy()
    to = joint[:classes].astype(np.float64)  # class, class behind it
    sides = np.stack([joint[:, :classes].T.astype(np.float64), to])  # side, own class, neighbour's class
    side, c = neighbour // BEHIND, neighbour % BEHIND
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    for i in range(0, len(starts), 4096):
        lo, hi = starts[i], starts[i + 4096] if i + 4096 < len(starts) else len(word)
        s, k, m, w = side[lo:hi], c[lo:hi], n[lo:hi].astype(np.float64), word[lo:hi]
        there = sides[s, :, k]
        each = _g(there + m[:, None]) - _g(there)
        a = cls[w]
        own = np.flatnonzero(a < classes)
        held = there[own, a[own]]
        each[own, a[own]] = _g(held) - _g(np.maximum(held - m[own], 0))
        gain[w[np.concatenate([[True], w[1:] != w[:-1]])]] = np.add.reduceat(each, starts[i : i + 4096] - lo, axis=0)
    for s in (0, 1):
        margin = sides[s].sum(axis=1)
        total = np.bincount(word[side == s], n[side == s], minlength=words)
        kinds, kind = np.unique(total, return_inverse=True)
        gain -= (_g(margin + kinds[:, None]) - _g(margin))[kind]
        own = np.flatnonzero(cls < classes)
        gain[own, cls[own]] += (_g(margin + kinds[:, None]) - _g(margin))[kind[own], cls[own]]
        gain[own, cls[own]] -= _g(margin[cls[own]]) - _g(np.maximum(margin[cls[own]] - total[own], 0))
    best = gain.argmax(axis=1)
    own = np.flatnonzero(cls < classes)
    stay = gain[own, best[own]] <= gain[own, cls[own]] + 1e-9
    best[own[stay]] = cls[own[stay]]
    return best


def _by_number(block: blocks.BlockTexts, answers: list[bytes], *kinds: type) -> list[np.ndarray]:
    each = [blocks.unsqueezed(d, *kinds) for d in answers]
    return [block.by_number(np.concatenate([x[k] for x in each])) if each else np.zeros(0, kinds[k]) for k in range(len(kinds))]


def _values(*kinds: type):
    """How answers with one value of each kind for a word are put together and taken."""

    def join(data: list[bytes]) -> tuple[np.ndarray, ...]:
        each = [blocks.unsqueezed(d, *kinds) for d in data]
        return tuple(np.concatenate([x[k] for x in each]) if each else np.zeros(0, kind) for k, kind in enumerate(kinds))

    return join, lambda values, at: blocks.squeezed(*(v[at] for v in values))


def _summed(said: list[tuple[np.ndarray, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of neighbours by word * 128 + neighbour, sorted, of several blocks whose words have places in one list."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, data in said:
        size, neighbour, n = blocks.unsqueezed(data, np.uint32, np.uint8, np.uint64)
        keys.append(np.repeat(at, size).astype(np.int64) * 128 + neighbour)
        counts.append(n.astype(np.int64))
    keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return keys, total


def _added(said: list[tuple[np.ndarray, bytes]], words: int):
    keys, n = _summed(said)
    upto = np.concatenate([[0], np.cumsum(np.bincount(keys // 128, minlength=words))])

    def part(i: int, j: int) -> bytes:
        a, b = upto[i], upto[j]
        return blocks.squeezed(np.diff(upto[i : j + 1]).astype(np.uint32), (keys[a:b] % 128).astype(np.uint8), n[a:b].astype(np.uint64))

    return part


@tidy
def class_scores(docs: DataFrame, held_out: F.Column, *, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Tokens are the words of a text after lower-casing A-Z, and one end. The model learns from all rows where ``held_out``
    is false: log10 P(text) is the sum over tokens of log10 P(class | class before) * P(word | class).

    1. Texts become word numbers in blocks, whose words meet by hash bucket (``blocks``): there every word of the corpus
       has its count. Neither driver nor task ever holds the whole vocabulary.
    2. The ``core``, the most frequent words, is clustered by exchange on its bigram counts, a word at a time, to
       convergence. That gives the first classes.
    3. Exchange sweeps over all words: blocks count each word's neighbours by class, buckets sum these over the whole
       corpus and move each word to the class that gains most, against the matrix of class bigrams; then the classes go
       back to the blocks and the matrix is counted anew. In the first sweep only core words and ends have a class to be
       counted by. ``sweeps`` bounds the work: each one moves every word once.
    4. Class transitions are counted over all training texts. A word not seen in training is one more event; its
       probability behind a class is the share of words seen once there (Good and Turing), and it is followed as those are.

    All counts are sums of whole numbers and all ties fall to the lower class, so scores depend neither on partitions nor
    on the order of rows. ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))). A null text counts as empty:
    its end alone. Null ids and repeated rows are scored each. A null ``held_out`` counts as held out. Without any
    training text every class is equally likely. Other columns are not read. An empty table gives an empty result.
    """
    if not 0 < classes < BEHIND - 2:
        raise ValueError(f"classes lie between 1 and {BEHIND - 3}")
    spark = docs.sparkSession
    flag = F.coalesce(held_out, F.lit(True)).cast("int")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), flag.alias("flag"), F.col(text_col).alias("text"))
    parts = blocks.text_blocks(texts, lower=True)
    ends = texts.filter("flag = 0").count()

    def per_bucket(df: DataFrame, f, schema: str) -> DataFrame:
        return df.repartition(parts.partitions, "bucket").groupBy("bucket").applyInArrow(f, schema)

    def per_block(answers: DataFrame, f, schema: str) -> DataFrame:
        return blocks.per_block(parts.texts, answers, f, schema)

    # rows of a bucket: kind 0 its words with counts and classes, 1 the places of a block's words in them, 2 a block's counts of neighbours, 3 answers to a block
    rows = "kind int, block long, bucket long, data binary"

    def table(kind: list[int], block: list[int], bucket: int, data: list[bytes]) -> pa.Table:
        return pa.table({"kind": pa.array(kind, pa.int32()), "block": pa.array(block, pa.int64()), "bucket": pa.array([bucket] * len(kind), pa.int64()), "data": pa.array(data, pa.binary())})

    def counted(part: pa.Table) -> pa.Table:
        seen = blocks.WordRows(part)
        c = seen.counts()
        cls = np.full(len(c), classes, np.uint8)
        data = [blocks.squeezed(blocks.packed_words(pa.array(seen.distinct, pa.string())), c, cls), *(blocks.squeezed(at) for at in seen.places)]
        return table([0] + [1] * len(seen.block), [-1, *seen.block], part.column("bucket")[0].as_py(), data)

    lexicon = written(per_bucket(parts.words, counted, rows), "lm-lexicon")
    places = lexicon.filter("kind = 1")
    lexicon = lexicon.filter("kind = 0")

    def most_frequent(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                words, c, _ = blocks.unsqueezed(data, np.uint8, np.uint64, np.uint8)
                words = blocks.unpacked_words(words)
                top = np.argsort(-c.astype(np.int64), kind="stable")[:core]  # words stand in order
                top = top[c[top] > 0]
                yield pa.record_batch([pa.array([words[k] for k in top], pa.string()), pa.array(c[top].astype(np.int64))], names=["word", "c"])

    first = lexicon.select("data").mapInArrow(most_frequent, "word string, c long").orderBy(F.desc("c"), "word").limit(core)
    number = {r["word"]: k for k, r in enumerate(first.collect())}
    other, end, wide = len(number), len(number) + 1, len(number) + 2
    shared = spark.sparkContext.broadcast(number)

    def numbers(part: pa.Table) -> pa.Table:
        kind, block, data = (part.column(c).to_pylist() for c in ("kind", "block", "data"))
        words, *_ = blocks.unsqueezed(data[kind.index(0)], np.uint8, np.uint64, np.uint8)
        own = np.array([shared.value.get(w, other) for w in blocks.unpacked_words(words)], np.uint16)
        rest = [k for k, x in enumerate(kind) if x == 1]
        return table([3] * len(rest), [block[k] for k in rest], part.column("bucket")[0].as_py(), [blocks.squeezed(own[blocks.unsqueezed(data[k], np.uint32)[0]]) for k in rest])

    named = parts.lowered(written(per_bucket(lexicon.union(places), numbers, rows), "lm-numbers"), *_values(np.uint16))
    named = written(named, "lm-named") if parts.levels else named  # it is read twice

    def bigrams(block: blocks.BlockTexts, answers: list[bytes]) -> pa.Table:
        (codes,) = _by_number(block, answers, np.uint16)
        *_, symbols = _contexts(codes, block.ends, block.flag, block.at, end, -1)
        seen, n = np.unique(symbols[:-1] * wide + symbols[1:], return_counts=True)
        return pa.table({"k": pa.array(seen), "n": pa.array(n)})

    found = per_block(named, bigrams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row for each pair of core words at most
    pairs = np.zeros(wide * wide)
    pairs[found.column("k").to_numpy()] = found.column("n").to_numpy()
    pairs = pairs.reshape(wide, wide)
    cls = exchange(pairs, len(number), classes) if number else np.zeros(0, np.int64)
    of_number = np.concatenate([cls, [BEHIND - 1, classes]])  # of a core word, of all others, of an end
    kept = [*range(classes), classes]
    joint = np.zeros((BEHIND, BEHIND))
    np.add.at(joint, (of_number[:, None], of_number[None, :]), pairs)
    joint = joint[np.ix_(kept, kept)]

    def neighbours(block: blocks.BlockTexts, answers: list[bytes]) -> pa.Table:
        (codes,) = _by_number(block, answers, np.uint16)
        return around(block, model.value[codes])

    def neighbours_again(block: blocks.BlockTexts, answers: list[bytes]) -> pa.Table:
        (codes,) = _by_number(block, answers, np.uint8)
        return around(block, np.where(codes < classes, codes, BEHIND - 1))

    def around(block: blocks.BlockTexts, codes: np.ndarray) -> pa.Table:
        word, neighbour, n, symbols = _contexts(codes, block.ends, block.flag, block.at, classes, BEHIND - 1)
        size = np.bincount(word, minlength=len(block.order))
        start = np.concatenate([[0], np.cumsum(size)])
        data, bucket = [], []
        for b, own in block.by_bucket(np.arange(len(size))):
            each = size[own]
            upto = np.cumsum(each)
            at = np.repeat(start[own] - (upto - each), each) + np.arange(upto[-1])
            data.append(blocks.squeezed(each.astype(np.uint32), neighbour[at].astype(np.uint8), n[at].astype(np.uint64)))
            bucket.append(b)
        seen, many = np.unique(symbols[:-1] * BEHIND + symbols[1:], return_counts=True)
        none = pa.nulls(len(seen), pa.binary())
        return pa.table(
            {
                "kind": pa.array([2] * len(data) + [4] * len(seen), pa.int32()), "block": pa.array([block.id] * len(data) + many.tolist(), pa.int64()),
                "bucket": pa.array(bucket + seen.tolist(), pa.int64()), "data": pa.chunked_array([pa.array(data, pa.binary()), none]),
            }
        )

    def moved(part: pa.Table) -> pa.Table:
        kind, block, data = (part.column(c).to_pylist() for c in ("kind", "block", "data"))
        words, c, cls = blocks.unsqueezed(data[kind.index(0)], np.uint8, np.uint64, np.uint8)
        at = {block[k]: blocks.unsqueezed(data[k], np.uint32)[0] for k, x in enumerate(kind) if x == 1}
        keys, n = _summed([(at[block[k]], data[k]) for k, x in enumerate(kind) if x == 2])
        new = best_classes(keys // 128, keys % 128, n, cls.astype(np.int64), matrix.value)
        new = np.where(c > 0, np.minimum(new, classes - 1), classes).astype(np.uint8)
        code = np.where(c > 0, new, UNSEEN).astype(np.uint8)
        out = [blocks.squeezed(words, c, new), *(blocks.squeezed(code[own], c[own]) if last else blocks.squeezed(code[own]) for own in at.values())]
        return table([0] + [3] * len(at), [-1, *at], part.column("bucket")[0].as_py(), out)

    answers = named
    for k in range(max(1, sweeps)):
        last = k == max(1, sweeps) - 1
        model = spark.sparkContext.broadcast(of_number)
        seen = written(per_block(answers, neighbours_again if k else neighbours, rows), "lm-neighbours")
        if k:
            joint = np.zeros((BEHIND, BEHIND))
            for pair, n in seen.filter("kind = 4").groupBy("bucket").agg(F.sum("block")).collect():  # a row for each pair of classes
                joint[pair // BEHIND, pair % BEHIND] = n
            joint = joint[np.ix_(kept, kept)]
        matrix = spark.sparkContext.broadcast(joint)
        said = parts.raised(seen.filter("kind = 2"), _added).select(F.lit(2).alias("kind"), "block", "bucket", "data")
        state = written(per_bucket(lexicon.union(places).union(said), moved, rows), "lm-classes")
        lexicon, answers = state.filter("kind = 0"), parts.lowered(state.filter("kind = 3"), *_values(*((np.uint8, np.uint64) if last else (np.uint8,))))

    def summed(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                _, c, cls = blocks.unsqueezed(data, np.uint8, np.uint64, np.uint8)
                n, v = np.bincount(cls, c, minlength=classes + 1), np.bincount(cls, minlength=classes + 1)
                yield pa.record_batch([pa.array(np.arange(classes)), pa.array(n[:classes].astype(np.int64)), pa.array(v[:classes])], names=["cls", "n", "v"])

    totals, kinds = np.zeros(classes), 0
    for k, n, v in lexicon.select("data").mapInArrow(summed, "cls long, n long, v long").groupBy("cls").agg(F.sum("n"), F.sum("v")).collect():  # a row for each class
        totals[k], kinds = n, kinds + v
    tokens, kinds = int(totals.sum()) + ends, kinds + (ends > 0)
    floor = math.log10(tokens + 0.5 * (kinds + 1))

    def classified(block: blocks.BlockTexts, answers: list[bytes]) -> pa.Table:
        kind, c = _by_number(block, answers, np.uint8, np.uint64)
        c = c.astype(np.float64)
        base = np.log10(c + 0.5) - floor
        emit = np.where(c > 0, np.log10(np.maximum(c, 1)) - np.log10(np.maximum(totals, 1))[np.minimum(kind, classes - 1)], 0.0)
        code = kind + np.where(c == 1, ONCE, 0).astype(np.uint8)
        out = {"n_tokens": [], "n_known": [], "base": [], "emitted": [], "codes": []}
        for i, j in zip(block.ends[:-1].tolist(), block.ends[1:].tolist(), strict=True):
            at = block.at[i:j]
            out["n_tokens"].append(len(at) + 1)
            out["n_known"].append(int(np.count_nonzero(c[at])) + (ends > 0))
            out["base"].append(float(base[at].sum()) + math.log10(ends + 0.5) - floor)
            out["emitted"].append(float(emit[at].sum()))
            out["codes"].append(code[at].tobytes())
        kinds_of = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "emitted": pa.float64(), "codes": pa.binary()}
        return pa.table({"doc_id": block.doc_id, "held_out": pa.array(block.flag > 0), **{n: pa.array(v, kinds_of[n]) for n, v in out.items()}})

    coded = written(per_block(answers, classified, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emitted double, codes binary"), "lm-coded")

    def steps(codes: bytes) -> np.ndarray:
        s = np.empty(len(codes) + 2, np.int64)
        s[0] = s[-1] = END
        s[1:-1] = np.frombuffer(codes, np.uint8)
        return s[:-1] * 256 + s[1:]

    def transitions(batches):
        seen = np.zeros(1 << 16, np.int64)
        for b in batches:
            for codes in b.column(0).to_pylist():
                seen += np.bincount(steps(codes), minlength=1 << 16) if len(codes) > 1 << 14 else 0
                if len(codes) <= 1 << 14:
                    np.add.at(seen, steps(codes), 1)
        k = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(k), pa.array(seen[k])], names=["k", "n"])

    seen = np.zeros((256, 256))
    for k, n in coded.filter("not held_out").select("codes").mapInArrow(transitions, "k long, n long").groupBy("k").agg(F.sum("n")).collect():  # a row for each pair of codes
        seen[k // 256, k % 256] = n
    steps_of = spark.sparkContext.broadcast(_transition_table(seen, classes))

    def scored(batches):
        for b in batches:
            score = [e + float(steps_of.value[steps(codes)].sum()) for e, codes in zip(b.column("emitted").to_pylist(), b.column("codes").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), b.column("n_known"), pa.array(np.full(b.num_rows, tokens)), b.column("base"), pa.array(score, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _transition_table(seen: np.ndarray, classes: int, weight: float = 10.0) -> np.ndarray:
    """log10 P(code | code before), flat, from training counts by code: for classes and the end smoothed towards their shares, for unseen words by those seen once."""
    real = [*range(classes), END]
    once = [c + ONCE for c in range(classes)]
    counts = seen.copy()
    counts[UNSEEN] = seen[once].sum(axis=0)
    counts[:classes] += seen[once]  # a word seen once is a member of its class as well
    new = counts[:, once].sum(axis=1)
    to = counts[:, real].copy()
    to[:, :classes] += counts[:, once]
    total = to.sum(axis=1)
    share = (to[[*range(classes), END]].sum(axis=0) + 0.5) / (to[[*range(classes), END]].sum() + 0.5 * len(real))
    rate = (to[[*range(classes), END]].sum() and new[[*range(classes), END]].sum() / to[[*range(classes), END]].sum()) or 0.5
    rate = min(max(rate, 1e-6), 0.5)
    unseen = np.clip((new + weight * rate) / (total + weight), 1e-9, 0.9)
    p = np.full((256, 256), 1e-300)
    p[:, real] = (to + weight * share) / (total[:, None] + weight) * (1 - unseen)[:, None]
    p[:, once] = p[:, :classes]
    p[:, UNSEEN] = unseen
    p[once] = p[:classes]
    return np.log10(p).ravel()
