"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import tidy, written

#: Hashed features; features that the classifier may use; rows it is fitted on at most (confirmed toxic, unlabelled).
SLOTS, USED, MOST_POSITIVE, MOST_UNLABELLED = 1 << 20, 4096, 20_000, 20_000
#: A feature is a word or its first so many characters, and that it occurs once, twice or three times in a text.
PREFIXES, LEVELS = (4, 5, 6), 3
_SPREAD = 0x9E3779B1

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 32
_LETTERS[97:123] = np.arange(97, 123)


def letters_only(text: pa.Array) -> pa.Array:
    """Lower case, and every ASCII character but a-z to a blank; characters beyond ASCII stay. One table look-up over the whole column."""
    text = pa.concat_arrays([pc.utf8_lower(text.fill_null("").cast(pa.large_string()))])
    _, ends, data = text.buffers()
    mapped = _LETTERS[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(text), [None, ends, pa.py_buffer(mapped)])


def _word_features(distinct: list[str]) -> np.ndarray:
    """The slots of each word: its own and those of its beginnings; -1 where it is too short."""
    out = np.full((len(distinct), 1 + len(PREFIXES)), -1)
    digest = xxhash.xxh3_64_intdigest
    for i, w in enumerate(distinct):
        out[i, 0] = digest(w) & (SLOTS - 1)
        for k, n in enumerate(PREFIXES, 1):
            if len(w) >= n:
                out[i, k] = digest(w[:n], seed=n) & (SLOTS - 1)
    return out


def text_features(text: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each text's features, once each, by row; with ``used`` (a mask of slots), only of those."""
    flat, ends = words.split(letters_only(text), lower=False)
    at, distinct = words.numbered(flat)
    slots = _word_features(distinct.to_pylist())
    row = np.repeat(np.arange(len(text)), np.diff(ends))
    if used is not None:
        any_level = used.copy()
        for level in range(1, LEVELS):
            any_level |= used[(np.arange(SLOTS) + level * _SPREAD) & (SLOTS - 1)]
        slots = np.where((slots >= 0) & any_level[slots], slots, -1)
        told = (slots >= 0).any(axis=1)[at]
        row, at = row[told], at[told]
    own = slots[at]
    codes, n = np.unique((row[:, None] * SLOTS + own)[own >= 0], return_counts=True)
    every = [codes] + [(c := codes[n > level]) - c % SLOTS + ((c % SLOTS + level * _SPREAD) & (SLOTS - 1)) for level in range(1, LEVELS)]
    every = np.unique(np.concatenate(every))
    row, slot = every // SLOTS, every % SLOTS
    return (row, slot) if used is None else (row[used[slot]], slot[used[slot]])


@dataclass
class Model:
    """A linear classifier over the presence of features; ``weights`` has a place for each slot."""

    bias: float
    weights: np.ndarray

    def scores(self, text: pa.Array) -> np.ndarray:
        row, slot = text_features(text, self.weights != 0)
        z = self.bias + np.bincount(row, self.weights[slot], minlength=len(text))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], used: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimises the class-prior-corrected risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the sigmoid loss, whose
    bound keeps a few texts of great scores from outweighing the rest.

    ``positive`` and ``unlabelled`` hold the distinct slots of each text, of ``used`` only. Where the estimate of the
    negatives' risk turns negative, the step goes the other way on that part alone, so the classifier cannot fit the
    positives by calling everything else negative. Features are signs of the positives, so no weight is negative: a sign
    that a text shows can't be outweighed by others."""
    weights = np.zeros(SLOTS)
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), weights)
    n_p, n_u = len(positive), len(unlabelled)
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))

    def sparse(texts):
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        col = place[np.concatenate(texts)]
        return row[col >= 0], col[col >= 0], len(texts)

    def value(x, w, b):
        return b + np.bincount(x[0], w[x[1]], minlength=x[2])

    def pull(x, g):
        return np.bincount(x[1], g[x[0]], minlength=len(used))

    def sigmoid(t):
        return 1 / (1 + np.exp(-np.clip(t, -40, 40)))

    xp, xu = sparse(positive), sparse(unlabelled)
    w, b = np.zeros(len(used)), math.log(prior / (1 - prior))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        zp, zu = value(xp, w, b), value(xu, w, b)
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = su.mean() - prior * sp.mean()
        g_pos, g_neg_p, g_neg_u = -sp * (1 - sp) * prior / n_p, -sp * (1 - sp) * prior / n_p, su * (1 - su) / n_u
        if negative >= 0:
            gp, gu = g_pos + g_neg_p, g_neg_u
        else:
            gp, gu = -g_neg_p, -g_neg_u
        g = np.append(pull(xp, gp) + pull(xu, gu) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    weights[used] = w
    return Model(b, weights)


@tidy
def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fits on about ``most_positive`` rows that ``labels`` confirms as toxic and ``most_unlabelled`` rows of ``docs`` taken as unlabelled.

    Both are drawn by a hash of the id, so the same rows at any partitioning; exact copies count once. The class prior
    is the share of toxic rows among the labelled ones, or less where fewer of the unlabelled show any sign of them. Features enter when they are commoner among the positives
    than chance explains; at most ``USED``. Rows with a null id or label take no part as positives. Where labels are positives alone, the prior is 1, less only where
    few of the unlabelled texts show a sign of them; without such signs every text gets one score, so give some labels of 0 or many texts."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).dropna().groupBy("_id").agg(F.max("_label").alias("_label"))
    n_toxic, n_known = known.agg(F.count_if(F.col("_label") == 1), F.count(F.lit(1))).first()
    n_docs = docs.count()
    if not n_known or not n_docs or not n_toxic:
        return fit([], [], np.zeros(0, np.int64), 0.0)
    lot = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 20))
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), lot.alias("lot"))
    drawn = text.filter(F.col("lot") < math.ceil(min(1.0, most_unlabelled / n_docs) * (1 << 20))).select("text", F.lit(False).alias("toxic"))
    toxic = known.filter("_label = 1").filter(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 20)) < math.ceil(min(1.0, most_positive / n_toxic) * (1 << 20)))
    # The ids drawn are bounded by ``most_positive``, so they go to all tasks and no text is shuffled for them.
    named = text.join(F.broadcast(toxic.select("_id")), "_id", "left_semi").select("text", F.lit(True).alias("toxic"))

    def featured(batches):
        for b in batches:
            for part in words.slices([b], size=4 << 20):
                row, slot = text_features(part.column("text"))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                slots = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(slot.astype(np.int32)))
                yield pa.record_batch([part.column("toxic"), part.column("sig"), slots], names=["toxic", "sig", "slots"])

    once = named.union(drawn).withColumn("sig", F.xxhash64("text")).dropDuplicates(["toxic", "sig"])
    sample = written(once.mapInArrow(featured, "toxic boolean, sig long, slots array<int>"), "toxic-sample")
    n_p, n_u = sample.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()

    def frequencies(batches):
        seen = np.zeros((2, SLOTS), np.int64)
        for b in batches:
            slots = b.column("slots")
            ends = np.diff(slots.offsets.to_numpy())
            toxic = np.repeat(b.column("toxic").to_numpy(zero_copy_only=False).astype(bool), ends)
            flat = slots.flatten().to_numpy()
            seen[0] += np.bincount(flat[~toxic], minlength=SLOTS)
            seen[1] += np.bincount(flat[toxic], minlength=SLOTS)
        k = np.flatnonzero(seen.any(axis=0))
        yield pa.record_batch([pa.array(k), pa.array(seen[1, k]), pa.array(seen[0, k])], names=["slot", "p", "u"])

    shares = sample.mapInArrow(frequencies, "slot long, p long, u long").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    both = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (F.col("p") / max(1, n_p) - F.col("u") / max(1, n_u)) / F.sqrt(both * (1 - both) * (1 / max(1, n_p) + 1 / max(1, n_u)))
    strong = shares.filter((F.col("p") + F.col("u") >= 5) & (F.col("p") >= 0.005 * n_p)).withColumn("z", z).filter("z > 5")
    used = np.array(sorted(r[0] for r in strong.orderBy(F.desc("z"), "slot").limit(USED).select("slot").collect()), np.int64)
    if not n_p or not n_u:
        return fit([], [], used, n_toxic / n_known)
    mask = np.zeros(SLOTS, bool)
    mask[used] = True

    def told(batches):
        for b in batches:
            slots = b.column("slots")
            flat = slots.flatten().to_numpy()
            kept = np.zeros(len(flat) + 1, np.int32)
            np.cumsum(mask[flat], out=kept[1:])
            ends = slots.offsets.to_numpy() - slots.offsets[0].as_py()
            yield pa.record_batch([b.column("toxic"), b.column("sig"), pa.ListArray.from_arrays(pa.array(kept[ends]), pa.array(flat[mask[flat]]))], names=["toxic", "sig", "slots"])

    # What share of the unlabelled texts shows a sign of the positives bounds the prior from above.
    table = sample.mapInArrow(told, "toxic boolean, sig long, slots array<int>").orderBy("toxic", "sig").toArrow()
    is_toxic = table.column("toxic").to_pylist()
    sets = [np.array(x, np.int64) for x in table.column("slots").to_pylist()]
    positive, unlabelled = ([s for s, t in zip(sets, is_toxic, strict=True) if t == side] for side in (True, False))
    df_p, df_u = (np.bincount(np.concatenate(x), minlength=SLOTS) / len(x) for x in (positive, unlabelled))
    sign = df_p > 3 * df_u
    shown_p, shown_u = (np.mean([bool(sign[s].any()) for s in x]) for x in (positive, unlabelled))
    prior = min(n_toxic / n_known, 0.9 * shown_u / shown_p) if shown_p > 0.1 else n_toxic / n_known
    return fit(positive, unlabelled, used, prior)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a double from 0 to 1: higher, likelier toxic. A null or empty text gets the score of a text without words. A column that is named
    ``into`` is replaced; all others pass as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index(text_col), docs.drop(into).schema.add(into, "double", False)

    def scored(batches):
        for b in words.slices(batches, text_col):
            kept = [i for i, name in enumerate(b.schema.names) if name != into]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(shared.value.scores(b.column(at)))], names=[*(b.schema.names[i] for i in kept), into])

    return docs.mapInArrow(scored, schema)
