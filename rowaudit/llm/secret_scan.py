"""Secrets in texts: candidates by shape, and a random forest that takes the false ones out."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import tidy, written

#: Labelled findings that the forest is fitted on at most, of each label; dictionary words; hashed neighbouring words.
MOST_LABELLED, DICTIONARY, NEIGHBOURS = 10_000, 20_000, 16
#: Characters that a candidate has at least: key characters of a run by itself, printable ones where a cue assigns the value.
LONG, SHORT = 14, 6
#: Words before a value that name it a secret (fixed values).
CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "private_key", "credential")
#: Placeholders that look like values (fixed values).
PLACEHOLDERS = ("example", "changeme", "placeholder", "your_", "xxxx", "dummy", "sample", "redacted")

_CANDIDATE = re.compile(rf"[A-Za-z0-9+/=_.~-]{{{LONG},}}")
#: An assigned value goes on over all printable ASCII but blanks, quotes, commas, semicolons and round or pointed brackets.
_ASSIGNED = re.compile(rf"(?:{'|'.join(map(re.escape, CUES))})[\"']?\s*[=:]\s*[\"']?([!#$%&*+./0-9?@A-Z\[\\\]^_a-z{{|}}~-][!#$%&*+./0-9:=?@A-Z\[\\\]^_a-z{{|}}~-]{{{SHORT - 1},}})", re.I)
#: Formats that are secrets by their shape alone (fixed values).
_KNOWN = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*|sk_live_[0-9A-Za-z]{16,}")
_WORDLIKE = re.compile(r"[A-Za-z]+(?:[-/_.][A-Za-z]+)*[-/_.]*")
_CHARS = np.full(128, 3)
for _k, _set in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")):
    for _c in _set:
        _CHARS[ord(_c)] = _k

FEATURES = 22 + NEIGHBOURS
#: Places of the features that read what the labelling rules read beside a value's characters: what assigns it, cues, placeholders, neighbouring words.
RULED = (15, 18, 19, 20, *range(22, FEATURES))


def letter_pairs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log2 P(character | character before) over all texts, for the 128 ASCII characters (others count as one)."""

    def counted(batches):
        seen = np.zeros(128 * 128, np.int64)
        for b in words.slices(batches):
            text = b.column("text").fill_null("").cast(pa.large_string())
            _, ends, data = text.buffers()
            if data is not None and len(text):
                ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
                c = np.minimum(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], 127).astype(np.uint16)
                inside = np.ones(max(0, len(c) - 1), bool)
                border = ends[1:-1] - ends[0] - 1  # a text's last character and the next one's first are no pair
                inside[border[(border >= 0) & (border < len(inside))]] = False
                seen += np.bincount((c[:-1] * np.uint16(128) + c[1:])[inside], minlength=128 * 128)
        k = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(k), pa.array(seen[k])], names=["k", "n"])

    table = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # 128 x 128 rows at most
    n = np.zeros(128 * 128)
    n[table.column("k").to_numpy()] = table.column("n").to_numpy()
    n = n.reshape(128, 128) + 0.5
    return np.log2(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def word_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``(word, n)``: every distinct word of all texts and how often it occurs; each task folds its own words first."""

    def counted(batches):
        for b in words.slices(batches):
            flat, _ = words.split(b.column(0), lower=False)
            if len(flat):
                v = flat.value_counts()
                yield pa.record_batch([v.field("values"), v.field("counts")], names=["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words of ``counts`` above the least frequency that leaves at most ``most`` of them."""
    left, least = most, None
    by_n = counts.filter("n > 1").groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("w")).orderBy(F.desc("n"))
    for n, w in by_n.collect():  # a row for each frequency, 100,000 at most
        if w > left:
            break
        left, least = left - w, n
    return counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> frozenset[str]:
    """The most frequent words of letters over all texts, four letters or more."""
    counts = word_counts(docs.select(F.lower(F.col(text_col)).alias("text"))).filter(F.col("word").rlike("^[a-z]{4,13}$"))
    return frozenset(r[0] for r in frequent_words(written(counts, "secret-words"), most).select("word").collect())


def _covered(value: str, known: frozenset[str]) -> float:
    """The share of a value's characters that dictionary words cover, longest first from the left."""
    low, at, got = value.lower(), 0, 0
    while at < len(low):
        for n in range(min(13, len(low) - at), 3, -1):
            if low[at : at + n] in known:
                got += n
                at += n
                break
        else:
            at += 1
    return got / max(1, len(low))


def _features(text: str, a: int, b: int, pairs: np.ndarray, known: frozenset[str]) -> list[float]:
    value = text[a:b]
    codes = np.frombuffer(value.encode("ascii"), np.uint8)
    kinds = _CHARS[codes]
    share = np.bincount(kinds, minlength=4) / len(codes)
    counts = np.bincount(codes)
    p = counts[counts > 0] / len(codes)
    steps = pairs[codes[:-1], codes[1:]]
    before, behind = text[max(0, a - 40) : a], text[b : b + 40]
    low = before.lower()
    cue = max((low.rfind(c) + len(c) for c in CUES if c in low), default=-1)
    out = [
        len(value), float(steps.mean()), float(steps.min()), float(np.count_nonzero(kinds[:-1] != kinds[1:]) / len(codes)), _covered(value, known), *share.tolist(), float(-(p * np.log2(p)).sum()),
        float(len(counts[counts > 0]) / len(codes)), float(all(c in "0123456789abcdefABCDEF" for c in value)), float("/" in value), float("." in value), float("://" in before[-60:] or before.endswith("/")),
        float(before.rstrip().endswith(("=", ":"))), float(before.endswith(('"', "'"))), float(behind.startswith(('"', "'"))), float(cue >= 0), float(len(low) - cue if cue >= 0 else 99),
        float(any(x in value.lower() for x in PLACEHOLDERS)), float(value.endswith("=")),
    ]
    near = [0.0] * NEIGHBOURS
    for w in re.findall(r"[a-z]+", low)[-2:] + re.findall(r"[a-z]+", behind.lower())[:1]:
        near[sum(w.encode()) % NEIGHBOURS] = 1.0
    return [*out, *near]


def _label(text: str, a: int, b: int) -> int | None:
    """What is known without a model: 1 for a known format or a value that a cue assigns, 0 for placeholders and for words, None otherwise."""
    value, before = text[a:b], text[max(0, a - 40) : a].lower()
    if any(x in value.lower() for x in PLACEHOLDERS) or _WORDLIKE.fullmatch(value):
        return 0
    if _KNOWN.fullmatch(value):
        return 1
    if re.search(rf"(?:{'|'.join(map(re.escape, CUES))})[\"']?\s*[=:]\s*[\"']?$", before) and any(c.isdigit() for c in value):
        return 1
    return None


def _spans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        head = re.match(rf"(?:{'|'.join(map(re.escape, CUES))})=+", text[a:b], re.I)  # key=value in one run
        a += head.end() if head else 0
        b = _ended(text, a, b)
        if b - a >= LONG:
            out.append((a, b))
    # Values that a cue assigns are whole, whatever printable characters they hold. A long run inside one gives way to it; one
    # that starts inside a long run is part of that.
    starts = [a for a, _ in out]
    assigned = []
    for m in _ASSIGNED.finditer(text):
        a, b = m.span(1)
        if m.start() and text[m.start() - 1] in "?&":  # in a query, the next name starts there
            b = min(x for x in (b, *(k for k in (text.find("&", a, b), text.find("#", a, b)) if k >= 0)))
        b = _ended(text, a, b)
        k = bisect_left(starts, a) - 1
        if b - a >= SHORT and (k < 0 or out[k][1] <= a):
            assigned.append((a, b))
    ends = [b for _, b in assigned]
    free = [s for s in out if (k := bisect_right(ends, s[0])) == len(assigned) or assigned[k][0] >= s[1]]
    return sorted(free + assigned)


def _ended(text: str, a: int, b: int) -> int:
    while b > a and text[b - 1] in ".-~":
        b -= 1
    return b


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end, value, label, features)`` of every run of ``LONG`` or more key characters, and of every value of
    ``SHORT`` or more printable characters that a cue assigns; ``label`` is null where no rule knows it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((letter_pairs(docs, text_col), dictionary(docs, text_col)))

    def found(batches):
        for b in words.slices(batches):
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for a, e in _spans(text) if text else ():
                    rows.append((i, a, e, text[a:e], _label(text, a, e), _features(text, a, e, *shared.value)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "end", "value", "label", "features"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(found, "doc_id long, start long, end long, value string, label int, features array<double>")


def fit_forest(labelled: DataFrame, *, trees: int = 20, depth: int = 6, most: int = MOST_LABELLED) -> RandomForestClassificationModel | None:
    """A random forest on about ``most`` findings of each label, drawn by a hash of the value; None without both labels."""
    share = {r[0]: min(1.0, most / r[1]) for r in labelled.groupBy("label").count().collect()}
    if set(share) < {0, 1}:
        return None
    keep = F.when(F.col("label") == 1, math.ceil(share[1] * (1 << 20))).otherwise(math.ceil(share[0] * (1 << 20)))
    drawn = labelled.filter(F.pmod(F.xxhash64("value", "doc_id", "start"), F.lit(1 << 20)) < keep)
    rows = drawn.orderBy("label", "doc_id", "start").coalesce(1).select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("v"))
    return RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, seed=7, subsamplingRate=0.8).fit(rows)


@tidy
def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, hold_out: int = 5, ruled: bool = True, findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate: ``doc_id``, ``start``, ``end`` (code points, end exclusive), ``label``, ``held_out``, ``score`` and ``is_secret``.

    Candidates are all runs of 14 or more key characters in all texts, and values of 6 or more printable characters that a cue
    assigns, such as a password. Features: length, character transitions (against those of the whole corpus), classes and entropy, dictionary
    coverage, whether it lies in a path, what assigns it and the neighbouring words. The forest learns from findings that rules can label (known formats, values assigned to a
    cue; placeholders, plain words) of documents whose id's CRC is not 0 modulo ``hold_out``, and scores every candidate.
    Where a known rule says 0 or 1 is for the reader to compare; the score is the forest's alone. With ``ruled=False``
    the forest doesn't see the features that the rules read (``RULED``), so agreement with the labels is not the rule again.

    ``findings`` are labels from elsewhere, ``(doc_id, start, end, label)``: they replace what the rules say of a candidate, and may
    bring in kinds of secrets that no rule knows. Of repeated ones a 1 counts; those that are no candidate are not used.

    A null or empty text has no candidates; null ids and repeated rows are scanned each. With no labelled findings of
    either kind, the score is 0. Other columns are not read. An empty table gives an empty result.
    """
    rows = written(candidates(docs, id_col=id_col, text_col=text_col).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % hold_out == 0, F.lit(False))), "secret-candidates")
    if findings is not None:
        told = findings.filter("label is not null").groupBy("doc_id", "start", "end").agg(F.max("label").cast("int").alias("told"))
        rows = written(rows.join(told, ["doc_id", "start", "end"], "left").withColumn("label", F.coalesce("told", "label")).select(rows.columns), "secret-labelled")
    if not ruled:
        rows = rows.withColumn("features", F.transform("features", lambda x, i: F.when(i.isin(*RULED), 0.0).otherwise(x)))
    model = fit_forest(rows.filter("label is not null and not held_out"))
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(rows.withColumn("v", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", "label", "held_out", "score", (F.col("score") >= threshold).alias("is_secret"))
