"""Exact Jaccard self-join of word n-gram sets, by prefix trees over globally ordered sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import _Forest, components
from .scratch import bitmap_has, bitmap_of, slot_of, tidy, written
from .words import numbered, slices, split

#: Bytes of text that a task hashes at once, about.
PART = 4 << 20
#: Buckets of each of the two frequency sketches that order the n-grams: a megabyte each on the driver, whatever the corpus holds.
SKETCH = 1 << 17
#: A cell of the join takes at most about so many sets and so many n-grams.
CELL_SETS, CELL_GRAMS = 96, 1 << 20
#: Two sets that link share so many prefix n-grams at least (their prefixes are longer by as many less one).
LEAST = 4
#: Members of a prefix n-gram that are compared with each other by a plain join at most; more go to blocks of about BLOCK.
FEW, BLOCK = 16, 512
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64)


def gram_sets(text: pa.Array, words: int, rarity: np.ndarray | None = None, seen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each text, the sorted distinct 64-bit hashes of its ``words``-grams; of a shorter text, one hash of all its words; empty without words.

    With ``rarity`` (by word bucket), also the sum of it over the words of each n-gram. ``seen`` counts words by bucket."""
    flat, ends = split(text)
    at, distinct = numbered(flat)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    h = table[at]
    if seen is not None:
        seen += np.bincount(_slot(table), np.bincount(at, minlength=len(table)), minlength=SKETCH).astype(np.int64)
    grams, rare = np.zeros(0, np.uint64), None
    size = len(h) - words + 1
    if size > 0:
        grams = h[:size] * _A
        for k in range(1, words):
            grams = _mixed(grams) + h[k : size + k] * _C
        grams = _mixed(grams)
        if rarity is not None:
            each = rarity[_slot(table)][at]
            rare = sum(each[k : size + k] for k in range(words))
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if j - i >= words:
            if rarity is None:
                yield np.unique(grams[i : j - words + 1]), None
            else:
                own, first = np.unique(grams[i : j - words + 1], return_index=True)
                yield own, rare[i : j - words + 1][first]
        elif j > i:
            yield np.array([xxhash.xxh3_64_intdigest(h[i:j].tobytes(), seed=j - i)], np.uint64), np.zeros(1, np.float32)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.float32)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _key(digest: tuple[int, int], moved: dict[tuple[int, int], int], bits: int) -> int:
    """What joins know a set by: half of its digest, or the key it got instead. ``bits`` is less than 64 in tests only."""
    return moved.get(digest, digest[1] & ((1 << bits) - 1) if bits < 64 else digest[1])


def _with_keys(sets: DataFrame, bits: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """``sets`` with a ``key`` that no two of them share, and the keys that differ from the digest's half.

    With 64 bits, ten billion sets have about three such pairs, so these are few and go to the driver."""
    half = F.col("lo") if bits == 64 else F.col("lo").bitwiseAND((1 << bits) - 1)
    sets = sets.withColumn("key", half)
    twins = written(sets.groupBy("key").agg(F.min(F.struct("hi", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "gram-twins")
    late = twins.join(sets, "key").filter(F.struct("hi", "lo") != F.col("first")).select("hi", "lo").collect() if twins.limit(1).count() else []
    moved: dict[tuple[int, int], int] = {}
    salt = 0
    while late:
        salt += 1
        named = {(r["hi"], r["lo"]): xxhash.xxh3_64_intdigest(f"{r['hi']} {r['lo']}", seed=salt) - (1 << 63) for r in late}
        taken = {r[0] for r in sets.filter(F.col("key").isin(list(named.values()))).select("key").collect()} | set(moved.values())
        fresh = {d: k for d, k in named.items() if k not in taken and list(named.values()).count(k) == 1}
        moved |= fresh
        late = [r for r in late if (r["hi"], r["lo"]) not in fresh]
    if moved:
        table = sets.sparkSession.createDataFrame([(*d, k) for d, k in moved.items()], "hi long, lo long, other long")
        sets = written(sets.join(F.broadcast(table), ["hi", "lo"], "left").withColumn("key", F.coalesce("other", "key")).drop("other"), "distinct-sets")
    return sets, moved


def _keys(grams: np.ndarray, rare: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The n-grams as sorted integers whose order is the global one: first those of rare words, last those that many texts share, then by hash.

    Any order that depends on the n-gram alone gives the same links; this one makes prefixes that few texts share."""
    rank = often[_slot(grams)]
    rank = np.where(rank > 0, rank, rare.astype(np.uint64))
    return np.sort((rank << np.uint64(56)) | (grams >> np.uint64(8))).astype(np.int64)


def _prefix(n: int, num: int, den: int) -> int:
    """So many first n-grams in the global order that two sets of Jaccard num/den or more must share ``LEAST`` of them (or all that a small set has)."""
    overlap = -(-num * n // den)
    return n - overlap + min(LEAST, overlap)


def parity(grams: np.ndarray) -> bytes:
    """One bit for each bucket of n-grams: whether the set has an odd number there. As many buckets as n-grams, a power of two."""
    size = max(256, 1 << (len(grams) - 1).bit_length())
    return np.packbits((np.bincount((grams >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(a: np.ndarray, size: int) -> np.ndarray:
    while a.shape[-1] > size:
        half = a.shape[-1] // 2
        a = a[..., :half] ^ a[..., half:]
    return a


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of how many n-grams two sets don't share: each bucket whose parity differs holds one at least."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


@tidy
def gram_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 9, den: int = 10, key_bits: int = 64) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Two rows link when ``den * |A and B| >= num * |A or B|`` for their sets of distinct word ``words``-grams (a text with
    fewer words is one n-gram). Every link counts: no cap, no sampling, no signature that could miss one.

    1. One pass gives each row a 128-bit digest of its set, and sketches of word and n-gram frequencies over all rows. Rows
       of one digest are one set from here on, so copies cost nothing more, however many.
    2. The global order puts n-grams of rare words first and those that many texts share last. A set's prefix is so long
       that two sets which link share ``LEAST`` n-grams of their prefixes; prefix n-grams that one set alone has are
       dropped, the others name each set's *leader* there. Pairs of a set and its leader go on if they share enough,
       if their sizes allow a link, and if their parity bits don't rule it out.
    3. The members of a leader, in cells of bounded size, are stored in a prefix tree in the global order; walking a set
       through it shares the overlaps of common paths and leaves a subtree as soon as what remains can't reach the
       bound. A cell hands on a spanning forest of its links, not all pairs.
    4. Components of these links. Sets that share prefix n-grams, but lie in different components and were not compared
       yet, are compared in a second round; after it no pair is open. Where few sets share an n-gram, pairs pass the same
       filters. The family of a leader with many goes to pairs of bounded blocks instead: a pair of blocks tells which of
       its members parity bits don't rule out against every member of another component, then only these meet in a
       tree. So no pair of a family is ever a row: its rows are its members times its blocks.

    A null text counts as empty; a text without words has no n-grams and links with nothing (its component is its own
    id). Rows with a null id share the component of rows with the same set and are never the smallest id; a set that
    only rows with null ids have links with no other set, and its component is null. Repeated rows are one set. Sets are
    known by 128 bits; joins use 64 of them, and sets that share those get new ones first.
    ``num / den`` is a half or more. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches):
        of_grams, of_words = np.zeros(SKETCH, np.int64), np.zeros(SKETCH, np.int64)
        names = ["kind", "doc_id", "n", "hi", "lo", "sig"]
        for b in slices(batches, size=PART):
            each = [s for s, _ in gram_sets(b.column("text"), words, seen=of_words)]
            if each:
                of_grams += np.bincount(_slot(np.concatenate(each)), minlength=SKETCH)
            hi, lo = zip(*(_digest(s) if len(s) else (None, None) for s in each), strict=True) if each else ((), ())
            yield pa.record_batch([pa.array(np.zeros(len(each), np.int32)), b.column("doc_id"), pa.array([len(s) for s in each], pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array([parity(s) if len(s) else None for s in each], pa.binary())], names=names)
        for kind, counts in ((1, of_grams), (2, of_words)):
            k = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(counts[k]), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.binary())], names=names)

    scanned = written(texts.mapInArrow(scan, "kind int, doc_id long, n long, hi long, lo long, sig binary"), "gram-sets")
    rows = scanned.filter("kind = 0").drop("kind")
    sketch = np.zeros((2, SKETCH))
    summed = scanned.filter("kind > 0").groupBy("kind", "doc_id").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket of the two sketches at most
    sketch[summed.column("kind").to_numpy() - 1, summed.column("doc_id").to_numpy()] = summed.column("n").to_numpy()
    of_grams, of_words = sketch + 1
    often = np.where(of_grams > 2 * of_grams.mean(), np.clip(64 + 6 * np.log2(of_grams / of_grams.mean()), 64, 127), 0).astype(np.uint64)
    rarity = (np.log2(of_words) * min(1.0, 63 / (words * max(1.0, np.log2(of_words.max()))))).astype(np.float32)
    order = spark.sparkContext.broadcast((rarity, often))
    sets = written(rows.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n"), F.first("sig").alias("sig")), "distinct-sets")

    sets, moved = _with_keys(sets, key_bits)
    renamed = spark.sparkContext.broadcast(moved)
    by_lo = written(sets.select(F.col("key").alias("lo"), "rep", "sig"), "gram-signatures")

    def postings(batches):
        rarity, often = order.value
        done: set[int] = set()
        for b in slices(batches, size=PART):
            token, owner, size = [], [], []
            for s, rare in gram_sets(b.column("text"), words, rarity):
                n = len(s)
                if n and den * n >= num * (n + 1):  # else no other set of any size reaches the bound
                    lo = _key(_digest(s), renamed.value, key_bits)
                    if lo in done:
                        continue
                    if len(done) < 200_000:
                        done.add(lo)
                    p = _prefix(n, num, den)
                    token.append(_keys(s, rare, often)[:p])
                    owner.append(np.full(p, lo))
                    size.append(np.full(p, n))
            pos = [np.arange(len(t)) for t in token]
            if token:
                yield pa.record_batch([pa.array(np.concatenate(token)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(pos).astype(np.int32))], names=["token", "lo", "n", "pos"])

    posted = written(texts.mapInArrow(postings, "token long, lo long, n int, pos int"), "gram-prefixes")
    live = posted.groupBy("token").agg(F.min("lo").alias("leader"), F.max("lo").alias("last"), F.min_by("n", "lo").alias("leader_n"), F.count(F.lit(1)).alias("size"))
    live = written(live.filter("leader <> last").drop("last"), "gram-live")
    shared = written(posted.join(live, "token"), "gram-shared")
    hits = shared.filter("lo <> leader").groupBy("leader", "lo", "leader_n", "n").agg(F.count(F.lit(1)).alias("hits"))
    first = written(_plausible(hits.select("leader", "lo", F.col("leader_n").alias("na"), F.col("n").alias("nb"), "hits"), by_lo, num, den), "gram-pairs")

    def fetched(pairs: DataFrame) -> DataFrame:
        """The whole sets of all members of pairs, from the texts; only texts that may be wanted are hashed and shuffled."""
        named = pairs.select("lo").union(pairs.select(F.col("leader").alias("lo"))).distinct()
        reps = written(sets.join(named, F.col("key") == named["lo"], "left_semi").select("key", "rep"), "gram-candidates")
        wanted = spark.sparkContext.broadcast(bitmap_of(reps.filter("rep is not null"), slot_of(F.col("rep"))))

        def fetch(batches):
            rarity, often = order.value
            for b in slices(batches, size=PART):
                b = b.filter(pa.array(bitmap_has(wanted.value, b.column("slot").to_numpy())))
                lo, grams = [], []
                for s, rare in gram_sets(b.column("text"), words, rarity):
                    lo.append(_key(_digest(s), renamed.value, key_bits))
                    grams.append(_keys(s, rare, often).tobytes())
                yield pa.record_batch([b.column("doc_id"), pa.array(lo, pa.int64()), pa.array(grams, pa.binary())], names=["doc_id", "lo", "grams"])

        rows = texts.dropna(subset=["doc_id"]).withColumn("slot", slot_of(F.col("doc_id"))).mapInArrow(fetch, "doc_id long, lo long, grams binary")
        return written(rows.join(reps.select(F.col("rep").alias("doc_id"), F.col("key").alias("lo")), ["doc_id", "lo"], "left_semi").dropDuplicates(["lo"]), "gram-whole")

    labels = components(_cell_links(first, fetched(first), num, den))
    pairs, families = _open(shared, by_lo, first, labels, num, den)
    if pairs.limit(1).count() or families.limit(1).count():
        whole = fetched(pairs.select("leader", "lo").union(families.select("lo", "lo")))
        late = written(_cell_links(pairs, whole, num, den).union(_family_links(families, whole, num, den)), "gram-more-links")
        if late.limit(1).count():
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late))
    known = written(
        sets.join(labels, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("component", "rep").alias("component_id")), "gram-components"
    )
    linked = rows.filter("n > 0").join(known, ["hi", "lo"], "left")
    alone = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _cell_links(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` among each leader's members, found in cells of bounded size; a spanning forest of each cell."""
    size = pairs.groupBy("leader").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL_SETS), F.ceil(F.sum("n") / CELL_GRAMS)).alias("cells"))
    spread = written(pairs.join(size, "leader").select("leader", F.pmod(F.xxhash64("lo"), F.col("cells")).alias("cell"), "lo"), "gram-cells")
    members = spread.union(spread.select("leader", "cell", F.col("leader").alias("lo")).distinct())

    def cell(table: pa.Table) -> pa.Table:
        ids, sets = table.column("doc_id").to_pylist(), [np.frombuffer(x, np.int64) for x in table.column("grams").to_pylist()]
        edges = tree_links(ids, sets, num, den)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return members.join(whole, "lo").select("leader", "cell", "doc_id", "grams").groupBy("leader", "cell").applyInArrow(cell, "a long, b long")


class _Node:
    __slots__ = ("path", "below", "ends", "short", "long")

    def __init__(self, path: np.ndarray) -> None:
        self.path, self.below, self.ends, self.short, self.long = path, {}, [], 1 << 62, 0


def _common(a: np.ndarray, b: np.ndarray) -> int:
    k = min(len(a), len(b))
    off = np.flatnonzero(a[:k] != b[:k])
    return int(off[0]) if len(off) else k


def _insert(root: _Node, x: np.ndarray, i: int) -> None:
    n, node, rest = len(x), root, x
    while True:
        node.short, node.long = min(node.short, n), max(node.long, n)
        if not len(rest):
            node.ends.append((n, i))
            return
        child = node.below.get(int(rest[0]))
        if child is None:
            child = _Node(rest)
            child.short = child.long = n
            child.ends.append((n, i))
            node.below[int(rest[0])] = child
            return
        k = _common(child.path, rest)
        if k < len(child.path):
            upper = _Node(child.path[:k])
            upper.short, upper.long = child.short, child.long
            child.path = child.path[k:]
            upper.below[int(child.path[0])] = child
            node.below[int(rest[0])] = upper
            child = upper
        node, rest = child, rest[k:]


def _walk(root: _Node, x: np.ndarray, has: np.ndarray, num: int, den: int) -> Iterator[int]:
    """The sets below ``root`` that link with ``x``; ``has`` marks its n-grams."""
    n = len(x)
    stack = [(child, 0, 0) for child in root.below.values()]
    while stack:
        node, depth, got = stack.pop()
        if node.long * den < num * n or node.short * num > den * n:
            continue
        run = node.path
        got += int(np.count_nonzero(has[run]))
        depth += len(run)
        for m, j in node.ends:
            if (num + den) * got >= num * (n + m):
                yield j
        least = num * (n + node.short)
        if node.below and (num + den) * (got + node.long - depth) >= least and (num + den) * (got + n - int(np.searchsorted(x, run[-1], "right"))) >= least:
            stack.extend((child, depth, got) for child in node.below.values())


def tree_links(ids: list[int], sets: list[np.ndarray], num: int, den: int, *, block: list[int] | None = None, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets that are sorted in one global order.

    The sets go one by one, short ones first, into a tree whose nodes hold runs of n-grams and the least and greatest
    size below them. Before a set goes in, it walks the tree: the overlap with a node's run is found once for all sets
    below, and a subtree is left when its sizes are out of bounds, or when overlap so far plus the most that can still
    come (what is left of the walker after the run's last n-gram, or of the longest set below) misses the bound.

    With two values of ``block``, only sets of different blocks are compared: the first block is stored, the second walks.
    Sets of one value of ``known`` are connected already; links among them are left out."""
    root, forest, links = _Node(np.zeros(0, np.int64)), _Forest(), []
    least: dict[int, int] = {}
    for i, c in zip(ids, known or ids, strict=True):
        forest.join(least.setdefault(c, i), i)
    bounds = np.cumsum([0, *map(len, sets)])
    grams, local = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True)
    sets = [local[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]  # numbers in the same order
    has = np.zeros(len(grams), bool)
    block = block or [0] * len(ids)
    both = len(set(block)) < 2
    stored = min(block, default=0)
    for i in sorted(range(len(ids)), key=lambda i: (block[i], len(sets[i]))):
        if both or block[i] != stored:
            has[sets[i]] = True
            links += [(ids[i], ids[j]) for j in _walk(root, sets[i], has, num, den) if forest.join(ids[i], ids[j])]
            has[sets[i]] = False
        if block[i] == stored:
            _insert(root, sets[i], i)
    return links


def _required(na: F.Column, nb: F.Column, num: int, den: int) -> F.Column:
    return F.least(F.lit(LEAST), F.ceil(F.least(na, nb) * num / den))


def _fits(na: F.Column, nb: F.Column, num: int, den: int) -> F.Column:
    return F.least(na, nb) * den >= F.greatest(na, nb) * num


def _plausible(pairs: DataFrame, by_lo: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``(leader, lo, na, nb, hits)``, the pairs whose sizes, shared prefix n-grams and parity bits allow a link; ``(leader, lo, n)``."""
    a, b = F.col("na"), F.col("nb")
    likely = pairs.filter(_fits(a, b, num, den) & (F.col("hits") >= _required(a, b, num, den)))
    sig = by_lo.select("lo", "sig")
    both = likely.join(sig.withColumnRenamed("sig", "sb"), "lo").join(sig.select(F.col("lo").alias("leader"), F.col("sig").alias("sa")), "leader")

    def kept(batches):
        for b in batches:
            most = [(den - num) * (x + y) // (den + num) for x, y in zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), strict=True)]
            ok = [differ_at_least(x, y) <= m for x, y, m in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), most, strict=True)]
            yield b.select(["leader", "lo", "nb"]).rename_columns(["leader", "lo", "n"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(kept, "leader long, lo long, n int")


def _open(shared: DataFrame, by_lo: DataFrame, tested: DataFrame, labels: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """What may still link two components of ``labels``: pairs ``(leader, lo, n)`` that were not compared yet, from prefix
    n-grams that few sets have, and members of families ``(leader, i, j, own, lo, comp)`` by pairs of blocks."""
    members = by_lo.select("lo", "rep")
    where = members.join(labels, F.col("rep") == F.col("node"), "left").select("lo", F.coalesce("component", F.col("rep"), "lo").alias("comp"))
    placed = written(shared.select("token", "leader", "lo", "n", "size").join(where, "lo"), "gram-placed")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
    rest = written(placed.join(written(mixed, "gram-mixed"), "token", "left_semi"), "gram-open")
    few = rest.filter(F.col("size") <= FEW)
    a, b = (few.select("token", *(F.col(c).alias(c + s) for c in ("lo", "n", "comp"))) for s in "ab")
    near_by = a.join(b, "token").filter((F.col("loa") < F.col("lob")) & (F.col("compa") != F.col("compb")) & _fits(F.col("na"), F.col("nb"), num, den))
    hits = near_by.groupBy("loa", "lob", "na", "nb").agg(F.count(F.lit(1)).alias("hits"))
    pairs = _plausible(hits.select(F.col("loa").alias("leader"), F.col("lob").alias("lo"), "na", "nb", "hits"), by_lo, num, den)
    done = tested.select(F.least("leader", "lo").alias("leader"), F.greatest("leader", "lo").alias("lo"))
    pairs = written(pairs.join(done, ["leader", "lo"], "left_anti"), "gram-open-pairs")

    # Many n-grams of one family of sets have the same leader: its members meet once, not once for each n-gram.
    crowd = written(rest.filter(F.col("size") > FEW).select("leader", "lo", "n", "comp").distinct(), "gram-crowd")
    blocks = crowd.groupBy("leader").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / CELL_GRAMS)).alias("blocks"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    crowd = crowd.join(blocks.filter("x <> y").select("leader", "blocks"), "leader").join(by_lo.select("lo", "sig"), "lo").withColumn("own", F.pmod(F.xxhash64("lo"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k")
    dealt = crowd.select("leader", "own", "lo", "n", "comp", "sig", other).select("leader", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "lo", "n", "comp", "sig")

    def block(table: pa.Table) -> pa.Table:
        own, n, comp = (table.column(c).to_numpy() for c in ("own", "n", "comp"))
        sig = table.column("sig").to_pylist()
        return table.select(["leader", "i", "j", "own", "lo", "comp"]).filter(pa.array(_undecided(own, n.astype(np.int64), comp, sig, num, den)))

    families = dealt.groupBy("leader", "i", "j").applyInArrow(block, "leader long, i long, j long, own long, lo long, comp long")
    return pairs, written(families, "gram-families")


def _undecided(own: np.ndarray, n: np.ndarray, comp: np.ndarray, sig: list[bytes], num: int, den: int) -> np.ndarray:
    """For each set of a pair of blocks (or of one block), whether sizes and parity bits leave it a partner of another component, of the other block if there are two."""
    kept = np.zeros(len(sig), bool)
    two = len(np.unique(own)) > 1
    buckets = np.array([len(x) for x in sig])
    for size in np.unique(buckets).tolist():
        # sets whose sizes allow a link have as many buckets, or twice as many: compare each class with itself and the next
        small, large = np.flatnonzero(buckets == size), np.flatnonzero(buckets == 2 * size)
        bits = np.array([np.frombuffer(sig[k], np.uint64) for k in small])
        every = np.concatenate([small, large])
        wide = np.concatenate([bits, _folded(np.array([np.frombuffer(sig[k], np.uint64) for k in large]), bits.shape[1])]) if len(large) else bits
        for p, k in enumerate(small):
            ok = comp[every] != comp[k]
            if two:
                ok &= own[every] != own[k]
            ok &= np.minimum(n[every], n[k]) * den >= np.maximum(n[every], n[k]) * num
            ok = np.flatnonzero(ok)
            if len(ok):
                ok = ok[np.bitwise_count(wide[ok] ^ bits[p]).sum(axis=1) * (den + num) <= (den - num) * (n[every[ok]] + n[k])]
                kept[every[ok]] = True
                kept[k] |= bool(len(ok))
    return kept


def _family_links(families: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` between components among the members of each pair of blocks; a spanning forest of each."""

    def cell(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.int64) for x in table.column("grams").to_pylist()]
        edges = tree_links(table.column("doc_id").to_pylist(), sets, num, den, block=table.column("own").to_pylist(), known=table.column("comp").to_pylist())
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return families.join(whole, "lo").select("leader", "i", "j", "own", "comp", "doc_id", "grams").groupBy("leader", "i", "j").applyInArrow(cell, "a long, b long")


@tidy
def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one of the smallest id; all columns stay as they are.

    Rows are numbered first and linked by these numbers, so rows with null or repeated ids are rows like others: a row goes
    only if its own group keeps another. A row with a null id stays where its group has no id at all, one of them. Of rows
    that repeat both id and text of the row that stays, each is kept. Texts without words link with nothing and all stay. The
    helper column takes a name that ``docs`` doesn't have. An empty table gives an empty one."""
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row = f"_{row}"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "gram-rows")
    labels = gram_links(rows, id_col=row, text_col=text_col, words=words, num=num, den=den).select(F.col("doc_id").alias("_row"), "component_id")
    of_row = rows.select(F.col(row).alias("_row"), F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))).alias("hash"))
    members = labels.join(of_row, "_row").select("_row", "component_id", "hash", F.col("id").isNull().alias("no_id"), F.coalesce("id", "_row").alias("id"))
    first = members.groupBy("component_id").agg(F.min(F.struct("no_id", "id", "hash")).alias("x")).select("component_id", "x.*")
    gone = members.join(first, ["component_id", "no_id", "id", "hash"], "left_anti")
    return rows.join(gone.select(F.col("_row").alias(row)), row, "left_anti").select(docs.columns)
