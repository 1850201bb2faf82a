"""Exact range join of vectors by cosine: pivots partition them, the triangle inequality bounds what crosses a border."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import tidy, written

#: Vectors that the pivots are chosen from, pivots of cells and of balls at most, vectors in a block.
SAMPLE, MOST_CELLS, MOST_BALLS, BLOCK = 2048, 512, 64, 4096
PER_CELL = 6000
_SAFE = 1e-7


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of length one, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    big = np.abs(flat).max(axis=1, keepdims=True)
    flat = flat / np.where(big > 0, big, 1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def choose_pivots(unit: np.ndarray, cells: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Cell pivots (each as far as can be from those before) and ball pivots (with many sample vectors within half the radius), from a bounded sample."""
    far, picked = np.full(len(unit), np.inf), [0]
    for _ in range(min(cells, len(unit)) - 1):
        far = np.minimum(far, 2 - 2 * unit @ unit[picked[-1]])
        if far.max() <= _SAFE:
            break
        picked.append(int(far.argmax()))
    near = unit @ unit.T >= 1 - (radius / 2) ** 2 / 2
    balls, free = [], np.ones(len(unit), bool)
    while len(balls) < MOST_BALLS:
        size = (near & free).sum(axis=1) * free
        best = int(size.argmax())
        if size[best] < 4:
            break
        balls.append(best)
        free &= ~near[best]
    return unit[picked], unit[balls].reshape(-1, unit.shape[1])


@tidy
def vector_links(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links`` (other rows of cosine ``cosine`` or more), ``component_id`` (the smallest id that links reach) and ``kept``.

    Exact, in double precision: for unit vectors, cosine t is the distance sqrt(2 - 2t), so a range join of a metric.

    1. Equal vectors become one row with a multiplicity, before anything else.
    2. From a sample of at most ``SAMPLE`` vectors come pivots. A vector within half the radius of a *ball* pivot is in
       that ball; by the triangle inequality a ball's members all link, so they are only counted. Any other vector that
       links with a member lies within one and a half radii of the pivot, and only those are copied to the ball.
    3. Vectors in no ball go to the cell of the nearest cell pivot, and also to each cell with a smaller number whose
       border is within the radius: half the difference of the squared distances over the distance of the two pivots.
    4. Each cell, cut into blocks of at most about ``BLOCK`` vectors, is joined on its own by matrix products. A block
       hands on link counts and, for each linked vector, the smallest id of its part; no list of pairs leaves a task.

    Vectors that are null, zero, empty or hold a null or non-finite component link with nothing, and so do vectors of
    different lengths. Repeated rows link with each other. A null id takes part in links but is never the smallest id
    (and stays null if its group has no other). Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    radius = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    whole = rows.filter("sound").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    points = written(whole.select("v", "rep", "mult", F.monotonically_increasing_id().alias("node"), F.size("v").alias("dim")), "vectors")
    parts = [_dim_links(points.filter(F.col("dim") == dim), dim, n, radius, cosine) for dim, n in points.groupBy("dim").count().collect()]
    found = parts[0] if parts else spark.createDataFrame([], "node long, n long, to long")
    for p in parts[1:]:
        found = found.union(p)
    found = written(found, "vector-links")
    degree = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found.filter("to is not null"), "node", "to")
    placed = points.select("v", "node", "rep", "mult").join(degree, "node", "left").join(labels, "node", "left")
    placed = written(placed.select("v", "rep", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("part")), "vector-parts")
    least = placed.groupBy("part").agg(F.min("rep").alias("component_id"))
    placed = written(placed.join(least, "part").select("v", "n_links", "component_id"), "vector-parts")
    linked = rows.filter("sound").join(placed, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _dim_links(points: DataFrame, dim: int, n: int, radius: float, cosine: float) -> DataFrame:
    """``(node, n, to)`` for vectors of one length: link counts by node, and edges to smaller nodes."""
    spark = points.sparkSession
    share = min(1.0, SAMPLE / n)
    drawn = points.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20)))).select("v").limit(2 * SAMPLE).toPandas()
    unit = np.array(drawn["v"].tolist(), np.float64).reshape(-1, dim)
    if not len(unit):
        unit = np.eye(1, dim)
    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(choose_pivots(unit, max(1, min(MOST_CELLS, n // PER_CELL)), radius))

    def deal(batches):
        pivots, balls = shared.value
        gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-30))
        for b in batches:
            if not b.num_rows:
                continue
            u = unit_rows(b.column("v"), dim)
            square = np.maximum(2 - 2 * u @ pivots.T, 0)
            cell = square.argmin(axis=1)
            own = square[np.arange(len(u)), cell]
            ball = np.full(len(u), -1)
            at: list[np.ndarray] = []
            to: list[np.ndarray] = []
            core: list[np.ndarray] = []

            def send(rows, cells, is_core, at=at, to=to, core=core):
                at.append(rows)
                to.append(cells)
                core.append(np.full(len(rows), is_core))

            if len(balls):
                dist = np.sqrt(np.maximum(2 - 2 * u @ balls.T, 0))
                nearest = dist.argmin(axis=1)
                ball = np.where(dist[np.arange(len(u)), nearest] <= radius / 2 - _SAFE, nearest, -1)
                inside = np.flatnonzero(ball >= 0)
                send(inside, -1 - ball[inside], True)
                r, k = np.nonzero(dist <= 1.5 * radius + _SAFE)
                other = (ball[r] < 0) | (k < ball[r])
                send(r[other], -1 - k[other], False)
            outside = np.flatnonzero(ball < 0)
            send(outside, cell[outside], True)
            border = (square[outside] - own[outside, None]) / (2 * gap[cell[outside]]) <= radius + _SAFE
            border &= np.arange(len(pivots))[None, :] < cell[outside, None]
            r, k = np.nonzero(border)
            send(outside[r], k, False)
            at_, to_, core_ = np.concatenate(at), np.concatenate(to), np.concatenate(core)
            out = b.select(["node", "mult", "v"]).take(pa.array(at_))
            yield pa.record_batch([*out.columns, pa.array(to_.astype(np.int64)), pa.array(core_)], names=["node", "mult", "v", "cell", "core"])

    dealt = written(points.select("node", "mult", "v").mapInArrow(deal, "node long, mult long, v array<double>, cell long, core boolean"), "vector-cells")
    sizes = dealt.groupBy("cell").agg(
        F.ceil(F.count_if("core") / BLOCK).alias("cores"), F.ceil(F.count_if(~F.col("core")) / BLOCK).alias("guests"), F.sum(F.when(F.col("core"), F.col("mult"))).alias("held"), F.min(F.when(F.col("core"), F.col("node"))).alias("first")
    )
    sizes = F.broadcast(sizes)  # a row for each cell and ball: at most MOST_CELLS + MOST_BALLS
    dealt = dealt.join(sizes, "cell")
    in_ball = F.col("cell") < 0
    counted = dealt.filter(in_ball & F.col("core")).select("node", (F.col("held") - F.col("mult")).alias("n"), F.when(F.col("node") != F.col("first"), F.col("first")).alias("to"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("guests")))
    own, spread = block.cast("long"), lambda upto: F.sequence(F.lit(0).cast("long"), F.greatest(upto, F.lit(1)) - 1)
    guests = F.when(F.col("guests") > 0, F.transform(spread(F.col("guests")), lambda j: F.struct(F.lit(True).alias("cross"), F.col("own").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<cross:boolean,i:bigint,j:bigint>>"))
    mates = F.when(in_ball, F.array().cast("array<struct<cross:boolean,i:bigint,j:bigint>>")).otherwise(
        F.transform(spread(F.col("cores")), lambda j: F.struct(F.lit(False).alias("cross"), F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    )
    hosts = F.transform(spread(F.col("cores")), lambda i: F.struct(F.lit(True).alias("cross"), i.alias("i"), F.col("own").alias("j")))
    tasks = dealt.withColumn("own", own).select("cell", "core", "node", "mult", "v", "own", F.explode(F.when(F.col("core"), F.concat(mates, guests)).otherwise(hosts)).alias("t"))
    tasks = tasks.select("cell", "t.cross", "t.i", "t.j", "core", "own", "node", "mult", "v")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        cross, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        table = table.combine_chunks()
        core, own = (table.column(c).to_numpy() for c in ("core", "own"))
        node, mult = table.column("node").to_numpy(), table.column("mult").to_numpy()
        u = unit_rows(table.column("v").combine_chunks() if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v"), dim)
        left = np.flatnonzero(core) if cross else np.flatnonzero(own == i)
        right = np.flatnonzero(~core) if cross else np.flatnonzero(own == j)
        same = not cross and i == j
        return _block_links(u[left], node[left], mult[left], u[right], node[right], mult[right], same, cosine)

    joined = tasks.groupBy("cell", "cross", "i", "j").applyInArrow(join, "node long, n long, to long")
    return counted.union(joined)


def _block_links(a, a_node, a_mult, b, b_node, b_mult, same: bool, cosine: float) -> pa.Table:
    """Link counts of both sides of one pair of blocks, and each linked node's smallest node within the block pair."""
    if not len(a) or not len(b):
        return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
    hit = np.empty((len(a), len(b)), bool)
    for k in range(0, len(a), 512):
        np.greater_equal(a[k : k + 512] @ b.T, cosine, out=hit[k : k + 512])
    if same:
        np.fill_diagonal(hit, False)
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    hit = hit[rows][:, cols]
    n_a, n_b = hit @ b_mult[cols], a_mult[rows] @ hit
    x, y = a_node[rows].copy(), b_node[cols].copy()
    top = np.iinfo(np.int64).max
    while len(rows):
        near = np.minimum(x, np.where(hit, y[None, :], top).min(axis=1))
        far = np.minimum(y, np.where(hit, near[:, None], top).min(axis=0))
        if (near == x).all() and (far == y).all():
            break
        x, y = near, far
    node, n, to = [a_node[rows]], [n_a], [x]
    if not same:
        node, n, to = [*node, b_node[cols]], [*n, n_b], [*to, y]
    node, n, to = np.concatenate(node), np.concatenate(n).astype(np.int64), np.concatenate(to)
    return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64()), "to": pa.array(to, pa.int64(), mask=node == to)})
