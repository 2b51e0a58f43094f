"""Greedy work that takes the clusters of a bag in their order, each after what those before it chose.

What a row has to know of all chosen rows is a sum or a least of distances.  Those are made for pairs of blocks, spread over
all tasks; clusters are then taken in chunks of about ``CHUNK`` rows (or one larger cluster), a chunk in a task, and before a
chunk its rows meet what the chunks before it chose.  So no task holds a bag, and none meets all of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import kernels, pairs

#: Rows of the clusters that a task takes one after the other, about.
CHUNK = 16384
#: Blocks of either side that meet under one key.
SLOT = 8


def chunked(sizes: DataFrame) -> DataFrame:
    """Clusters (bag, cluster, n, ...) with ``chunk``: 0, 1, ... in the order of the clusters of each bag."""
    order = Window.partitionBy("bag").orderBy("cluster")
    placed = sizes.withColumn("_at", F.floor((F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")) / CHUNK))
    return placed.withColumn("chunk", F.dense_rank().over(Window.partitionBy("bag").orderBy("_at")) - 1).drop("_at")


def _blocks(rows: DataFrame, name: str, slot: str, *columns: str) -> DataFrame:
    """(bag, <slot>, <name>): lists of rows of a bounded size, with the slot that each falls into."""
    n = F.ceil(F.greatest(F.sum(F.size("x")) * 8.0 / pairs.BLOCK_BYTES, F.count(F.lit(1)) / F.lit(float(pairs.BLOCK_ROWS))))
    dealt = rows.join(rows.groupBy("bag").agg(n.cast("int").alias("_n")), "bag").withColumn("_block", F.expr("int(pmod(xxhash64(vec_id), _n))"))
    return dealt.groupBy("bag", "_block").agg(F.collect_list(F.struct("vec_id", "cluster", "x", *columns)).alias(name)).select("bag", F.floor(F.col("_block") / SLOT).cast("int").alias(slot), name)


def meet(rows: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """(bag, rows, members): every block of rows (bag, vec_id, cluster, x) of a bag with every block of its members (with ``columns``, too)."""
    left, right = _blocks(rows, "rows", "_r"), _blocks(members, "members", "_m", *columns)
    slots = lambda blocks, c: blocks.groupBy("bag").agg(F.max(c).alias("_last"))
    spread = lambda blocks, other, c: blocks.join(slots(other, c), "bag").withColumn(c, F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    return spread(left, right, "_m").join(spread(right, left, "_r"), ["bag", "_r", "_m"]).select("bag", "rows", "members")


def _by_row(met: DataFrame, name: str, kernel: Callable) -> DataFrame:
    """(bag, vec_id, <name>): the value that ``kernel`` (rows, members) gives each row of every two blocks."""
    from .refine import _parts

    ship(met.sparkSession)
    kind = met.schema["bag"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = _parts(batch.column("rows"), k)
                found = kernel(own, _parts(batch.column("members"), k))
                bag = batch.column("bag").take(pa.array(np.full(len(found), k)))
                yield pa.RecordBatch.from_arrays([bag, pa.array(own[0], pa.int64()), pa.array(found)], names=["bag", "vec_id", name])

    return met.mapInArrow(run, f"bag {kind}, vec_id long, {name} double")


def far_sums(rows: DataFrame, members: DataFrame, name: str = "far") -> DataFrame:
    """(bag, vec_id, <name>): sums of distances to the members (bag, vec_id, cluster, x, w) of other clusters, times w."""

    def kernel(own, others):
        _, clusters, x, _ = own
        _, labels, y, w = others
        out = np.zeros(len(x))
        for part in pairs.tiles(len(x), len(y)):
            d = np.sqrt(pairs.squared(x[part], y))
            d *= clusters[part, None] != labels[None]
            out[part] = d @ w
        return out

    return _by_row(meet(rows, members, "w"), name, kernel).groupBy("bag", "vec_id").agg(F.sum(name).alias(name))


def own_sums(rows: DataFrame) -> DataFrame:
    """(bag, vec_id, inner, outer): sums of distances to the selected and to the other rows of the row's own cluster."""

    def kernel(own, other, same):
        (x, s), (y, t) = ([pairs.matrix(v.field(f))[0] for f in ("x", "mark")] for v in (own, other))
        s, t = np.hstack([s, 1.0 - s]), np.hstack([t, 1.0 - t])
        mine, theirs = np.zeros((len(x), 2)), np.zeros((len(y), 2))
        for part in pairs.tiles(len(x), len(y)):
            d = np.sqrt(pairs.squared(x[part], y))
            mine[part] = d @ t
            theirs += d.T @ s[part]
        yield [own.field("vec_id"), mine[:, 0].copy(), mine[:, 1].copy()]
        if not same:
            yield [other.field("vec_id"), theirs[:, 0].copy(), theirs[:, 1].copy()]

    told = rows.select(F.struct("bag", "cluster").alias("key"), "vec_id", "x", F.array(F.col("selected").cast("double")).alias("mark"))
    found = pairs.over(pairs.met(told, "key", "x", "mark"), kernel, "vec_id long, inner double, outer double")
    return found.groupBy(F.col("bag.bag").alias("bag"), "vec_id").agg(F.sum("inner").alias("inner"), F.sum("outer").alias("outer"))


def to_nearest(x: np.ndarray, y: np.ndarray, metric: str = "l2", alpha: float = 1.0) -> np.ndarray:
    """The distance of each row of x to the nearest of y, as ``kernels.farthest_points`` compares them.

    Products find the nearest; its distance is made from the rows themselves.
    """
    if metric != "l2":
        x, y = kernels._unit(x), kernels._unit(y)
    out = np.empty(len(x))
    for part in pairs.tiles(len(x), len(y)):
        near = y[pairs.squared(x[part], y).argmin(1)]
        d2 = np.square(x[part] - near).sum(1)
        cos = 1.0 - (x[part] * near).sum(1)
        out[part] = d2 if metric in ("l2", "l2_unit") else cos if metric == "cosine" else alpha * d2 + (1.0 - alpha) * cos
    return out


def nearest(rows: DataFrame, members: DataFrame, metric: str = "l2", alpha: float = 1.0, name: str = "far") -> DataFrame:
    """(bag, vec_id, <name>): the distance of each row to the nearest member of its bag, as the fill compares them."""
    found = _by_row(meet(rows, members), name, lambda own, others: to_nearest(own[2], others[2], metric, alpha))
    return found.groupBy("bag", "vec_id").agg(F.min(name).alias(name))
