"""Attention inside bags of any size: neighbour graphs with gated messages, landmarks with a pseudo-inverse.

Blocks of a bag (see ``bagwise``) meet the blocks, or the few landmarks, that they attend to.  What leaves a pair is the first few
neighbours of each row, or for each landmark the sum of a softmax and of what it weighs, with its largest exponent, so that the sums of several
blocks can be put together.  Only tables of a bag's landmarks are in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, mean_vector, softmax, total
from ..session import ship
from ..sources.tables import written
from . import bagwise, pairs
from .density import _met

_DIGITS = 9
_matrix = bagwise._matrix


# Neighbour graph


def mean_shifted(rows: DataFrame) -> DataFrame:
    """Rows (bag, vec_id, x) half way to their bag's mean."""
    means = rows.groupBy("bag").agg(mean_vector("x").alias("_mean"))
    return rows.join(means, "bag").withColumn("x", F.zip_with("x", "_mean", lambda a, b: (a + b) * 0.5)).drop("_mean")


def largest(heads: np.ndarray, tails: np.ndarray, k: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest scaled products (to 9 digits) of each head with the tails, and their places; ties go to the first."""
    logit = heads @ tails.T * scale
    k = min(k, logit.shape[1])
    bound = np.partition(logit, logit.shape[1] - k, axis=1)[:, -k:].min(1, keepdims=True)
    i, j = np.nonzero(logit >= bound - 1e-8)
    if not np.isfinite(bound).all() or np.isnan(logit).any():
        logit = np.round(logit, _DIGITS)
        first = np.argsort(-logit, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(logit, first, 1), first
    found = np.round(logit[i, j], _DIGITS)
    order = np.lexsort((j, -found, i))
    at = order[np.searchsorted(i, np.arange(len(logit)))[:, None] + np.arange(k)]
    return found[at], j[at]


def neighbours(rows: DataFrame, k: int = 6, scale: float = 1.0, bytes_: int = bagwise.BLOCK_BYTES) -> DataFrame:
    """(bag, vec_id, other, logit, place): the ``k`` rows of the largest product of each row's head with their tails.

    ``rows`` has (bag, vec_id, head, tail); a row may be its own neighbour; ties go to the least id; smaller bags give fewer.
    """
    blocks = bagwise.block(rows.select("bag", "vec_id", F.col("head").alias("x"), "tail"), bytes_, ("tail",))
    met = _met(blocks.packed, blocks.packed, blocks.counts).select("bag", "own", "other")
    kind = met.schema["bag"].dataType.simpleString()
    ship(met.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own, other = batch.column("own")[r].values, batch.column("other")[r].values
                heads, tails, ids, ids_ = _matrix(own.field("x")), _matrix(other.field("tail")), own.field("vec_id").to_numpy(), other.field("vec_id").to_numpy()
                for part in pairs.tiles(len(heads), len(tails)):
                    logit, first = largest(heads[part], tails, k, scale)  # ids ascend in a block
                    found = [pa.array(np.repeat(ids[part], first.shape[1])), pa.array(ids_[first].ravel()), pa.array(logit.ravel())]
                    yield pa.RecordBatch.from_arrays([batch.column("bag").take(pa.array(np.full(first.size, r))), *found], names=["bag", "vec_id", "other", "logit"])

    near = met.mapInArrow(run, f"bag {kind}, vec_id long, other long, logit double")
    place = F.row_number().over(Window.partitionBy("bag", "vec_id").orderBy(F.desc("logit"), "other"))
    return near.withColumn("place", place).where(F.col("place") <= k)


def messages(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(bag, vec_id, head, message): what each row's neighbours tell it.

    With p the softmax of the logits, a neighbour's gate is tanh(head + p * tail); the softmax of the products of gates and tails weighs the
    tails.
    """
    told = edges.join(rows.select("bag", F.col("vec_id").alias("other"), "tail"), ["bag", "other"])
    told = told.groupBy("bag", "vec_id").agg(F.array_sort(F.collect_list(F.struct("place", "logit", "tail"))).alias("near"))
    told = told.join(rows.select("bag", "vec_id", "head"), ["bag", "vec_id"]).withColumn("p", softmax(F.transform("near", lambda e: e["logit"])))

    def gated(e: Column, p: Column) -> Column:
        return total(F.zip_with("head", e["tail"], lambda h, t: F.tanh(h + p * t) * t))

    told = told.withColumn("knows", softmax(F.zip_with("near", "p", gated)))
    zero = F.transform("head", lambda h: h * 0.0)
    weighed = F.zip_with("near", "knows", lambda e, w: F.transform(e["tail"], lambda t: t * w))
    message = F.aggregate(weighed, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return told.select("bag", "vec_id", "head", message.alias("message"))


# Landmarks


def placed(rows: DataFrame, m: int) -> DataFrame:
    """``rows`` with segment (0 to m - 1), length (rows of a segment) and padding: in the order of ids, a bag is cut into ``m`` segments
    of one length, as if rows of zeros stood in front to make it fit. Ids only are numbered, without their vectors."""
    n = rows.groupBy("bag").agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("bag").orderBy("vec_id")) - 1
    at = rows.select("bag", "vec_id").withColumn("place", order).join(n, "bag")
    at = at.withColumn("padding", F.pmod(-F.col("n"), F.lit(m))).withColumn("length", ((F.col("n") + F.col("padding")) / m).cast("long"))
    at = at.withColumn("segment", F.floor((F.col("place") + F.col("padding")) / F.col("length")).cast("int"))
    return rows.join(at.select("bag", "vec_id", "segment", "length", "padding"), ["bag", "vec_id"])


def landmarks(rows: DataFrame, m: int) -> DataFrame:
    """(bag, segment, q, k, padding): means of the queries and keys of ``m`` segments of each bag of (bag, vec_id, q, k).

    A segment of padding alone has zeros.
    """
    own = placed(rows, m)
    summed = [vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c) for c in ("q", "k")]
    found = own.groupBy("bag", "segment", "length", "padding").agg(*summed)
    found = found.select("bag", "segment", "padding", *(F.transform(c, lambda v: v / F.col("length")).alias(c) for c in ("q", "k")))
    every = found.groupBy("bag", "padding").agg(F.max(F.transform("q", lambda v: v * 0.0)).alias("zero")).select("bag", "padding", "zero", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("segment"))
    return every.join(found.drop("padding"), ["bag", "segment"], "left").select("bag", "segment", "padding", F.coalesce("q", "zero").alias("q"), F.coalesce("k", "zero").alias("k"))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pseudo_inverse(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """The Moore-Penrose inverse by a third-order iteration that starts from the transpose over the largest row and column sums."""
    z = x.T / (np.abs(x).sum(1).max() * np.abs(x).sum(0).max())
    one = np.eye(len(x))
    for _ in range(rounds):
        xz = x @ z
        z = 0.25 * z @ (13 * one - xz @ (15 * one - xz @ (7 * one - xz)))
    return z


def nystrom_attention(rows: DataFrame, m: int = 256, rounds: int = 6, bytes_: int = bagwise.BLOCK_BYTES) -> DataFrame:
    """(bag, vec_id, out) for rows (bag, vec_id, q, k, v), queries scaled: softmax(q K') pinv(softmax(Q' K')) softmax(Q' k) v with the
    landmarks Q', K' of ``landmarks``. Rows of padding take their part of the last softmax, with values of zeros."""
    marks = written(landmarks(rows, m), "landmarks")
    blocks = bagwise.block(rows.select("bag", "vec_id", F.col("q").alias("x"), "k", "v"), bytes_, ("k", "v"))
    kind = rows.schema["bag"].dataType.simpleString()
    ship(rows.sparkSession)

    def sent(table: DataFrame) -> DataFrame:
        to = table.join(blocks.counts, "bag").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        return blocks.packed.join(to, ["bag", "block"]).drop("block")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own, q = batch.column("own")[r].values, _matrix(batch.column("marks")[r].values.field("q"))
                logit = q @ _matrix(own.field("k")).T
                top = logit.max(1)
                e = np.exp(logit - top[:, None])
                columns = [pa.array(np.arange(len(q), dtype=np.int32)), pa.array(top), pa.array(e.sum(1)), pa.array(list(e @ _matrix(own.field("v"))), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("bag").take(pa.array(np.full(len(q), r))), *columns], names=["bag", "segment", "top", "all", "value"])

    packed = marks.groupBy("bag").agg(F.array_sort(F.collect_list(F.struct("segment", "q", "k"))).alias("marks"), F.max("padding").alias("padding"))
    parts = sent(packed.select("bag", "marks")).mapInArrow(summed, f"bag {kind}, segment int, top double, all double, value array<double>")
    parts = parts.join(packed.select("bag", "padding"), "bag")
    # Padding has the exponent 0 for each of its rows.
    most = F.greatest(F.max("top").over(Window.partitionBy("bag", "segment")), F.when(F.col("padding") > 0, 0.0).otherwise(F.lit(float("-inf"))))
    parts = parts.withColumn("most", most).withColumn("w", F.exp(F.col("top") - F.col("most")))
    weighed = vector_to_array(Summarizer.sum(array_to_vector(F.transform("value", lambda v: v * F.col("w")))))
    values = parts.groupBy("bag", "segment", "most", "padding").agg(F.sum(F.col("all") * F.col("w")).alias("all"), weighed.alias("value"))
    share = F.col("all") + F.when(F.col("padding") > 0, F.col("padding") * F.exp(-F.col("most"))).otherwise(0.0)
    values = values.select("bag", "segment", F.transform("value", lambda v: v / share).alias("value"))
    both = marks.join(values, ["bag", "segment"]).groupBy("bag").agg(F.array_sort(F.collect_list(F.struct("segment", "q", "k", "value"))).alias("marks"))

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column("marks")[r].values
                q, k = _matrix(own.field("q")), _matrix(own.field("k"))
                out = pseudo_inverse(_softmax(q @ k.T), rounds) @ _matrix(own.field("value"))
                pairs = pa.StructArray.from_arrays([own.field("k"), pa.array(list(out), pa.list_(pa.float64()))], names=["k", "value"])
                yield pa.RecordBatch.from_arrays([batch.column("bag").slice(r, 1), pa.ListArray.from_arrays(pa.array([0, len(q)], pa.int32()), pairs)], names=["bag", "marks"])

    ready = written(both.mapInArrow(inverted, f"bag {kind}, marks array<struct<k: array<double>, value: array<double>>>"), "landmarks")

    def attended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own, mark = batch.column("own")[r].values, batch.column("marks")[r].values
                out = _softmax(_matrix(own.field("x")) @ _matrix(mark.field("k")).T) @ _matrix(mark.field("value"))
                yield pa.RecordBatch.from_arrays([batch.column("bag").take(pa.array(np.full(len(out), r))), own.field("vec_id"), pa.array(list(out), pa.list_(pa.float64()))], names=["bag", "vec_id", "out"])

    return sent(ready).mapInArrow(attended, f"bag {kind}, vec_id long, out array<double>")


# Pseudo-groups


def pseudo_groups(rows: DataFrame, groups: int, seed: int = 42) -> DataFrame:
    """``rows`` with part (0 to groups - 1): each bag dealt evenly, in the order of a hash of the ids."""
    from ..functions.portable import shuffle_key

    order = F.row_number().over(Window.partitionBy("bag").orderBy(shuffle_key(seed, "bag", "vec_id"), "vec_id")) - 1
    at = rows.select("bag", "vec_id").withColumn("part", (order % groups).cast("int"))
    return rows.join(at, ["bag", "vec_id"])


def two_level_pool(rows: DataFrame, score: str, weights: list[float], k: int = 1, side: str = "both") -> DataFrame:
    """(bag, pooled, n): attention in each pseudo-group of (bag, part, vec_id, x), then over what stands for the groups.

    In a group, rows weigh by the softmax of ``score``; a row's part in it is its weight times its product with the class's ``weights``.
    side: ``top`` and ``bottom`` stand for a group by the ``k`` rows of most and least such part, ``both`` by either, ``pooled`` by its weighed mean.
    These, n in a bag, are pooled by the softmax of their products with the weights.
    """
    key = ["bag", "part"]
    most = rows.groupBy(*key).agg(F.max(score).alias("_most"))
    rows = rows.join(most, key).withColumn("_e", F.exp(F.col(score) - F.col("_most")))
    rows = rows.join(rows.groupBy(*key).agg(F.sum("_e").alias("_all")), key).withColumn("_w", F.col("_e") / F.col("_all"))
    given = F.array(*(F.lit(float(w)) for w in weights))
    if side == "pooled":
        chosen = rows.groupBy(*key).agg(vector_to_array(Summarizer.sum(array_to_vector(F.transform("x", lambda v: v * F.col("_w"))))).alias("x")).select("bag", "x")
    elif side in ("top", "bottom", "both"):
        part = F.round(F.col("_w") * dot("x", given), _DIGITS)
        first = {"top": [F.desc("_c")], "bottom": [F.asc("_c")], "both": [F.desc("_c"), F.asc("_c")]}[side]
        chosen = None
        for order in first:
            place = F.row_number().over(Window.partitionBy(*key).orderBy(order, "vec_id"))
            some = rows.withColumn("_c", part).withColumn("_place", place).where(F.col("_place") <= k).select("bag", "x")
            chosen = some if chosen is None else chosen.unionByName(some)
    else:
        raise ValueError(f"no side {side!r}")
    chosen = chosen.withColumn("_s", dot("x", given))
    top = chosen.groupBy("bag").agg(F.max("_s").alias("_top"))
    chosen = chosen.join(top, "bag").withColumn("_e", F.exp(F.col("_s") - F.col("_top")))
    weighed = vector_to_array(Summarizer.sum(array_to_vector(F.transform("x", lambda v: v * F.col("_e")))))
    out = chosen.groupBy("bag").agg(weighed.alias("sum"), F.sum("_e").alias("all"), F.count(F.lit(1)).alias("n"))
    return out.select("bag", F.transform("sum", lambda v: v / F.col("all")).alias("pooled"), "n")
