"""Bags to vectors without training: projections by given weights, attention pooling, padding, relations to an anchor.

Rows are (bag, vec_id, x).  Weights are given, are small, and travel with the function that uses them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2, norm
from .cluster import centroids
from .metrics import softmax_pool


def dense(x: str, layers: list[tuple[np.ndarray, np.ndarray]]) -> Column:
    """A perceptron over vectors: x W + b for each layer, with max(0, .) between layers; in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        values = np.stack(batch.to_numpy())
        for k, (weight, bias) in enumerate(layers):
            values = (np.maximum(values, 0.0) if k else values) @ weight + bias
        return pd.Series(list(values))

    return run(F.col(x))


def bag_components(rows: DataFrame, basis: object, k: int) -> DataFrame:
    """(bag, vec_id, p): ``k`` principal directions of one named bag; every bag is centred by its own mean."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    means = centroids(rows, "bag").select("bag", "centre")
    own = rows.join(means, "bag").select("bag", "vec_id", array_to_vector(F.zip_with("x", "centre", lambda a, b: a - b)).alias("c"))
    return PCA(k=k, inputCol="c", outputCol="p").fit(own.where(F.col("bag") == basis)).transform(own).select("bag", "vec_id", vector_to_array("p").alias("p"))


def extreme_instances(rows: DataFrame, score: str, k: int = 8) -> DataFrame:
    """(bag, vec_id, side, place): the ``k`` rows of the largest score of each bag and the ``k`` of the least.

    Only the first rows of each order leave a task, so that no bag is sorted whole.
    """
    sides = []
    for side, order in (("top", F.desc(score)), ("bottom", F.asc(score))):
        place = F.row_number().over(Window.partitionBy("bag").orderBy(order, "vec_id"))
        sides.append(rows.withColumn("place", place).where(F.col("place") <= k).select("bag", "vec_id", F.lit(side).alias("side"), "place"))
    return sides[0].unionByName(sides[1])


def critical_pool(rows: DataFrame, score: str) -> DataFrame:
    """(bag, critical, pooled): attention of all rows to the one of the largest score (the least id of equal ones).

    A row's weight is the softmax of its product with the critical row over the root of the width.
    """
    best = rows.groupBy("bag").agg(F.max(F.struct(score, (-F.col("vec_id")).alias("minus"), "x")).alias("m"))
    best = best.select("bag", (-F.col("m.minus")).alias("critical"), F.col("m.x").alias("query"))
    scored = rows.join(best, "bag").withColumn("_score", dot("x", "query") / F.sqrt(F.size("x")))
    return softmax_pool(scored, "bag", "_score").join(best.select("bag", "critical"), "bag").select("bag", "critical", "pooled")


def gated_pool(rows: DataFrame, content: np.ndarray, gate: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(bag, pooled): softmax pooling with the score w (tanh(x V) * sigmoid(x U))."""
    zero = np.zeros(content.shape[1])
    both = rows.withColumn("_v", dense("x", [(content, zero)])).withColumn("_u", dense("x", [(gate, zero)]))
    gated = F.zip_with("_v", "_u", lambda a, b: F.tanh(a) / (1.0 + F.exp(-b)))
    return softmax_pool(both.withColumn("_score", dot(gated, F.array(*[F.lit(float(w)) for w in weight]))), "bag", "_score")


def square_padded(rows: DataFrame) -> DataFrame:
    """(bag, vec_id, copy): each bag filled to the next square number by repeating its first rows, as copy 1."""
    side = F.ceil(F.sqrt("n"))
    short = rows.groupBy("bag").agg(F.count(F.lit(1)).alias("n")).select("bag", (side * side - F.col("n")).alias("missing"))
    place = F.row_number().over(Window.partitionBy("bag").orderBy("vec_id"))
    head = rows.select("bag", "vec_id").withColumn("place", place).join(short, "bag").where("place <= missing")
    return rows.select("bag", "vec_id", F.lit(0).alias("copy")).unionByName(head.select("bag", "vec_id", F.lit(1).alias("copy")))


def anchor_relations(rows: DataFrame, anchors: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(bag, vec_id, affinity, radius, anchor_norm) of the rows of each bag to its anchor (bag, anchor).

    Rows are scaled by their bag's mean norm, anchors by the mean norm of all anchors.
    """
    scale = anchors.agg(F.avg(norm("anchor")).alias("anchor_scale"))
    own = rows.groupBy("bag").agg(F.avg(norm("x")).alias("scale")).join(anchors, "bag").crossJoin(F.broadcast(scale))  # one row
    both = rows.join(own, "bag")
    return both.select(
        "bag",
        "vec_id",
        (dot("x", "anchor") / (F.col("scale") * F.col("anchor_scale"))).alias("affinity"),
        (l2("x", "anchor") / (F.col("scale") + eps)).alias("radius"),
        (norm("anchor") / (F.col("anchor_scale") + eps)).alias("anchor_norm"),
    )
