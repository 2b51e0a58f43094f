"""Column functions over vectors held as arrays of doubles. All stay in the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x) -> Column:
    """The vector in double precision."""
    return F.col(x).cast("array<double>") if isinstance(x, str) else x.cast("array<double>")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v)


def dot(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def norm(x) -> Column:
    return F.sqrt(F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v * v))


def squared_l2(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)))


def l2(x, y) -> Column:
    return F.sqrt(squared_l2(x, y))


def unit(x, eps: float = 1e-12) -> Column:
    """The vector over its norm, or over ``eps`` if that is larger."""
    n = F.greatest(norm(x), F.lit(eps))
    return F.transform(_c(x), lambda v: v / n)


def cosine_distance(x, y, eps: float = 1e-12) -> Column:
    return F.lit(1.0) - dot(x, y) / (F.greatest(norm(x), F.lit(eps)) * F.greatest(norm(y), F.lit(eps)))


def hybrid_distance(x, y, alpha: float) -> Column:
    """alpha times the squared distance of the unit vectors plus the rest times the cosine distance."""
    cos = cosine_distance(x, y)
    return F.lit(alpha) * (F.lit(2.0) * cos) + F.lit(1.0 - alpha) * cos


def mean_vector(x) -> Column:
    """Aggregate: the mean of vectors, combined before the shuffle, one buffer of the vector's width for each group."""
    return vector_to_array(Summarizer.mean(array_to_vector(_c(x))))


def softmax(x) -> Column:
    """Softmax, shifted by the largest entry."""
    top = F.array_max(_c(x))
    shifted = F.transform(_c(x), lambda v: F.exp(v - top))
    return F.transform(shifted, lambda v: v / total(shifted))


def softmax_one(x) -> Column:
    """exp / (1 + sum of exp): attention that may go nowhere."""
    exps = F.transform(_c(x), F.exp)
    return F.transform(exps, lambda v: v / (F.lit(1.0) + total(exps)))


def argmax(x) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(_c(x), F.array_max(_c(x))) - 1).cast("int")


def tokens(x, width: int, drop: int = 0) -> Column:
    """A vector as a sequence of tokens of ``width`` entries, without the first ``drop``."""
    return F.transform(F.sequence(F.lit(drop), (F.size(_c(x)) / width).cast("int") - 1), lambda k: F.slice(_c(x), k * width + 1, width))


def picture_normalise(x, mean: float, deviation: float) -> Column:
    """(v / 255 - mean) / deviation."""
    return F.transform(_c(x), lambda v: (v / 255.0 - mean) / deviation)
