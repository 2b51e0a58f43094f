"""All pairs of the rows of each group, met by blocks of a bounded size.

Rows are dealt into blocks by a hash of their ids; every two blocks of a group meet once, under a key of their slots, and a numpy
kernel takes their distances from products in tiles.  Differences that cancel are made anew from the rows themselves.  A pair of
rows is a record only where pairs are the result; what else leaves two blocks is one partial result for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of vectors, and rows, in a block.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 2048
#: Slots of blocks that a bag has, up to so many blocks in one; two slots meet under a key.
SLOTS, SLOT = 8, 32
#: Distances that a kernel holds at once.
TILE = 1 << 19
#: Squared distances below this share of the squared norms are made from differences.
CANCELS = 1e-4


def matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors as rows, and which of them are whole (None: all); the others are NaN."""
    flat = lists.flatten()
    if not lists.null_count and not flat.null_count:
        return flat.to_numpy().reshape(len(lists), -1), None
    rows = lists.to_pylist()
    whole = np.array([v is not None and None not in v for v in rows])
    out = np.full((len(rows), max((len(v) for v in rows if v is not None), default=0)), np.nan)
    for k in np.flatnonzero(whole):
        out[k] = rows[k]
    return out, whole


def where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true in a matrix; faster than ``np.nonzero`` where that is little."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1]) if mask.size else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def direct(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the rows i of x to the rows j of y, from their differences."""
    out = np.empty(len(i))
    step = max(1, TILE // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        out[at : at + step] = np.square(x[i[at : at + step]] - y[j[at : at + step]]).sum(1)
    return out


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by rows of x, from products, and from differences where those cancel."""
    with np.errstate(invalid="ignore", over="ignore"):
        xx, yy = np.square(x).sum(1), np.square(y).sum(1)
        d2 = x @ y.T
        d2 *= -2.0
        d2 += xx[:, None]
        d2 += yy
        i, j = where(~(d2 > CANCELS * (xx + yy.max(initial=0.0))[:, None]))
        d2[i, j] = direct(x, y, i, j)
    return d2


def l2(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Distances and squared distances."""
    d2 = squared(x, y)
    return [np.sqrt(d2), d2]


def cosine(eps: float = 1e-12) -> Callable:
    """One minus the cosine."""

    def measure(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        x, y = (v / np.maximum(np.sqrt(np.square(v).sum(1)), eps)[:, None] for v in (x, y))
        return [1.0 - x @ y.T]

    return measure


def hybrid(alpha: float) -> Callable:
    """alpha times the squared distance of the unit vectors plus the rest times the cosine distance."""
    return lambda x, y: [alpha * (2.0 * d) + (1.0 - alpha) * d for d in cosine()(x, y)]


def gram(eps: float = 1e-12) -> Callable:
    """Distances from products alone, softened by ``eps``."""

    def measure(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        d2 = np.square(x).sum(1)[:, None] + np.square(y).sum(1)[None] - 2.0 * (x @ y.T)
        return [np.sqrt(np.maximum(d2, 0.0) + eps)]

    return measure


def tiles(n: int, m: int, most: int | None = None) -> Iterator[slice]:
    """Slices of ``n`` rows that meet ``m`` others in a tile."""
    step = max(1, (most or TILE) // max(1, m))
    return (slice(a, min(a + step, n)) for a in range(0, n, step))


def slotted(packed: DataFrame, most: int = SLOT) -> DataFrame:
    """Blocks (bag, n, block, ...) with their slot and its bag's last: eight slots, and more where they would have over ``most`` blocks."""
    size = F.least(F.ceil(F.col("n") / SLOTS), F.lit(most))
    return packed.withColumn("_slot", F.floor(F.col("block") / size).cast("int")).withColumn("_last", F.floor((F.col("n") - 1) / size).cast("int"))


def twice(packed: DataFrame, most: int = SLOT) -> DataFrame:
    """(bag, block, to, own, other): every two blocks (bag, n, block, own) of each bag once, block <= to.

    Two slots are a key, so a block is copied once for each slot and once more, nine times in all for bags of up to eight slots.
    """
    cut = slotted(packed, most)
    left = cut.select("bag", "block", "own", F.col("_slot").alias("_s"), F.explode(F.sequence("_slot", "_last")).alias("_t"))
    right = cut.select("bag", F.col("block").alias("to"), F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), "_slot")).alias("_s"), F.col("_slot").alias("_t"))
    return left.join(right, ["bag", "_s", "_t"]).where("block <= to").select("bag", "block", "to", "own", "other")


def met(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(bag, block, to, own, other): every two blocks (arrays of vec_id and ``columns``) of each bag once, block <= to."""
    width = sum((F.greatest(F.size(c), F.lit(1)) for c in columns), F.lit(1))
    n = F.ceil(F.greatest(F.sum(width) * 8.0 / BLOCK_BYTES, F.count(F.lit(1)) / F.lit(float(BLOCK_ROWS)))).cast("int")
    base = rows.select(F.col(key).alias("bag"), "vec_id", *columns)
    dealt = base.join(base.groupBy("bag").agg(n.alias("n")), "bag").withColumn("block", F.expr("int(pmod(xxhash64(vec_id), n))"))
    return twice(dealt.groupBy("bag", "n", "block").agg(F.collect_list(F.struct("vec_id", *columns)).alias("own")))


def over(met_: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """(bag, *schema): what ``kernel`` (own, other, whether they are one block) yields as columns for each two blocks."""
    ship(met_.sparkSession)
    kind = met_.schema["bag"].dataType.simpleString()
    names = ["bag", *(part.split()[0] for part in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = batch.column("block")[r].as_py() == batch.column("to")[r].as_py()
                for found in kernel(batch.column("own")[r].values, batch.column("other")[r].values, same):
                    if len(found[0]):
                        bag = batch.column("bag").take(pa.array(np.full(len(found[0]), r)))
                        yield pa.RecordBatch.from_arrays([bag, *(v if isinstance(v, pa.Array) else pa.array(v) for v in found)], names=names)

    return met_.mapInArrow(run, f"bag {kind}, {schema}")


def table(rows: DataFrame, key: str, measure: Callable, names: tuple[str, ...], digits: int = 6) -> DataFrame:
    """(key, a, b, *names) for the pairs a < b of (key, vec_id, x): ``measure`` (x, y) gives a matrix for each name, rounded here.

    A vector that is null, or has nulls, has null measures.
    """

    def kernel(own, other, same):
        (x, ok), (y, ok_) = matrix(own.field("x")), matrix(other.field("x"))
        if not y.shape[1]:
            y = np.full((len(y), x.shape[1]), np.nan)
        if not x.shape[1]:
            x = np.full((len(x), y.shape[1]), np.nan)
        ids, ids_ = own.field("vec_id").to_numpy(), other.field("vec_id").to_numpy()
        for part in tiles(len(x), len(y)):
            left, right = np.broadcast_arrays(ids[part, None], ids_[None])
            wanted = left < right if same else left != right
            whole = wanted.all()
            pick = (lambda v: v.ravel()) if whole else lambda v: v[wanted]
            mask = None
            if ok is not None or ok_ is not None:
                at, at_ = (np.ones(n, bool) if v is None else v for v, n in ((ok, len(x)), (ok_, len(y))))
                mask = pick(~(at[part, None] & at_[None]))
            values = [pa.array(np.round(pick(v), digits) + 0.0, mask=mask) for v in measure(x[part], y)]
            left, right = pick(left), pick(right)
            yield [np.minimum(left, right), np.maximum(left, right), *values]

    found = over(met(rows.where("vec_id IS NOT NULL"), key, "x"), kernel, ", ".join(["a long", "b long", *(f"{c} double" for c in names)]))
    return found.select(F.col("bag").alias(key), "a", "b", *names)


def sums(rows: DataFrame, key: str) -> DataFrame:
    """(key, vec_id, cost): each row's sum of distances to the rows of its group."""

    def kernel(own, other, same):
        x, y = matrix(own.field("x"))[0], matrix(other.field("x"))[0]
        mine, theirs = np.zeros(len(x)), np.zeros(len(y))
        for part in tiles(len(x), len(y)):
            d = np.sqrt(squared(x[part], y))
            mine[part] = d.sum(1)
            theirs += d.sum(0)
        yield [own.field("vec_id"), mine]
        if not same:
            yield [other.field("vec_id"), theirs]

    found = over(met(rows.where("x IS NOT NULL"), key, "x"), kernel, "vec_id long, part double")
    return found.groupBy(F.col("bag").alias(key), "vec_id").agg(F.sum("part").alias("cost"))


def least(d: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least of each row, in any order."""
    return np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d


def lists(d: np.ndarray) -> pa.Array:
    """Rows as lists of doubles."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))


def nearest(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, vec_id, near): the distances of each row to the ``k`` nearest others of its group, ascending; fewer in small groups."""

    def kernel(own, other, same):
        x, y = matrix(own.field("x"))[0], matrix(other.field("x"))[0]
        ids, ids_ = own.field("vec_id").to_numpy(), other.field("vec_id").to_numpy()
        mine, theirs = [], None
        for part in tiles(len(x), len(y)):
            d = np.sqrt(squared(x[part], y))
            d[ids[part, None] == ids_[None]] = np.inf
            mine.append(least(d, k))
            if not same:
                d = least(d.T, k)
                theirs = d if theirs is None else least(np.hstack([theirs, d]), k)
        yield [own.field("vec_id"), lists(np.vstack(mine))]
        if theirs is not None:
            yield [other.field("vec_id"), lists(theirs)]

    found = over(met(rows.where("vec_id IS NOT NULL AND x IS NOT NULL"), key, "x"), kernel, "vec_id long, near array<double>")
    near = F.filter(F.flatten(F.collect_list("near")), lambda d: d != float("inf"))
    return found.groupBy(F.col("bag").alias(key), "vec_id").agg(F.slice(F.array_sort(near), 1, k).alias("near")).where("size(near) > 0")


def mean_squared_gap(rows: DataFrame, key: str) -> DataFrame:
    """(key, mse): the mean squared difference of the distances of xa and of xb over the pairs of each group."""

    def kernel(own, other, same):
        (a, b), (c, d) = ([matrix(v.field(f))[0] for f in ("xa", "xb")] for v in (own, other))
        ids, ids_ = own.field("vec_id").to_numpy(), other.field("vec_id").to_numpy()
        total, n = 0.0, 0
        for part in tiles(len(a), len(c)):
            gap = np.square(np.sqrt(squared(a[part], c)) - np.sqrt(squared(b[part], d)))
            apart = ids[part, None] != ids_[None]
            total += float(gap.sum(where=apart)) / (2 if same else 1)
            n += int(apart.sum()) / (2 if same else 1)
        if n:
            yield [np.array([total]), np.array([float(n)])]

    found = over(met(rows.where("vec_id IS NOT NULL AND xa IS NOT NULL AND xb IS NOT NULL"), key, "xa", "xb"), kernel, "total double, n double")
    return found.groupBy(F.col("bag").alias(key)).agg((F.sum("total") / F.sum("n")).alias("mse"))
