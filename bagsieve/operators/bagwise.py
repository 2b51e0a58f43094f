"""Clustering every bag of a table at once: k-means, medoids by several rules, several starts, polish.

Rows (bag, vec_id, x) are packed once into blocks of a bounded size, written to the shared folder; a bag of any size is as many
blocks as it needs.  Centres are rows keyed by (bag, start, cluster).  A round packs the centres of each (bag, start) that hasn't
converged into one row, sends it to the bag's blocks by a join on (bag, block), and takes distances there with
numpy; what leaves a block is one partial sum for each cluster or the few candidates of each, and the rest is grouping.
A round of all bags is one written table and one count in the driver, however many bags and starts there are.

Ties go to the least cluster, and among rows to the least id; scores are compared to 9 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import shuffle_key
from ..session import ship
from ..sources.tables import written
from . import cluster as formulas
from . import pairs

#: Bytes of vectors in a block.
BLOCK_BYTES = 4 << 20
#: Bytes of all centres up to which a round ships them to the blocks; beyond, both are joined by (bag, block).
NARROW_BYTES = 32 << 20
GROUP = ["bag", "start"]
_DIGITS = 9


@dataclass(frozen=True)
class Medoids:
    """How medoids are refined.

    strategy: the shortlist, as ``cluster.shortlist`` names them (two_stage: mean_margin in the first round; large:
    another one for clusters of ``threshold`` rows).  size: candidates of a cluster (0: all); adaptive_size: the root of its rows between floor and
    cap.  pull and push: weights of the distances to the mean and to the next centre; push_mode: fixed, adaptive (by
    relative size, between scale bounds) or density (from low to high by rank).  least: smaller clusters take the
    member nearest their mean.
    """

    rounds: int = 50
    strategy: str = "margin_max"
    two_stage: bool = False
    large: str | None = None
    threshold: int = 0
    size: int = 8
    adaptive_size: bool = False
    floor: int = 4
    cap: int = 16
    multiple: float = 4.0
    weight: float = 1.0
    pull: float = 0.0
    push: float = 0.22
    push_mode: str = "fixed"
    scale: tuple[float, float] = (0.5, 2.0)
    low: float = 0.15
    high: float = 0.28
    least: int = 0

    def __post_init__(self) -> None:
        for name in (self.strategy, *([self.large] if self.large else [])):
            if name not in SCORES:
                raise ValueError(f"no strategy {name!r}")
        if self.push_mode not in ("fixed", "adaptive", "density"):
            raise ValueError(f"no push mode {self.push_mode!r}")


#: What a shortlist ranks members by, least first: (first cut, second cut or None); m, o: squared distances to the mean and the next centre.
SCORES = {
    "mean": ("m", None),
    "mean_margin": ("m / greatest(o, 1e-12D)", None),
    "margin_max": ("m - o", None),
    "knn_mean_margin": ("m", "m - {weight}D * o"),
    "knn_mean_ratio": ("m", "m / greatest(o, 1e-12D)"),
}


# Blocks


@dataclass(frozen=True)
class Blocks:
    """Written tables: packed (bag, block, own: array of (vec_id, x) by id) and counts (bag, n) of blocks."""

    packed: DataFrame
    counts: DataFrame


def block(rows: DataFrame, bytes_: int = BLOCK_BYTES, more: tuple[str, ...] = ()) -> Blocks:
    """Rows (bag, vec_id, x, *more) in blocks."""
    sizes = rows.groupBy("bag").agg(F.ceil(F.sum(F.size("x") * 8.0) / bytes_).cast("int").alias("n"))
    counts = written(sizes, "block-counts")
    dealt = rows.select("bag", "vec_id", "x", *more).join(counts, "bag").withColumn("block", F.expr("int(pmod(xxhash64(vec_id), n))"))
    packed = dealt.groupBy("bag", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x", *more))).alias("own"))
    return Blocks(written(packed, "blocks"), counts)


def _sent(blocks: Blocks, centres: DataFrame, narrow: bool = False) -> DataFrame:
    """Blocks with the packed centres (all columns of ``centres`` but the keys) of each start of their bag.

    ``narrow`` centres (see ``NARROW_BYTES``) are shipped, so that the vectors of the blocks aren't shuffled.
    """
    told = [c for c in centres.columns if c not in GROUP and c != "cluster"]
    packed = centres.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("cluster", *told))).alias("centres"))
    if narrow:
        return blocks.packed.join(F.broadcast(packed), "bag").select("bag", "start", "own", "centres")
    packed = packed.join(blocks.counts, "bag").select(*GROUP, "centres", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    return blocks.packed.join(packed, ["bag", "block"]).select("bag", "start", "own", "centres")


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def nearest_two(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest centre of each row, and the squared distance of the next one (0 if none).

    Products find the candidates, in tiles (``pairs.TILE``), however many centres there are; all that come within rounding of the least
    are measured again, exactly.
    """
    top, own = np.square(centres).sum(1), np.square(x).sum(1)
    slack = 1e-9 * (own + top.max())
    label, following = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for part in pairs.tiles(len(x), len(centres)):
        rough = x[part] @ centres.T
        rough *= -2.0
        rough += top
        rows, first = np.arange(len(rough)), rough.argmin(1)
        least = rough[rows, first]
        rough[rows, first] = np.inf
        after = rough.argmin(1)
        for k in np.flatnonzero(rough[rows, after] <= least + slack[part]):
            rough[k, first[k]] = least[k]
            some = np.flatnonzero(rough[k] <= least[k] + slack[part][k])
            first[k] = some[np.round(np.square(centres[some] - x[part][k]).sum(1), _DIGITS).argmin()]
            rough[k, first[k]] = np.inf
            after[k] = rough[k].argmin()
        label[part], following[part] = first, after
    d2 = np.square(x - centres[label]).sum(1)
    return label, d2, np.square(x - centres[following]).sum(1) if len(centres) > 1 else np.zeros(len(x))


def _over(sent: DataFrame, schema: str, kernel: Callable) -> DataFrame:
    """(bag, start, cluster, *schema): what ``kernel(ids, x, centres)`` gives for each block and start, column by column.

    The kernel returns indices of clusters and a list of columns; ``centres`` is the struct array of the packed centres.
    """
    ship(sent.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in sent.schema}
    names = ["bag", "start", "cluster", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own, centres = batch.column("own")[r].values, batch.column("centres")[r].values
                at, columns = kernel(own.field("vec_id").to_numpy(), _matrix(own.field("x")), centres)
                if len(at):
                    group = [batch.column(c).take(pa.array(np.full(len(at), r))) for c in GROUP]
                    yield pa.RecordBatch.from_arrays([*group, centres.field("cluster").take(at if isinstance(at, pa.Array) else pa.array(at)), *columns], names=names)

    return sent.mapInArrow(run, f"bag {kinds['bag']}, start {kinds['start']}, cluster int, {schema}")


# Stages of a round


def statistics(blocks: Blocks, centres: DataFrame, narrow: bool = False) -> DataFrame:
    """``centres`` with n, mean, d (sum of distances) and d2 (sum of squares) of the rows nearest each; n 0 and mean null without any."""

    def kernel(ids, x, own):
        label, d2, _ = nearest_two(x, _matrix(own.field("centre")))
        found, at, n = np.unique(label, return_inverse=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(n)[:-1]])
        totals = pa.array(list(np.add.reduceat(x[order], cuts)), pa.list_(pa.float64()))
        sums = [pa.array(np.add.reduceat(v[order], cuts)) for v in (np.sqrt(d2), d2)]
        return found, [pa.array(n), totals, *sums]

    parts = _over(_sent(blocks, centres.select(*GROUP, "cluster", "centre"), narrow), "n long, total array<double>, d double, d2 double", kernel)
    total = vector_to_array(Summarizer.sum(array_to_vector("total")))
    sums = parts.groupBy(*GROUP, "cluster").agg(F.sum("n").alias("n"), total.alias("total"), F.sum("d").alias("d"), F.sum("d2").alias("d2"))
    sums = sums.select(*GROUP, "cluster", "n", F.transform("total", lambda v: v / F.col("n")).alias("mean"), "d", "d2")
    return centres.join(sums, [*GROUP, "cluster"], "left").fillna(0, ["n", "d", "d2"])


def assigned(blocks: Blocks, centres: DataFrame) -> DataFrame:
    """(bag, start, cluster, vec_id, d2): every row with its nearest centre."""

    def kernel(ids, x, own):
        label, d2, _ = nearest_two(x, _matrix(own.field("centre")))
        return label, [pa.array(ids), pa.array(d2)]

    return _over(_sent(blocks, centres.select(*GROUP, "cluster", "centre")), "vec_id long, d2 double", kernel)


def _ranked(values: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    return np.lexsort((ids, np.round(values, _DIGITS)))[:most]


def candidates(blocks: Blocks, wanted: DataFrame, narrow: bool = False) -> DataFrame:
    """(bag, start, cluster, vec_id, m, o, take, pull, push, rule, size, strategy): of each cluster with take > 0, the first ``take`` rows of each block by its rule.

    ``wanted`` has (bag, start, cluster, centre, anchor, take, pull, push, rule, size, strategy) for all clusters of a bag.  m and o are the squared
    distances to the anchor and to the next other centre.  rule: mean (least m), mean_margin (m / o), margin_max (m - o), objective
    ((1 + pull) m - push o), or any: least m among all rows of the bag, for clusters without rows.
    """

    def kernel(ids, x, own):
        label, _, other = nearest_two(x, _matrix(own.field("centre")))
        take, rule = own.field("take").to_numpy(), own.field("rule").to_pylist()
        anchors, pull, push = own.field("anchor"), own.field("pull").to_numpy(), own.field("push").to_numpy()
        at, found, m_, o_ = [], [], [], []
        order = np.argsort(label, kind="stable")
        cuts = np.searchsorted(label[order], np.arange(len(take) + 1))
        for c in np.flatnonzero(take > 0).tolist():
            rows = np.arange(len(x)) if rule[c] == "any" else order[cuts[c] : cuts[c + 1]]
            if not len(rows):
                continue
            m, o = np.square(x[rows] - anchors[c].values.to_numpy()).sum(1), other[rows]
            score = {"any": m, "mean": m, "mean_margin": m / np.maximum(o, 1e-12), "margin_max": m - o, "objective": (1.0 + pull[c]) * m - push[c] * o}[rule[c]]
            best = _ranked(score, ids[rows], int(take[c]))
            at.append(np.full(len(best), c))
            found.append(ids[rows][best])
            m_.append(m[best])
            o_.append(o[best])
        joined = [np.concatenate(v) if v else np.zeros(0) for v in (at, found, m_, o_)]
        at = pa.array(joined[0].astype(np.int64))
        told = [own.field(c).take(at) for c in ("take", "pull", "push", "rule", "size", "strategy")]
        return at, [pa.array(joined[1].astype(np.int64)), pa.array(joined[2]), pa.array(joined[3]), *told]

    wanted = wanted.select(*GROUP, "cluster", "centre", "anchor", F.col("take").cast("int"), F.col("pull").cast("double"), F.col("push").cast("double"), "rule", F.col("size").cast("long"), "strategy")
    return _over(_sent(blocks, wanted, narrow), "vec_id long, m double, o double, take int, pull double, push double, rule string, size long, strategy string", kernel)


def _nearest(clusters: DataFrame, take, rule="mean") -> DataFrame:
    """What ``candidates`` wants of (bag, start, cluster, centre, anchor), for the ``take`` rows nearest each anchor."""
    plain = {"pull": F.lit(0.0), "push": F.lit(0.0), "rule": rule if not isinstance(rule, str) else F.lit(rule), "size": F.lit(0), "strategy": F.lit("mean")}
    return clusters.select(*GROUP, "cluster", "centre", "anchor", take.alias("take"), *(c.alias(n) for n, c in plain.items()))


def _vectors(rows: DataFrame, picks: DataFrame, narrow: bool = False, *more: str) -> DataFrame:
    """``picks`` (bag, start, cluster, vec_id, *more) with their vectors as centre."""
    return (F.broadcast(picks) if narrow else picks).join(rows.select("bag", "vec_id", F.col("x").alias("centre")), ["bag", "vec_id"]).select(*GROUP, "cluster", "vec_id", "centre", *more)


def _best(found: DataFrame, value, *more) -> DataFrame:
    """The row of least ``value``, then id, of each cluster."""
    low = F.min(F.struct(F.round(value, _DIGITS).alias("value"), "vec_id", *more)).alias("low")
    return found.groupBy(*GROUP, "cluster").agg(low).select(*GROUP, "cluster", "low.vec_id")


def _chosen(blocks: Blocks, centres: DataFrame, state: DataFrame, how: Medoids, step: int, narrow: bool = False) -> DataFrame:
    """(bag, start, cluster, vec_id): the refined medoid of every cluster with rows; ``state`` is ``statistics`` of ``centres``."""
    sized = state.where("n > 0")
    if how.push_mode == "adaptive":
        sized = formulas.separation_weight(sized, how.push, *how.scale, by=GROUP).withColumnRenamed("weight", "push")
    elif how.push_mode == "density":
        sized = formulas.density_rank(sized.withColumn("spread", F.round(F.col("d") / F.col("n"), _DIGITS)), how.low, how.high, by=GROUP).withColumnRenamed("weight", "push")
    else:
        sized = sized.withColumn("push", F.lit(float(how.push)))
    several = F.count(F.lit(1)).over(Window.partitionBy(*GROUP)) > 1  # one centre has no next one
    size = formulas.shortlist_size(F.col("n"), how.floor, how.cap) if how.adaptive_size else F.lit(how.size).cast("long")
    rule = F.when(several, formulas.strategy(F.lit(step), F.col("n"), how.strategy, how.two_stage, how.large, how.threshold)).otherwise("mean")
    plain = F.col("n") < how.least
    sized = sized.withColumn("several", several).withColumn("size", size).withColumn("strategy", rule)
    whole = (F.col("size") <= 0) | (F.col("size") >= F.col("n"))
    wide = F.greatest(F.col("size"), F.least(F.bround(F.col("size") * F.lit(how.multiple), 0).cast("long"), F.col("n")))
    knn = F.col("strategy").startswith("knn")
    sized = sized.select(
        *GROUP, "cluster", F.col("mean").alias("anchor"), "size", "strategy",
        F.when(plain, 1).when(whole, 1).when(knn, wide).otherwise(F.col("size")).cast("int").alias("take"),
        F.when(plain, F.lit(0.0)).otherwise(F.lit(float(how.pull))).alias("pull"),
        F.when(plain | ~F.col("several"), F.lit(0.0)).otherwise(F.col("push")).alias("push"),
        F.when(plain, "mean").when(whole, "objective").when(knn, "mean").otherwise(F.col("strategy")).alias("rule"),
    )
    # Centres without rows still stand between the others' rows and their next centre.
    every = centres.select(*GROUP, "cluster", "centre").join(sized, [*GROUP, "cluster"], "left")
    found = candidates(blocks, every.fillna(0, ["take", "pull", "push", "size"]).fillna("mean", ["rule", "strategy"]), narrow)
    m, o = F.col("m"), F.col("o")
    first = F.when(F.col("rule") == "mean_margin", m / F.greatest(o, F.lit(1e-12))).when(F.col("rule") == "margin_max", m - o).when(F.col("rule") == "objective", (1.0 + F.col("pull")) * m - F.col("push") * o).otherwise(m)
    own = Window.partitionBy(*GROUP, "cluster")
    found = found.withColumn("place", F.row_number().over(own.orderBy(F.round(first, _DIGITS), "vec_id"))).where("place <= take")
    second = F.when(F.col("strategy") == "knn_mean_margin", m - F.lit(float(how.weight)) * o).when(F.col("strategy") == "knn_mean_ratio", m / F.greatest(o, F.lit(1e-12)))
    found = found.withColumn("place", F.row_number().over(own.orderBy(F.round(second, _DIGITS).asc_nulls_first(), "place"))).where("place <= greatest(size, 1) OR rule = 'objective'")
    return _best(found, (1.0 + F.col("pull")) * m - F.col("push") * o)


def refill(blocks: Blocks, medoids: DataFrame, picks: DataFrame, narrow: bool = False) -> DataFrame:
    """``picks`` with the clusters of ``medoids`` that they lack: of each bag, the untaken rows farthest from their centres.

    Which clusters lack rows, and how many, is known from small tables; only blocks of such bags are read.
    """
    lost = medoids.select(*GROUP, "cluster").join(picks, [*GROUP, "cluster"], "left_anti")
    lost = lost.withColumn("place", F.row_number().over(Window.partitionBy(*GROUP).orderBy("cluster")))
    most = lost.groupBy(*GROUP).agg(F.max("place").alias("lack"))
    taken = picks.select(*GROUP, "cluster", F.col("vec_id").alias("pick"))
    some = medoids.join(most, GROUP).join(taken, [*GROUP, "cluster"], "left").select(*GROUP, "cluster", "centre", "lack", F.coalesce("pick", "vec_id").alias("pick"), F.col("pick").isNotNull().alias("taken"))

    def kernel(ids, x, own):
        label, d2, _ = nearest_two(x, _matrix(own.field("centre")))
        taken = own.field("pick").to_numpy()[own.field("taken").to_numpy(zero_copy_only=False)]
        free = np.flatnonzero(~np.isin(ids, taken))
        best = free[_ranked(-d2[free], ids[free], int(own.field("lack")[0].as_py()))]
        return label[best], [pa.array(ids[best]), pa.array(d2[best])]

    far = _over(_sent(blocks, some, narrow), "vec_id long, d2 double", kernel)
    far = far.withColumn("place", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.round("d2", _DIGITS).desc(), "vec_id")))
    return picks.unionByName(lost.join(far.drop("cluster"), [*GROUP, "place"]).select(*GROUP, "cluster", "vec_id"))


# Loops


def _rounds(first: DataFrame, rounds: int, step: Callable[[DataFrame, int, bool], DataFrame], mend: Callable[[DataFrame, DataFrame, bool], DataFrame] | None = None) -> DataFrame:
    """Takes ``step`` until the centres of every (bag, start) stay; those that stay rest. All centres at the end.

    ``step(centres, k, narrow)`` gives the next centres with the column ``stays``; of a (bag, start), all rows have to.  Where it gives
    fewer centres than there were, ``mend(centres, next, narrow)`` adds the rest.  narrow: all centres have ``NARROW_BYTES`` at most.
    """
    group = Window.partitionBy(*GROUP)
    resting, moving = [], written(first, "centres")
    n, bytes_ = moving.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("centre") * 8), F.lit(0))).first()
    narrow = bytes_ <= NARROW_BYTES
    for k in range(rounds):
        after = written(step(moving, k, narrow).withColumn("stays", F.min("stays").over(group)), "centres")
        found, on = after.agg(F.count(F.lit(1)), F.coalesce(F.sum((~F.col("stays")).cast("long")), F.lit(0))).first()
        if mend and found < n:
            after = written(mend(moving, after.drop("stays"), narrow).withColumn("stays", F.min("stays").over(group)), "centres")
            on = after.where("NOT stays").count()
        resting.append(after.where("stays").drop("stays"))
        moving, n = after.where("NOT stays").drop("stays"), on
        if not on:
            break
    for rest in resting:
        moving = moving.unionByName(rest)
    return written(moving, "centres")


def kmeans(blocks: Blocks, first: DataFrame, rounds: int = 10, tolerance: float = 1e-4) -> DataFrame:
    """(bag, start, cluster, centre) after Lloyd's rounds from ``first``; a centre without rows stays where it is."""

    def step(centres: DataFrame, k: int, narrow: bool) -> DataFrame:
        found = statistics(blocks, centres, narrow)
        moved = F.when(F.col("n") > 0, F.col("mean")).otherwise(F.col("centre"))
        shift = F.aggregate(F.zip_with("centre", moved, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        return found.select(*GROUP, "cluster", moved.alias("centre"), (shift <= tolerance * tolerance).alias("stays"))

    return _rounds(first.select(*GROUP, "cluster", "centre"), rounds, step)


def seeded_starts(rows: DataFrame, blocks: Blocks, counts: DataFrame, seed: int = 42, starts: int = 1, rounds: int = 2) -> DataFrame:
    """(bag, start, cluster, vec_id, centre): k rows of each bag by oversampled k-means++, for ``counts`` (bag, k).

    The first is the row of the least hash.  In each round a row is drawn with the probability 2 k d2 / (sum of d2), by its hash;
    each drawn row weighs as many rows as are nearest it, and of them k are kept: the heaviest, then whichever has the most
    weight times squared distance to the kept.  Start i draws with seed + 997 i.  Bags with fewer different rows than k get fewer.
    """
    tries = rows.select("bag", "vec_id", "x").withColumn("start", F.explode(F.array(*(F.lit(s) for s in range(starts)))))
    order = shuffle_key(str(seed), F.col("start") * 997, "bag", "vec_id")
    first = tries.groupBy(*GROUP).agg(F.min(F.struct(order.alias("key"), "vec_id", "x")).alias("low")).select(*GROUP, F.lit(0).alias("cluster"), "low.vec_id", F.col("low.x").alias("centre"))
    drawn = written(first, "drawn")
    for r in range(rounds):
        near = assigned(blocks, drawn)
        total = near.groupBy(*GROUP).agg(F.sum("d2").alias("all"))
        u = F.conv(F.substring(shuffle_key(str(seed), F.col("start") * 997, F.lit(r), "bag", "vec_id"), 1, 12), 16, 10).cast("double") / float(1 << 48)
        more = near.join(total, GROUP).join(counts, "bag").where(u * F.col("all") < 2.0 * F.col("k") * F.col("d2")).where("d2 > 0")
        more = _vectors(rows, more.select(*GROUP, F.lit(0).alias("cluster"), "vec_id"))
        both = drawn.unionByName(more).dropDuplicates([*GROUP, "vec_id"])
        drawn = written(both.withColumn("cluster", F.row_number().over(Window.partitionBy(*GROUP).orderBy("vec_id")) - 1), "drawn")
    weighed = statistics(blocks, drawn).join(counts, "bag")
    kinds = {f.name: f.dataType.simpleString() for f in drawn.schema}

    def keep(group):
        import pandas as pd

        group = group.sort_values("vec_id")
        x, w, k = np.stack(group["centre"].to_numpy()), group["n"].to_numpy(float), int(group["k"].iloc[0])
        picks, far = [int(w.argmax())], np.square(x - x[int(w.argmax())]).sum(1)
        while len(picks) < min(k, len(x)) and np.round(w * far, _DIGITS).max() > 0:
            picks.append(int(np.round(w * far, _DIGITS).argmax()))
            far = np.minimum(far, np.square(x - x[picks[-1]]).sum(1))
        kept = group.iloc[picks]
        return pd.DataFrame({"bag": kept["bag"], "start": kept["start"], "cluster": np.arange(len(picks)), "vec_id": kept["vec_id"], "centre": kept["centre"]})

    schema = f"bag {kinds['bag']}, start int, cluster int, vec_id long, centre array<double>"
    return written(weighed.select(*GROUP, "vec_id", "centre", "n", "k").groupBy(*GROUP).applyInPandas(keep, schema), "starts")


def farthest_starts(rows: DataFrame, blocks: Blocks, first: DataFrame, counts: DataFrame, batch: int = 16) -> DataFrame:
    """(bag, start, cluster, vec_id, centre): ``first`` (one row for each bag and start) and after it, up to k of ``counts`` (bag, k), always
    the row farthest from all before it; ties go to the least id. It ends early where all rows are taken or equal ones that are.

    A round reads the blocks once.  Each gives the ``batch`` rows that are farthest, and the distance of the next one as a bound: no
    other row of it can be farther, now or later.  So of all batches together rows can be taken, in the exact order, for as long as
    the farthest of them is beyond the largest bound; a round takes one row at least.
    """

    def kernel(ids, x, own):
        label, d2, _ = nearest_two(x, _matrix(own.field("centre")))
        order = _ranked(-d2, ids, batch + 1)
        bound = d2[order[batch]] if len(order) > batch else -1.0
        order = order[:batch]
        return label[order], [pa.array(ids[order]), pa.array(d2[order]), pa.array(np.full(len(order), bound)), pa.array(list(x[order]), pa.list_(pa.float64()))]

    def taken(group):
        import pandas as pd

        group = group.sort_values("vec_id")
        x, far, bound = np.stack(group["x"].to_numpy()), group["d2"].to_numpy(float), round(float(group["bound"].max()), _DIGITS)
        picks, left = [], int(group["k"].iloc[0] - group["n"].iloc[0])
        while len(picks) < min(left, len(x)):
            best = int(np.round(far, _DIGITS).argmax())
            if round(float(far[best]), _DIGITS) <= (bound if picks else 0.0) or round(float(far[best]), _DIGITS) <= 0.0:
                break
            picks.append(best)
            far = np.minimum(far, np.square(x - x[best]).sum(1))
        found = group.iloc[picks]
        at = int(group["n"].iloc[0])
        return pd.DataFrame({"bag": found["bag"], "start": found["start"], "cluster": np.arange(at, at + len(picks)), "vec_id": found["vec_id"], "centre": found["x"]})

    chosen = written(first.select(*GROUP, "cluster", "vec_id", "centre"), "farthest")
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    schema = f"bag {kinds['bag']}, start {kinds['start']}, cluster int, vec_id long, centre array<double>"
    moving = chosen.select(*GROUP).distinct()
    while True:
        now = chosen.join(moving, GROUP)
        size = now.groupBy(*GROUP).agg(F.count(F.lit(1)).cast("int").alias("n")).join(counts.select("bag", "k"), "bag").where("n < k")
        far = _over(_sent(blocks, now.join(size.select(*GROUP), GROUP)), "vec_id long, d2 double, bound double, x array<double>", kernel)
        more = written(far.drop("cluster").join(size, GROUP).groupBy(*GROUP).applyInPandas(taken, schema), "farthest")
        moving = written(more.select(*GROUP).distinct(), "moving")
        if moving.isEmpty():
            return chosen
        chosen = written(chosen.unionByName(more), "farthest")


def representatives(rows: DataFrame, blocks: Blocks, centres: DataFrame) -> DataFrame:
    """(bag, start, cluster, vec_id, centre): of each centre the nearest of its own rows, or of all rows where it has none."""
    found = statistics(blocks, centres.select(*GROUP, "cluster", "centre"))
    rule = F.when(F.col("n") > 0, "mean").otherwise("any")
    return _vectors(rows, _best(candidates(blocks, _nearest(found.withColumn("anchor", F.col("centre")), F.lit(1), rule)), F.col("m")))


def kmedoids(rows: DataFrame, blocks: Blocks, first: DataFrame, how: Medoids = Medoids()) -> DataFrame:
    """(bag, start, cluster, vec_id, centre): medoids of every bag and start from ``first``, until they repeat."""

    def seen(picks: DataFrame, medoids: DataFrame, narrow: bool) -> DataFrame:
        before = medoids.select(*GROUP, "cluster", F.col("vec_id").alias("was"))
        return _vectors(rows, picks.join(before, [*GROUP, "cluster"]), narrow, "was").withColumn("stays", F.col("vec_id") == F.col("was")).drop("was")

    def step(medoids: DataFrame, k: int, narrow: bool) -> DataFrame:
        return seen(_chosen(blocks, medoids, statistics(blocks, medoids, narrow), how, k, narrow), medoids, narrow)

    def mend(medoids: DataFrame, after: DataFrame, narrow: bool) -> DataFrame:
        return seen(refill(blocks, medoids, after.select(*GROUP, "cluster", "vec_id"), narrow), medoids, narrow)

    return _rounds(first.select(*GROUP, "cluster", "vec_id", "centre"), how.rounds, step, mend)


def best_start(blocks: Blocks, medoids: DataFrame, by: str = "inertia") -> DataFrame:
    """``medoids`` of the best start of each bag: the least sum of squared distances (inertia) or the largest least distance
    of two medoids (dispersion). Of equal ones the first."""
    if by == "inertia":
        score = statistics(blocks, medoids.select(*GROUP, "cluster", "centre")).groupBy(*GROUP).agg(F.sum("d2").alias("score"))
    elif by == "dispersion":
        score = contested(medoids.withColumns({"n": F.lit(1).cast("long"), "mean": F.col("centre"), "d2": F.lit(0.0)}), "closest_pair").groupBy(*GROUP).agg((-F.min("score")).alias("score"))
    else:
        raise ValueError(f"no criterion {by!r}")
    least = score.groupBy("bag").agg(F.min(F.struct(F.round("score", _DIGITS).alias("score"), "start")).alias("low")).select("bag", "low.start")
    return medoids.join(least, GROUP)


#: Criteria of ``contested``; those that put the largest scores first.
CRITERIA = {"closest_pair": False, "cluster_size": True, "centroid_dist": True, "silhouette": False, "within_variance": True}


def contested(state: DataFrame, by: str) -> DataFrame:
    """(bag, start, cluster, score): how much each medoid of ``state`` (as ``statistics`` gives it) is worth another look.

    closest_pair: its distance to the nearest other medoid.  cluster_size: its rows.  centroid_dist: its squared distance to its
    mean.  silhouette: (other - own) / (other + own) of its distances to the nearest other mean and its own.  within_variance: mean squared
    distance of its rows.  A bag's medoids are compared in one row of arrays.
    """
    if by not in CRITERIA:
        raise ValueError(f"no criterion {by!r}")
    if by == "cluster_size":
        return state.select(*GROUP, "cluster", F.col("n").cast("double").alias("score"))
    if by == "within_variance":
        return state.select(*GROUP, "cluster", (F.col("d2") / F.greatest("n", F.lit(1))).alias("score"))
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    packed = state.select(*GROUP, F.struct("cluster", "centre", F.coalesce("mean", F.transform("centre", lambda v: v * 0.0)).alias("mean")).alias("own"))
    packed = packed.groupBy(*GROUP).agg(F.array_sort(F.collect_list("own")).alias("own"))
    ship(state.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column("own")[r].values
                medoids, means = _matrix(own.field("centre")), _matrix(own.field("mean"))
                if by == "centroid_dist":
                    score = np.square(medoids - means).sum(1)
                else:
                    other = np.array([np.sqrt(np.square((medoids if by == "closest_pair" else means) - m).sum(1)) for m in medoids])
                    np.fill_diagonal(other, np.inf)
                    score = other.min(1)
                    if by == "silhouette":
                        mine = np.sqrt(np.square(medoids - means).sum(1))
                        score = np.where(np.isinf(score), 1.0, (score - mine) / np.maximum(score + mine, 1e-8))
                group = [batch.column(c).take(pa.array(np.full(len(score), r))) for c in GROUP]
                yield pa.RecordBatch.from_arrays([*group, own.field("cluster"), pa.array(score)], names=[*GROUP, "cluster", "score"])

    return packed.mapInArrow(run, f"bag {kinds['bag']}, start {kinds['start']}, cluster int, score double")


def polish(rows: DataFrame, blocks: Blocks, medoids: DataFrame, how: Medoids, most: int, by: str = "closest_pair", passes: int = 1, forward: int = 1) -> DataFrame:
    """``medoids`` after looking again, in each pass, at the ``most`` most contested of each bag and start.

    A contested medoid is chosen anew by the fixed shortlist of ``how``; with ``forward`` over 1, of the ``forward`` rows nearest its
    mean, the one farthest from all other medoids.  The others stand as they were at the start of the pass; a cluster of
    one row stays.  A pass in which nothing moves is the last.
    """
    plain = Medoids(strategy=how.strategy, size=how.size, multiple=how.multiple, weight=how.weight, pull=how.pull, push=how.push)
    for _ in range(passes if most > 0 else 0):
        state = written(statistics(blocks, medoids), "state")
        order = F.desc if CRITERIA[by] else F.asc
        place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(order(F.round("score", _DIGITS)), "cluster"))
        wide = F.count(F.lit(1)).over(Window.partitionBy(*GROUP)) > 1
        ranked = contested(state, by).withColumn("place", place).withColumn("wide", wide)
        top = ranked.where((F.col("place") <= most) & F.col("wide")).select(*GROUP, "cluster").join(state.where("n > 1").select(*GROUP, "cluster"), [*GROUP, "cluster"])
        if forward > 1 and how.size > 0:
            wanted = state.join(top.withColumn("take", F.lit(forward)), [*GROUP, "cluster"], "left").fillna(0, ["take"])
            found = candidates(blocks, _nearest(wanted.withColumn("anchor", F.coalesce("mean", "centre")), F.col("take")))
            found = found.withColumn("place", F.row_number().over(Window.partitionBy(*GROUP, "cluster").orderBy(F.round("m", _DIGITS), "vec_id"))).where(F.col("place") <= forward)
            picks = found.groupBy(*GROUP, "cluster").agg(F.min(F.struct((-F.round(F.sqrt("o"), _DIGITS)).alias("v"), "place", "vec_id")).alias("low")).select(*GROUP, "cluster", "low.vec_id")
        else:
            picks = _chosen(blocks, medoids, state, plain, 1).join(top, [*GROUP, "cluster"], "left_semi")
        new = picks.select(*GROUP, "cluster", F.col("vec_id").alias("new"))
        ids = medoids.join(new, [*GROUP, "cluster"], "left").select(*GROUP, "cluster", F.coalesce("new", "vec_id").alias("vec_id"), (F.col("new") != F.col("vec_id")).alias("moved"))
        ids = written(ids, "polished")
        if ids.where("moved").isEmpty():
            break
        medoids = written(_vectors(rows, ids.drop("moved")), "centres")
    return medoids
