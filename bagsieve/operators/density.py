"""Density clustering of every bag of a table: core distances, spanning forest, condensed tree, stability.

Every two blocks of a bag's rows (see ``bagwise``) meet once for the core distances, which join most rows to a denser neighbour, and
once in each round of the spanning forest that asks many rows; what leaves a pair of blocks is the few nearest of each row, or the
lightest edge of each component that it holds, so pairs of rows are never records.  A round asks all components but a bag's
largest, so few rows are left after the first; those are shipped to the blocks.  The hierarchy of a bag's forest is made in one task from its edges alone (24 bytes a row, no vectors), checked for their number first.

Mutual reachability of two rows is the largest of their distance and their core distances; a row's core distance is that to its
k-th nearest row, itself the first.  Edges of equal weight (to 9 digits) merge at once, so the result doesn't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import half_even, shuffle_key
from ..functions.vectors import mean_vector, squared_l2
from ..session import ship
from ..sources.tables import written
from . import bagwise, pairs

_DIGITS = 9
#: Rows of a bag whose hierarchy fits a task: their edges are 24 bytes each.
EDGES = 20_000_000


#: Blocks of ``bagwise`` in a slot at most.
SLOT = 8


def _met(left: DataFrame, right: DataFrame, counts: DataFrame) -> DataFrame:
    """Every block of ``left`` (bag, block, own) with every block of ``right`` of its bag; two slots are a key."""
    each = F.explode(F.sequence(F.lit(0), "_last"))
    sent = pairs.slotted(right.select("bag", "block", F.col("own").alias("other")).join(counts, "bag"), SLOT).select("bag", "other", each.alias("_s"), F.col("_slot").alias("_t"))
    own = pairs.slotted(left.join(counts, "bag"), SLOT).withColumn("_s", F.col("_slot")).withColumn("_t", each).drop("n", "_slot", "_last")
    return own.join(sent, ["bag", "_s", "_t"]).drop("_s", "_t")


class _Least:
    """The ``k`` least values of each row, and the ids of their columns, as parts of the columns come.

    What is below a row's bound waits until about as many columns have come again as before.
    """

    def __init__(self, n: int, k: int):
        self.values, self.ids = np.full((n, k), np.inf), np.full((n, k), -1)
        self.seen, self.settled, self.waiting = 0, 0, []

    def add(self, d: np.ndarray, ids: np.ndarray, axis: int = 1) -> None:
        """Columns ``ids`` of all rows; with ``axis`` 0, d has the rows as columns."""
        k, m = self.values.shape[1], d.shape[axis]
        bound = self.values[:, -1]
        if not self.settled and m > k:
            # minima of groups are values, too: the k-th of them is a bound
            g = m // 16
            low = d if g < k else d[:, : 16 * g].reshape(len(d), 16, g).min(1) if axis else d[: 16 * g].reshape(16, g, -1).min(0)
            bound = np.partition(low, k - 1, axis)
            bound = np.nextafter(bound[:, k - 1] if axis else bound[k - 1], np.inf)
        one, two = pairs.where(d < (bound[:, None] if axis else bound))
        self.waiting.append((one if axis else two, d[one, two], ids[two if axis else one]))
        self.seen += m
        if self.seen >= 2 * self.settled:
            self.settle()

    def settle(self) -> None:
        row, value, found = (np.concatenate(v) for v in zip(*self.waiting))
        self.waiting, self.settled = [], self.seen
        if not len(row):
            return
        k = self.values.shape[1]
        some, at = np.unique(row, return_inverse=True)
        value, found = np.concatenate([self.values[some].ravel(), value]), np.concatenate([self.ids[some].ravel(), found])
        at = np.concatenate([np.repeat(np.arange(len(some)), k), at])
        order = np.lexsort((found, value, at))
        order = order[np.searchsorted(at[order], np.arange(len(some)))[:, None] + np.arange(k)]
        self.values[some], self.ids[some] = value[order], found[order]

    def lists(self) -> pa.Array:
        """Arrays of (d, id), d the root of the value."""
        if self.waiting:
            self.settle()
        n, k = self.values.shape
        told = pa.StructArray.from_arrays([pa.array(np.sqrt(self.values.ravel())), pa.array(self.ids.ravel())], names=["d", "id"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), told)


def core_distances(blocks: bagwise.Blocks, neighbours: DataFrame) -> DataFrame:
    """(bag, vec_id, core, near): the distance to the k-th nearest row, itself the first, for ``neighbours`` (bag, k), and the ids of the k nearest."""
    met = pairs.twice(blocks.packed.join(blocks.counts, "bag"), SLOT).join(F.broadcast(neighbours), "bag").select("bag", "block", "to", "own", "other", "k")
    kind = met.schema["bag"].dataType.simpleString()
    ship(met.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own, other, k = batch.column("own")[r].values, batch.column("other")[r].values, batch.column("k")[r].as_py()
                x, y, ids, ids_ = bagwise._matrix(own.field("x")), bagwise._matrix(other.field("x")), own.field("vec_id").to_numpy(), other.field("vec_id").to_numpy()
                same = batch.column("block")[r].as_py() == batch.column("to")[r].as_py()
                theirs = _Least(len(y), k)
                for part in pairs.tiles(len(x), len(y)):
                    d2 = pairs.squared(x[part], y)
                    mine = _Least(len(d2), k)
                    mine.add(d2, ids_)
                    if not same:
                        theirs.add(d2, ids[part], 0)
                    yield pa.RecordBatch.from_arrays([batch.column("bag").take(pa.array(np.full(len(d2), r))), own.field("vec_id")[part], mine.lists()], names=["bag", "vec_id", "near"])
                if not same:
                    yield pa.RecordBatch.from_arrays([batch.column("bag").take(pa.array(np.full(len(y), r))), other.field("vec_id"), theirs.lists()], names=["bag", "vec_id", "near"])

    near = met.mapInArrow(run, f"bag {kind}, vec_id long, near array<struct<d:double,id:long>>").groupBy("bag", "vec_id").agg(F.flatten(F.collect_list("near")).alias("near"))
    near = near.join(F.broadcast(neighbours), "bag").select("bag", "vec_id", F.expr("slice(array_sort(filter(near, v -> v.id >= 0)), 1, k)").alias("near"))
    return near.select("bag", "vec_id", F.element_at("near", -1)["d"].alias("core"), F.col("near")["id"].alias("near"))


def _reach(x: np.ndarray, y: np.ndarray, core: np.ndarray, core_: np.ndarray, part: np.ndarray, part_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the rows of x to those of y, and their reachability, infinite inside a component, both by products."""
    far = np.sqrt(pairs.squared(x, y))
    w = np.maximum(far, core_)
    np.maximum(w, core[:, None], out=w)
    np.copyto(w, np.inf, where=part[:, None] == part_)
    return far, w


def _first(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray, x: np.ndarray, y: np.ndarray, core: np.ndarray, core_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs i, j of rows of x (``n``) and y at the distances ``far``, the least exact reachability of each i and the first such j."""
    exact = np.maximum(core[i], core_[j])
    open_ = far > exact - 1e-8  # elsewhere the core distances decide
    exact[open_] = np.maximum(exact[open_], np.sqrt(pairs.direct(x, y, i[open_], j[open_])))
    w = np.round(exact, _DIGITS)
    order = np.lexsort((j, w, i))  # ids ascend, so that the first of equal ones has the least id
    rows, first = np.unique(i[order], return_index=True)
    low, best = np.full(n, np.inf), np.zeros(n, int)
    low[rows], best[rows] = w[order][first], j[order][first]
    return low, best


def _close(low: np.ndarray) -> np.ndarray:
    """Up to where products may be wrong about what is least; nothing where all is infinite."""
    return np.where(np.isfinite(low), low + np.maximum(1e-8, low * 1e-9), -np.inf)


def lightest_of(x: np.ndarray, y: np.ndarray, core: np.ndarray, core_: np.ndarray, part: np.ndarray, part_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least reachability (to 9 digits, infinite if none) of each row of x to a row of y of another component, and the first such row.

    Products rule out all but what may be least; that is made from differences, so that it is the same from either side.
    """
    far, w = _reach(x, y, core, core_, part, part_)
    i, j = pairs.where(w <= _close(w.min(1))[:, None])
    return _first(len(x), i, j, far[i, j], x, y, core, core_)


def lightest_both(x: np.ndarray, y: np.ndarray, core: np.ndarray, core_: np.ndarray, part: np.ndarray, part_: np.ndarray) -> tuple[tuple, tuple]:
    """``lightest_of`` x to y and of y to x, from the same products, in tiles."""
    mine, low_, best_ = [], np.full(len(y), np.inf), np.zeros(len(y), int)
    for k in pairs.tiles(len(x), len(y)):
        far, w = _reach(x[k], y, core[k], core_, part[k], part_)
        i, j = pairs.where(w <= _close(w.min(1))[:, None])
        mine.append(_first(len(far), i, j, far[i, j], x[k], y, core[k], core_))
        i, j = pairs.where(w <= _close(np.minimum(w.min(0), low_)))
        low, best = _first(len(y), j, i, far[i, j], y, x[k], core_, core[k])
        less = low < low_
        low_[less], best_[less] = low[less], best[less] + k.start
    low, best = (np.concatenate(v) for v in zip(*mine))
    return (low, best), (low_, best_)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """(bag, part, root, kept, w, a, b): chosen edges (bag, part, w, a, b, next) that join components, and every component's root.

    Of chosen edges of equal weight that make a circle, one is left out, whichever it is.
    """
    parts, at = np.unique(np.concatenate([group["part"].to_numpy(), group["next"].to_numpy()]), return_inverse=True)
    w, n, up = group["w"].to_numpy(), len(group), list(range(len(parts)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    kept = np.zeros(n, bool)
    for e in np.argsort(w, kind="stable").tolist():
        p, q = root(int(at[e])), root(int(at[n + e]))
        if p != q:
            kept[e], up[q] = True, p
    edges = group[kept]
    roots = pd.DataFrame({"part": parts, "root": parts[[root(k) for k in range(len(parts))]], "kept": False, "w": 0.0, "a": 0, "b": 0})
    out = pd.concat([roots, pd.DataFrame({"part": edges["part"], "root": edges["part"], "kept": True, "w": np.round(edges["w"], _DIGITS), "a": edges["a"], "b": edges["b"]})])
    out.insert(0, "bag", group["bag"].iloc[0])
    return out


def spanning_forest(blocks: bagwise.Blocks, core: DataFrame) -> DataFrame:
    """(bag, w, a, b): the lightest edges that join all rows of each bag, by the mutual reachability; a < b.

    In a round each component but the largest takes its lightest edge to another, until a bag is one component. Where ``core`` has
    ``near``, rows start with an edge to one of those that is no less dense: none is lighter, as all of a row's weigh its core distance at least.
    """
    rows = blocks.packed.select("bag", "block", F.explode("own").alias("r")).select("bag", "block", "r.vec_id", "r.x").join(core.select("bag", "vec_id", "core"), ["bag", "vec_id"])
    rows = written(rows, "reach")
    state, edges = written(rows.select("bag", "vec_id", F.col("vec_id").alias("part")), "parts"), []
    kind = rows.schema["bag"].dataType.simpleString()
    chosen = f"bag {kind}, part long, w double, a long, b long, next long"
    ship(rows.sparkSession)

    def told(batch: pa.RecordBatch, r: int, own: list, other: list, found: tuple) -> pa.RecordBatch:
        """The lightest edge of each component of ``own`` (ids, parts) to ``other``; found: weights and places."""
        (ids, part), (ids_, part_), (low, j) = own, other, found
        a, b = np.minimum(ids, ids_[j]), np.maximum(ids, ids_[j])
        order = np.lexsort((b, a, low, part))
        order = order[np.isfinite(low[order])]
        order = order[np.unique(part[order], return_index=True)[1]]
        columns = [pa.array(v[order]) for v in (part, low, a, b, part_[j])]
        return pa.RecordBatch.from_arrays([batch.column("bag").take(pa.array(np.full(len(order), r))), *columns], names=["bag", "part", "w", "a", "b", "next"])

    def lightest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                both = [batch.column(c)[r].values for c in ("own", "other")]
                own, other = ([v.field(c).to_numpy() for c in ("vec_id", "part")] for v in both)
                (x, core), (y, core_) = ((bagwise._matrix(v.field("x")), v.field("core").to_numpy()) for v in both)
                if "to" not in batch.schema.names:  # rows that are asked, and a block
                    at = [lightest_of(x[k], y, core[k], core_, own[1][k], other[1]) for k in pairs.tiles(len(x), len(y))]
                    yield told(batch, r, own, other, tuple(np.concatenate(v) for v in zip(*at)))
                    continue
                mine, theirs = lightest_both(x, y, core, core_, own[1], other[1])
                yield told(batch, r, own, other, mine)
                if batch.column("block")[r].as_py() != batch.column("to")[r].as_py():
                    yield told(batch, r, other, own, theirs)

    def merge(found: DataFrame) -> DataFrame:
        """``state`` after the edges ``found``, which are kept if they join components."""
        roots = written(found.groupBy("bag").applyInPandas(_merged, f"bag {kind}, part long, root long, kept boolean, w double, a long, b long"), "merged")
        edges.append(roots.where("kept").select("bag", "w", "a", "b"))
        return written(state.join(roots.where("NOT kept").select("bag", "part", "root"), ["bag", "part"], "left").select("bag", "vec_id", F.coalesce("root", "part").alias("part")), "parts")

    if "near" in core.columns:
        near = core.select("bag", F.col("vec_id").alias("part"), F.col("core").alias("w"), F.explode("near").alias("next")).where("next <> part")
        near = near.join(core.select("bag", F.col("vec_id").alias("next"), F.col("core").alias("_core")), ["bag", "next"]).where("_core <= w")
        near = near.groupBy("bag", "part", "w").agg(F.min("next").alias("next"))
        state = merge(near.select("bag", "part", "w", F.least("part", "next").alias("a"), F.greatest("part", "next").alias("b"), "next"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    while True:
        sizes = state.groupBy("bag", "part").agg(F.count(F.lit(1)).alias("size"))
        sizes = written(sizes.withColumn("_place", F.row_number().over(Window.partitionBy("bag").orderBy(F.desc("size"), "part"))).where("_place > 1"), "sizes")
        asked = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if not asked:
            break
        now = rows.join(state, ["bag", "vec_id"]).join(F.broadcast(sizes.select("bag").distinct()), "bag", "left_semi")
        pack = F.array_sort(F.collect_list(F.struct("vec_id", "x", "core", "part")))
        packed = now.groupBy("bag", "block").agg(pack.alias("own"))
        if asked * (width + 3) * 8 <= bagwise.NARROW_BYTES:
            few = now.join(sizes.select("bag", "part"), ["bag", "part"], "left_semi").groupBy("bag").agg(pack.alias("own"))
            met = packed.withColumnRenamed("own", "other").join(F.broadcast(few), "bag").select("bag", "own", "other")
        else:
            met = pairs.twice(packed.join(blocks.counts, "bag"), SLOT)
        best = F.min(F.struct("w", "a", "b", "next")).alias("m")
        found = met.mapInArrow(lightest, chosen).join(sizes.select("bag", "part"), ["bag", "part"], "left_semi")
        found = written(found.groupBy("bag", "part").agg(best).select("bag", "part", "m.*"), "lightest")
        if found.isEmpty():
            break
        state = merge(found)
    out = rows.sparkSession.createDataFrame([], f"bag {kind}, w double, a long, b long")
    for more in edges:
        out = out.unionByName(more)
    return out


def hierarchy(w: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, cluster (-1: noise) and confidence of the rows of a spanning tree, by the stability of its condensed tree.

    Down from the root, a merge of several parts of ``least`` rows splits a cluster; smaller parts fall out of it.  A cluster's stability is
    the sum over its rows of 1 / weight where they leave it less that where it began.  Chosen are the clusters more
    stable than those below them together; the root never is.  Clusters are numbered by their least id.
    """
    ids = np.unique(np.concatenate([a, b]))
    n = len(ids)
    a, b, w = np.searchsorted(ids, a), np.searchsorted(ids, b), np.maximum(np.round(w, _DIGITS), 1e-9)
    order = np.argsort(w, kind="stable")
    up, node = list(range(n)), list(range(n))  # union-find over rows; the tree's node of each root
    children, size, lam = [()] * n, [1] * n, [0.0] * n

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for same in np.split(order, np.flatnonzero(np.diff(w[order])) + 1):
        touched: dict[int, list[int]] = {}
        for e in same.tolist():
            x, y = root(int(a[e])), root(int(b[e]))
            parts = touched.pop(x, [node[x]]) + touched.pop(y, [node[y]])
            up[y] = x
            touched[x] = parts
        for x, parts in touched.items():
            children.append(tuple(parts))
            size.append(sum(size[p] for p in parts))
            lam.append(1.0 / float(w[same[0]]))
            node[root(x)] = len(size) - 1
    parent, birth, stability, death = [-1], [0.0], [0.0], [0.0]
    fell, left = np.zeros(n, int), np.zeros(n)  # the cluster that each row falls out of, and where
    todo = [(len(size) - 1, 0)]
    while todo:
        at, c = todo.pop()
        if at < n:  # a cluster of one row
            fell[at] = c
            continue
        big = [p for p in children[at] if size[p] >= least]
        for p in children[at]:
            if p in big:
                if len(big) == 1:
                    todo.append((p, c))
                    continue
                parent.append(c)
                birth.append(lam[at])
                stability.append(0.0)
                death.append(lam[at])
                todo.append((p, len(parent) - 1))
            else:
                below = [p]
                while below:
                    q = below.pop()
                    if q < n:
                        fell[q], left[q] = c, lam[at]
                    below += children[q]
            stability[c] += size[p] * (lam[at] - birth[c])
        death[c] = max(death[c], lam[at])
    total, chosen, below_ = list(stability), [False] * len(parent), [0.0] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        chosen[c] = not below_[c] > total[c]
        total[c] = max(total[c], below_[c])
        below_[parent[c]] += total[c]
    own = [-1] * len(parent)
    for c in range(1, len(parent)):
        own[c] = own[parent[c]] if own[parent[c]] >= 0 else c if chosen[c] else -1
    cluster = np.array(own)[fell]
    confidence = np.where(cluster >= 0, np.minimum(left, np.array(death)[cluster]) / np.maximum(np.array(death)[cluster], 1e-300), 0.0)
    numbers: dict[int, int] = {}
    for c in cluster[cluster >= 0].tolist():
        numbers.setdefault(c, len(numbers))
    return ids, np.array([numbers.get(c, -1) for c in cluster.tolist()], int), confidence


def density_clusters(rows: DataFrame, blocks: bagwise.Blocks, params: DataFrame) -> DataFrame:
    """(bag, vec_id, cluster, confidence) for ``params`` (bag, least, k): least rows of a cluster, k-th neighbour of the core distance.

    Noise has cluster -1 and confidence 0. A bag of one row is noise.
    """
    blocks = bagwise.Blocks(blocks.packed.join(F.broadcast(params.select("bag")), "bag", "left_semi"), blocks.counts)
    forest = written(spanning_forest(blocks, written(core_distances(blocks, params.select("bag", "k")), "core")), "forest")
    worst = forest.groupBy("bag").count().agg(F.max("count")).first()[0] or 0
    if worst > EDGES:
        raise ValueError(f"a bag of {worst + 1} rows; the hierarchy of at most {EDGES} fits one task")
    kind = forest.schema["bag"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, cluster, confidence = hierarchy(group["w"].to_numpy(), group["a"].to_numpy(), group["b"].to_numpy(), int(group["least"].iloc[0]))
        return pd.DataFrame({"bag": group["bag"].iloc[0], "vec_id": ids, "cluster": cluster, "confidence": confidence})

    found = forest.join(params.select("bag", "least"), "bag").groupBy("bag").applyInPandas(run, f"bag {kind}, vec_id long, cluster int, confidence double")
    every = rows.select("bag", "vec_id").join(found, ["bag", "vec_id"], "left")
    return every.select("bag", "vec_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def density_sample(rows: DataFrame, ratio: float, seed: int = 42, by: str = "density") -> DataFrame:
    """(bag, vec_id, how): ``ratio`` of the rows of each bag, one of each dense cluster first.

    The clusters' least size is that which gives about as many as are wanted.  The row nearest a cluster's mean stands for it; the largest clusters, then
    the most certain, come first.  A bag without clusters takes the representatives of k-means; what is short is filled in the order of a
    hash.  ``by`` kmeans takes that way for all bags.  ``how`` is cluster, kmeans or filled, or all where the share is the whole bag.
    """
    if by not in ("density", "kmeans"):
        raise ValueError(f"no way {by!r} to sample")
    rows = written(rows.select("bag", "vec_id", "x"), "bags")
    plan = rows.groupBy("bag").agg(F.count(F.lit(1)).alias("n")).withColumn("want", F.greatest(F.lit(1), half_even(F.col("n") * F.lit(float(ratio)))))
    plan = plan.withColumn("least", F.greatest(F.lit(2), F.least("n", F.ceil(F.col("n") / F.col("want")))).cast("int"))
    plan = written(plan.withColumn("k", F.greatest(F.lit(1), F.floor(F.col("least") / 2)).cast("int")), "plan")
    whole = rows.join(plan.where("want >= n"), "bag").select("bag", "vec_id", F.lit("all").alias("how"))
    some = written(rows.join(plan.where("want < n").select("bag"), "bag", "left_semi"), "bags")
    blocks = bagwise.block(some)
    clusters = density_clusters(some, blocks, plan.where("want < n" if by == "density" else "false"))
    dense = written(clusters.where("cluster >= 0").join(some, ["bag", "vec_id"]), "dense")
    means = dense.groupBy("bag", "cluster").agg(mean_vector("x").alias("mean"), F.count(F.lit(1)).alias("size"), F.round(F.avg("confidence"), _DIGITS).alias("sure"))
    best = dense.join(means, ["bag", "cluster"]).groupBy("bag", "cluster", "size", "sure").agg(F.min(F.struct(F.round(squared_l2("x", "mean"), _DIGITS).alias("d"), "vec_id")).alias("m"))
    place = F.row_number().over(Window.partitionBy("bag").orderBy(F.desc("size"), F.desc("sure"), "cluster"))
    found = best.select("bag", "m.vec_id", place.alias("place"), F.lit("cluster").alias("how"))
    bare = plan.where("want < n").join(dense.select("bag").distinct(), "bag", "left_anti").select("bag", F.col("want").alias("k"))
    bare = written(bare, "bare")
    if not bare.isEmpty():
        first = bagwise.seeded_starts(some.join(bare.select("bag"), "bag", "left_semi"), blocks, bare, seed)
        reps = bagwise.representatives(some, blocks, bagwise.kmeans(blocks, first)).select("bag", "vec_id", "cluster").dropDuplicates(["bag", "vec_id"])
        found = found.unionByName(reps.select("bag", "vec_id", F.col("cluster").alias("place"), F.lit("kmeans").alias("how")))
    order = F.row_number().over(Window.partitionBy("bag").orderBy(F.col("place").isNull(), "place", shuffle_key(seed, "bag", "vec_id"), "vec_id"))
    filled = some.select("bag", "vec_id").join(found, ["bag", "vec_id"], "left").withColumn("order", order).join(plan.select("bag", "want"), "bag").where("order <= want")
    return whole.unionByName(filled.select("bag", "vec_id", F.coalesce("how", F.lit("filled")).alias("how")))
