"""Parallel swaps with the sums of distances kept up to date.

A swap changes two selected rows, so the sums of every other row change by two terms.  After a step only the rows that
moved are met with the blocks of rows, one with a weight of minus one and one with plus one, instead of all selected
rows; and only clusters that may be asked again are met at all, several of them in a block.  The vectors that can be asked
are written once; what each step writes is a table of ids and sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import shuffle_key
from ..sources.tables import discard, written
from . import ordered, refine

#: Weights of selected rows that no swap changes; with the others sums are made anew for each step.
STEADY = ("uniform", "cluster_size", "uncertainty")
#: Sums of weighted distances and of weights, to selected rows of other clusters and of the own one.
SUMS = ("os", "ow", "ss", "sw")


@dataclass(frozen=True)
class Passes:
    """passes: at most so many; a bag ends with the first that changes nothing.  sign, least, weight, spread: as in ``refine.swaps``.

    chunks: a pass deals each bag's clusters, in a seeded order of its own, into so many parts and takes one after the
    other, each on what those before left.  active: after the first pass only clusters that swapped in the last one are
    asked.  second: each pass takes a second step (with ``active``, on the clusters that have just swapped).  large: after
    the passes, one more step on clusters of so many rows (0: none).
    """

    passes: int = 2
    sign: int = -1
    least: int = 2
    weight: str = "uniform"
    spread: float = 0.0
    chunks: int = 1
    active: bool = False
    second: bool = False
    large: int = 0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.passes < 0 or self.chunks < 1:
            raise ValueError("passes are at least 0 and chunks at least 1")
        if self.sign not in (-1, 1):
            raise ValueError("sign must be -1 or 1")


def refined(rows: DataFrame, how: Passes, trace: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (bag, vec_id, cluster, x, selected[, is_seed]) after the passes, and the swaps (bag, cluster, out_id, in_id, delta) made.

    ``trace`` gets (pass, rows whose sums a step made or changed, swaps) of each step, at the price of a count.
    """
    run = _Run(rows, how, trace)
    open_ = run.able.select("bag", "cluster")
    for p in range(how.passes):
        end = p + 1 == how.passes and not how.large
        first = run.sweep(open_, p, 2 * p, end and not how.second)
        if first is None:
            break
        if how.active:
            open_ = first
        if how.second:
            more = run.sweep(open_, p, 2 * p + 1, end)
            if how.active and more is not None and how.chunks == 1:
                open_ = more
    if how.large and how.passes:
        run.step(run.large, how.passes, open_, True)
    return run.result(), run.swaps


class _Run:
    """The state of the passes: vectors, a table of sums, and the swaps so far."""

    def __init__(self, rows: DataFrame, how: Passes, trace: list | None):
        self.rows, self.how, self.trace, self.weights = rows, how, trace, None
        sizes = rows.groupBy("bag", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("selected").cast("long")).alias("own"))
        self.sizes = written(sizes.withColumn("others", F.sum("own").over(Window.partitionBy("bag")) - F.col("own")), "sizes")
        # a swap leaves these counts as they are, so no other cluster can ever have one
        self.able = self.sizes.where((F.col("own") > 0) & (F.col("own") < F.col("n")) & (F.col("n") >= how.least))
        self.large = self.able.where(F.col("n") >= how.large if how.large else F.lit(False)).select("bag", "cluster")
        self.steady = how.weight in STEADY and how.spread == 0
        self.columns = [c for c in ("selected", "is_seed") if c in rows.columns]
        state = rows.select("bag", "vec_id", "cluster", *self.columns)
        if self.steady:
            state = state.join(self.able.drop("n"), ["bag", "cluster"])
            self.vectors = written(rows.select("bag", "vec_id", "cluster", "x").join(self.able.select("bag", "cluster"), ["bag", "cluster"], "left_semi"), "vectors")
            sums = self._sums(self._weighted(rows.where("selected")), self.able.select("bag", "cluster"))
            state = state.join(sums, ["bag", "vec_id"], "left").na.fill(0.0, list(SUMS))
            self._note(0, self.able, 0)
        self.state = written(state, "sums")
        self.swaps = rows.sparkSession.createDataFrame([], _kinds(rows))

    def _weighted(self, selected: DataFrame) -> DataFrame:
        """Rows (bag, vec_id, cluster, x, w) from (bag, vec_id, cluster, x)."""
        base = selected.select("bag", "vec_id", "cluster", "x")
        if self.how.weight == "uniform":
            return base.withColumn("w", F.lit(1.0))
        if self.weights is None:
            every = self.rows.select("bag", "vec_id", "cluster", "x", F.lit(True).alias("selected"))
            self.weights = written(refine.swap_weights(every, self.how.weight), "weights")
        return base.join(self.weights, ["bag", "vec_id"])

    def _sums(self, members: DataFrame, kept: DataFrame) -> DataFrame:
        """Sums over members (with w) for the rows of the clusters ``kept``."""
        rows = self.vectors.join(kept, ["bag", "cluster"], "left_semi")
        return refine.block_sums(ordered.meet(rows, members, "w")).drop("near")

    def _note(self, p: int, kept: DataFrame | None, swaps: int) -> None:
        if self.trace is not None:
            sizes = None if kept is None else self.sizes.join(kept, ["bag", "cluster"], "left_semi")
            self.trace.append((p, 0 if sizes is None else sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], swaps))

    def _found(self, only: DataFrame) -> DataFrame:
        if not self.steady:
            whole = self.rows.select("bag", "vec_id", "cluster", "x").join(self.state.drop("cluster"), ["bag", "vec_id"])
            found = refine.swaps(whole, self.how.sign, self.how.least, self.how.weight, self.how.spread)
            return found.join(only, ["bag", "cluster"], "left_semi")
        asked = self.state.join(only, ["bag", "cluster"], "left_semi")
        side = lambda number, total, weight: F.when(number > 0, F.col(total) / F.greatest(weight, F.lit(1e-8))).otherwise(0.0)
        margin = side(F.col("others"), "os", "ow") - side(F.col("own") - F.col("selected").cast("long"), "ss", "sw")
        return refine.best_pairs(asked.withColumn("score", F.round(F.lit(float(self.how.sign)) * margin, 9)), self.how.least)

    def step(self, only: DataFrame, p: int, open_: DataFrame, last: bool) -> DataFrame | None:
        """One swap in each of the clusters ``only`` that gain by it, applied; those clusters, or None.

        Sums are kept up in the clusters that a later step may ask: of ``open_``, of those that have just swapped if no
        others are asked again, and of large ones; after the ``last`` step in none.
        """
        found = written(self._found(only), "swaps")
        if found.isEmpty():
            discard(found)
            return None
        self.swaps = self.swaps.union(found.select(self.swaps.columns))
        after, kept = refine.apply_swaps(self.state, found), None
        if self.steady and not last:
            narrow = self.how.active and self.how.chunks == 1
            kept = (found if narrow else open_).select("bag", "cluster").union(self.large).distinct()
            kept = kept.join(found.select("bag").distinct(), "bag", "left_semi")
            ends = F.array(F.struct(F.col("out_id").alias("vec_id"), F.lit(-1.0).alias("sign")), F.struct(F.col("in_id").alias("vec_id"), F.lit(1.0).alias("sign")))
            moved = found.select("bag", F.explode(ends).alias("m")).select("bag", "m.vec_id", "m.sign")
            members = self._weighted(self.rows.join(moved, ["bag", "vec_id"], "left_semi"))
            members = members.join(moved, ["bag", "vec_id"]).withColumn("w", F.col("w") * F.col("sign")).drop("sign")
            change = self._sums(members, kept).select("bag", "vec_id", *[F.col(c).alias(f"_{c}") for c in SUMS])
            after = after.join(change, ["bag", "vec_id"], "left")
            after = after.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0.0)) for c in SUMS}).select(self.state.columns)
        before, self.state = self.state, written(after, "sums")
        discard(before)
        self._note(p, kept, found.count() if self.trace is not None else 0)
        return found.select("bag", "cluster")

    def sweep(self, only: DataFrame, p: int, turn: int, last: bool) -> DataFrame | None:
        """The steps of a pass, one for each chunk; the clusters that swapped, or None."""
        if self.how.chunks == 1:
            return self.step(only, p, only, last)
        order = Window.partitionBy("bag").orderBy(shuffle_key(f"{self.how.seed}|{turn}", "cluster"), "cluster")
        number = F.count(F.lit(1)).over(Window.partitionBy("bag"))
        dealt = self.sizes.select("bag", "cluster", F.floor((F.row_number().over(order) - 1) / F.ceil(number / self.how.chunks)).alias("chunk"))
        dealt = written(dealt.join(only, ["bag", "cluster"], "left_semi"), "chunks")
        changed = None
        for c in range(self.how.chunks):
            now = self.step(dealt.where(F.col("chunk") == c).select("bag", "cluster"), p, only, last and c + 1 == self.how.chunks)
            if now is not None:
                changed = now if changed is None else changed.union(now)
        return changed

    def result(self) -> DataFrame:
        """The rows given, with ``selected`` (and ``is_seed``) as they are now."""
        now = self.state.select("bag", "vec_id", *[F.col(c).alias(f"_{c}") for c in self.columns])
        both = self.rows.join(now, ["bag", "vec_id"], "left")
        return both.withColumns({c: F.coalesce(f"_{c}", c) for c in self.columns}).select(self.rows.columns)


def _kinds(rows: DataFrame) -> str:
    """The columns of swaps over ``rows``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return f"bag {kinds['bag']}, cluster {kinds['cluster']}, out_id long, in_id long, delta double"
