"""The canonical recipe: budget, medoids, allocation, fill, refinement, as one plan over a table of bags."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import mean_vector, squared_l2
from ..operators import bagwise, budget, fill, refine, upkeep
from ..sources.tables import written

@dataclass(frozen=True)
class SamplerSpec:
    """What to select from each bag of (bag, vec_id, x), and how.

    ratio: share of a bag's rows.  cluster_ratio: clusters as a share of its rows.  rounds, shortlist, shortlist_size and
    separation describe the medoids, or ``medoids`` in full; start: kmeans, or farthest points from a row by hash; starts: so many, the best by start_by (inertia or dispersion).
    polish: most contested medoids looked at again, in polish_passes by polish_by, out of forward rows.  allocation: how the
    budget is shared (budget.MODES).  fill: fps (with metric l2, l2_unit, cosine or hybrid, alpha, beta for the norms' weight, median, and seed_cap seeds),
    facility_location or random.  swaps: parallel passes, ``sign`` -1 towards other clusters' picks, with ``passes`` for all that
    they can do besides (its own passes and sign don't count).  sequential: options of kernels.sequential_swaps.  residual: share of
    clusters that get a sequential pass after them, by residual_by (delta: those that gained most; proximity: those whose selected rows'
    mean is nearest another's).  second: share that gets another, stale (the next by delta) or recomputed (by the deltas of one
    more parallel step).  late_polish: medoids looked at again after the swaps, without taking an extra row.
    extras_polish: extras move away from all selected rows.  reseed: extras are dropped and filled anew around the medoids.
    """

    ratio: float = 0.25
    cluster_ratio: float = 0.0125
    least_clusters: int = 1
    rounds: int = 50
    shortlist: str = "margin_max"
    shortlist_size: int = 8
    separation: float = 0.22
    allocation: str = "entropy"
    temperature: float = 3.0
    fill: str = "fps"
    swaps: int = 2
    sign: int = -1
    passes: upkeep.Passes = upkeep.Passes()
    sequential: dict = field(default_factory=lambda: {"chain": True})
    residual: float = 0.5
    seed: int = 42
    medoids: bagwise.Medoids | None = None
    starts: int = 1
    start_by: str = "inertia"
    start: str = "kmeans"
    polish: int = 0
    polish_passes: int = 1
    polish_by: str = "closest_pair"
    forward: int = 1
    metric: str = "l2"
    alpha: float = 1.0
    beta: float = 0.0
    median: bool = False
    seed_cap: int | None = None
    residual_by: str = "delta"
    second: float = 0.0
    second_mode: str = "stale"
    late_polish: int = 0
    extras_polish: bool = False
    reseed: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.ratio <= 1:
            raise ValueError("ratio must be over 0 and at most 1")
        if self.allocation not in budget.MODES:
            raise ValueError(f"no allocation {self.allocation!r}")
        if self.fill not in ("fps", "facility_location", "random"):
            raise ValueError(f"no fill {self.fill!r}")
        if self.sign not in (-1, 1):
            raise ValueError("sign must be -1 or 1")
        for name, allowed in (
            ("start", ("kmeans", "farthest")),
            ("start_by", ("inertia", "dispersion")),
            ("polish_by", tuple(bagwise.CRITERIA)),
            ("metric", ("l2", "l2_unit", "cosine", "hybrid")),
            ("residual_by", ("delta", "proximity")),
            ("second_mode", ("stale", "recomputed")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}, not {getattr(self, name)!r}")
        if min(self.rounds, self.starts) < 1:
            raise ValueError("rounds and starts are at least 1")

    @classmethod
    def canonical(cls) -> SamplerSpec:
        """A quarter of the rows."""
        return cls()

    @classmethod
    def canonical_tenth(cls) -> SamplerSpec:
        """A tenth of the rows, without swaps."""
        return cls(ratio=0.1, cluster_ratio=0.005, rounds=10, shortlist="knn_mean_margin", shortlist_size=16, swaps=0, residual=0.0)

    def run(self, rows: DataFrame) -> DataFrame:
        """(bag, vec_id, role) of the selected rows of each bag of (bag, vec_id, x): core for the clusters' medoids, or the rows
        that swaps put in their places, extra for the rest. Without a column ``bag`` the table is one, and the result has none.

        Bags are independent: each gets what it would get alone.  ``vec_id`` is unique within a bag.
        """
        single = "bag" not in rows.columns
        rows = written(rows.select(F.lit(1).alias("bag") if single else "bag", "vec_id", "x"), "bags")
        sizes = rows.groupBy("bag").agg(F.count(F.lit(1)).alias("n"))
        goal = budget.target(self.ratio, F.col("n"))
        plan = sizes.withColumn("goal", goal).withColumn("k", budget.cluster_count(self.cluster_ratio, F.col("n"), F.col("goal"), self.least_clusters))
        plan = written(plan, "plan")
        blocks = bagwise.block(rows)
        medoids = self._medoids(rows, blocks, plan)
        state = self._filled(rows, blocks, medoids, plan)
        if self.swaps:
            state = self._swapped(state)
        if self.late_polish:
            state = self._polished(rows, state)
        if self.extras_polish:
            state = self._moved(state)
        if self.reseed:
            state = self._filled(rows, blocks, self._core(state), plan)
        chosen = state.where("selected").select("bag", "vec_id", F.when(F.col("is_seed"), "core").otherwise("extra").alias("role"))
        return chosen.drop("bag") if single else chosen

    def _how(self) -> bagwise.Medoids:
        return self.medoids or bagwise.Medoids(rounds=self.rounds, strategy=self.shortlist, size=self.shortlist_size, push=self.separation)

    def _medoids(self, rows: DataFrame, blocks: DataFrame, plan: DataFrame) -> DataFrame:
        how = self._how()
        if self.start == "farthest":
            one = bagwise.seeded_starts(rows, blocks, plan.select("bag", F.lit(1).alias("k")), self.seed, self.starts, 0)
            first = bagwise.farthest_starts(rows, blocks, one, plan.select("bag", "k"))
        else:
            drawn = bagwise.seeded_starts(rows, blocks, plan.select("bag", "k"), self.seed, self.starts)
            first = bagwise.representatives(rows, blocks, bagwise.kmeans(blocks, drawn, min(how.rounds, 10)))
        medoids = bagwise.kmedoids(rows, blocks, first, how)
        if self.starts > 1:
            medoids = written(bagwise.best_start(blocks, medoids, self.start_by), "centres")
        return bagwise.polish(rows, blocks, medoids, how, self.polish, self.polish_by, self.polish_passes, self.forward)

    def _filled(self, rows: DataFrame, blocks: DataFrame, medoids: DataFrame, plan: DataFrame) -> DataFrame:
        """Rows (bag, vec_id, cluster, x, is_seed, selected): labelled by their nearest medoid, filled up to each bag's budget."""
        seeds = medoids.select("bag", "vec_id", F.lit(True).alias("is_seed"))
        near = bagwise.assigned(blocks, medoids).drop("start").join(rows, ["bag", "vec_id"]).join(seeds, ["bag", "vec_id"], "left")
        labelled = written(near.withColumn("is_seed", F.coalesce("is_seed", F.lit(False))), "labelled")
        clusters = labelled.groupBy("bag", "cluster").agg(F.count(F.lit(1)).alias("size"), F.sum((~F.col("is_seed")).cast("long")).alias("available"), F.avg(F.sqrt("d2")).alias("density"))
        if self.allocation.startswith("within_var"):
            means = bagwise.statistics(blocks, medoids).where("n > 0")
            own = labelled.join(means.select("bag", "cluster", "mean"), ["bag", "cluster"]).groupBy("bag", "cluster").agg(F.avg(squared_l2("x", "mean")).alias("variance"))
            clusters = clusters.join(own, ["bag", "cluster"])
        taken = labelled.where("is_seed").groupBy("bag").agg(F.count(F.lit(1)).alias("taken"))
        totals = plan.join(taken, "bag").select("bag", (F.col("goal") - F.col("taken")).alias("total"))
        quotas = budget.largest_remainder(budget.weights(clusters, self.allocation, self.temperature).join(totals, "bag"))
        ready = labelled.join(quotas, ["bag", "cluster"])
        if self.fill == "random":
            found = fill.fill_clusters(ready, "random", seed=self.seed)
        elif self.fill == "fps":
            found = fill.fill_bag(ready, "fps", self.seed_cap, metric=self.metric, alpha=self.alpha, beta=self.beta, median=self.median)
        else:
            found = fill.fill_bag(ready, self.fill, self.seed_cap)
        chosen = found.select("bag", "vec_id", F.lit(True).alias("_extra"))
        state = labelled.join(chosen, ["bag", "vec_id"], "left").withColumn("selected", F.col("is_seed") | F.coalesce("_extra", F.lit(False)))
        return written(state.select("bag", "vec_id", "cluster", "x", "is_seed", "selected"), "selection")

    def _swapped(self, state: DataFrame) -> DataFrame:
        """The parallel passes, then the sequential ones on some of the clusters of bags that the former changed."""
        state, deltas = upkeep.refined(state, replace(self.passes, passes=self.swaps, sign=self.sign))
        state = written(state, "selection")
        if self.residual <= 0 or deltas.isEmpty():
            return state
        ranked = written(self._ranked(state, deltas, self.residual_by), "ranked")
        state = self._sequential(state, ranked.where(F.col("place") <= _share(self.residual)))
        if self.second > 0 and self.second_mode == "stale":
            if self.residual_by != "delta":
                ranked = written(self._ranked(state, deltas, "delta"), "ranked")
            first, last = _share(self.residual), _share(self.residual) + _share(self.second)
            state = self._sequential(state, ranked.where((F.col("place") > first) & (F.col("place") <= last)))
        elif self.second > 0:
            found = written(refine.swaps(state, self.sign, self.passes.least, self.passes.weight, self.passes.spread), "swaps")
            state = written(refine.apply_swaps(state, found), "selection")
            ranked = self._ranked(state, found, "delta")
            state = self._sequential(state, ranked.where(F.col("place") <= _share(self.second)))
        return state

    def _ranked(self, state: DataFrame, deltas: DataFrame, by: str) -> DataFrame:
        """(bag, cluster, place, clusters) for the bags of ``deltas``: first place to the cluster that most needs another pass."""
        gained = deltas.groupBy("bag", "cluster").agg(F.sum(F.abs("delta")).alias("gain"))
        scored = state.select("bag", "cluster").distinct().join(deltas.select("bag").distinct(), "bag").join(gained, ["bag", "cluster"], "left")
        scored = scored.withColumn("score", -F.round(F.coalesce("gain", F.lit(0.0)), 9))
        if by == "proximity":
            means = state.where("selected").groupBy("bag", "cluster").agg(mean_vector("x").alias("centre")).withColumn("mean", F.col("centre"))
            near = bagwise.contested(means.withColumns({"start": F.lit(0), "n": F.lit(1).cast("long"), "d2": F.lit(0.0)}), "closest_pair")
            scored = scored.drop("score").join(near.select("bag", "cluster", F.round("score", 9).alias("score")), ["bag", "cluster"])
        own = Window.partitionBy("bag")
        return scored.select("bag", "cluster", F.row_number().over(own.orderBy("score", "cluster")).alias("place"), F.count(F.lit(1)).over(own).alias("clusters"))

    def _sequential(self, state: DataFrame, only: DataFrame) -> DataFrame:
        return written(refine.sequential_refine(state, 1, only=only.select("bag", "cluster"), sign=self.sign, **self.sequential), "selection")

    def _core(self, state: DataFrame) -> DataFrame:
        return state.where("is_seed").select("bag", F.lit(0).alias("start"), "cluster", "vec_id", F.col("x").alias("centre"))

    def _polished(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        """Medoids after another look, on the rows that aren't extras, each with its nearest medoid: so none is taken twice."""
        free = written(state.where("is_seed OR NOT selected").select("bag", "vec_id", "x"), "bags")
        core = bagwise.polish(free, bagwise.block(free), written(self._core(state), "centres"), self._how(), self.late_polish, self.polish_by, self.polish_passes, self.forward)
        now = core.select("bag", "vec_id", F.lit(True).alias("_core"))
        after = state.join(now, ["bag", "vec_id"], "left").withColumn("_core", F.coalesce("_core", F.lit(False)))
        extra = F.col("selected") & ~F.col("is_seed")
        return written(after.select("bag", "vec_id", "cluster", "x", F.col("_core").alias("is_seed"), (extra | F.col("_core")).alias("selected")), "selection")

    def _moved(self, state: DataFrame) -> DataFrame:
        """The selection after each extra has moved inside its cluster, away from all selected rows."""
        told = state.where("x IS NOT NULL").withColumn("role", F.when(F.col("is_seed"), "core").when(F.col("selected"), "extra"))
        moved = refine.polish_extras(told).select("bag", F.col("new_id").alias("vec_id"), F.lit(True).alias("_extra"))
        after = state.join(moved, ["bag", "vec_id"], "left")
        return written(after.select("bag", "vec_id", "cluster", "x", "is_seed", (F.col("is_seed") | F.coalesce("_extra", F.lit(False))).alias("selected")), "selection")


def _share(share: float):
    """Clusters of a bag that a share stands for: rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.round(F.col("clusters") * F.lit(float(share)), 9)))
