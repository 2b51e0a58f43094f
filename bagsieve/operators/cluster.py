"""Assigning vectors to centres, representatives, medoids and their refinement.

Centres are few and travel as one array inside one broadcast row, after a check of their number; a vector then
finds its centre inside its own row, so that no (vector, centre) rows are made.  Ties go to the least id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2, mean_vector, squared_l2, total, unit
from . import pairs

#: Centres that are broadcast at most: 8192 of 2560 doubles are 168 MB.
CENTRE_BOUND = 8192


def packed(centres: DataFrame, bound: int = CENTRE_BOUND) -> DataFrame:
    """One row with the array ``centres`` of (cluster, centre), sorted; more than ``bound`` is an error."""
    rows = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("centres"))
    too_many = F.raise_error(F.lit(f"more than {bound} centres")).cast(rows.schema["centres"].dataType)
    return F.broadcast(rows.select(F.when(F.size("centres") <= bound, F.col("centres")).otherwise(too_many).alias("centres")))


def nearest(vector: str = "x") -> Column:
    """struct(d2, cluster) of the nearest of ``centres``."""
    return F.array_min(F.transform("centres", lambda c: F.struct(squared_l2(F.col(vector), c["centre"]).alias("d2"), c["cluster"].alias("cluster"))))


def assign(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Rows with cluster and d2 of the nearest centre."""
    found = rows.drop("cluster", "d2").crossJoin(packed(centres)).withColumn("_n", nearest()).drop("centres")
    return found.withColumn("cluster", F.col("_n.cluster")).withColumn("d2", F.col("_n.d2")).drop("_n")


def centroids(rows: DataFrame, key: str = "cluster") -> DataFrame:
    """(key, centre, n): mean and size of each group."""
    return rows.groupBy(key).agg(mean_vector("x").alias("centre"), F.count(F.lit(1)).alias("n"))


def nearest_rows(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(cluster, vec_id, d2): for each centre the nearest of all rows."""
    each = rows.crossJoin(packed(centres)).select("vec_id", F.explode(F.transform("centres", lambda c: F.struct(c["cluster"].alias("cluster"), squared_l2(F.col("x"), c["centre"]).alias("d2")))).alias("c"))
    return each.groupBy("c.cluster").agg(F.min(F.struct("c.d2", "vec_id")).alias("m")).select("cluster", "m.vec_id", "m.d2")


def representatives(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(cluster, vec_id, d2): each cluster's own member nearest its centre; an empty one takes the nearest of all."""
    own = rows.join(centres.select("cluster", "centre"), "cluster")
    own = own.groupBy("cluster").agg(F.min(F.struct(squared_l2("x", "centre").alias("d2"), "vec_id")).alias("m")).select("cluster", "m.vec_id", "m.d2")
    empty = centres.join(own, "cluster", "left_anti")
    return own.unionByName(nearest_rows(rows, empty))


def ranked_to_centre(rows: DataFrame) -> DataFrame:
    """Rows with their d2 to the own group's mean and, as ``rank``, their place by it."""
    own = rows.join(centroids(rows), "cluster").withColumn("d2", squared_l2("x", "centre"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("d2", "vec_id")))


def margins(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Rows with d_mean, the d2 to their own cluster's mean, and d_other, that to the nearest other centre."""
    own = rows.join(centroids(rows), "cluster").withColumn("d_mean", squared_l2("x", "centre"))
    other = F.array_min(F.transform(F.filter("centres", lambda c: c["cluster"] != F.col("cluster")), lambda c: squared_l2(F.col("x"), c["centre"])))
    return own.crossJoin(packed(centres)).withColumn("d_other", other).drop("centres")


def shortlist(rows: DataFrame, strategy: str, size, multiple: float = 2.0, weight: float = 1.0) -> DataFrame:
    """Rows that ``margins`` has scored, cut to the ``size`` candidates of each cluster.

    mean: nearest the mean.  mean_margin: least d_mean / d_other.  margin_max: most d_other - d_mean.
    knn_mean_margin: of the nearest ``multiple * size``, the least d_mean - weight * d_other; knn_mean_ratio: of these,
    the least d_mean / d_other.
    """
    size = F.lit(size) if isinstance(size, int) else size
    by = {
        "mean": F.col("d_mean"),
        "mean_margin": F.col("d_mean") / F.greatest(F.col("d_other"), F.lit(1e-12)),
        "margin_max": F.col("d_mean") - F.col("d_other"),
        "knn_mean_margin": F.col("d_mean") - F.lit(weight) * F.col("d_other"),
        "knn_mean_ratio": F.col("d_mean") / F.greatest(F.col("d_other"), F.lit(1e-12)),
    }[strategy]
    cluster = Window.partitionBy("cluster")
    if strategy.startswith("knn"):
        most = F.greatest(size, F.least(F.bround(size * F.lit(multiple), 0).cast("int"), F.col("n").cast("int")))
        rows = rows.withColumn("_pre", F.row_number().over(cluster.orderBy("d_mean", "vec_id"))).where(F.col("_pre") <= most).drop("_pre")
    rows = rows.withColumn("_score", by)
    return rows.withColumn("place", F.row_number().over(cluster.orderBy("_score", "vec_id"))).where(F.col("place") <= size).drop("_score")


def bounded_medoids(rows: DataFrame, candidates: DataFrame, pull: float = 0.0, push: float = 0.22) -> DataFrame:
    """(cluster, vec_id, cost): the candidate of least sum of d2 to members + pull * n * d_mean - push * n * d_other.

    The sum over members is n * d_mean plus what is the same for all candidates of the cluster (their distances to
    the mean), so no pairs of members are needed.
    """
    spread = rows.join(centroids(rows), "cluster").groupBy("cluster").agg(F.sum(squared_l2("x", "centre")).alias("spread"))
    other = F.coalesce(F.col("d_other"), F.lit(0.0))
    cost = F.col("n") * F.col("d_mean") * (1.0 + pull) + F.col("spread") - F.lit(push) * F.col("n") * other
    return candidates.join(spread, "cluster").groupBy("cluster").agg(F.min(F.struct(cost.alias("cost"), "vec_id")).alias("m")).select("cluster", "m.vec_id", "m.cost")


def exact_medoids(rows: DataFrame) -> DataFrame:
    """(cluster, vec_id, cost): the member of least sum of distances (not squared) to its cluster, by pairs of blocks."""
    best = F.min(F.struct(F.round("cost", 9).alias("cost"), "vec_id"))
    return pairs.sums(rows, "cluster").groupBy("cluster").agg(best.alias("m")).select("cluster", "m.vec_id", "m.cost")


def local_density(rows: DataFrame, k: int = 5) -> DataFrame:
    """(cluster, vec_id, density): mean distance to the ``k`` nearest other members."""
    near = pairs.nearest(rows, "cluster", k)
    return near.select("cluster", "vec_id", (total("near") / F.size("near")).alias("density"))


def refill_empty(assigned: DataFrame, taken: DataFrame, n: int) -> DataFrame:
    """(vec_id, d2): the ``n`` rows farthest from their centre that no cluster has taken."""
    return assigned.join(taken.select("vec_id"), "vec_id", "left_anti").orderBy(F.desc("d2"), "vec_id").limit(n).select("vec_id", "d2")


def separation_weight(sizes: DataFrame, weight: float = 0.22, low: float = 0.5, high: float = 2.0, by=()) -> DataFrame:
    """(cluster, n, weight): the separation weight scaled by the root of the relative size, clamped; relative within ``by``."""
    mean = F.avg("n").over(Window.partitionBy(*by))
    return sizes.withColumn("weight", F.lit(weight) * F.least(F.greatest(F.sqrt(F.col("n") / mean), F.lit(low)), F.lit(high)))


def shortlist_size(n: Column, least: int, most: int) -> Column:
    """Candidates of a cluster of ``n`` rows: the root of its size, to the even neighbour, within bounds."""
    return F.least(F.greatest(F.bround(F.sqrt(n), 0), F.lit(float(least))), F.lit(float(most))).cast("long")


def strategy(step: Column, n: Column, usual: str, two_stage: bool = False, large: str | None = None, threshold: float = 0) -> Column:
    """The shortlist of a round: ``large`` for clusters of ``threshold`` rows, else mean_margin in a two-stage run's first."""
    chosen = F.when((step == 0) & F.lit(two_stage), F.lit("mean_margin")).otherwise(F.lit(usual))
    return F.when(n >= threshold, F.lit(large)).otherwise(chosen) if large and threshold > 0 else chosen


def density_weight(rows: DataFrame, centres: DataFrame, low: float, high: float) -> DataFrame:
    """(cluster, weight): the separation weight from ``low`` for the loosest cluster to ``high`` for the densest, by rank."""
    spread = rows.join(centres.select("cluster", "centre"), "cluster").groupBy("cluster").agg(F.round(F.avg(l2("x", "centre")), 9).alias("spread"))
    return density_rank(spread, low, high).select("cluster", "weight")


def density_rank(spread: DataFrame, low: float, high: float, by=()) -> DataFrame:
    """``spread`` (cluster, spread) with the weight from ``low`` for the largest spread to ``high`` for the least, by rank within ``by``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("spread"), "cluster")) - 1
    last = F.greatest(F.count(F.lit(1)).over(Window.partitionBy(*by)) - 1, F.lit(1))
    return spread.withColumn("weight", F.lit(low) + F.lit(high - low) * place / last)


def contested(rows: DataFrame, medoids: DataFrame, by: str, most: int) -> DataFrame:
    """(cluster, score) of the ``most`` clusters whose medoid (cluster, vec_id) is most worth another look.

    cluster_size: the largest.  centroid_dist: medoids farthest from the mean.
    """
    if by == "cluster_size":
        scored = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("score"))
    elif by == "centroid_dist":
        own = rows.join(medoids.select("cluster", "vec_id"), ["cluster", "vec_id"]).join(centroids(rows), "cluster")
        scored = own.select("cluster", F.round(squared_l2("x", "centre"), 9).alias("score"))
    else:
        raise ValueError(f"no criterion {by!r}")
    return scored.orderBy(F.desc("score"), "cluster").limit(most)


def least_separation(centres: DataFrame) -> DataFrame:
    """One row closest: the least squared distance between two centres."""
    return closest_centres(centres).agg(F.min("d2").alias("closest"))


def silhouettes(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(cluster, silhouette): mean of (b - a) / max(a, b) with a and b the distances to the own and the next centre."""
    found = rows.join(centres.select("cluster", F.col("centre").alias("own")), "cluster").crossJoin(packed(centres))
    found = found.withColumn("a", l2("x", "own")).withColumn("b", F.sqrt(F.array_min(F.transform(F.filter("centres", lambda c: c["cluster"] != F.col("cluster")), lambda c: squared_l2(F.col("x"), c["centre"])))))
    return found.groupBy("cluster").agg(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12))).alias("silhouette"))


def within_variance(rows: DataFrame) -> DataFrame:
    """(cluster, n, variance): mean squared distance to the cluster's mean."""
    own = rows.join(centroids(rows), "cluster")
    return own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(squared_l2("x", "centre")).alias("variance"))


def closest_centres(centres: DataFrame) -> DataFrame:
    """(cluster, other, d2): for each centre the nearest other one."""
    rows = centres.crossJoin(packed(centres))
    best = F.array_min(F.transform(F.filter("centres", lambda c: c["cluster"] != F.col("cluster")), lambda c: F.struct(squared_l2(F.col("centre"), c["centre"]).alias("d2"), c["cluster"].alias("other"))))
    return rows.select("cluster", best.alias("m")).select("cluster", "m.other", "m.d2")


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d2").alias("inertia"))


def kmedoid(rows: DataFrame, start: DataFrame, rounds: int = 50, size: int = 8, strategy: str = "margin_max", push: float = 0.22) -> DataFrame:
    """(cluster, vec_id): medoids by assigning, refining and refilling until they repeat.

    ``start`` has (cluster, vec_id).  The ids of a round's medoids, one for each cluster, pass through the driver
    (CENTRE_BOUND at most), so that no round builds on the plan of the last.
    """
    spark, kind = rows.sparkSession, "cluster int, vec_id long"
    now = sorted((int(c), int(v)) for c, v in start.select("cluster", "vec_id").limit(CENTRE_BOUND + 1).collect())
    if len(now) > CENTRE_BOUND:
        raise ValueError(f"more than {CENTRE_BOUND} medoids")
    for _ in range(rounds):
        medoids = spark.createDataFrame(now, kind)
        centres = rows.select("vec_id", F.col("x").alias("centre")).join(F.broadcast(medoids), "vec_id").select("cluster", "centre")
        assigned = assign(rows, centres)
        found = {int(c): int(v) for c, v in bounded_medoids(assigned, shortlist(margins(assigned, centres), strategy, size), push=push).select("cluster", "vec_id").collect()}
        lost = [c for c, _ in now if c not in found]
        if lost:
            taken = spark.createDataFrame(sorted(found.items()), kind)
            found.update(zip(lost, (int(r["vec_id"]) for r in refill_empty(assigned, taken, len(lost)).collect())))
        before, now = now, sorted(found.items())
        if now == before:
            break
    return spark.createDataFrame(now, kind)


def unit_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", unit("x"))
