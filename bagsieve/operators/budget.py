"""How many rows to select, in how many clusters, and how many from each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import truncated


def target(ratio: float, n: Column) -> Column:
    """int(ratio * n); outside 1..n it is an error."""
    t = truncated(ratio, n)
    return F.when((t >= 1) & (t <= n), t).otherwise(F.raise_error(F.lit(f"a budget of {ratio} selects none or more than all")).cast("long"))


def cluster_count(ratio: float, n: Column, goal: Column, least: int = 1) -> Column:
    return F.least(F.greatest(truncated(ratio, n), F.lit(least)), n, goal)


def scheduled_ratio(n: Column, schedule: list[tuple[int, float]], default: float | None = None) -> Column:
    """Ratio of the first threshold that n doesn't pass."""
    out = F.lit(default).cast("double")
    for most, ratio in reversed(schedule):
        out = F.when(n <= most, F.lit(float(ratio))).otherwise(out)
    return out


MODES = ("uniform", "size", "sqrt", "entropy", "density", "adaptive_size", "within_var", "within_var_sqrt")


def weights(clusters: DataFrame, mode: str, temperature: float = 3.0, bag: str = "bag") -> DataFrame:
    """``clusters`` (bag, cluster, size, available, density, variance) with weight; 0 where nothing is available."""
    all_ = Window.partitionBy(bag)
    size = F.col("size").cast("double")
    if mode == "uniform":
        weight = F.lit(1.0)
    elif mode == "size":
        weight = size
    elif mode == "sqrt":
        weight = F.sqrt(F.col("available").cast("double"))
    elif mode == "entropy":
        share = size / F.sum(size).over(all_)
        clusters = clusters.withColumn("_e", -share * F.log(F.greatest(share, F.lit(1e-12))) / F.lit(temperature))
        clusters = clusters.withColumn("_e", F.exp(F.col("_e") - F.max("_e").over(all_)))
        weight = F.col("_e") / F.sum("_e").over(all_)
    elif mode == "density":
        weight = F.col("density")
    elif mode == "adaptive_size":
        power = F.lit(0.5) + F.lit(0.5) * F.tanh(F.log1p(F.sum(size).over(all_) / 10000.0) - 1.0)
        weight = F.pow(size, F.least(F.greatest(power, F.lit(0.5)), F.lit(1.0)))
    elif mode == "within_var":
        weight = (F.col("variance") + 1e-8) * size
    elif mode == "within_var_sqrt":
        weight = F.sqrt(F.col("variance") + 1e-8) * size
    else:
        raise ValueError(f"no allocation mode {mode!r}; there are {', '.join(MODES)}")
    out = clusters.withColumn("weight", F.when(F.col("available") > 0, weight).otherwise(0.0))
    return out.drop("_e")


def one_round(clusters: DataFrame, bag: str = "bag") -> DataFrame:
    """One round of capped largest remainder of ``total`` rows: quota by floor, cap and one more by largest fraction."""
    all_ = Window.partitionBy(bag)
    ideal = F.col("weight") / F.sum("weight").over(all_) * F.col("total")
    rows = clusters.withColumn("_ideal", F.round(ideal, 9)).withColumn("quota", F.least(F.floor("_ideal"), F.col("available")))
    rows = rows.withColumn("_left", F.col("total") - F.sum("quota").over(all_)).withColumn("_room", F.col("available") - F.col("quota"))
    order = all_.orderBy((F.col("_room") <= 0).cast("int"), F.desc(F.round(F.col("_ideal") - F.floor("_ideal"), 9)), F.desc("_room"), "cluster")
    rows = rows.withColumn("_k", F.row_number().over(order))
    more = (F.col("_room") > 0) & (F.col("_k") <= F.col("_left"))
    return rows.withColumn("quota", (F.col("quota") + more.cast("long")).cast("long")).drop("_ideal", "_left", "_room", "_k")


def _rounds(key, rows):
    """Largest remainder over the clusters of one bag, round after round, until all is given."""
    import numpy as np

    rows = rows.sort_values("cluster").reset_index(drop=True)
    available, weight = rows["available"].to_numpy(np.int64), rows["weight"].to_numpy(float)
    goal = int(rows["total"].iloc[0])
    if goal <= 0 or available.sum() <= 0:
        return rows.assign(quota=np.zeros(len(rows), np.int64))[["bag", "cluster", "quota"]]
    if goal > available.sum():
        raise ValueError(f"{goal} rows to give, {available.sum()} available")
    if weight.sum() <= 0:
        raise ValueError("no cluster has a positive weight")
    ideal = np.round(weight / weight.sum() * goal, 9)
    quota = np.minimum(np.floor(ideal).astype(np.int64), available)
    fraction = np.round(ideal - np.floor(ideal), 9)
    while quota.sum() < goal:
        room = available - quota
        open_ = np.flatnonzero(room > 0)
        order = open_[np.lexsort((open_, -room[open_], -fraction[open_]))]
        quota[order[: goal - quota.sum()]] += 1
    return rows.assign(quota=quota)[["bag", "cluster", "quota"]]


def largest_remainder(clusters: DataFrame) -> DataFrame:
    """(bag, cluster, quota) for (bag, cluster, available, weight, total), exact also where caps bind.

    A bag with more to give than there is, or without a positive weight, is an error; one with nothing to give or nothing
    available gets nothing.

    A group is the clusters of one bag, a few thousand rows at most.
    """
    from ..session import ship

    ship(clusters.sparkSession)
    rows = clusters.select("bag", "cluster", F.col("available").cast("long").alias("available"), F.col("weight").cast("double").alias("weight"), F.col("total").cast("long").alias("total"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("bag").applyInPandas(_rounds, f"bag {kinds['bag']}, cluster {kinds['cluster']}, quota long")
