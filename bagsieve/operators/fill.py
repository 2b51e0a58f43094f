"""Filling clusters with greedily chosen rows, by grouped numpy kernels.

Where clusters are independent a group is a (bag, cluster); where picks repel those of clusters before, it is a chunk of a bag's clusters.
A group has to fit a task's memory (100,000 rows of 768 doubles are 0.6 GB): larger ones are an error up front.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import shuffle_key
from ..functions.vectors import l2, mean_vector
from ..session import ship
from ..sources.tables import written
from . import kernels, ordered, pairs

#: Bytes of vectors that a group may have.
GROUP_BYTES = 1 << 30
#: Rows of a cluster whose pairs one task takes for facility location; larger ones are spread.
WHOLE = 4096
#: Rows whose gains a round of a large cluster makes anew.
BATCH = 1024


def checked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, after making sure that every group fits one task."""
    worst = rows.groupBy(*keys).agg(F.sum(F.size("x") * 8).alias("bytes")).agg(F.max("bytes")).first()[0]
    if worst and worst > GROUP_BYTES:
        raise ValueError(f"a group of {keys} holds {worst} bytes of vectors; at most {GROUP_BYTES} fit one task: split the bag")
    return rows


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def _picker(mode: str, **how):
    def pick(x, seeds, centre, k, start=None):
        return kernels.facility_location(x, seeds, centre, k, start) if mode == "facility_location" else kernels.farthest_points(x, seeds, centre, k, start=start, **how)

    return pick


def fill_clusters(rows: DataFrame, mode: str = "fps", **how) -> DataFrame:
    """(bag, cluster, vec_id, step) for rows (bag, cluster, vec_id, x, is_seed, quota), each cluster by itself.

    Seeds are the cluster's rows with is_seed; the others are available.  random takes the hash's order.
    """
    if mode == "random":
        order = Window.partitionBy("bag", "cluster").orderBy(shuffle_key(how.get("seed", 0), "bag", "vec_id"), "vec_id")
        return rows.where("NOT is_seed").withColumn("step", F.row_number().over(order)).where("step <= quota").select("bag", "cluster", "vec_id", "step")
    pick = _picker(mode, **how)
    ship(rows.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        x = _matrix(group["x"])
        seed = group["is_seed"].to_numpy(bool)
        free = group[~seed]
        found = pick(x[~seed], x[seed], x.mean(0), int(group["quota"].iloc[0]))
        return pd.DataFrame({"bag": group["bag"].iloc[0], "cluster": group["cluster"].iloc[0], "vec_id": free["vec_id"].to_numpy()[found], "step": np.arange(1, len(found) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"bag {kinds['bag']}, cluster {kinds['cluster']}, vec_id long, step int"
    rows = rows.select("bag", "cluster", "vec_id", "x", "is_seed", "quota")
    large = None
    if mode == "facility_location":
        wide = rows.groupBy("bag", "cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).select("bag", "cluster")
        if not wide.isEmpty():
            large = _facility_rounds(rows.join(wide, ["bag", "cluster"], "left_semi")).select("bag", "cluster", "vec_id", "step")
            rows = rows.join(wide, ["bag", "cluster"], "left_anti")
    found = checked(rows, ["bag", "cluster"]).groupBy("bag", "cluster").applyInPandas(run, schema)
    return found if large is None else found.unionByName(large)


def _facility_rounds(rows: DataFrame) -> DataFrame:
    """``fill_clusters`` by facility_location for clusters of many rows, spread over all tasks.

    All gains are made once, by pairs of blocks.  They only fall from then on, so they are bounds: a round makes the gains of the
    ``BATCH`` rows of the largest bounds anew and takes the best if no other bound comes before it.
    """
    key = F.struct("bag", "cluster").alias("bag")
    rows = written(rows.select(key, "vec_id", "x", "is_seed", F.col("quota").cast("int").alias("quota"), F.lit(0).alias("cluster")), "facility")
    centre = rows.groupBy("bag").agg(mean_vector("x").alias("centre"))
    seed = ordered.nearest(rows.where("NOT is_seed"), rows.where("is_seed"))
    near = F.coalesce(F.sqrt("far"), l2("x", "centre")).alias("near")
    base = rows.where("NOT is_seed").join(seed, ["bag", "vec_id"], "left").join(centre, "bag").select("bag", "vec_id", "cluster", "x", near, "quota")
    base = written(base, "facility")

    def first(own, other, same):
        (x, a), (y, b) = ([pairs.matrix(v.field(f))[0] for f in ("x", "mark")] for v in (own, other))
        a, b, mine, theirs = a[:, 0], b[:, 0], np.zeros(len(x)), np.zeros(len(y))
        for part in pairs.tiles(len(x), len(y)):
            d = np.sqrt(pairs.squared(x[part], y))
            mine[part] = np.maximum(b - d, 0.0).sum(1)
            theirs += np.maximum(a[part, None] - d, 0.0).sum(0)
        yield [own.field("vec_id"), mine]
        if not same:
            yield [other.field("vec_id"), theirs]

    gains = pairs.over(pairs.met(base.withColumn("mark", F.array("near")), "bag", "x", "mark"), first, "vec_id long, part double")
    gains = gains.groupBy("bag", "vec_id").agg(F.sum("part").alias("gain"))
    bounds = written(gains.join(base.select("bag", "vec_id", "quota"), ["bag", "vec_id"]).withColumn("gain", F.round("gain", 9)), "bounds")
    blocks = written(ordered._blocks(base, "rows", "slot", "near"), "blocks")
    slots = written(blocks.select("bag", "slot").distinct(), "slots")
    kind = rows.schema["bag"].dataType.simpleString()
    ship(rows.sparkSession)

    def again(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                own, told = batch.column("rows")[r].values, batch.column("told")[r].values
                x, y = pairs.matrix(own.field("x"))[0], pairs.matrix(told.field("x"))[0]
                taken = told.field("taken").to_numpy(zero_copy_only=False).astype(bool)
                near, gain = own.field("near").to_numpy(), np.zeros(int((~taken).sum()))
                if taken.any():
                    near = np.minimum(near, np.sqrt(ordered.to_nearest(x, y[taken])))
                for part in pairs.tiles(len(x), len(gain)):
                    gain += np.maximum(near[part, None] - np.sqrt(pairs.squared(x[part], y[~taken])), 0.0).sum(0)
                bag = batch.column("bag").take(pa.array(np.full(len(gain), r)))
                yield pa.RecordBatch.from_arrays([bag, pa.array(told.field("vec_id").to_numpy()[~taken]), pa.array(gain)], names=["bag", "vec_id", "part"])

    order = Window.partitionBy("bag").orderBy(F.desc("gain"), "vec_id")
    best = lambda found: found.groupBy("bag").agg(F.max(F.struct("gain", (-F.col("vec_id")).alias("minus"))).alias("m"))
    picks = written(best(bounds.where("quota > 0")).select("bag", (-F.col("m.minus")).alias("vec_id"), F.lit(1).alias("step")), "picks")
    while True:
        done = picks.groupBy("bag").agg(F.count(F.lit(1)).cast("int").alias("done"))
        free = bounds.join(done, "bag").where("done < quota").join(picks, ["bag", "vec_id"], "left_anti")
        top = written(free.withColumn("place", F.row_number().over(order)).where(F.col("place") <= BATCH + 1), "top")
        if top.isEmpty():
            break
        asked = top.where(F.col("place") <= BATCH).select("bag", "vec_id", F.lit(False).alias("taken"))
        taken = picks.join(asked.select("bag").distinct(), "bag", "left_semi").select("bag", "vec_id", F.lit(True).alias("taken"))
        told = asked.unionByName(taken).join(base.select("bag", "vec_id", "x"), ["bag", "vec_id"])
        told = told.groupBy("bag").agg(F.collect_list(F.struct("vec_id", "x", "taken")).alias("told")).join(slots, "bag")
        now = blocks.join(told, ["bag", "slot"]).select("bag", "rows", "told").mapInArrow(again, f"bag {kind}, vec_id long, part double")
        now = written(now.groupBy("bag", "vec_id").agg(F.round(F.sum("part"), 9).alias("gain")), "gains")
        bar = top.where(F.col("place") == BATCH + 1).select("bag", F.struct("gain", (-F.col("vec_id")).alias("minus")).alias("bar"))
        found = best(now).join(bar, "bag", "left").where("bar IS NULL OR m > bar").join(done, "bag")
        picks = written(picks.unionByName(found.select("bag", (-F.col("m.minus")).alias("vec_id"), (F.col("done") + 1).alias("step"))), "picks")
        fresh = bounds.join(now.withColumnRenamed("gain", "_now"), ["bag", "vec_id"], "left")
        bounds = written(fresh.select("bag", "vec_id", F.coalesce("_now", "gain").alias("gain"), "quota"), "bounds")
    return picks.select("bag.bag", "bag.cluster", "vec_id", "step")


def fill_bag(rows: DataFrame, mode: str = "fps", cap: int | None = None, **how) -> DataFrame:
    """The same with all that a bag has selected so far as seeds, clusters in ascending order.

    ``cap`` keeps the seeds of the highest ids; with it, or with medians, a bag is one group.
    """
    if not cap and not how.get("median"):
        return _fill_chunks(rows, mode, **how)
    pick = _picker(mode, **how)
    ship(rows.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id").reset_index(drop=True)
        x, cluster, chosen = _matrix(group["x"]), group["cluster"].to_numpy(), group["is_seed"].to_numpy(bool).copy()
        out = []
        for c in np.unique(cluster):
            own = cluster == c
            free = np.flatnonzero(own & ~chosen)
            seeds = np.flatnonzero(chosen)
            found = free[pick(x[free], x[seeds[-cap:] if cap else seeds], x[own].mean(0), int(group["quota"].to_numpy()[own][0]))] if len(free) else []
            for k in found:
                chosen[k] = True
                out.append((group["bag"].iloc[0], c, int(group["vec_id"].iloc[k]), len(out) + 1))
        return pd.DataFrame(out, columns=["bag", "cluster", "vec_id", "step"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"bag {kinds['bag']}, cluster {kinds['cluster']}, vec_id long, step int"
    return checked(rows, ["bag"]).select("bag", "cluster", "vec_id", "x", "is_seed", "quota").groupBy("bag").applyInPandas(run, schema)


def _fill_chunks(rows: DataFrame, mode: str, **how) -> DataFrame:
    """Fills a bag's clusters in chunks: rows know the distance to the nearest seed, and before each chunk that to the picks before."""
    pick, facility = _picker(mode, **how), mode == "facility_location"
    measure = ("l2", 1.0) if facility else (how.get("metric", "l2"), how.get("alpha", 1.0))
    rows = written(rows.select("bag", "cluster", "vec_id", "x", "is_seed", "quota"), "fill")
    free = F.sum((~F.col("is_seed")).cast("long"))
    sizes = ordered.chunked(rows.groupBy("bag", "cluster").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.least(free, F.max("quota")), F.lit(0)).alias("picks")))
    before = F.sum("picks").over(Window.partitionBy("bag").orderBy("cluster")) - F.col("picks")
    sizes = written(sizes.where("picks > 0").withColumn("before", before).drop("n"), "fill-sizes")
    last = sizes.agg(F.max("chunk")).first()[0]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    base = rows.drop("quota").join(sizes, ["bag", "cluster"])
    far = ordered.nearest(base.where("NOT is_seed"), rows.where("is_seed"), *measure)
    base = written(base.join(far, ["bag", "vec_id"], "left").orderBy("chunk", "bag", "vec_id"), "fill")
    checked(base, ["bag", "chunk"])
    ship(rows.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id").reset_index(drop=True)
        x, seed, far = _matrix(group["x"]), group["is_seed"].to_numpy(bool), group["far"].to_numpy(float)
        names, at = np.unique(group["cluster"].to_numpy(), return_inverse=True)
        by, cuts = np.argsort(at, kind="stable"), np.bincount(at).cumsum()[:-1]
        chosen, out = [], []
        for own in np.split(by, cuts):
            free = own[~seed[own]]
            start = far[free]
            if chosen:
                start = np.fmin(start, ordered.to_nearest(x[free], x[chosen], *measure))
            known = not len(free) or not np.isnan(start[0])
            found = free[pick(x[free], x[:0], x[own].mean(0), int(group["picks"][own[0]]), start=(np.sqrt(start) if facility else start) if known else None)]
            chosen += found.tolist()
            out.append(group.iloc[found][["bag", "cluster", "vec_id", "x"]].assign(step=int(group["before"][own[0]]) + np.arange(1, len(found) + 1)))
        return pd.concat(out)

    schema = f"bag {kinds['bag']}, cluster {kinds['cluster']}, vec_id long, x array<double>, step int"
    made = None
    for c in range(-1 if last is None else last + 1):
        part = base.where(F.col("chunk") == c)
        if made is not None:
            near = ordered.nearest(part.where("NOT is_seed"), made, *measure, name="near")
            part = part.join(near, ["bag", "vec_id"], "left").withColumn("far", F.least("far", "near")).drop("near")
        more = written(part.groupBy("bag").applyInPandas(run, schema), "filled")
        made = more if made is None else made.unionByName(more)
    return (made if made is not None else rows.sparkSession.createDataFrame([], schema)).drop("x")
