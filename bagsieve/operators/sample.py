"""Baseline samplers of a bag, and filling a selection back to a full bag.

Draws are by a portable hash, so that they don't depend on partitions; they differ from any other generator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import half_even, shuffle_key


def drawn(ratio: float, n: Column) -> Column:
    """max(1, round half to even of ratio * n); all for a ratio of 1 or more."""
    return F.when(F.lit(ratio) >= 1.0, n).otherwise(F.greatest(F.lit(1).cast("long"), half_even(F.lit(float(ratio)) * n)))


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bag").agg(F.count(F.lit(1)).alias("n"))


#: Rows of a task that orders whole bags, about; one bag of more rows is one task.
TASK_ROWS = 1 << 18


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out by bag to as many tasks as their number asks for, so that a task's share doesn't grow with the input."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, -(-rows.count() // TASK_ROWS)), "bag")


def random_k(rows: DataFrame, ratio: float, seed=0) -> DataFrame:
    """(bag, vec_id): exactly the drawn number of rows of each bag."""
    order = Window.partitionBy("bag").orderBy(shuffle_key(seed, "bag", "vec_id"), "vec_id")
    ranked = rows.select("bag", "vec_id").withColumn("k", F.row_number().over(order)).join(_sizes(rows), "bag")
    return ranked.where(F.col("k") <= drawn(ratio, F.col("n"))).select("bag", "vec_id")


def grid(rows: DataFrame, ratio: float, seed=0, x: str = "px", y: str = "py") -> DataFrame:
    """(bag, vec_id): one row of each occupied cell of a square grid, topped up at random to the drawn number.

    The grid has ceil(sqrt(k)) cells along each axis of the bag's bounding box; a box without width or height
    draws at random.
    """
    box = rows.groupBy("bag").agg(F.count(F.lit(1)).alias("n"), *[f(c).cast("double").alias(a) for c, f, a in ((x, F.min, "x0"), (x, F.max, "x1"), (y, F.min, "y0"), (y, F.max, "y1"))])
    found = _dealt(rows.select("bag", "vec_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).join(box, "bag")
    found = found.withColumn("k", drawn(ratio, F.col("n"))).withColumn("side", F.ceil(F.sqrt(F.col("k").cast("double"))))
    flat = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    place = lambda v, a, b: F.least(F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * F.col("side")), F.col("side") - 1)
    found = found.withColumn("cell", F.when(flat, F.col("vec_id")).otherwise(place("x", "x0", "x1") * F.col("side") + place("y", "y0", "y1")))
    key = shuffle_key(seed, "bag", "vec_id")
    found = found.withColumn("key", key).withColumn("in_cell", F.row_number().over(Window.partitionBy("bag", "cell").orderBy("key", "vec_id")))
    order = Window.partitionBy("bag").orderBy((F.col("in_cell") > 1).cast("int"), "key", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= k").select("bag", "vec_id")


def cluster_representatives(rows: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """(vec_id) of one bag: the member nearest the centre of each of the drawn number of k-means clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .cluster import representatives

    k = rows.agg(drawn(ratio, F.count(F.lit(1)))).first()[0]
    data = rows.select("vec_id", "x", array_to_vector("x").alias("features"))
    model = KMeans(k=int(k), seed=seed, maxIter=10).fit(data)
    centres = rows.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    labelled = model.transform(data).select("vec_id", "x", F.col("prediction").alias("cluster"))
    return representatives(labelled, centres).select("vec_id").distinct()


def custom(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """(bag, vec_id): the rows of a given selection that exist."""
    return rows.select("bag", "vec_id").join(selection.select("bag", "vec_id"), ["bag", "vec_id"], "left_semi")


def inverse(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """(bag, vec_id): the rows that a given selection leaves."""
    return rows.select("bag", "vec_id").join(selection.select("bag", "vec_id"), ["bag", "vec_id"], "left_anti")


def ensure_size(rows: DataFrame, selection: DataFrame, k: int, seed=0) -> DataFrame:
    """(bag, vec_id): a selection (bag, vec_id, place), repeats dropped, cut or filled at random to ``k``."""
    first = selection.groupBy("bag", "vec_id").agg(F.min("place").alias("place"))
    both = rows.select("bag", "vec_id").join(first, ["bag", "vec_id"], "left")
    order = Window.partitionBy("bag").orderBy(F.col("place").asc_nulls_last(), shuffle_key(seed, "bag", "vec_id"), "vec_id")
    return both.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("bag", "vec_id")


def fill_from(rows: DataFrame, other: DataFrame, selection: DataFrame) -> DataFrame:
    """Full bags with the features of ``rows`` where selected and those of ``other`` elsewhere."""
    chosen = selection.select("bag", "vec_id").distinct().withColumn("_chosen", F.lit(True))
    both = rows.join(other.select("bag", "vec_id", F.col("x").alias("_other")), ["bag", "vec_id"]).join(chosen, ["bag", "vec_id"], "left")
    return both.withColumn("x", F.when(F.col("_chosen"), F.col("x")).otherwise(F.col("_other"))).drop("_other", "_chosen")


def partial_fill(rows: DataFrame, other: DataFrame, selection: DataFrame, ratio: float, seed=0) -> DataFrame:
    """The selected rows, and round(ratio * n) others drawn at random with the features of ``other``."""
    chosen = custom(rows, selection)
    rest = inverse(rows, selection)
    order = Window.partitionBy("bag").orderBy(shuffle_key(seed, "bag", "vec_id"), "vec_id")
    rest = rest.withColumn("k", F.row_number().over(order)).join(_sizes(rows), "bag").where(F.col("k") <= half_even(F.lit(float(ratio)) * F.col("n"))).select("bag", "vec_id")
    return rows.join(chosen, ["bag", "vec_id"], "left_semi").withColumn("filled", F.lit(False)).unionByName(other.join(rest, ["bag", "vec_id"], "left_semi").withColumn("filled", F.lit(True)))


def zero_fill(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Full bags with zeros for the rows that aren't selected."""
    chosen = selection.select("bag", "vec_id").distinct().withColumn("_chosen", F.lit(True))
    both = rows.join(chosen, ["bag", "vec_id"], "left")
    return both.withColumn("x", F.when(F.col("_chosen"), F.col("x")).otherwise(F.transform("x", lambda v: F.lit(0.0)))).drop("_chosen")


def joined_bags(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(sample, sub, vec_id, x, place): the bags of each sample one after the other, in the order of ``sub``."""
    both = members.join(rows, "bag")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy("sub", "vec_id")) - 1)


def random_members(rows: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Rows (sample, sub, vec_id) drawn from each bag of a sample, with a seed of the sample's and the bag's number."""
    own = F.lit(seed) + F.col("sample") * 100003 + F.col("sub")
    bag = ["sample", "sub"]
    place = F.row_number().over(Window.partitionBy(*bag).orderBy(shuffle_key(seed, own, F.col("vec_id")), "vec_id"))
    sizes = rows.groupBy(*bag).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("k", place).join(sizes, bag).where(F.col("k") <= drawn(ratio, F.col("n"))).drop("k", "n")


def one_encoder(rows: DataFrame, mode: str, ratio: float = 1.0, seed=0, selection: DataFrame | None = None) -> DataFrame:
    """(bag, vec_id) by a custom selection, each row once, or by a random draw; no other mode."""
    if mode == "custom":
        return custom(rows, selection).select("bag", "vec_id").distinct()
    if mode == "random":
        return random_k(rows, ratio, seed)
    raise ValueError(f"one encoder samples by custom or random, not {mode!r}")


#: Other names of sampling modes.
ALIASES = {"grid": "geometric"}


def mode_name(mode: str) -> str:
    """The name of a sampling mode: dashes as underscores, other names resolved."""
    plain = mode.strip().replace("-", "_")
    return ALIASES.get(plain, plain)


def ranked_clusters(rows: DataFrame, k: int) -> DataFrame:
    """(cluster, vec_id): the most certain row of each cluster but noise (-1), largest clusters first, ``k`` of them."""
    best = rows.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("confidence", (-F.col("vec_id")).alias("minus"))).alias("m"))
    best = best.select("cluster", "n", F.col("m.confidence").alias("confidence"), (-F.col("m.minus")).alias("vec_id"))
    return best.orderBy(F.desc("n"), F.desc("confidence"), "vec_id").limit(k)
