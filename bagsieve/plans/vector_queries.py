"""Queries over vectors: scans, distances, assignment, representatives, medoids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import cluster, pairs
from .registry import C, V, query, sq, table, vectors

R = 6


def _r(c: str, digits: int = R):
    return F.round(c, digits).alias(c)


@query("SELECT count(*) AS n, count(DISTINCT label)::BIGINT AS bags FROM embeddings")
def scan_count(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("bags"))


@query(f"WITH {V} SELECT vec_id, len(x)::INT AS width, round(list_sum(x), 6) AS total FROM v")
def vector_scan(spark, sf_dir):
    from ..sources.bags import vectors as checked

    return checked(vectors(spark, sf_dir), "x", 64).select("vec_id", F.size("x").alias("width"), F.round(vec.total("x"), R).alias("total"))


@query(f"WITH {V} SELECT vec_id, round(sqrt(list_inner_product(x, x)), 6) AS norm, round(list_sum(list_transform(x, lambda t: t / greatest(sqrt(list_inner_product(x, x)), 1e-12))), 6) AS total FROM v")
def l2_normalize(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(vec.norm("x"), R).alias("norm"), F.round(vec.total(vec.unit("x")), R).alias("total"))


@query(f"WITH {V} SELECT p.cluster, p.vec_id AS a, q.vec_id AS b, round(list_distance(p.x, q.x), 6) AS d, round({sq('p.x', 'q.x')}, 6) AS d2 FROM v p JOIN v q ON p.cluster = q.cluster AND p.vec_id < q.vec_id")
def pairwise_l2(spark, sf_dir):
    """All pairs inside each bag."""
    return pairs.table(vectors(spark, sf_dir), "cluster", pairs.l2, ("d", "d2"), R)


@query(f"WITH {V} SELECT p.cluster, p.vec_id AS a, q.vec_id AS b, round(1 - list_cosine_similarity(p.x, q.x), 6) AS d FROM v p JOIN v q ON p.cluster = q.cluster AND p.vec_id < q.vec_id")
def cosine_distance(spark, sf_dir):
    return pairs.table(vectors(spark, sf_dir), "cluster", pairs.cosine(), ("d",), R)


@query(f"WITH {V} SELECT p.cluster, p.vec_id AS a, q.vec_id AS b, round((0.7 * 2 + 0.3) * (1 - list_cosine_similarity(p.x, q.x)), 6) AS d FROM v p JOIN v q ON p.cluster = q.cluster AND p.vec_id < q.vec_id")
def hybrid_distance(spark, sf_dir):
    return pairs.table(vectors(spark, sf_dir), "cluster", pairs.hybrid(0.7), ("d",), R)


@query(f"WITH {V}, {C} SELECT cluster, d::INT AS d, round(centre[d], 6) AS mean FROM (SELECT cluster, centre, unnest(range(1, len(centre) + 1)) AS d FROM c)")
def cluster_centroid(spark, sf_dir):
    return cluster.centroids(vectors(spark, sf_dir)).select("cluster", F.posexplode("centre").alias("d", "mean")).select("cluster", (F.col("d") + 1).alias("d"), _r("mean"))


ASSIGNED = f"""WITH {V}, {C}, a AS (SELECT v.vec_id, c.cluster, {sq('v.x', 'c.centre')} AS d2, row_number() OVER (PARTITION BY v.vec_id ORDER BY {sq('v.x', 'c.centre')}, c.cluster) AS k FROM v, c)"""


@query(ASSIGNED + " SELECT vec_id, cluster, round(d2, 6) AS d2 FROM a WHERE k = 1")
def assign_nearest(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return cluster.assign(rows, cluster.centroids(rows)).select("vec_id", "cluster", _r("d2"))


@query(ASSIGNED + " SELECT round(sum(d2), 5) AS inertia FROM a WHERE k = 1")
def inertia(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return cluster.inertia(cluster.assign(rows, cluster.centroids(rows))).select(_r("inertia", 5))


@query(ASSIGNED + ", t AS (SELECT * FROM a WHERE k = 1) SELECT vec_id, round(d2, 6) AS d2 FROM t WHERE vec_id % 4 <> 0 ORDER BY t.d2 DESC, vec_id LIMIT 7")
def refill_empty(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    assigned = cluster.assign(rows, cluster.centroids(rows))
    return cluster.refill_empty(assigned, assigned.where("vec_id % 4 = 0"), 7).select("vec_id", _r("d2"))


@query(f"WITH {V}, {C} SELECT cluster, vec_id, round(d2, 6) AS d2 FROM (SELECT c.cluster, v.vec_id, {sq('v.x', 'c.centre')} AS d2, row_number() OVER (PARTITION BY c.cluster ORDER BY {sq('v.x', 'c.centre')}, v.vec_id) AS k FROM v, c) WHERE k = 1")
def nearest_to_center(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return cluster.nearest_rows(rows, cluster.centroids(rows)).select("cluster", "vec_id", _r("d2"))


OWN = f"o AS (SELECT v.vec_id, v.cluster, {sq('v.x', 'c.centre')} AS d2, row_number() OVER (PARTITION BY v.cluster ORDER BY {sq('v.x', 'c.centre')}, v.vec_id) AS k FROM v JOIN c USING (cluster))"


@query(f"WITH {V}, {C}, {OWN} SELECT cluster, vec_id, round(d2, 6) AS d2 FROM o WHERE k = 1")
def cluster_representative(spark, sf_dir):
    """The flagship: for each cluster its own member nearest the mean."""
    rows = vectors(spark, sf_dir)
    return cluster.representatives(rows, cluster.centroids(rows)).select("cluster", "vec_id", _r("d2"))


@query(f"WITH {V}, {C}, {OWN} SELECT cluster, vec_id, k::INT AS rank, round(d2, 6) AS d2 FROM o WHERE k <= 5")
def medoid_update(spark, sf_dir):
    """Candidates of the plain update: the five members nearest the mean."""
    return cluster.ranked_to_centre(vectors(spark, sf_dir)).where("rank <= 5").select("cluster", "vec_id", "rank", _r("d2"))


MARGINS = f"""m AS (SELECT v.vec_id, v.cluster, v.x, count(*) OVER (PARTITION BY v.cluster) AS n, {sq('v.x', 'c.centre')} AS d_mean,
 (SELECT min({sq('v.x', 'z.centre')}) FROM c z WHERE z.cluster <> v.cluster) AS d_other FROM v JOIN c USING (cluster))"""


def _medoid_sql(score: str, where: str = "true") -> str:
    return f"""WITH {V}, {C}, {MARGINS}, p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d_mean, vec_id) AS pre FROM m),
s AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {score}, vec_id) AS place FROM p WHERE {where}),
t AS (SELECT s.cluster, s.vec_id, (SELECT sum({sq('s.x', 'w.x')}) FROM v w WHERE w.cluster = s.cluster) - 0.22 * n * d_other AS cost FROM s WHERE place <= 8)
SELECT cluster, vec_id, round(cost, 5) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cost, vec_id) AS k FROM t) WHERE k = 1"""


def _bounded(spark, sf_dir, strategy):
    rows = vectors(spark, sf_dir)
    found = cluster.shortlist(cluster.margins(rows, cluster.centroids(rows)), strategy, 8)
    return cluster.bounded_medoids(rows, found).select("cluster", "vec_id", _r("cost", 5))


@query(_medoid_sql("d_mean - d_other"))
def bounded_medoid(spark, sf_dir):
    return _bounded(spark, sf_dir, "margin_max")


@query(_medoid_sql("d_mean / greatest(d_other, 1e-12)"))
def bounded_medoid_batched(spark, sf_dir):
    return _bounded(spark, sf_dir, "mean_margin")


@query(_medoid_sql("d_mean"))
def bounded_medoid_mean(spark, sf_dir):
    return _bounded(spark, sf_dir, "mean")


@query(_medoid_sql("d_mean - d_other", "pre <= greatest(8, least(16, n))"))
def bounded_medoid_knn(spark, sf_dir):
    return _bounded(spark, sf_dir, "knn_mean_margin")


@query(f"""WITH {V}, p AS (SELECT a.cluster, a.vec_id AS a, b.vec_id AS b, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.cluster = b.cluster AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p) SELECT cluster, a AS vec_id, round(avg(d), 6) AS density FROM r WHERE k <= 5 GROUP BY 1, 2""")
def local_density(spark, sf_dir):
    return cluster.local_density(vectors(spark, sf_dir)).select("cluster", "vec_id", _r("density"))


@query(f"WITH {V}, s AS (SELECT cluster, count(*) AS n FROM v GROUP BY 1) SELECT cluster, n, round(0.22 * least(greatest(sqrt(n / (avg(n) OVER ())), 0.5), 2.0), 6) AS weight FROM s")
def adaptive_sep_reg(spark, sf_dir):
    sizes = vectors(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return cluster.separation_weight(sizes).select("cluster", "n", _r("weight"))


@query(f"WITH {V}, {C}, {MARGINS} SELECT cluster, round(avg((sqrt(d_other) - sqrt(d_mean)) / greatest(sqrt(d_mean), sqrt(d_other), 1e-12)), 6) AS silhouette FROM m GROUP BY 1")
def silhouette_rank(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return cluster.silhouettes(rows, cluster.centroids(rows)).select("cluster", _r("silhouette"))


@query(f"WITH {V}, {C}, {OWN} SELECT cluster, count(*) AS n, round(avg(d2), 6) AS variance FROM o GROUP BY 1")
def within_variance(spark, sf_dir):
    return cluster.within_variance(vectors(spark, sf_dir)).select("cluster", "n", _r("variance"))


@query(f"WITH {V}, {C} SELECT cluster, other, round(d2, 6) AS d2 FROM (SELECT a.cluster, b.cluster AS other, {sq('a.centre', 'b.centre')} AS d2, row_number() OVER (PARTITION BY a.cluster ORDER BY {sq('a.centre', 'b.centre')}, b.cluster) AS k FROM c a JOIN c b ON a.cluster <> b.cluster) WHERE k = 1")
def closest_pair(spark, sf_dir):
    return cluster.closest_centres(cluster.centroids(vectors(spark, sf_dir))).select("cluster", "other", _r("d2"))


@query(f"""WITH {V}, s AS (SELECT a.cluster, a.vec_id, round(sum(list_distance(a.x, b.x)), 9) AS cost FROM v a JOIN v b USING (cluster) GROUP BY 1, 2)
SELECT cluster, vec_id, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cost, vec_id) AS k FROM s) WHERE k = 1""")
def exact_medoid(spark, sf_dir):
    return cluster.exact_medoids(vectors(spark, sf_dir)).select("cluster", "vec_id", _r("cost"))


@query(f"WITH {V} SELECT cluster, arg_min(vec_id, (x[1], vec_id)) AS low, arg_max(vec_id, (x[1], -vec_id)) AS high FROM v GROUP BY 1")
def segment_argmin(spark, sf_dir):
    first = F.col("x")[0]
    by = vectors(spark, sf_dir).groupBy("cluster").agg(F.min(F.struct(first.alias("f"), "vec_id"))["vec_id"].alias("low"), F.max(F.struct(first.alias("f"), (-F.col("vec_id")).alias("m")))["m"].alias("m"))
    return by.select("cluster", "low", (-F.col("m")).alias("high"))


@query()
def kmeans_clusters(spark, sf_dir):
    """(cluster, n, cost): the best of three starts of k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors(spark, sf_dir).select("vec_id", array_to_vector("x").alias("features")).cache()
    models = [KMeans(k=10, seed=s, maxIter=20, tol=1e-4).fit(data) for s in (42, 43, 44)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    cost = best.summary.trainingCost
    return best.transform(data).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n")).withColumn("cost", F.lit(round(cost, 4)))


@query()
def kmedoid(spark, sf_dir):
    """(cluster, vec_id): medoids from the representatives of the labels."""
    rows = vectors(spark, sf_dir)
    start = cluster.representatives(rows, cluster.centroids(rows)).select("cluster", "vec_id")
    return cluster.kmedoid(rows, start, rounds=6)


@query()
def pca_project(spark, sf_dir):
    """(vec_id, p): eight principal components of the centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors(spark, sf_dir).select("vec_id", array_to_vector("x").alias("raw"))
    data = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="c").fit(data).transform(data)
    return PCA(k=8, inputCol="c", outputCol="p").fit(data).transform(data).select("vec_id", vector_to_array("p").alias("p"))


@query()
def random_project(spark, sf_dir):
    """(vec_id, p): Gaussian projection to 16 dimensions, the matrix drawn once from seed 42."""
    import numpy as np

    matrix = np.random.default_rng(42).standard_normal((64, 16)) / 4.0
    columns = F.array(*[F.array(*[F.lit(float(v)) for v in matrix[:, j]]) for j in range(16)])
    return vectors(spark, sf_dir).select("vec_id", F.transform(columns, lambda w: F.round(vec.dot("x", w), R)).alias("p"))
