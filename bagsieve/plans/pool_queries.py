"""Queries of pooling, projections, choices by cluster, lookups of files, and records of runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import cluster, metrics, pool, sample
from ..sources import bags as source
from .metric_queries import _SCORES, _scores
from .registry import C, V, query, sq, table, vectors
from .vector_queries import MARGINS, OWN, _bounded, _medoid_sql


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _bags(spark, sf_dir):
    return vectors(spark, sf_dir).withColumnRenamed("cluster", "bag")


# Choices by cluster.

_SIZES = f"WITH {V}, s AS (SELECT cluster, count(*) AS n FROM v GROUP BY 1)"


def _sizes(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(_SIZES + " SELECT cluster, n, least(greatest(round_even(sqrt(n), 0), 4), 12)::BIGINT AS size FROM s")
def shortlist_size(spark, sf_dir):
    return _sizes(spark, sf_dir).select("cluster", "n", cluster.shortlist_size(F.col("n"), 4, 12).alias("size"))


@query(_SIZES + ", m AS (SELECT avg(n) AS mean FROM s) SELECT cluster, r.range::INT AS round, CASE WHEN n >= mean THEN 'mean' WHEN r.range = 0 THEN 'mean_margin' ELSE 'margin_max' END AS strategy FROM s, m, range(2) r")
def strategy_switch(spark, sf_dir):
    """Clusters of the mean size and above take the plain strategy, the others that of their round."""
    sizes = _sizes(spark, sf_dir)
    threshold = sizes.agg(F.avg("n")).first()[0]
    rounds = sizes.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
    chosen = cluster.strategy(F.col("round"), F.col("n"), "margin_max", two_stage=True, large="mean", threshold=threshold)
    return rounds.select("cluster", "round", chosen.alias("strategy"))


@query(_medoid_sql("d_mean / greatest(d_other, 1e-12)", "pre <= greatest(8, least(16, n))"))
def bounded_medoid_ratio(spark, sf_dir):
    return _bounded(spark, sf_dir, "knn_mean_ratio")


@query(f"WITH {V}, {C}, {OWN}, a AS (SELECT cluster, round(avg(sqrt(d2)), 9) AS spread FROM o GROUP BY 1) SELECT cluster, round(0.15 + 0.13 * (row_number() OVER (ORDER BY spread DESC, cluster) - 1) / greatest(count(*) OVER () - 1, 1), 6) AS weight FROM a")
def density_sep_reg(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return cluster.density_weight(rows, cluster.centroids(rows), 0.15, 0.28).select("cluster", _r("weight"))


_CONTEST = f"WITH {V}, {C}, {MARGINS}, {OWN}, r AS (SELECT cluster, vec_id, d2 FROM o WHERE k = 1), s AS (SELECT cluster, count(*) AS n FROM v GROUP BY 1)"


def _contested(spark, sf_dir, by):
    rows = vectors(spark, sf_dir)
    medoids = cluster.representatives(rows, cluster.centroids(rows)).select("cluster", "vec_id")
    return cluster.contested(rows, medoids, by, 3).select("cluster")


@query(_CONTEST + " SELECT cluster FROM s ORDER BY n DESC, cluster LIMIT 3")
def contested_by_size(spark, sf_dir):
    return _contested(spark, sf_dir, "cluster_size")


@query(_CONTEST + " SELECT cluster FROM r ORDER BY round(d2, 9) DESC, cluster LIMIT 3")
def contested_by_centroid(spark, sf_dir):
    return _contested(spark, sf_dir, "centroid_dist")


# Pooling of bags; the first entry stands for a score.


def _scored(spark, sf_dir):
    return _bags(spark, sf_dir).withColumn("score", F.col("x")[0])


@query(
    f"""WITH {V}, t AS (SELECT cluster AS bag, vec_id, 'top' AS side, row_number() OVER (PARTITION BY cluster ORDER BY x[1] DESC, vec_id)::INT AS place FROM v
UNION ALL SELECT cluster, vec_id, 'bottom', row_number() OVER (PARTITION BY cluster ORDER BY x[1], vec_id)::INT FROM v) SELECT * FROM t WHERE place <= 8"""
)
def extreme_instances(spark, sf_dir):
    return pool.extreme_instances(_scored(spark, sf_dir), "score")


def _pooled_sql(score: str) -> str:
    """Entries of the softmax pooling of bags by ``score``, a table s(vec_id, score)."""
    return f"""{score}, w AS (SELECT e.cluster AS bag, e.d, exp(s.score - max(s.score) OVER (PARTITION BY e.cluster)) AS a, e.value FROM e JOIN s USING (vec_id))
SELECT bag, d::INT AS d, round(sum(a * value) / sum(a), 6) AS pooled FROM w GROUP BY 1, 2"""


@query(f"WITH {V}, {C}, k AS (SELECT cluster, arg_max(x, (x[1], -vec_id)) AS q FROM v GROUP BY 1), " + _pooled_sql("s AS (SELECT vec_id, list_inner_product(x, q) / 8 AS score FROM v JOIN k USING (cluster))"))
def critical_pool(spark, sf_dir):
    found = pool.critical_pool(_scored(spark, sf_dir), "score")
    return found.select("bag", F.posexplode("pooled").alias("d", "pooled")).select("bag", (F.col("d") + 1).alias("d"), _r("pooled"))


@query(
    f"""WITH {V}, {C}, h AS (SELECT vec_id, j, sum(value * sin(d * (j + 1) / 10.0)) AS a, sum(value * cos(d * (j + 1) / 10.0)) AS b FROM e, range(4) t(j) GROUP BY 1, 2),
"""
    + _pooled_sql("s AS (SELECT vec_id, sum((j + 1) * tanh(a) / (1 + exp(-b))) AS score FROM h GROUP BY 1)")
)
def gated_pool(spark, sf_dir):
    """Gated attention of four hidden units, with sines and cosines as weights."""
    angle = np.outer(np.arange(1, 65), np.arange(1, 5)) / 10.0
    found = pool.gated_pool(_bags(spark, sf_dir), np.sin(angle), np.cos(angle), np.arange(1.0, 5.0))
    return found.select("bag", F.posexplode("pooled").alias("d", "pooled")).select("bag", (F.col("d") + 1).alias("d"), _r("pooled"))


@query(
    f"""WITH {V}, {C}, u AS (SELECT vec_id, j, sum(value * sin(d * (j + 1) / 10.0)) + 0.1 AS a FROM e, range(6) t(j) GROUP BY 1, 2)
SELECT vec_id, round(sum(greatest(a, 0) * (j + 1)) - 0.5, 6) AS y FROM u GROUP BY 1"""
)
def mlp_project(spark, sf_dir):
    """A perceptron of six hidden units and one output."""
    hidden = np.sin(np.outer(np.arange(1, 65), np.arange(1, 7)) / 10.0)
    layers = [(hidden, np.full(6, 0.1)), (np.arange(1.0, 7.0).reshape(6, 1), np.array([-0.5]))]
    return vectors(spark, sf_dir).select("vec_id", F.round(pool.dense("x", layers)[0], 6).alias("y"))


@query()
def bag_pca(spark, sf_dir):
    """(bag, vec_id, p): four directions of bag 0; every bag is centred by itself."""
    return pool.bag_components(_bags(spark, sf_dir), 0, 4)


@query(
    f"""WITH {V}, p AS (SELECT cluster AS bag, vec_id, row_number() OVER (PARTITION BY cluster ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY cluster) AS n FROM v)
SELECT bag, vec_id, 0 AS copy FROM p UNION ALL SELECT bag, vec_id, 1 FROM p WHERE k <= pow(ceil(sqrt(n)), 2) - n"""
)
def square_padded(spark, sf_dir):
    return pool.square_padded(_bags(spark, sf_dir))


@query(
    f"""WITH {V}, {C}, a AS (SELECT avg(sqrt(list_inner_product(centre, centre))) AS m FROM c), n AS (SELECT cluster, avg(sqrt(list_inner_product(x, x))) AS s FROM v GROUP BY 1)
SELECT cluster AS bag, vec_id, round(list_inner_product(x, centre) / (s * m), 6) AS affinity, round(list_distance(x, centre) / (s + 1e-6), 6) AS radius, round(sqrt(list_inner_product(centre, centre)) / (m + 1e-6), 6) AS anchor_norm
FROM v JOIN c USING (cluster) JOIN n USING (cluster), a"""
)
def anchor_relations(spark, sf_dir):
    """Relations of vectors to their bag's mean."""
    rows = _bags(spark, sf_dir)
    anchors = cluster.centroids(rows, "bag").select("bag", F.col("centre").alias("anchor"))
    return pool.anchor_relations(rows, anchors).select("bag", "vec_id", _r("affinity"), _r("radius"), _r("anchor_norm"))


@query(f"WITH {V} SELECT vec_id, 14 AS tokens, round(list_sum(x[9:]), 6) AS total FROM v")
def sequence_tokens(spark, sf_dir):
    """Vectors as sequences of 16 tokens of four entries, without the two in front."""
    tokens = vec.tokens("x", 4, 2)
    return vectors(spark, sf_dir).select("vec_id", F.size(tokens).alias("tokens"), F.round(vec.total(F.flatten(tokens)), 6).alias("total"))


# Samples, lookups, records.


@query("SELECT DISTINCT label AS bag, vec_id FROM embeddings WHERE vec_id % 7 < 2")
def one_encoder(spark, sf_dir):
    """A custom selection that names rows twice."""
    rows = _bags(spark, sf_dir).select(F.col("bag").cast("int").alias("bag"), "vec_id")
    named = rows.where("vec_id % 7 < 2")
    return sample.one_encoder(rows, "custom", selection=named.unionByName(named))


@query(
    """WITH m AS (SELECT (label // 3)::INT AS sample, (label % 3)::INT AS sub, label AS bag, vec_id, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY md5('42|' || (42 + sample * 100003 + sub) || '|' || vec_id), vec_id) AS place FROM m) SELECT sample, sub, vec_id FROM k WHERE place <= greatest(1, round_even(0.25::DOUBLE * n, 0))"""
)
def multi_bag_random(spark, sf_dir):
    """A quarter of every bag of a sample, drawn with the seed of its place in the sample."""
    rows = vectors(spark, sf_dir).select(F.floor(F.col("cluster") / 3).cast("int").alias("sample"), (F.col("cluster") % 3).alias("sub"), F.col("cluster").alias("bag"), "vec_id")
    return sample.random_members(rows, 0.25, 42).select("sample", "sub", "vec_id")


@query("SELECT doc_id, quality FROM labels ORDER BY md5('7|' || doc_id), doc_id LIMIT 50")
def labelled_head(spark, sf_dir):
    return source.labelled_head(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", 50, 7)


@query("SELECT n_nationkey::VARCHAR AS bag, CASE n_nationkey % 3 WHEN 0 THEN 'd/' || n_nationkey || '.npy' WHEN 1 THEN 'e/' || n_nationkey || '.npy' END AS path, (CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE 2 END)::BIGINT AS candidates FROM nation")
def resolve_path(spark, sf_dir):
    """Files named by a path, by a stem that one file has, and by a stem that two have."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("bag"), (F.col("n_nationkey") % 3).alias("kind"))
    path = lambda folder: F.concat(F.lit(folder), "bag", F.lit(".npy"))
    files = nations.select(F.explode(F.array(path("e/"), F.when(F.col("kind") == 0, path("d/")), F.when(F.col("kind") == 2, path("f/")))).alias("path")).where("path IS NOT NULL")
    return source.resolve(nations.select("bag", path("d/").alias("relative")), files)


@query("SELECT event_type AS arch, round(avg(user_id), 6) AS kept, round(sum(value), 4) AS latency, round(sum(value) / count(*), 6) AS latency_each FROM events GROUP BY 1")
def run_costs(spark, sf_dir):
    """Users stand for rows kept, values for seconds."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("arch"), F.col("user_id").alias("kept"), F.col("value").alias("seconds"))
    return metrics.costs(rows, ["arch"]).select("arch", _r("kept"), _r("latency", 4), _r("latency_each"))


@query(_SCORES + ", q AS (SELECT y, p, scores[y + 1] - list_max(scores) - ln(list_sum(list_transform(scores, lambda t: exp(t - list_max(scores))))) AS lp FROM t) SELECT round(-avg(lp), 6) AS loss, round(avg((y = p)::INT), 6) AS accuracy, count(*) AS n FROM q")
def evaluation(spark, sf_dir):
    return metrics.evaluation(_scores(spark, sf_dir)).select(_r("loss"), _r("accuracy"), "n")


@query("SELECT toxic::BIGINT AS toxic, 'undefined' AS told FROM labels GROUP BY 1")
def auroc_undefined(spark, sf_dir):
    """Groups of one class have no pairs, and their area is NaN."""
    rows = table(spark, sf_dir, "labels").select(F.col("toxic").cast("long").alias("toxic"), (F.col("toxic") == 1).alias("positive"), F.col("quality").cast("double").alias("score"))
    return metrics.auroc_by(rows, ["toxic"]).select("toxic", F.when(F.isnan("auroc"), "undefined").otherwise(F.col("auroc").cast("string")).alias("told"))


@query(f"WITH {V}, {C}, m AS (SELECT cluster, centre, row_number() OVER (ORDER BY cluster) - 1 AS k FROM c) SELECT round(min({sq('a.centre', 'b.centre')}), 6) AS closest FROM m a JOIN m b ON a.k < b.k")
def least_separation(spark, sf_dir):
    """What runs from several starts are compared by: the least distance between two of their centres."""
    return cluster.least_separation(cluster.centroids(vectors(spark, sf_dir))).select(_r("closest"))
