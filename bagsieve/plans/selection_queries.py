"""Queries that select: budgets, allocation, fills, refinement, baseline samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import mean_vector, squared_l2
from ..operators import budget, cluster, fill, refine, sample
from ..session import keep
from .registry import C, V, bags, query, sq, table, vectors

RATIO = 0.25


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# Budgets: lineitem's orders are bags, their lines are rows.

_BAGS = "b AS (SELECT l_suppkey AS bag, count(*) AS n FROM lineitem GROUP BY 1)"


def _sizes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("bag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BAGS} SELECT bag, n, trunc(0.25::DOUBLE * n)::BIGINT AS target FROM b")
def budget_target(spark, sf_dir):
    return _sizes(spark, sf_dir).select("bag", "n", budget.target(RATIO, F.col("n")).alias("target"))


@query(f"WITH {_BAGS} SELECT bag, n, least(greatest(trunc(0.0125::DOUBLE * n)::BIGINT, 1), n, trunc(0.25::DOUBLE * n)::BIGINT) AS clusters FROM b")
def cluster_count(spark, sf_dir):
    n = F.col("n")
    return _sizes(spark, sf_dir).select("bag", "n", budget.cluster_count(0.0125, n, budget.target(RATIO, n)).alias("clusters"))


@query(f"WITH {_BAGS} SELECT bag, n, CASE WHEN n <= 580 THEN 0.4 WHEN n <= 600 THEN 0.3 WHEN n <= 620 THEN 0.2 ELSE 0.1 END::DOUBLE AS ratio FROM b")
def adaptive_ratio(spark, sf_dir):
    return _sizes(spark, sf_dir).select("bag", "n", budget.scheduled_ratio(F.col("n"), [(580, 0.4), (600, 0.3), (620, 0.2)], 0.1).alias("ratio"))


def _clusters(spark, sf_dir):
    """Clusters of the one bag with their size, available rows, density and variance."""
    rows = vectors(spark, sf_dir)
    own = rows.join(cluster.centroids(rows).drop("n"), "cluster").withColumn("d2", squared_l2("x", "centre"))
    by = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum((F.col("vec_id") % 4 != 0).cast("long")).alias("available"), F.avg(F.sqrt("d2")).alias("density"), F.avg("d2").alias("variance"))
    return by.select(F.lit(1).alias("bag"), "*")


_CLUSTERS = f"""WITH {V}, {C}, k AS (SELECT 1 AS bag, cluster, count(*)::DOUBLE AS size, sum((vec_id % 4 <> 0)::INT)::BIGINT AS available, avg(list_distance(x, centre)) AS density, avg({sq('x', 'centre')}) AS variance FROM v JOIN c USING (cluster) GROUP BY cluster)"""
_WEIGHTS = {
    "uniform": "1.0",
    "size": "size",
    "sqrt": "sqrt(available)",
    "entropy": "exp(-(size / sum(size) OVER ()) * ln(size / sum(size) OVER ()) / 3.0) / sum(exp(-(size / t) * ln(size / t) / 3.0)) OVER ()",
    "density": "density",
    "adaptive_size": "pow(size, least(greatest(0.5 + 0.5 * tanh(ln(1 + sum(size) OVER () / 10000.0) - 1), 0.5), 1.0))",
    "within_var": "(variance + 1e-8) * size",
    "within_var_sqrt": "sqrt(variance + 1e-8) * size",
}


def _alloc(mode: str):
    def run(spark, sf_dir):
        return budget.weights(_clusters(spark, sf_dir), mode).select("cluster", "available", F.round(F.col("weight").cast("double"), 6).alias("weight"))

    run.__name__ = f"alloc_{mode}"
    weight = _WEIGHTS[mode]
    return query(f"{_CLUSTERS} SELECT cluster, available, round((CASE WHEN available > 0 THEN w ELSE 0 END)::DOUBLE, 6) AS weight FROM (SELECT *, {weight} AS w FROM (SELECT *, sum(size) OVER () AS t FROM k))")(run)


for _mode in budget.MODES:
    _alloc(_mode)


@query(
    f"""{_CLUSTERS}, i AS (SELECT *, round(size / sum(size) OVER () * 120, 9) AS ideal FROM k),
q AS (SELECT *, least(floor(ideal), available) AS q0 FROM i), r AS (SELECT *, 120 - sum(q0) OVER () AS rest, row_number() OVER (ORDER BY (available - q0 <= 0)::INT, round(ideal - floor(ideal), 9) DESC, available - q0 DESC, cluster) AS k FROM q)
SELECT cluster, available, (q0 + (available > q0 AND k <= rest)::INT)::BIGINT AS quota FROM r"""
)
def one_round_remainder(spark, sf_dir):
    rows = budget.weights(_clusters(spark, sf_dir), "size").withColumn("total", F.lit(120))
    return budget.one_round(rows).select("cluster", "available", "quota")


@query(
    f"""WITH RECURSIVE {_CLUSTERS[5:]}, i AS (SELECT cluster, available, least(available, 20)::BIGINT AS room, 175 AS total, round(size / sum(size) OVER () * 175, 9) AS ideal FROM k),
g AS (SELECT cluster, room AS available, round(ideal - floor(ideal), 9) AS f, least(floor(ideal), room)::BIGINT AS quota, 175 AS total, 0 AS step FROM i
 UNION ALL SELECT cluster, available, f, (quota + (available > quota AND row_number() OVER (ORDER BY (available <= quota)::INT, f DESC, available - quota DESC, cluster) <= total - sum(quota) OVER ())::INT)::BIGINT, total, step + 1 FROM g WHERE step < 60)
SELECT cluster, available, quota FROM g WHERE step = 60"""
)
def largest_remainder(spark, sf_dir):
    """Several rounds, as no cluster may give more than 20 rows."""
    rows = budget.weights(_clusters(spark, sf_dir), "size").withColumn("available", F.least("available", F.lit(20)).cast("long")).withColumn("total", F.lit(175))
    return budget.largest_remainder(rows).join(rows.select("cluster", "available"), "cluster").select("cluster", "available", "quota")


# Fills.


def _seeded(spark, sf_dir, quota=4, every=0):
    """Rows of the one bag with quota and, each ``every`` ids, seeds."""
    rows = vectors(spark, sf_dir)
    seed = (F.col("vec_id") % every == 0) if every else F.lit(False)
    return rows.select(F.lit(1).alias("bag"), "cluster", "vec_id", "x", seed.alias("is_seed"), F.lit(quota).alias("quota"))


def _fps_sql(start: str, step: str, picks: int, scope: str = "cluster", cluster_out: str = "cluster") -> str:
    """Farthest points as a recursion over all rows: m is the distance so far, used marks picks."""
    return f"""WITH RECURSIVE {V}, {C},
s AS (SELECT vec_id, v.cluster, {scope} AS g, x, {start} AS m, vec_id % 16 = 0 AS used, 0 AS step, NULL::BIGINT AS pick FROM v JOIN c USING (cluster)),
g AS (SELECT * FROM s UNION ALL
 SELECT n.vec_id, n.cluster, n.g, n.x, least(n.m, {step}), n.used OR n.vec_id = p.vec_id, n.step + 1, p.vec_id
 FROM g n JOIN (SELECT g AS pg, vec_id, x AS px, row_number() OVER (PARTITION BY g ORDER BY round(m, 9) DESC, vec_id) AS k FROM g WHERE NOT used) p ON p.pg = n.g AND p.k = 1 WHERE n.step < {picks})
SELECT DISTINCT {cluster_out}, pick AS vec_id, step::INT AS step FROM g WHERE step > 0"""


_NO_SEED = "vec_id % 16 = 0 AS used"


@query(_fps_sql(sq("x", "centre"), sq("n.x", "p.px"), 4).replace(_NO_SEED, "false AS used"))
def fps(spark, sf_dir):
    """Four farthest points of each cluster, from its mean."""
    return fill.fill_clusters(_seeded(spark, sf_dir)).select("cluster", "vec_id", "step")


@query(_fps_sql("1 - list_cosine_similarity(x, centre)", "1 - list_cosine_similarity(n.x, p.px)", 4).replace(_NO_SEED, "false AS used"))
def fps_cosine(spark, sf_dir):
    return fill.fill_clusters(_seeded(spark, sf_dir), metric="cosine").select("cluster", "vec_id", "step")


@query(_fps_sql(f"coalesce((SELECT min({sq('v.x', 'w.x')}) FROM v w WHERE w.cluster = v.cluster AND w.vec_id % 16 = 0), {sq('x', 'centre')})", sq("n.x", "p.px"), 4))
def fill_to_budget(spark, sf_dir):
    """Four farthest points of each cluster from the seeds that it has, each 16th row."""
    return fill.fill_clusters(_seeded(spark, sf_dir, every=16)).select("cluster", "vec_id", "step")


@query(_fps_sql(sq("x", "(SELECT list(m ORDER BY d) FROM (SELECT d, avg(value) AS m FROM e GROUP BY 1))"), sq("n.x", "p.px"), 12, "0", "0 AS cluster").replace(_NO_SEED, "false AS used"))
def kcenter_greedy(spark, sf_dir):
    """Twelve farthest points of the whole bag."""
    rows = _seeded(spark, sf_dir, quota=12).withColumn("cluster", F.lit(0))
    return fill.fill_clusters(rows).select("cluster", "vec_id", "step")


_FACILITY = f"""WITH RECURSIVE {V}, {C}, p AS (SELECT a.cluster, a.vec_id AS i, b.vec_id AS j, list_distance(a.x, b.x) AS d FROM v a JOIN v b USING (cluster)),
g AS (SELECT v.vec_id, v.cluster, list_distance(x, centre) AS m, false AS used, 0 AS step, NULL::BIGINT AS pick FROM v JOIN c USING (cluster) UNION ALL
 SELECT n.vec_id, n.cluster, least(n.m, p.d), n.used OR n.vec_id = b.j, n.step + 1, b.j FROM g n
 JOIN (SELECT cluster, j, row_number() OVER (PARTITION BY cluster ORDER BY round(gain, 9) DESC, j) AS k FROM
   (SELECT q.cluster, p.j, sum(greatest(0, q.m - p.d)) AS gain FROM g q JOIN p ON p.i = q.vec_id GROUP BY 1, 2) t JOIN (SELECT vec_id AS free FROM g WHERE NOT used) f ON f.free = t.j) b ON b.cluster = n.cluster AND b.k = 1
 JOIN p ON p.i = n.vec_id AND p.j = b.j WHERE n.step < 3)
SELECT DISTINCT cluster, pick AS vec_id, step::INT AS step FROM g WHERE step > 0"""


@query(_FACILITY)
def facility_location(spark, sf_dir):
    return fill.fill_clusters(_seeded(spark, sf_dir, quota=3), "facility_location").select("cluster", "vec_id", "step")


@query(_FACILITY.replace("n.step < 3", "n.step < 2"))
def fill_fixed(spark, sf_dir):
    """The same number for every cluster that has rows."""
    return fill.fill_clusters(_seeded(spark, sf_dir, quota=2), "facility_location").select("cluster", "vec_id", "step")


@query()
def fill_global_seed(spark, sf_dir):
    """Clusters in order, each away from all that is selected so far."""
    return fill.fill_bag(_seeded(spark, sf_dir, every=16)).select("cluster", "vec_id", "step")


@query(f"WITH {V} SELECT cluster, vec_id, k::INT AS step FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('7|1|' || vec_id), vec_id) AS k FROM v WHERE vec_id % 16 <> 0) WHERE k <= 4")
def fill_random(spark, sf_dir):
    return fill.fill_clusters(_seeded(spark, sf_dir, every=16), "random", seed=7).select("cluster", "vec_id", "step")


# Refinement.

_MARGIN = """s AS (SELECT * FROM v WHERE vec_id % 4 = 0), p AS (SELECT a.vec_id, a.cluster, a.vec_id % 4 = 0 AS selected, b.cluster = a.cluster AS same, list_distance(a.x, b.x) AS d FROM v a JOIN s b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, cluster, selected, -round(coalesce(avg(d) FILTER (WHERE NOT same), 0) - coalesce(avg(d) FILTER (WHERE same), 0), 9) AS score FROM p GROUP BY ALL),
w AS (SELECT cluster, arg_min(vec_id, (score, vec_id)) FILTER (WHERE selected) AS out_id, min(score) FILTER (WHERE selected) AS lo, arg_max(vec_id, (score, -vec_id)) FILTER (WHERE NOT selected) AS in_id, max(score) FILTER (WHERE NOT selected) AS hi FROM m GROUP BY 1)"""


@query(f"WITH {V}, {_MARGIN} SELECT cluster, out_id, in_id, round(hi - lo, 6) AS delta FROM w WHERE hi - lo > 1e-9")
def swap_step_parallel(spark, sf_dir):
    return refine.swaps(bags(spark, sf_dir)).select("cluster", "out_id", "in_id", _r("delta"))


@query(
    f"""WITH {V}, s AS (SELECT * FROM v WHERE vec_id % 4 = 0), z AS (SELECT cluster, count(*) AS n FROM v GROUP BY 1), p AS (SELECT a.vec_id, a.cluster, a.vec_id % 4 = 0 AS selected, b.cluster = a.cluster AS same, list_distance(a.x, b.x) AS d, 1 / sqrt(z.n) AS u FROM v a JOIN s b ON a.vec_id <> b.vec_id JOIN z ON z.cluster = b.cluster),
m AS (SELECT vec_id, cluster, selected, round(-(sum(d * u) FILTER (WHERE NOT same) / sum(u) FILTER (WHERE NOT same) - sum(d * u) FILTER (WHERE same) / sum(u) FILTER (WHERE same)) + 0.5 * min(d) FILTER (WHERE NOT same), 9) AS score FROM p GROUP BY ALL),
w AS (SELECT cluster, arg_min(vec_id, (score, vec_id)) FILTER (WHERE selected) AS out_id, min(score) FILTER (WHERE selected) AS lo, arg_max(vec_id, (score, -vec_id)) FILTER (WHERE NOT selected) AS in_id, max(score) FILTER (WHERE NOT selected) AS hi FROM m GROUP BY 1)
SELECT cluster, out_id, in_id, round(hi - lo, 6) AS delta FROM w WHERE hi - lo > 1e-9"""
)
def swap_step_weighted(spark, sf_dir):
    """Weights by cluster size, and a reward for distance to other clusters' picks."""
    return refine.swaps(bags(spark, sf_dir), weight="cluster_size", spread=0.5).select("cluster", "out_id", "in_id", _r("delta"))


def _pass_sql(k: int) -> str:
    """The selection s{k + 1} after a parallel step from s{k}."""
    return f"""q{k} AS (SELECT a.vec_id, a.cluster, a.vec_id IN (SELECT vec_id FROM s{k}) AS selected, b.cluster = a.cluster AS same, list_distance(a.x, b.x) AS d FROM v a JOIN (SELECT v.* FROM v JOIN s{k} USING (vec_id)) b ON a.vec_id <> b.vec_id),
m{k} AS (SELECT vec_id, cluster, selected, round(coalesce(avg(d) FILTER (WHERE same), 0) - coalesce(avg(d) FILTER (WHERE NOT same), 0), 9) AS score FROM q{k} GROUP BY ALL),
w{k} AS (SELECT * FROM (SELECT cluster, arg_min(vec_id, (score, vec_id)) FILTER (WHERE selected) AS out_id, min(score) FILTER (WHERE selected) AS lo, arg_max(vec_id, (score, -vec_id)) FILTER (WHERE NOT selected) AS in_id, max(score) FILTER (WHERE NOT selected) AS hi FROM m{k} GROUP BY 1) WHERE hi - lo > 1e-9),
s{k + 1} AS (SELECT vec_id FROM s{k} WHERE vec_id NOT IN (SELECT out_id FROM w{k}) UNION ALL SELECT in_id FROM w{k})"""


@query(f"WITH {V}, s0 AS (SELECT vec_id FROM v WHERE vec_id % 4 = 0), {_pass_sql(0)}, {_pass_sql(1)} SELECT vec_id FROM s2")
def swap_refine(spark, sf_dir):
    """(vec_id): the selection after two parallel passes."""
    return refine.parallel_refine(bags(spark, sf_dir), 2, keep=keep).where("selected").select("vec_id")


@query()
def swap_refine_seq(spark, sf_dir):
    """(vec_id): the selection after one sequential pass."""
    return refine.sequential_refine(bags(spark, sf_dir)).where("selected").select("vec_id")


@query(f"WITH {V}, {C}, i AS (SELECT cluster, avg(list_distance(x, centre)) AS intra FROM v JOIN c USING (cluster) GROUP BY 1) SELECT cluster, round(intra, 6) AS intra, intra < 1.0 * (SELECT quantile_disc(intra, 0.5) FROM i) AS skip FROM i")
def variance_skip(spark, sf_dir):
    return refine.tight_clusters(bags(spark, sf_dir), 1.0).select("cluster", _r("intra"), "skip")


_MEANS = "s AS (SELECT * FROM v WHERE vec_id % 4 = 0), a AS (SELECT v.vec_id, v.cluster, v.x, v.vec_id % 4 = 0 AS selected, sum(list_distance(v.x, s.x)) AS total, count(*) AS k FROM v, s GROUP BY ALL)"


@query(
    f"""WITH {V}, {_MEANS}, m AS (SELECT *, round(total / (k - selected::INT), 9) AS mean FROM a),
w AS (SELECT cluster, arg_min(vec_id, (mean, vec_id)) FILTER (WHERE selected) AS out_id, min(mean) FILTER (WHERE selected) AS lo, arg_max(vec_id, (mean, -vec_id)) FILTER (WHERE NOT selected) AS in_id, max(mean) FILTER (WHERE NOT selected) AS hi FROM m GROUP BY 1)
SELECT cluster, out_id, in_id FROM w WHERE hi > lo + 1e-9"""
)
def max_spread_swap(spark, sf_dir):
    return refine.spread_swaps(bags(spark, sf_dir)).select("cluster", "out_id", "in_id")


@query(
    f"""WITH {V}, {_MEANS}, n AS (SELECT p.vec_id AS out_id, q.vec_id AS in_id, list_distance(p.x, q.x) AS d, p.total / (p.k - 1) AS now, q.total AS then_total, q.k FROM a p, a q WHERE p.selected AND NOT q.selected),
r AS (SELECT *, row_number() OVER (PARTITION BY out_id ORDER BY d, in_id) AS rank FROM n), t AS (SELECT out_id, in_id, round(2 * ((then_total - d) / (k - 1) - now), 9) AS delta FROM r WHERE rank <= 5)
SELECT out_id, in_id, round(delta, 6) AS delta FROM t WHERE -delta > 1e-9 ORDER BY t.delta, out_id, in_id LIMIT 1"""
)
def knn_swap(spark, sf_dir):
    return refine.knn_swap(bags(spark, sf_dir)).select("out_id", "in_id", _r("delta"))


@query("SELECT count(*) AS n, sum((vec_id % 4 = 0)::INT)::BIGINT AS selected, count(DISTINCT CASE WHEN vec_id % 4 = 0 THEN vec_id END) AS \"distinct\", 0::BIGINT AS duplicates, round(count(DISTINCT CASE WHEN vec_id % 4 = 0 THEN vec_id END) / count(*), 6) AS ratio FROM embeddings")
def selection_stats(spark, sf_dir):
    rows = bags(spark, sf_dir)
    return refine.statistics(rows, rows.where("selected")).select("n", "selected", "distinct", "duplicates", _r("ratio"))


@query()
def canonical_selection(spark, sf_dir):
    """(vec_id, role): the whole recipe on the one bag."""
    from .sampler import SamplerSpec

    return SamplerSpec.canonical().run(vectors(spark, sf_dir))


# Baseline samplers: suppliers' line items are bags, an item is a row.

_L = "r AS (SELECT l_suppkey AS bag, l_orderkey * 10 + l_linenumber AS vec_id, l_quantity::DOUBLE AS px, l_extendedprice::DOUBLE AS py FROM lineitem)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vec_id"), F.col("l_quantity").cast("double").alias("px"), F.col("l_extendedprice").cast("double").alias("py"))


@query(f"WITH {_L}, k AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY md5('0|' || bag || '|' || vec_id), vec_id) AS k, count(*) OVER (PARTITION BY bag) AS n FROM r) SELECT bag, vec_id FROM k WHERE k <= greatest(1, round_even(0.25::DOUBLE * n, 0)::BIGINT)")
def random_k(spark, sf_dir):
    return sample.random_k(_items(spark, sf_dir), RATIO)


@query(
    f"""WITH {_L}, b AS (SELECT bag, greatest(1, round_even(0.1::DOUBLE * count(*), 0)::BIGINT) AS k, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM r GROUP BY 1),
g AS (SELECT r.bag, vec_id, k, md5('0|' || r.bag || '|' || vec_id) AS key, least(floor((px - x0) / (x1 - x0) * ceil(sqrt(k))), ceil(sqrt(k)) - 1) * ceil(sqrt(k)) + least(floor((py - y0) / (y1 - y0) * ceil(sqrt(k))), ceil(sqrt(k)) - 1) AS cell FROM r JOIN b ON r.bag = b.bag),
c AS (SELECT *, row_number() OVER (PARTITION BY bag, cell ORDER BY key, vec_id) AS in_cell FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY (in_cell > 1)::INT, key, vec_id) AS rank FROM c)
SELECT bag, vec_id FROM o WHERE rank <= k"""
)
def grid_sample(spark, sf_dir):
    return sample.grid(_items(spark, sf_dir), 0.1)


@query()
def kmeans_sample(spark, sf_dir):
    return sample.cluster_representatives(vectors(spark, sf_dir), 0.02)


def _chosen(spark, sf_dir):
    rows = bags(spark, sf_dir)
    return rows, rows.where("vec_id % 3 = 0").select("bag", "vec_id", F.col("vec_id").alias("place"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0")
def custom_select(spark, sf_dir):
    return sample.custom(*_chosen(spark, sf_dir)).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0")
def custom_inverse(spark, sf_dir):
    return sample.inverse(*_chosen(spark, sf_dir)).select("vec_id")


@query("SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY CASE WHEN vec_id % 3 = 0 THEN vec_id END NULLS LAST, md5('0|1|' || vec_id), vec_id) AS k FROM embeddings) WHERE k <= 300")
def ensure_size(spark, sf_dir):
    return sample.ensure_size(*_chosen(spark, sf_dir), 300).select("vec_id")


@query(f"WITH {V} SELECT vec_id, round(list_sum(CASE WHEN vec_id % 3 = 0 THEN x ELSE list_transform(x, lambda t: 2 * t) END), 6) AS total FROM v")
def coalesce_fill(spark, sf_dir):
    from ..functions.vectors import total

    rows, chosen = _chosen(spark, sf_dir)
    other = rows.withColumn("x", F.transform("x", lambda t: t * 2))
    return sample.fill_from(rows, other, chosen).select("vec_id", F.round(total("x"), 6).alias("total"))


@query(
    f"""WITH {V}, k AS (SELECT vec_id, x, row_number() OVER (ORDER BY md5('0|1|' || vec_id), vec_id) AS k FROM v WHERE vec_id % 3 <> 0)
SELECT vec_id, false AS filled, round(list_sum(x), 6) AS total FROM v WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, true, round(2 * list_sum(x), 6) FROM k WHERE k <= round_even(0.1::DOUBLE * (SELECT count(*) FROM v), 0)"""
)
def partial_fill(spark, sf_dir):
    from ..functions.vectors import total

    rows, chosen = _chosen(spark, sf_dir)
    return sample.partial_fill(rows, rows.withColumn("x", F.transform("x", lambda t: t * 2)), chosen, 0.1).select("vec_id", "filled", F.round(total("x"), 6).alias("total"))


@query(f"WITH {V} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN round(sqrt(list_inner_product(x, x)), 6) ELSE 0 END::DOUBLE AS norm FROM v")
def zero_fill(spark, sf_dir):
    from ..functions.vectors import norm

    return sample.zero_fill(*_chosen(spark, sf_dir)).select("vec_id", F.round(norm("x"), 6).alias("norm"))


@query("WITH m AS (SELECT label // 3 AS sample, label AS bag, label % 3 AS sub, vec_id FROM embeddings) SELECT sample::INT AS sample, sub::INT AS sub, vec_id, row_number() OVER (PARTITION BY sample ORDER BY sub, vec_id) - 1 AS place FROM m")
def multi_bag_concat(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("cluster").alias("bag"), "vec_id", "x")
    members = rows.select("bag").distinct().select("bag", F.floor(F.col("bag") / 3).cast("int").alias("sample"), (F.col("bag") % 3).alias("sub"))
    return sample.joined_bags(rows, members).select("sample", "sub", "vec_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {V}, c AS (SELECT *, x[1] AS confidence FROM v WHERE cluster <> 0), g AS (SELECT cluster, count(*) AS n, arg_max(vec_id, (confidence, -vec_id)) AS vec_id, max(confidence) AS confidence FROM c GROUP BY 1) SELECT cluster, n, vec_id FROM g ORDER BY n DESC, confidence DESC, vec_id LIMIT 5")
def ranked_clusters(spark, sf_dir):
    """Label 0 stands for noise."""
    rows = vectors(spark, sf_dir).withColumn("confidence", F.col("x")[0]).withColumn("cluster", F.when(F.col("cluster") == 0, -1).otherwise(F.col("cluster")))
    return sample.ranked_clusters(rows, 5).select("cluster", "n", "vec_id")


@query(f"WITH {V}, {C} SELECT cluster, round(avg(list_distance(x, centre)), 6) AS spread FROM v JOIN c USING (cluster) GROUP BY 1")
def cluster_spread(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    centre = rows.groupBy("cluster").agg(mean_vector("x").alias("centre"))
    return rows.join(centre, "cluster").groupBy("cluster").agg(F.round(F.avg(F.sqrt(squared_l2("x", "centre"))), 6).alias("spread"))
