"""Queries of metrics, aggregation of runs, pooling, and measures between sets of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import cluster, metrics, pairs, relations
from .registry import C, V, query, table, vectors


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# Predictions: the nearest mean's label, and minus the distances to the means as scores.

_SCORES = f"""WITH {V}, {C}, s AS (SELECT v.vec_id, v.cluster AS y, list(round(-list_distance(v.x, c.centre), 9) ORDER BY c.cluster) AS scores FROM v, c GROUP BY 1, 2),
t AS (SELECT *, (list_position(scores, list_max(scores)) - 1)::INT AS p FROM s)"""


def _scores(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = rows.withColumnRenamed("cluster", "y").crossJoin(cluster.packed(cluster.centroids(rows)))
    found = found.select("vec_id", "y", F.transform("centres", lambda c: F.round(-vec.l2(F.col("x"), c["centre"]), 9)).alias("scores"))
    return found.withColumn("p", vec.argmax("scores"))


@query(_SCORES + " SELECT vec_id, y, p FROM t")
def argmax_pred(spark, sf_dir):
    return _scores(spark, sf_dir).select("vec_id", "y", "p")


@query(_SCORES + " SELECT round(avg((y = p)::INT), 6) AS accuracy FROM t")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_scores(spark, sf_dir)).select(_r("accuracy"))


_PRF = _SCORES + """, k AS (SELECT DISTINCT y AS c FROM t UNION SELECT DISTINCT p FROM t), n AS (SELECT c, (SELECT count(*) FROM t WHERE y = c) AS a, (SELECT count(*) FROM t WHERE p = c) AS b, (SELECT count(*) FROM t WHERE y = c AND p = c) AS tp FROM k),
r AS (SELECT c AS class, CASE WHEN b > 0 THEN tp / b ELSE 0 END AS precision, CASE WHEN a > 0 THEN tp / a ELSE 0 END AS recall, CASE WHEN a + b > 0 THEN 2 * tp / (a + b) ELSE 0 END AS f1 FROM n)"""


@query(_PRF + " SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def class_prf(spark, sf_dir):
    return metrics.class_scores(_scores(spark, sf_dir)).select("class", *[_r(c) for c in ("precision", "recall", "f1")])


@query(_PRF + " SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM r")
def macro_prf(spark, sf_dir):
    return metrics.macro(_scores(spark, sf_dir)).select(*[_r("macro_" + c) for c in ("precision", "recall", "f1")])


def _auc(pos: str, score: str, source: str, keys: str = "") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    head, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"""k AS (SELECT *, ({pos})::INT AS pos, rank() OVER ({by}ORDER BY {score}) + (count(*) OVER ({by.strip()}{' , ' if keys else 'PARTITION BY '}{score}) - 1) / 2.0 AS r FROM {source}),
z AS (SELECT {head}CASE WHEN sum(pos) > 0 AND sum(1 - pos) > 0 THEN (sum(r) FILTER (WHERE pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(1 - pos)) ELSE 'nan'::DOUBLE END AS auroc FROM k{group})"""


@query(f"WITH d AS (SELECT l.doc_id, toxic, n_chars // 50 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id), {_auc('toxic = 1', 'score', 'd')} SELECT round(auroc, 6) AS auroc FROM z")
def auroc(spark, sf_dir):
    """How well a document's length, with many ties, tells toxic ones."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.auroc(rows.select((F.col("toxic") == 1).alias("positive"), F.floor(F.col("n_chars") / 50).cast("double").alias("score"))).select(_r("auroc"))


@query(f"{_SCORES}, d AS (SELECT y, unnest(range(0, len(scores)))::INT AS class, unnest(scores) AS score FROM s), {_auc('y = class', 'score', 'd', 'class')} SELECT class, round(auroc, 6) AS auroc FROM z")
def auroc_ovr(spark, sf_dir):
    return metrics.auroc_rest(_scores(spark, sf_dir)).select("class", _r("auroc"))


@query(
    f"""{_SCORES}, n AS (SELECT i.r::INT AS a, j.r::INT AS b, w.r::INT AS way FROM range(10) i(r), range(10) j(r), range(2) w(r) WHERE i.r < j.r),
d AS (SELECT a, b, way, CASE WHEN way = 0 THEN y = a ELSE y = b END AS is_pos, scores[CASE WHEN way = 0 THEN a ELSE b END + 1] AS score FROM n JOIN s ON y = a OR y = b), {_auc('is_pos', 'score', 'd', 'a, b, way')}
SELECT a, b, round(avg(auroc), 6) AS auroc FROM z GROUP BY 1, 2"""
)
def auroc_ovo(spark, sf_dir):
    return metrics.auroc_pairs(_scores(spark, sf_dir), 10).select("a", "b", _r("auroc"))


@query(_SCORES + " SELECT vec_id, round(list_max(list_transform(scores, lambda t: exp(t - list_max(scores)))) / list_sum(list_transform(scores, lambda t: exp(t - list_max(scores)))), 6) AS top FROM s")
def softmax(spark, sf_dir):
    return _scores(spark, sf_dir).select("vec_id", F.round(F.array_max(vec.softmax("scores")), 6).alias("top"))


@query(_SCORES + " SELECT vec_id, round(list_sum(list_transform(scores, lambda t: exp(t))) / (1 + list_sum(list_transform(scores, lambda t: exp(t)))), 6) AS total FROM s")
def softmax_one(spark, sf_dir):
    return _scores(spark, sf_dir).select("vec_id", F.round(vec.total(vec.softmax_one("scores")), 6).alias("total"))


@query("SELECT quality::BIGINT AS quality, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY 1")
def class_weight(spark, sf_dir):
    return metrics.class_weights(table(spark, sf_dir, "labels").select(F.col("quality").cast("long").alias("quality")), "quality").select("quality", _r("weight"))


@query()
def linear_probe(spark, sf_dir):
    """(vec_id, label, p) of the third of the rows that the probe didn't see."""
    rows = vectors(spark, sf_dir).withColumnRenamed("cluster", "label")
    return metrics.linear_probe(rows.where("vec_id % 3 <> 0"), rows.where("vec_id % 3 = 0")).select("vec_id", "label", "p")


# Runs: events' values by type and user; a value of each seventh event is missing (NaN).

_RUNS = "r AS (SELECT event_type AS arch, user_id % 5 AS fold, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE value END AS value FROM events)"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("arch"), (F.col("user_id") % 5).alias("fold"), F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))


@query(f"WITH {_RUNS} SELECT arch, fold, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM r WHERE NOT isnan(value) GROUP BY 1, 2")
def run_aggregate(spark, sf_dir):
    return metrics.run_aggregate(_runs(spark, sf_dir), ["arch", "fold"]).select("arch", "fold", _r("mean"), _r("std"), "n")


_TWO = f"WITH {_RUNS}, f AS (SELECT arch, fold, avg(value) AS m FROM r WHERE NOT isnan(value) GROUP BY 1, 2)"


@query(_TWO + " SELECT arch, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, count(*) AS n FROM f GROUP BY 1")
def two_level_aggregate(spark, sf_dir):
    return metrics.two_level_aggregate(_runs(spark, sf_dir), ["arch"], "fold").select("arch", _r("mean"), _r("std"), "n")


@query(_TWO + " SELECT arch, printf('%.4f +- %.4f', round(avg(m), 6), round(stddev_pop(m), 6)) AS told FROM f GROUP BY 1")
def format_agg(spark, sf_dir):
    rows = metrics.two_level_aggregate(_runs(spark, sf_dir), ["arch"], "fold")
    return rows.select("arch", metrics.told(F.round("mean", 6), F.round("std", 6)).alias("told"))


@query(f"WITH {_RUNS} SELECT arch, " + ", ".join(f"round(avg(value) FILTER (WHERE fold = {k}), 6) AS f{k}" for k in range(5)) + " FROM r WHERE NOT isnan(value) GROUP BY 1")
def pivot_metrics(spark, sf_dir):
    rows = _runs(spark, sf_dir).where("NOT isnan(value)").groupBy("arch").pivot("fold", list(range(5))).agg(F.round(F.avg("value"), 6))
    return rows.select("arch", *[F.col(str(k)).alias(f"f{k}") for k in range(5)])


@query(
    """WITH e AS (SELECT event_type AS series, event_id AS step, value, 1 + user_id % 3 AS n FROM events) SELECT series, step,
round(sum(value * n) OVER w / sum(n) OVER w, 9) AS average, round(median(value) OVER (PARTITION BY series ORDER BY step ROWS 19 PRECEDING), 6) AS median FROM e WINDOW w AS (PARTITION BY series ORDER BY step ROWS UNBOUNDED PRECEDING)"""
)
def smoothed_value(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("step"), "value", (1 + F.col("user_id") % 3).alias("n"))
    return metrics.smoothed(rows, "step", "value", "n").select("series", "step", _r("average", 9), _r("median"))


@query("WITH e AS (SELECT event_type AS arch, event_id AS epoch, round(value + user_id % 10, 9) AS score FROM events) SELECT arch, arg_max(epoch, (score, -epoch)) AS epoch, round(max(score), 6) AS score FROM e GROUP BY 1")
def best_epoch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("arch"), F.col("event_id").alias("epoch"), F.col("value").alias("auroc"), (F.col("user_id") % 10).cast("double").alias("f1"))
    return metrics.best_epoch(rows, ["arch"]).select("arch", "epoch", _r("score"))


# Two sets of vectors: the embeddings and their cyclic shift by one entry, squared.

_TWIN = f"{V}, w AS (SELECT vec_id, cluster, x AS xa, list_transform(list_concat(x[2:], x[:1]), lambda t: t * t) AS xb FROM v)"


def _twins(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    turned = F.concat(F.slice("x", 2, 63), F.slice("x", 1, 1))
    return rows.select("vec_id", "cluster", F.col("x").alias("xa"), F.transform(turned, lambda t: t * t).alias("xb"))


@query(
    f"""WITH {_TWIN}, u AS (SELECT vec_id, unnest(xa) AS a, unnest(xb) AS b, unnest(range(64)) AS d FROM w), q AS (SELECT vec_id, d, a - avg(a) OVER (PARTITION BY d) AS a, b - avg(b) OVER (PARTITION BY d) AS b FROM u),
p AS (SELECT l.d, r.d AS e, sum(l.a * r.b) AS ab, sum(l.a * r.a) AS aa, sum(l.b * r.b) AS bb FROM q l JOIN q r USING (vec_id) GROUP BY 1, 2)
SELECT round(sum(ab * ab) / (sqrt(sum(aa * aa)) * sqrt(sum(bb * bb))), 6) AS cka FROM p"""
)
def linear_cka(spark, sf_dir):
    return metrics.linear_cka(_twins(spark, sf_dir)).select(_r("cka"))


@query(f"WITH {_TWIN} SELECT i.cluster, round(avg(pow(list_distance(i.xa, j.xa) - list_distance(i.xb, j.xb), 2)), 6) AS mse FROM w i JOIN w j ON i.cluster = j.cluster AND i.vec_id <> j.vec_id GROUP BY 1")
def pairwise_mse(spark, sf_dir):
    return metrics.pairwise_mse(_twins(spark, sf_dir), "cluster").select("cluster", _r("mse"))


@query(
    f"""WITH {_TWIN}, p AS (SELECT i.cluster, i.vec_id AS i, list_inner_product(i.xa, j.xa) / 4 AS t, list_inner_product(i.xb, j.xb) / 4 AS s FROM w i JOIN w j ON i.cluster = j.cluster AND i.vec_id <> j.vec_id),
l AS (SELECT cluster, i, t - ln(sum(exp(t)) OVER (PARTITION BY i)) AS t, s - ln(sum(exp(s)) OVER (PARTITION BY i)) AS s FROM p), k AS (SELECT cluster, i, sum(exp(t) * (t - s)) AS kl FROM l GROUP BY 1, 2)
SELECT cluster, round(avg(kl) * 16, 6) AS kl FROM k GROUP BY 1"""
)
def relation_kl(spark, sf_dir):
    return metrics.relation_kl(_twins(spark, sf_dir), "cluster").select("cluster", _r("kl"))


def _relation_sql(name: str, t: str, s: str) -> str:
    """Divergences {name} of the softmaxes of t and s, at temperatures 1 and 4."""
    return f"""{name}p AS (SELECT cluster, i, h, {t} / h AS t, {s} / h AS s FROM g, (VALUES (1.0::DOUBLE), (4.0::DOUBLE)) q(h)),
{name}l AS (SELECT cluster, i, h, t - ln(sum(exp(t)) OVER (PARTITION BY i, h)) AS t, s - ln(sum(exp(s)) OVER (PARTITION BY i, h)) AS s FROM {name}p),
{name} AS (SELECT cluster, avg(kl) AS kl FROM (SELECT cluster, i, h, sum(exp(t) * (t - s)) * h * h AS kl FROM {name}l GROUP BY 1, 2, 3) GROUP BY 1)"""


@query(
    f"""WITH {_TWIN}, n AS (SELECT cluster, avg(sqrt(list_inner_product(xa, xa))) AS ma, avg(sqrt(list_inner_product(xb, xb))) AS mb FROM w GROUP BY 1),
g AS (SELECT i.cluster, i.vec_id AS i, list_inner_product(i.xa, j.xa) / (ma * ma) AS ta, list_inner_product(i.xb, j.xb) / (mb * mb) AS sa, -sqrt(pow(list_distance(i.xa, j.xa) / ma, 2) + 1e-12) AS td, -sqrt(pow(list_distance(i.xb, j.xb) / mb, 2) + 1e-12) AS sd FROM w i JOIN w j ON i.cluster = j.cluster AND i.vec_id <> j.vec_id JOIN n ON n.cluster = i.cluster),
{_relation_sql('a', 'ta', 'sa')}, {_relation_sql('d', 'td', 'sd')}
SELECT cluster, round(a.kl, 6) AS affinity, round(d.kl, 6) AS distance, round(a.kl + d.kl, 6) AS structure, round(0.5 * a.kl + 2 * d.kl, 6) AS total FROM a JOIN d USING (cluster)"""
)
def structure_loss(spark, sf_dir):
    """Relations of batches at two temperatures, and a weighted sum of losses."""
    found = relations.structure_loss(_twins(spark, sf_dir), "cluster", (1.0, 4.0))
    return relations.composite_loss(found, {"affinity": 0.5, "distance": 2.0, "structure": 0.0}).select("cluster", *[_r(c) for c in ("affinity", "distance", "structure", "total")])


@query(
    f"""WITH {V}, n AS (SELECT cluster, avg(sqrt(list_inner_product(x, x))) AS m FROM v GROUP BY 1)
SELECT i.cluster, i.vec_id AS a, j.vec_id AS b, round(sqrt(greatest(list_inner_product(i.x, i.x) + list_inner_product(j.x, j.x) - 2 * list_inner_product(i.x, j.x), 0) / (m * m) + 1e-12), 6) AS d FROM v i JOIN v j ON i.cluster = j.cluster AND i.vec_id < j.vec_id JOIN n ON n.cluster = i.cluster"""
)
def gram_distance(spark, sf_dir):
    """Distances from products alone, after scaling each batch by its mean norm."""
    rows = vectors(spark, sf_dir)
    mean = rows.groupBy("cluster").agg(F.avg(vec.norm("x")).alias("m"))
    scaled = rows.join(mean, "cluster").withColumn("x", F.transform("x", lambda v: v / F.col("m")))
    return pairs.table(scaled, "cluster", pairs.gram(), ("d",), 6)


# Bags to vectors.


@query(f"WITH {V}, {C} SELECT cluster, round(list_sum(list_transform(centre, lambda t: t * t)), 6) AS energy FROM c")
def bag_mean(spark, sf_dir):
    return cluster.centroids(vectors(spark, sf_dir)).select("cluster", F.round(vec.dot("centre", "centre"), 6).alias("energy"))


@query(f"WITH {V}, {C} SELECT cluster, d::INT AS d, round(max(value), 6) AS most FROM e GROUP BY 1, 2")
def bag_max(spark, sf_dir):
    each = vectors(spark, sf_dir).select("cluster", F.posexplode("x").alias("d", "value"))
    return each.groupBy("cluster", (F.col("d") + 1).alias("d")).agg(F.round(F.max("value"), 6).alias("most"))


@query(f"WITH {V}, w AS (SELECT cluster, exp(10 * x[1]) AS a, x FROM v), e AS (SELECT cluster, a, unnest(x) AS value, unnest(range(1, 65)) AS d FROM w) SELECT cluster, d::INT AS d, round(sum(a * value) / sum(a), 6) AS pooled FROM e GROUP BY 1, 2")
def softmax_pool(spark, sf_dir):
    """Attention pooling with ten times the first entry as score."""
    rows = vectors(spark, sf_dir).withColumn("score", F.col("x")[0] * 10)
    return metrics.softmax_pool(rows, "cluster", "score").select("cluster", F.posexplode("pooled").alias("d", "pooled")).select("cluster", (F.col("d") + 1).alias("d"), _r("pooled"))


@query(f"WITH {V} SELECT vec_id, len(list_concat(x[1:16], x[33:48], x[49:64]))::INT AS width, round(list_sum(list_concat(x[1:16], x[33:48], x[49:64])), 6) AS total FROM v")
def concat_layers(spark, sf_dir):
    """Layers 0, 2 and 3 of four, one after the other."""
    joined = F.concat(*[F.slice("x", 1 + 16 * k, 16) for k in (0, 2, 3)])
    return vectors(spark, sf_dir).select("vec_id", F.size(joined).alias("width"), F.round(vec.total(joined), 6).alias("total"))


@query(f"WITH {V} SELECT vec_id, round(list_sum(list_transform(x, lambda t: (t / 255.0 - 0.5) / 0.25)), 6) AS total FROM v")
def pixel_normalize(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(vec.total(vec.picture_normalise("x", 0.5, 0.25)), 6).alias("total"))


_STEPS = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events)"


def _steps(spark, sf_dir):
    """(user_id, step): users stand for runs, their events for steps."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", place.alias("step"))


@query(f"WITH {_STEPS} SELECT user_id, count(*) AS n, round(sum(CASE WHEN step < 5 THEN 0.001 * step / 5 ELSE 1e-6 + (0.001 - 1e-6) * 0.5 * (1 + cos(pi() * (step - 5) / 45)) END::DOUBLE), 8) AS rate FROM e WHERE step < 50 GROUP BY 1")
def half_cosine_lr(spark, sf_dir):
    """The learning rates of each run's first fifty epochs, summed."""
    rate = metrics.half_cosine(F.col("step"), 0.001, 1e-6, 5.0, 50.0)
    return _steps(spark, sf_dir).where("step < 50").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(rate), 8).alias("rate"))


@query(f"WITH {_STEPS} SELECT user_id, max(step) AS last, round(sum(CASE WHEN step < 10 THEN step / 10.0 ELSE greatest(0.1, 0.5 * (1 + cos(pi() * least((step - 10) / 90.0, 1)))) END::DOUBLE), 6) AS factor FROM e GROUP BY 1")
def cosine_schedule(spark, sf_dir):
    """The factors of all steps of each run, summed; after the hundredth they stay at the least."""
    factor = metrics.cosine_schedule(F.col("step"), 100, 10, 0.1)
    return _steps(spark, sf_dir).groupBy("user_id").agg(F.max("step").cast("long").alias("last"), F.round(F.sum(factor), 6).alias("factor"))
