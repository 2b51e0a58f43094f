"""Queries over a table of bags of unequal size, all clustered at once, and their SQL.

The ten labels of the embeddings make four bags of one, three, five and one label: bag is floor(sqrt(label)).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bagwise, refine, upkeep
from .registry import query, sq, table

K, SIZE, PUSH = 4, 8, 0.22


def bag_rows(spark, sf_dir):
    """Embeddings as (bag, vec_id, x)."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.floor(F.sqrt(F.col("label"))).cast("int").alias("bag"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))


def _starts(rows, starts: int):
    """K rows for each bag and start: places start, start + starts, ... of the bag's rows in the order of an md5 of their ids."""
    from pyspark.sql import Window

    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("bag").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id")) - 1)
    first = placed.where(F.col("place") < K * starts)
    return first.select("bag", (F.col("place") % starts).cast("int").alias("start"), F.floor(F.col("place") / starts).cast("int").alias("cluster"), "vec_id", F.col("x").alias("centre"))


_V = f"""v AS (SELECT floor(sqrt(label))::INT AS bag, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
w AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS place FROM v)"""


def _start_sql(starts: int) -> str:
    return f"m0 AS (SELECT bag, (place % {starts})::INT AS start, (place // {starts})::INT AS cluster, vec_id, x AS centre FROM w WHERE place < {K * starts})"


def _near_sql(k: int) -> str:
    """Rows with the nearest of the medoids m{k}, and the squared distance to the next one."""
    return f"""p{k} AS (SELECT v.bag, start, v.vec_id, v.x, cluster, round({sq('v.x', 'centre')}, 9) AS d2 FROM v JOIN m{k} USING (bag)),
l{k} AS (SELECT bag, start, vec_id, any_value(x) AS x, arg_min(cluster, (d2, cluster)) AS cluster, min(d2) AS d2, list_sort(list(d2))[2] AS other FROM p{k} GROUP BY 1, 2, 3),
e{k} AS (SELECT bag, start, cluster, unnest(x) AS value, unnest(range(1, len(x) + 1)) AS d FROM l{k}),
c{k} AS (SELECT bag, start, cluster, list(mean ORDER BY d) AS mean FROM (SELECT bag, start, cluster, d, avg(value) AS mean FROM e{k} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
s{k} AS (SELECT l{k}.*, {sq('x', 'mean')} AS m FROM l{k} JOIN c{k} USING (bag, start, cluster))"""


def _round_sql(k: int) -> str:
    """The medoids m{k + 1} after a round from m{k}: of the rows of least m - other, that of the least m - push * other."""
    return f"""{_near_sql(k)},
r{k} AS (SELECT *, row_number() OVER (PARTITION BY bag, start, cluster ORDER BY round(m - other, 9), vec_id) AS place FROM s{k}),
m{k + 1} AS (SELECT bag, start, cluster, arg_min(vec_id, (round(m - {PUSH} * other, 9), vec_id)) AS vec_id, arg_min(x, (round(m - {PUSH} * other, 9), vec_id)) AS centre FROM r{k} WHERE place <= {SIZE} GROUP BY 1, 2, 3)"""


def _medoids(spark, sf_dir, rounds: int, starts: int = 1):
    rows = bag_rows(spark, sf_dir)
    blocks = bagwise.block(rows)
    found = bagwise.kmedoids(rows, blocks, _starts(rows, starts), bagwise.Medoids(rounds=rounds, size=SIZE, push=PUSH))
    return rows, blocks, found


@query(f"WITH {_V}, {_start_sql(1)}, {_round_sql(0)}, {_round_sql(1)} SELECT bag, cluster, vec_id FROM m2")
def bag_medoids(spark, sf_dir):
    """Two rounds of medoids in every bag, from given starts."""
    return _medoids(spark, sf_dir, 2)[2].select("bag", "cluster", "vec_id")


@query(
    f"""WITH {_V}, {_start_sql(2)}, {_round_sql(0)}, {_near_sql(1)},
i AS (SELECT bag, start, round(sum(d2), 6) AS inertia FROM l1 GROUP BY 1, 2)
SELECT m1.bag, m1.start, cluster, vec_id FROM m1 JOIN (SELECT bag, arg_min(start, (inertia, start)) AS start FROM i GROUP BY 1) b ON m1.bag = b.bag AND m1.start = b.start"""
)
def bag_best_start(spark, sf_dir):
    """Of two starts of every bag, a round each, the medoids of the one of the least inertia."""
    _, blocks, found = _medoids(spark, sf_dir, 1, 2)
    return bagwise.best_start(blocks, found).select("bag", "start", "cluster", "vec_id")


@query(
    f"""WITH {_V}, {_start_sql(2)}, d AS (SELECT a.bag, a.start, min(list_distance(a.centre, b.centre)) AS closest FROM m0 a JOIN m0 b ON a.bag = b.bag AND a.start = b.start AND a.cluster < b.cluster GROUP BY 1, 2)
SELECT bag, arg_max(start, (round(closest, 9), -start)) AS start, round(max(closest), 6) AS closest FROM d GROUP BY 1"""
)
def bag_dispersed_start(spark, sf_dir):
    """Of two starts of every bag, the one whose closest two medoids are farthest apart."""
    rows = bag_rows(spark, sf_dir)
    first = _starts(rows, 2)
    best = bagwise.best_start(bagwise.block(rows), first, "dispersion")
    scored = bagwise.contested(best.withColumns({"n": F.lit(1).cast("long"), "mean": F.col("centre"), "d2": F.lit(0.0)}), "closest_pair")
    return scored.groupBy("bag", "start").agg(F.round(F.min("score"), 6).alias("closest"))


@query(
    f"""WITH {_V}, {_start_sql(1)}, {_near_sql(0)},
a AS (SELECT m.bag, m.cluster, min(list_distance(m.centre, o.centre)) AS near FROM m0 m JOIN m0 o ON m.bag = o.bag AND m.cluster <> o.cluster GROUP BY 1, 2),
t AS (SELECT bag, cluster FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY round(near, 9), cluster) AS place FROM a) WHERE place <= 2),
f AS (SELECT s0.*, row_number() OVER (PARTITION BY s0.bag, s0.cluster ORDER BY round(m, 9), vec_id) AS place FROM s0 JOIN t USING (bag, cluster) WHERE (SELECT count(*) FROM l0 WHERE l0.bag = s0.bag AND l0.cluster = s0.cluster) > 1),
n AS (SELECT bag, cluster, arg_min(vec_id, (-round(sqrt(other), 9), place)) AS vec_id FROM f WHERE place <= 3 GROUP BY 1, 2)
SELECT m0.bag, m0.cluster, coalesce(n.vec_id, m0.vec_id) AS vec_id FROM m0 LEFT JOIN n ON m0.bag = n.bag AND m0.cluster = n.cluster"""
)
def bag_polish(spark, sf_dir):
    """One pass over the two medoids of every bag that stand closest to another, forward out of three rows."""
    rows = bag_rows(spark, sf_dir)
    found = bagwise.polish(rows, bagwise.block(rows), _starts(rows, 1), bagwise.Medoids(size=SIZE, push=PUSH), 2, "closest_pair", 1, 3)
    return found.select("bag", "cluster", "vec_id")


def _farthest_sql(k: int) -> str:
    """The k-th pick f{k} after f0 .. f{k - 1}."""
    before = " UNION ALL ".join(f"SELECT * FROM f{j}" for j in range(k))
    return f"""t{k} AS ({before}), g{k} AS (SELECT v.bag, v.vec_id, any_value(v.x) AS x, round(min({sq('v.x', 't.x')}), 9) AS d2 FROM v JOIN t{k} t USING (bag) GROUP BY 1, 2),
f{k} AS (SELECT bag, {k} AS cluster, arg_max(vec_id, (d2, -vec_id)) AS vec_id, arg_max(x, (d2, -vec_id)) AS x FROM g{k} GROUP BY 1)"""


@query(f"WITH {_V}, f0 AS (SELECT bag, 0 AS cluster, vec_id, x FROM w WHERE place = 0), {', '.join(_farthest_sql(k) for k in range(1, 6))} SELECT bag, cluster, vec_id FROM ({' UNION ALL '.join(f'SELECT * FROM f{k}' for k in range(6))})")
def farthest_start(spark, sf_dir):
    """Six rows of every bag, each the farthest from those before it."""
    rows = bag_rows(spark, sf_dir)
    first = _starts(rows, 1).where("cluster = 0")
    found = bagwise.farthest_starts(rows, bagwise.block(rows), first, rows.select("bag").distinct().withColumn("k", F.lit(6)), 4)
    return found.select("bag", "cluster", "vec_id")


@query()
def canonical_bags(spark, sf_dir):
    """(bag, vec_id, role): the whole recipe on four bags at once."""
    from .sampler import SamplerSpec

    return SamplerSpec.canonical().run(bag_rows(spark, sf_dir))


@query(
    f"""WITH {_V}, p AS (SELECT a.bag, a.vec_id, list_distance(a.x, b.x) AS d FROM v a JOIN v b USING (bag))
SELECT bag, vec_id, round(list_sort(list(d))[5], 6) AS core FROM p GROUP BY 1, 2"""
)
def core_distance(spark, sf_dir):
    """The distance of every row of a bag to its fifth nearest, itself the first."""
    from ..operators import density

    rows = bag_rows(spark, sf_dir)
    found = density.core_distances(bagwise.block(rows), rows.select("bag").distinct().withColumn("k", F.lit(5)))
    return found.select("bag", "vec_id", F.round("core", 6).alias("core"))


@query()
def density_sample(spark, sf_dir):
    """(bag, vec_id, how): a tenth of each bag, one row of each dense cluster first."""
    from ..operators import density

    return density.density_sample(bag_rows(spark, sf_dir), 0.1)


def _linked(spark, sf_dir):
    from ..operators import attention

    rows = attention.mean_shifted(bag_rows(spark, sf_dir))
    return rows.select("bag", "vec_id", F.col("x").alias("head"), F.reverse("x").alias("tail"))


_GRAPH = f"""{_V}, u AS (SELECT bag, vec_id, unnest(x) AS value, unnest(range(1, len(x) + 1)) AS d FROM v),
h AS (SELECT bag, vec_id, list(y ORDER BY d) AS head, list(y ORDER BY -d) AS tail FROM (SELECT bag, vec_id, d, (value + avg(value) OVER (PARTITION BY bag, d)) * 0.5 AS y FROM u) GROUP BY 1, 2),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bag, vec_id ORDER BY logit DESC, other) AS place FROM
      (SELECT a.bag, a.vec_id, b.vec_id AS other, a.head, b.tail, round(list_inner_product(a.head, b.tail) * 0.125, 9) AS logit FROM h a JOIN h b USING (bag))) WHERE place <= 6)"""


@query(f"WITH {_GRAPH} SELECT bag, vec_id, other, round(logit, 6) AS logit, place::INT AS place FROM e")
def neighbour_edges(spark, sf_dir):
    """The six rows of a bag that each row attends to, heads being half way to the mean and tails their reverse."""
    from ..operators import attention

    return attention.neighbours(_linked(spark, sf_dir), 6, 0.125).select("bag", "vec_id", "other", F.round("logit", 6).alias("logit"), "place")


@query(
    f"""WITH {_GRAPH}, p AS (SELECT *, exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w) AS p FROM e WINDOW w AS (PARTITION BY bag, vec_id)),
g AS (SELECT *, list_sum(list_transform(list_zip(head, tail), lambda t: (1 - 2 / (exp(2 * (t[1] + p * t[2])) + 1)) * t[2])) AS gate FROM p),
k AS (SELECT *, exp(gate - max(gate) OVER (PARTITION BY bag, vec_id)) AS s FROM g)
SELECT bag, vec_id, round(sum(s * list_sum(tail)) / sum(s), 5) AS total, round(sum(s * list_inner_product(head, tail)) / sum(s), 5) AS product FROM k GROUP BY 1, 2"""
)
def neighbour_messages(spark, sf_dir):
    """What each row's neighbours tell it: the sum of the message and its product with the head."""
    from ..functions import vectors as vec
    from ..operators import attention

    rows = _linked(spark, sf_dir)
    found = attention.messages(rows, attention.neighbours(rows, 6, 0.125))
    return found.select("bag", "vec_id", F.round(vec.total("message"), 5).alias("total"), F.round(vec.dot("head", "message"), 5).alias("product"))


@query(
    f"""WITH {_V}, n AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY vec_id) - 1 AS spot, count(*) OVER (PARTITION BY bag) AS n FROM v),
g AS (SELECT bag, x, ((8 - n % 8) % 8)::BIGINT AS padding, spot, n FROM n), s AS (SELECT bag, x, padding, ((spot + padding) // ((n + padding) // 8))::INT AS segment, (n + padding) // 8 AS length FROM g)
SELECT bag, segment, padding, round(sum(list_sum(x)) / any_value(length), 6) AS total FROM s GROUP BY 1, 2, 3"""
)
def landmark_means(spark, sf_dir):
    """Means of eight segments of each bag, in the order of ids, padded in front."""
    from ..functions import vectors as vec
    from ..operators import attention

    rows = bag_rows(spark, sf_dir)
    found = attention.landmarks(rows.select("bag", "vec_id", F.col("x").alias("q"), F.col("x").alias("k")), 8)
    return found.select("bag", "segment", "padding", F.round(vec.total("q"), 6).alias("total"))


@query()
def nystrom_attention(spark, sf_dir):
    """(bag, vec_id, total): attention of every row to its bag through 16 landmarks."""
    from ..functions import vectors as vec
    from ..operators import attention

    rows = bag_rows(spark, sf_dir).select("bag", "vec_id", F.transform("x", lambda v: v * 0.125).alias("q"), F.col("x").alias("k"), F.col("x").alias("v"))
    return attention.nystrom_attention(rows, 16).select("bag", "vec_id", F.round(vec.total("out"), 6).alias("total"))


@query(
    f"""WITH {_V}, d AS (SELECT *, (row_number() OVER (PARTITION BY bag ORDER BY md5('42|' || bag || '|' || vec_id), vec_id) - 1) % 4 AS part, list_sum(x) / 64 AS score FROM v),
y AS (SELECT *, exp(score - max(score) OVER g) AS e FROM d WINDOW g AS (PARTITION BY bag, part)),
c AS (SELECT *, round(e / sum(e) OVER (PARTITION BY bag, part) * list_sum(x[1:32]), 9) AS c FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY bag, part ORDER BY c DESC, vec_id) AS top, row_number() OVER (PARTITION BY bag, part ORDER BY c, vec_id) AS bottom FROM c),
f AS (SELECT bag, x FROM r WHERE top <= 2 UNION ALL SELECT bag, x FROM r WHERE bottom <= 2)
SELECT bag, round(sum(exp(list_sum(x[1:32])) * list_sum(x)) / sum(exp(list_sum(x[1:32]))), 5) AS total, count(*) AS n FROM f GROUP BY 1"""
)
def two_level_pool(spark, sf_dir):
    """Four pseudo-groups of each bag, the two rows of most and of least part of each, pooled again; the class looks at the first half."""
    from ..functions import vectors as vec
    from ..operators import attention

    rows = attention.pseudo_groups(bag_rows(spark, sf_dir), 4).withColumn("score", vec.total("x") / 64)
    found = attention.two_level_pool(rows, "score", [1.0] * 32 + [0.0] * 32, 2)
    return found.select("bag", F.round(vec.total("pooled"), 5).alias("total"), "n")


def _selected_rows(spark, sf_dir):
    """Bags with the label as cluster, every fourth row selected."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("cluster"))
    return bag_rows(spark, sf_dir).join(rows, "vec_id").withColumn("selected", F.col("vec_id") % 4 == 0)


def _swap_sql(k: int, only: str = "") -> str:
    """The selection s{k + 1} after a step from s{k} in the clusters ``only``, and its swaps w{k}."""
    return f"""q{k} AS (SELECT a.bag, a.vec_id, a.cluster, a.vec_id IN (SELECT vec_id FROM s{k}) AS selected, b.cluster = a.cluster AS same, list_distance(a.x, b.x) AS d FROM r a JOIN (SELECT r.* FROM r JOIN s{k} USING (vec_id)) b ON a.bag = b.bag AND a.vec_id <> b.vec_id),
m{k} AS (SELECT bag, vec_id, cluster, selected, round(coalesce(avg(d) FILTER (WHERE same), 0) - coalesce(avg(d) FILTER (WHERE NOT same), 0), 9) AS score FROM q{k} GROUP BY ALL),
w{k} AS (SELECT * FROM (SELECT bag, cluster, arg_min(vec_id, (score, vec_id)) FILTER (WHERE selected) AS out_id, min(score) FILTER (WHERE selected) AS lo, arg_max(vec_id, (score, -vec_id)) FILTER (WHERE NOT selected) AS in_id, max(score) FILTER (WHERE NOT selected) AS hi FROM m{k} GROUP BY 1, 2) WHERE hi - lo > 1e-9 {only}),
s{k + 1} AS (SELECT vec_id FROM s{k} WHERE vec_id NOT IN (SELECT out_id FROM w{k}) UNION ALL SELECT in_id FROM w{k})"""


_R = "r AS (SELECT floor(sqrt(label))::INT AS bag, label::INT AS cluster, vec_id, embedding::DOUBLE[] AS x FROM embeddings), s0 AS (SELECT vec_id FROM r WHERE vec_id % 4 = 0)"
_CHUNKS = "h AS (SELECT *, floor((row_number() OVER (PARTITION BY bag ORDER BY md5('42|0|' || cluster), cluster) - 1) / ceil(count(*) OVER (PARTITION BY bag) / 2)) AS chunk FROM (SELECT DISTINCT bag, cluster FROM r))"


@query(f"WITH {_R}, {_swap_sql(0)}, {_swap_sql(1, 'AND cluster IN (SELECT cluster FROM w0)')} SELECT bag, vec_id FROM s2 JOIN r USING (vec_id)")
def bag_swaps(spark, sf_dir):
    """The selection of every bag after two parallel passes, the second on the clusters that swapped in the first."""
    after, _ = upkeep.refined(_selected_rows(spark, sf_dir), upkeep.Passes(active=True))
    return after.where("selected").select("bag", "vec_id")


@query(f"""WITH {_R}, {_CHUNKS}, {_swap_sql(0, 'AND cluster IN (SELECT cluster FROM h WHERE chunk = 0)')}, {_swap_sql(1, 'AND cluster IN (SELECT cluster FROM h WHERE chunk = 1)')}, z AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1)
SELECT bag, cluster, out_id, in_id, round(hi - lo, 6) AS delta FROM z""")
def bag_swap_chunks(spark, sf_dir):
    """The swaps of a pass over the clusters of every bag in two chunks, the second on what the first left."""
    _, swaps = upkeep.refined(_selected_rows(spark, sf_dir), upkeep.Passes(passes=1, chunks=2))
    return swaps.withColumn("delta", F.round("delta", 6))


_PAIRS = "SELECT a.bag, a.vec_id, sum(list_distance(a.x, b.x)) AS total, avg(list_distance(a.x, b.x)) AS mean FROM {0} a JOIN {1} b ON a.bag = b.bag GROUP BY 1, 2"


@query(
    f"""WITH {_R}, f AS (SELECT bag, min(cluster) AS first FROM r GROUP BY 1),
n AS (SELECT bag, list(m ORDER BY d) AS mean FROM (SELECT bag, d, avg(value) AS m FROM (SELECT r.bag, unnest(x) AS value, unnest(range(1, len(x) + 1)) AS d FROM r JOIN f USING (bag) WHERE cluster = first) GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT r.*, vec_id IN (SELECT vec_id FROM s0) AS selected, cluster = first AS own, round({sq('x', 'mean')}, 9) AS far FROM r JOIN f USING (bag) JOIN n USING (bag)),
i AS (SELECT * FROM t WHERE selected AND own), o AS (SELECT * FROM t WHERE selected AND NOT own),
c AS (SELECT *, row_number() OVER (PARTITION BY bag, own ORDER BY far, vec_id) AS near FROM t WHERE NOT selected),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY far, vec_id) AS place FROM c WHERE own OR near <= 5) WHERE place <= 20),
io AS ({_PAIRS.format('i', 'o')}), iu AS ({_PAIRS.format('i', 'u')}), ii AS ({_PAIRS.format('i', 'i')}),
uo AS ({_PAIRS.format('u', 'o')}), uu AS ({_PAIRS.format('u', 'u')}), ui AS ({_PAIRS.format('u', 'i')}), m AS (SELECT bag, count(*) AS m FROM u GROUP BY 1),
l AS (SELECT bag, vec_id, x, io.mean + (ii.total - iu.total) / m AS leaving FROM i JOIN io USING (bag, vec_id) JOIN iu USING (bag, vec_id) JOIN ii USING (bag, vec_id) JOIN m USING (bag)),
e AS (SELECT bag, vec_id, x, m, uo.mean - (uu.total - ui.total) / m AS entering FROM u JOIN uo USING (bag, vec_id) JOIN uu USING (bag, vec_id) JOIN ui USING (bag, vec_id) JOIN m USING (bag)),
p AS (SELECT l.bag, l.vec_id AS out_id, e.vec_id AS in_id, round(entering - leaving - 2 * list_distance(l.x, e.x) / m, 9) AS delta FROM l JOIN e ON l.bag = e.bag)
SELECT bag, out_id, in_id FROM (SELECT bag, arg_min(out_id, (delta, out_id, in_id)) AS out_id, arg_min(in_id, (delta, out_id, in_id)) AS in_id, min(delta) AS delta FROM p GROUP BY 1) WHERE delta < -1e-9"""
)
def bag_swap_nearest(spark, sf_dir):
    """The sequential swap in the first cluster of every bag, from the 20 rows nearest to its mean, 5 of other clusters among them."""
    rows = _selected_rows(spark, sf_dir)
    first = rows.groupBy("bag").agg(F.min("cluster").alias("cluster"))
    after = refine.sequential_refine(rows, 1, only=first, cross=5, nearest=20).select("bag", "vec_id", F.col("selected").alias("now"))
    changed = rows.join(after, ["bag", "vec_id"]).where("selected <> now").groupBy("bag")
    return changed.agg(F.max(F.when(F.col("selected"), F.col("vec_id"))).alias("out_id"), F.max(F.when(F.col("now"), F.col("vec_id"))).alias("in_id"))


@query()
def bag_swap_sampled(spark, sf_dir):
    """The selection of every bag after two sequential passes against samples of 40 selected rows, tight clusters left out."""
    after = refine.sequential_refine(_selected_rows(spark, sf_dir), 2, sample=40, skip=0.5, active=True)
    return after.where("selected").select("bag", "vec_id")


@query(
    """WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS value, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings), m AS (SELECT label, d, avg(value) AS m FROM e GROUP BY 1, 2)
SELECT label::INT AS bag, round(sum(m * m), 6) AS energy FROM m GROUP BY 1"""
)
def cached_means(spark, sf_dir):
    """The energy of each bag's mean, of which every other bag's was kept by an earlier run."""
    from ..functions.vectors import mean_vector
    from ..sources.results import BagResults
    from ..sources.tables import shared_dir

    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("bag"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    energy = F.aggregate("mean", F.lit(0.0), lambda a, v: a + v * v)
    kept = BagResults(spark, f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}", "means", {})
    compute = lambda some: some.groupBy("bag").agg(mean_vector("x").alias("mean")).select("bag", F.round(energy, 6).alias("energy"))
    kept.of(rows.where("bag % 2 = 0"), compute)
    return kept.of(rows, compute)
