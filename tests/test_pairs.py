"""Pairs met by blocks against whole matrices, with several blocks, copies, a very common vector and null vectors."""

import numpy as np
import pytest

from bagsieve.operators import cluster, metrics, pairs, relations


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 7)


def _sets():
    rng = np.random.default_rng(5)
    out = {}
    for name, n in (("u", 40), ("v", 9), ("w", 1)):
        x = rng.normal(size=(n, 4)) * 100
        x[3:12] = x[:1]  # copies, in several blocks
        x[-1] += 1e-7
        out[name] = x
    return out


def _rows(spark):
    data = [(k, i, x.tolist()) for k, xs in _sets().items() for i, x in enumerate(xs)]
    return spark.createDataFrame(data + [("v", 99, None)], "cluster string, vec_id long, x array<double>")


def _far(x):
    return np.sqrt(np.square(x[:, None] - x[None]).sum(2))


def test_table_has_every_pair_once(spark):
    got = pairs.table(_rows(spark), "cluster", pairs.l2, ("d", "d2")).collect()
    sets = _sets()
    assert len(got) == len({(r.cluster, r.a, r.b) for r in got}) == 40 * 39 // 2 + 10 * 9 // 2
    for r in got:
        assert r.a < r.b
        if r.b == 99:
            assert r.d is None and r.d2 is None
        else:
            want = _far(sets[r.cluster])[r.a, r.b]
            assert np.allclose([r.d, r.d2], [round(want, 6), round(want * want, 6)], atol=1.1e-6)


@pytest.mark.parametrize("name", ["cosine", "hybrid", "gram"])
def test_measures(spark, name):
    x = _sets()["u"] / 100
    far = 1 - (x @ x.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1))
    measure, want = {"cosine": (pairs.cosine(), far), "hybrid": (pairs.hybrid(0.7), 1.7 * far), "gram": (pairs.gram(), _far(x))}[name]
    rows = spark.createDataFrame([("u", i, v.tolist()) for i, v in enumerate(x)], "cluster string, vec_id long, x array<double>")
    for r in pairs.table(rows, "cluster", measure, ("d",)).collect():
        assert abs(r.d - want[r.a, r.b]) < 3e-6


def test_pairs_are_no_records(spark):
    """Only blocks meet: no join makes a row for two rows."""
    rows = _rows(spark)
    for found in (cluster.exact_medoids(rows), cluster.local_density(rows)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "zip_with" not in plan


def test_medoid_and_density(spark):
    costs = {r.cluster: r for r in cluster.exact_medoids(_rows(spark)).collect()}
    near = {(r.cluster, r.vec_id): r.density for r in cluster.local_density(_rows(spark), 5).collect()}
    assert len(near) == 49
    for name, x in _sets().items():
        far = _far(x)
        cost = np.round(far.sum(1), 9)
        assert np.isclose(costs[name].cost, cost.min(), atol=1e-7) and np.isclose(cost[costs[name].vec_id], cost.min(), atol=1e-7)
        for i in range(len(x) if len(x) > 1 else 0):
            assert np.isclose(near[name, i], np.sort(np.delete(far[i], i))[:5].mean(), atol=1e-9)


def test_batches(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(30, 3)), rng.normal(size=(30, 5))
    rows = spark.createDataFrame([(1, i, a[i].tolist(), b[i].tolist()) for i in range(30)], "k int, vec_id long, xa array<double>, xb array<double>")
    apart = ~np.eye(30, dtype=bool)
    assert np.isclose(metrics.pairwise_mse(rows, "k").first().mse, np.square(_far(a) - _far(b))[apart].mean())

    def soft(x):
        e = np.where(apart, x @ x.T / 4.0, -np.inf)
        return e - np.log(np.exp(e).sum(1))[:, None]

    t, s = soft(a), soft(b)
    want = (np.exp(t) * np.where(apart, t - np.where(apart, s, 0), 0)).sum(1).mean() * 16
    assert np.isclose(metrics.relation_kl(rows, "k").first().kl, want)
    assert np.isclose(relations.structure_loss(rows, "k", (4.0,), distance=False, scaled=False).first().structure, want)


def test_kernels_hold_tiles(monkeypatch):
    """Neighbours and lightest edges by tiles and products are those of whole matrices, with ties and copies."""
    from bagsieve.operators import attention, density

    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 3, (30, 3)) / 7.0, rng.integers(0, 3, (50, 3)) / 7.0
    logit = np.round(x @ y.T * 0.5, 9)
    first = np.argsort(-logit, axis=1, kind="stable")[:, :6]
    got, places = attention.largest(x, y, 6, 0.5)
    assert (places == first).all() and (got == np.take_along_axis(logit, first, 1)).all()
    x[4, 0] = np.nan
    assert (attention.largest(x, y, 6, 0.5)[1] == np.argsort(-np.round(x @ y.T * 0.5, 9), axis=1, kind="stable")[:, :6]).all()
    x[4, 0] = 0.0
    core, core_ = rng.integers(0, 3, 30) / 9.0, rng.integers(0, 3, 50) / 9.0
    part, part_ = rng.integers(0, 3, 30), rng.integers(0, 2, 50)
    w = np.round(np.maximum(np.maximum(np.sqrt(np.square(x[:, None] - y[None]).sum(2)), core[:, None]), core_), 9)
    w[part[:, None] == part_] = np.inf
    low, j = density.lightest_of(x, y, core, core_, part, part_)
    assert (low == w.min(1)).all() and (j == w.argmin(1)).all()
    assert max(p.stop - p.start for p in pairs.tiles(8192, 8192)) * 8192 <= pairs.TILE


def test_swaps_take_distances_from_products():
    """Sums of distances of two blocks need no loop over rows, and copies are at distance 0."""
    import inspect

    from bagsieve.operators import kernels, refine

    assert all("pairwise" not in inspect.getsource(f) for f in (refine.block_sums, refine.nearest_free))
    x = _sets()["u"]
    got = np.sqrt(pairs.squared(x, x))
    assert np.allclose(got, kernels.pairwise(x, x), rtol=1e-12, atol=1e-12) and (got[3:12, 3:12] == 0).all()


def test_blocks_meet_once_by_slots(spark):
    """Every two blocks of a bag meet once; a bag of many blocks has eight slots, so that each block is copied nine times, not once for each other."""
    from pyspark.sql import functions as F

    n = {1: 64, 2: 13, 3: 1}
    blocks = spark.createDataFrame([(bag, m, b, [b]) for bag, m in n.items() for b in range(m)], "bag int, n int, block int, own array<int>")
    met = [tuple(r) for r in pairs.twice(blocks).select("bag", "block", "to", F.col("own")[0], F.col("other")[0]).collect()]
    assert sorted(met) == [(bag, i, j, i, j) for bag, m in n.items() for i in range(m) for j in range(i, m)]
    last = {r.bag: r.last for r in pairs.slotted(blocks).groupBy("bag").agg(F.max("_last").alias("last")).collect()}
    assert last == {1: 7, 2: 6, 3: 0}
    assert pairs.slotted(blocks, 2).agg(F.max("_last")).first()[0] == 31
