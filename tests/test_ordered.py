"""Clusters taken in their order by chunks, against one task that holds the bag."""

import numpy as np
import pytest

from bagsieve.operators import fill, kernels, ordered, pairs, refine


def _rows(spark, n=160, clusters=9, seed=3):
    rng = np.random.default_rng(seed)
    x, labels, chosen = rng.normal(size=(2 * n, 5)), rng.integers(0, clusters, 2 * n), rng.random(2 * n) < 0.3
    x[7] = x[3]
    bags = [i // n for i in range(2 * n)]
    rows = [(bags[i], i, int(labels[i]), x[i].tolist(), bool(chosen[i]), bool(chosen[i] and i % 3 == 0)) for i in range(2 * n)]
    return spark.createDataFrame(rows, "bag int, vec_id long, cluster int, x array<double>, selected boolean, is_seed boolean"), x, labels, chosen, np.array(bags)


@pytest.fixture
def small(monkeypatch):
    """Small blocks and chunks, and groups of at most 70 rows: no bag fits a task."""
    monkeypatch.setattr(ordered, "CHUNK", 40)
    monkeypatch.setattr(ordered, "SLOT", 2)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 16)
    monkeypatch.setattr(fill, "GROUP_BYTES", 70 * 5 * 8)


@pytest.mark.parametrize("how", [{"chain": True}, {"sign": 1}, {"sample": 12, "skip": 0.97, "active": True}])
def test_sequential_refine_of_a_bag_beyond_a_task(spark, small, how):
    rows, x, labels, chosen, bags = _rows(spark)
    got = {r[0] for r in refine.sequential_refine(rows, 2, **how).where("selected").select("vec_id").collect()}
    want = set()
    for b in (0, 1):
        at = np.flatnonzero(bags == b)
        after = kernels.sequential_swaps(x[at], labels[at], chosen[at], 2, **how)
        want |= set(at[after].tolist())
    assert want != set(np.flatnonzero(chosen).tolist())
    assert got == want


@pytest.mark.parametrize("how", [{}, {"metric": "cosine"}, {"metric": "hybrid", "alpha": 0.4, "beta": 0.6}, {"mode": "facility_location"}])
@pytest.mark.parametrize("seeded", [True, False])
def test_fill_of_a_bag_beyond_a_task(spark, small, monkeypatch, how, seeded):
    rows = _rows(spark)[0].selectExpr("bag", "vec_id", "cluster", "x", f"is_seed AND {str(seeded).lower()} AS is_seed", "cluster % 4 AS quota")
    got = sorted(map(tuple, fill.fill_bag(rows, **how).collect()))
    monkeypatch.setattr(fill, "GROUP_BYTES", 1 << 30)
    assert got == sorted(map(tuple, fill.fill_bag(rows, cap=1 << 30, **how).collect()))
    assert got


def test_best_pair_is_that_of_all_pairs():
    rng = np.random.default_rng(5)
    for sign in (-1, 1):
        for n in (3, 40, 600):
            inside, outside, others = rng.normal(size=(n // 3 + 1, 4)), rng.normal(size=(n, 4)), rng.normal(size=(9, 4)) + 1
            want = kernels.best_swap(inside, outside, others, sign)
            sums = lambda a, b: kernels.pairwise(a, b).sum(1)
            leaving = sums(inside, others) / 9 + (sums(inside, inside) - sums(inside, outside)) / n
            entering = sums(outside, others) / 9 - (sums(outside, outside) - sums(outside, inside)) / n
            assert kernels.best_pair(inside, outside, leaving, entering, sign) == (want and want[1:])


def test_grid_deals_bags_by_the_number_of_rows(spark, monkeypatch):
    from bagsieve.operators import sample

    rows = spark.range(900).selectExpr("id % 30 AS bag", "id AS vec_id", "double(id * 37 % 101) AS px", "double(id * 53 % 97) AS py")
    want = sorted(map(tuple, sample.grid(rows, 0.3).collect()))
    monkeypatch.setattr(sample, "TASK_ROWS", 90)
    assert sample._dealt(rows).rdd.getNumPartitions() == 10
    assert sorted(map(tuple, sample.grid(rows, 0.3).collect())) == want


@pytest.mark.parametrize("seeded", [True, False])
def test_facility_location_of_large_clusters_by_rounds(spark, small, monkeypatch, seeded):
    rows = _rows(spark, clusters=2)[0].selectExpr("bag", "vec_id", "cluster", "x", f"is_seed AND {str(seeded).lower()} AS is_seed", "3 - cluster AS quota")
    monkeypatch.setattr(fill, "WHOLE", 20)
    monkeypatch.setattr(fill, "BATCH", 4)
    got = sorted(map(tuple, fill.fill_clusters(rows, "facility_location").collect()))
    monkeypatch.setattr(fill, "WHOLE", 1 << 30)
    monkeypatch.setattr(fill, "GROUP_BYTES", 1 << 30)
    assert got == sorted(map(tuple, fill.fill_clusters(rows, "facility_location").collect()))
    assert len(got) == 10
