"""The recipe over a table of bags: each bag gets what it would get alone, and its budget exactly."""

import numpy as np
import pytest

from bagsieve.operators.bagwise import Medoids
from bagsieve.operators.upkeep import Passes
from bagsieve.plans.sampler import SamplerSpec

SIZES = {"a": 120, "b": 37, "c": 8}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(b, k, [float(v) for v in rng.normal(size=5) + 4 * rng.integers(0, 3)]) for b, n in SIZES.items() for k in range(n)]
    return spark.createDataFrame(data, "bag string, vec_id long, x array<double>").repartition(4)


SPECS = [
    SamplerSpec(ratio=0.25, cluster_ratio=0.06, rounds=2, swaps=2, residual=0.5),
    SamplerSpec(ratio=0.3, cluster_ratio=0.1, rounds=2, starts=2, start_by="dispersion", polish=2, forward=3, swaps=1, residual=0.4, residual_by="proximity", second=0.3, passes=Passes(chunks=2, second=True), sequential={"cross": 3, "nearest": 12, "sample": 20}, late_polish=2, fill="facility_location", allocation="within_var"),
    SamplerSpec(ratio=0.5, cluster_ratio=0.08, medoids=Medoids(rounds=2, strategy="knn_mean_margin", adaptive_size=True, push_mode="density"), metric="hybrid", alpha=0.3, seed_cap=4, swaps=1, residual=0.2, second=0.2, second_mode="recomputed", extras_polish=True),
    SamplerSpec(ratio=0.25, cluster_ratio=0.06, rounds=2, start="farthest", beta=1.0, median=True, swaps=1, residual=0.0, reseed=True),
]


@pytest.mark.parametrize("spec", SPECS)
def test_recipe(rows, spec):
    got = {}
    for r in spec.run(rows).collect():
        got.setdefault(r.bag, []).append((r.vec_id, r.role))
    for bag, n in SIZES.items():
        goal = int(spec.ratio * n)
        assert len(got[bag]) == len({v for v, _ in got[bag]}) == goal
        assert 1 <= sum(role == "core" for _, role in got[bag]) <= max(1, min(int(spec.cluster_ratio * n), goal))
    alone = spec.run(rows.where("bag = 'b'").repartition(1)).collect()
    assert sorted((r.vec_id, r.role) for r in alone) == sorted(got["b"])


def test_one_bag_without_a_name(rows):
    spec = SPECS[3]
    one = spec.run(rows.where("bag = 'c'").drop("bag"))
    assert one.columns == ["vec_id", "role"] and one.count() == 2


@pytest.mark.parametrize("bad", [dict(metric="l3"), dict(start_by="luck"), dict(residual_by="luck"), dict(second_mode="luck"), dict(polish_by="luck"), dict(rounds=0), dict(start="luck"), dict(starts=0)])
def test_refuses(bad):
    with pytest.raises(ValueError):
        SamplerSpec(**bad)
