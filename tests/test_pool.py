"""Pooling, projections and lookups against numpy and small cases."""

import numpy as np
import pytest

from bagsieve.operators import metrics, pool, sample
from bagsieve.sources import bags


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(3).standard_normal((40, 5))
    return x, spark.createDataFrame([(k % 3, k, [float(v) for v in row]) for k, row in enumerate(x)], "bag int, vec_id long, x array<double>")


def test_components_of_a_named_bag(vectors):
    x, rows = vectors
    own = np.stack([x[np.arange(40) % 3 == b].mean(0) for b in range(3)])[np.arange(40) % 3]
    centred = x - own
    _, _, basis = np.linalg.svd(centred[np.arange(40) % 3 == 1], full_matrices=False)
    found = {r.vec_id: r.p for r in pool.bag_components(rows, 1, 2).collect()}
    assert np.allclose(np.abs([found[k] for k in range(40)]), np.abs(centred @ basis[:2].T), atol=1e-8)


def test_padding_fills_squares(spark, vectors):
    sizes = {r.bag: r["count"] for r in pool.square_padded(vectors[1]).groupBy("bag").count().collect()}
    assert sizes == {0: 16, 1: 16, 2: 16}
    assert pool.square_padded(vectors[1].where("false")).count() == 0


def test_linear_cka(spark, vectors):
    x, rows = vectors
    y = np.tanh(x[:, ::-1]) ** 2
    pairs = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, y)], "xa array<double>, xb array<double>").repartition(3)
    a, b = x - x.mean(0), y - y.mean(0)
    want = np.linalg.norm(a.T @ b) ** 2 / (np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b))
    assert metrics.linear_cka(pairs).first().cka == pytest.approx(want)


def test_lookups(spark):
    wanted = spark.createDataFrame([("a", "x/a.pt"), ("b", "x/b.pt"), ("c", "x/c.pt"), ("d", "x/d.pt")], "bag string, relative string")
    files = spark.createDataFrame([("x/a.pt",), ("y/a.pt",), ("y/b.pt",), ("y/c.pt",), ("z/c.pt",)], "path string")
    assert {r.bag: r.path for r in bags.resolve(wanted, files).collect()} == {"a": "x/a.pt", "b": "y/b.pt", "c": None, "d": None}
    assert bags.resolved(wanted.where("bag < 'c'"), files).count() == 2
    with pytest.raises(Exception, match="files and none by its path"):
        bags.resolved(wanted, files).collect()


def test_modes():
    assert [sample.mode_name(m) for m in ("grid", "custom-inverse", "random")] == ["geometric", "custom_inverse", "random"]
    with pytest.raises(ValueError):
        sample.one_encoder(None, "grid")
