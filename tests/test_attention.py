"""Attention inside bags against dense numpy."""

import numpy as np
import pytest

from bagsieve.operators import attention


def _soft(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@pytest.fixture(scope="module")
def bags():
    rng = np.random.default_rng(4)
    return {b: {c: rng.normal(size=(n, 5)) for c in "qkvht"} for b, n in ((1, 53), (2, 16), (3, 3), (4, 1))}


@pytest.fixture(scope="module")
def rows(spark, bags):
    data = [(b, k, *([float(v) for v in x[c][k]] for c in "qkvht")) for b, x in bags.items() for k in range(len(x["q"]))]
    return spark.createDataFrame(data, "bag int, vec_id long, q array<double>, k array<double>, v array<double>, head array<double>, tail array<double>").repartition(3)


def _dense(x, m, rounds):
    q, k, v = (np.concatenate([np.zeros((-len(x["q"]) % m, 5)), x[c]]) for c in "qkv")
    q_, k_ = (y.reshape(m, -1, 5).mean(1) for y in (q, k))
    middle = _soft(q_ @ k_.T)
    inner = attention.pseudo_inverse(middle, rounds) if rounds else np.linalg.pinv(middle)
    return (_soft(q @ k_.T) @ inner @ (_soft(q_ @ k.T) @ v))[-len(x["q"]) :]


@pytest.mark.parametrize("m", [4, 16])
def test_nystrom(bags, rows, m):
    got = {}
    for r in attention.nystrom_attention(rows, m, 6, 5 * 8 * 12).collect():
        got.setdefault(r.bag, {})[r.vec_id] = r.out
    for b, x in bags.items():
        assert np.allclose([got[b][k] for k in range(len(x["q"]))], _dense(x, m, 6), atol=1e-9)


def test_nystrom_with_all_rows_as_landmarks_is_plain_attention(bags, rows):
    x = bags[2]
    got = {r.vec_id: r.out for r in attention.nystrom_attention(rows.where("bag = 2"), 16, 40).collect()}
    out = np.array([got[k] for k in range(16)])
    assert np.allclose(out, _dense(x, 16, 0), atol=1e-6)  # the library's pseudo-inverse
    assert np.allclose(out, _soft(x["q"] @ x["k"].T) @ x["v"], atol=1e-6)


def test_pseudo_inverse():
    x = _soft(np.random.default_rng(1).normal(size=(12, 12)))
    assert np.allclose(attention.pseudo_inverse(x, 40), np.linalg.pinv(x), atol=1e-8)


def test_neighbours_and_messages(bags, rows):
    edges = attention.neighbours(rows, 6, 0.5, 5 * 16 * 12)
    near, told = {}, {}
    for e in edges.collect():
        near.setdefault((e.bag, e.vec_id), {})[e.place] = (e.other, e.logit)
    for r in attention.messages(rows, edges).collect():
        told[r.bag, r.vec_id] = r.message
    for b, x in bags.items():
        logit = np.round(x["h"] @ x["t"].T * 0.5, 9)
        for j, own in enumerate(logit):
            order = sorted(range(len(own)), key=lambda c: (-own[c], c))[:6]
            assert [near[b, j][p][0] for p in range(1, len(order) + 1)] == order and len(near[b, j]) == len(order)
            tails = x["t"][order]
            knows = _soft((np.tanh(x["h"][j] + _soft(own[order])[:, None] * tails) * tails).sum(1))
            assert np.allclose(told[b, j], knows @ tails)


@pytest.mark.parametrize("side", ["top", "bottom", "both", "pooled"])
def test_two_level_pool(bags, rows, side):
    weights = [0.5, -1.0, 0.0, 2.0, 0.3]
    dealt = attention.pseudo_groups(rows.withColumnRenamed("q", "x").selectExpr("bag", "vec_id", "x", "x[1] AS score"), 3)
    parts = {(r.bag, r.vec_id): r.part for r in dealt.collect()}
    got = {r.bag: r for r in attention.two_level_pool(dealt, "score", weights, 2, side).collect()}
    for b, x in bags.items():
        chosen = []
        for p in range(3):
            own = [j for j in range(len(x["q"])) if parts[b, j] == p]
            if not own:
                continue
            w = _soft(x["q"][own][:, 1])
            part = np.round(w * (x["q"][own] @ weights), 9)
            if side == "pooled":
                chosen.append(w @ x["q"][own])
                continue
            if side in ("top", "both"):
                chosen += [x["q"][own[c]] for c in sorted(range(len(own)), key=lambda c: (-part[c], c))[:2]]
            if side in ("bottom", "both"):
                chosen += [x["q"][own[c]] for c in sorted(range(len(own)), key=lambda c: (part[c], c))[:2]]
        chosen = np.array(chosen)
        assert got[b].n == len(chosen) and np.allclose(got[b].pooled, _soft(chosen @ weights) @ chosen)
    sizes = np.bincount([p for (b, _), p in parts.items() if b == 1])
    assert sizes.max() - sizes.min() <= 1
    with pytest.raises(ValueError):
        attention.two_level_pool(dealt, "score", weights, 1, "middle")
