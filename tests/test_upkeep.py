"""Swaps with sums kept up to date: the same as with all sums made anew, for every bag."""

import hashlib

import numpy as np
import pytest

from bagsieve.operators import upkeep
from bagsieve.operators.upkeep import Passes

SIZES = {"a": (150, 6), "b": (41, 3), "c": (9, 4), "d": (2, 1)}


@pytest.fixture(scope="module")
def bags():
    rng = np.random.default_rng(11)
    found = {}
    for bag, (n, k) in SIZES.items():
        labels = rng.integers(0, k, n)
        found[bag] = rng.normal(size=(n, 4)) + 2.0 * labels[:, None], labels, rng.random(n) < 0.3
    found["a"][2][found["a"][1] == 5] = False  # a cluster without selected rows
    found["a"][2][found["a"][1] == 4] = True  # one of selected rows only
    found["b"][0][:20] = found["b"][0][20:40]  # rows that repeat
    return found


@pytest.fixture(scope="module")
def rows(spark, bags):
    data = [(b, k, int(c), [float(v) for v in x[k]], bool(s[k]), bool(s[k]) and k % 2 == 0) for b, (x, labels, s) in bags.items() for k, c in enumerate(labels)]
    return spark.createDataFrame(data, "bag string, vec_id long, cluster int, x array<double>, selected boolean, is_seed boolean").repartition(4)


def _scores(x, labels, chosen, how):
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(-1))
    size = {c: int((labels == c).sum()) for c in set(labels)}
    w = np.ones(len(x))
    if how.weight == "cluster_size":
        w = np.array([1 / np.sqrt(size[c]) for c in labels])
    if how.weight == "uncertainty":
        w = np.array([1 / max(np.linalg.norm(x[i] - x[labels == labels[i]].mean(0)), 1e-4) for i in range(len(x))])

    def margins(w):
        out = []
        for i in range(len(x)):
            far, own = chosen & (labels != labels[i]), chosen & (labels == labels[i])
            own[i] = False
            out.append(sum((1, -1)[k] * (d[i, s] * w[s]).sum() / max(w[s].sum(), 1e-8) for k, s in enumerate((far, own))))
        return np.array(out)

    if how.weight == "margin_magnitude":
        w = np.maximum(np.abs(margins(w)), 1e-6)
    score = how.sign * margins(w)
    if how.spread:
        near = [d[i, chosen & (labels != labels[i])] for i in range(len(x))]
        score = score + how.spread * np.array([v.min() if len(v) else 0.0 for v in near])
    return np.round(score, 9)


def _step(x, labels, chosen, only, how):
    score, found = _scores(x, labels, chosen, how), []
    for c in sorted(only):
        inside, outside = np.flatnonzero((labels == c) & chosen), np.flatnonzero((labels == c) & ~chosen)
        if len(inside) and len(outside) and len(inside) + len(outside) >= how.least:
            i, u = inside[score[inside].argmin()], outside[score[outside].argmax()]
            if score[u] - score[i] > 1e-9:
                found.append((c, i, u))
    for _, i, u in found:
        chosen[i], chosen[u] = False, True
    return {c for c, _, _ in found}


def _sweep(x, labels, chosen, only, how, turn):
    if how.chunks == 1:
        return _step(x, labels, chosen, only, how)
    every = sorted(set(labels), key=lambda c: (hashlib.md5(f"{how.seed}|{turn}|{c}".encode()).hexdigest(), c))
    size, changed = -(-len(every) // how.chunks), set()
    for k in range(how.chunks):
        changed |= _step(x, labels, chosen, set(every[k * size : (k + 1) * size]) & set(only), how)
    return changed


def _anew(x, labels, chosen, how):
    chosen, open_ = chosen.copy(), set(labels)
    for p in range(how.passes):
        first = _sweep(x, labels, chosen, open_, how, 2 * p)
        if not first:
            break
        open_ = first if how.active else open_
        if how.second:
            more = _sweep(x, labels, chosen, open_, how, 2 * p + 1)
            if how.active and more and how.chunks == 1:
                open_ = more
    if how.large and how.passes:
        _step(x, labels, chosen, {c for c in set(labels) if (labels == c).sum() >= how.large}, how)
    return chosen


@pytest.mark.parametrize(
    "how",
    [
        Passes(passes=2),
        Passes(passes=2, active=True, second=True, large=20, weight="uncertainty"),
        Passes(passes=1, chunks=3, second=True, sign=1, least=5, weight="cluster_size"),
        Passes(passes=2, chunks=2, active=True, second=True, large=10, sign=1),
        Passes(passes=2, active=True, spread=0.5, weight="margin_magnitude", large=10),
    ],
)
def test_same_swaps_as_anew(rows, bags, how):
    after, swaps = upkeep.refined(rows, how)
    got = {b: set() for b in bags}
    for r in after.where("selected").collect():
        got[r.bag].add(r.vec_id)
    for bag, (x, labels, chosen) in bags.items():
        assert got[bag] == set(np.flatnonzero(_anew(x, labels, chosen, how))), bag
    assert after.columns == rows.columns and after.count() == rows.count()
    assert after.where("is_seed AND NOT selected").count() == 0 and after.where("is_seed").count() == rows.where("is_seed").count()
    assert swaps.where("delta <= 0").count() == 0 and swaps.count() > 0


def test_touched_rows_fall(rows):
    trace = []
    upkeep.refined(rows, Passes(passes=4, sign=1, active=True), trace)
    touched = [n for _, n, _ in trace]
    assert len(touched) > 2 and touched == sorted(touched, reverse=True) and touched[0] > touched[1] > touched[-1]


def test_nothing_to_do(rows):
    none = rows.where("false")
    after, swaps = upkeep.refined(none, Passes())
    assert after.count() == swaps.count() == 0
    after, swaps = upkeep.refined(rows, Passes(passes=0, large=2))
    assert swaps.count() == 0 and after.exceptAll(rows).count() == 0


@pytest.mark.parametrize("bad", [dict(passes=-1), dict(chunks=0), dict(sign=2)])
def test_refuses(bad):
    with pytest.raises(ValueError):
        Passes(**bad)


def test_small_clusters_share_blocks(spark, monkeypatch):
    """Rows of many small clusters meet the selected rows in few blocks, not in one for each cluster."""
    from bagsieve.operators import refine

    rng = np.random.default_rng(3)
    data = [(1, i, i // 4, rng.normal(size=3).tolist(), i % 2 == 0) for i in range(400)]
    rows = spark.createDataFrame(data, "bag int, vec_id long, cluster int, x array<double>, selected boolean")
    plain, met = refine.block_sums, []
    monkeypatch.setattr(refine, "block_sums", lambda m: met.append(m.count()) or plain(m))
    upkeep.refined(rows, upkeep.Passes(passes=1))
    assert met == [1]  # 100 before, one for each cluster
