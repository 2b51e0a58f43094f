"""Density clustering against brute force: all distances, all thresholds, no spanning tree."""

import numpy as np
import pytest

from bagsieve.operators import bagwise, density


def _reach(x, k):
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(2))
    core = np.sort(d, 1)[:, min(k, len(x)) - 1]
    return np.maximum(np.round(np.maximum(np.maximum(d, core[:, None]), core[None]), 9), 1e-9)


def _parts(reach, some, below):
    """Components of the rows ``some`` over edges lighter than ``below``."""
    some, out = set(some), []
    while some:
        part, todo = set(), [min(some)]
        while todo:
            p = todo.pop()
            if p in part:
                continue
            part.add(p)
            todo += [q for q in some if q not in part and q != p and reach[p, q] < below]
        out.append(sorted(part))
        some -= part
    return out


def _brute(x, least, k):
    """(cluster, confidence) of every row: clusters shrink as the threshold falls from one weight to the next."""
    reach, n = _reach(x, k), len(x)
    found = []  # parent, rows that leave: {row: 1 / weight}, stability, rows

    def grow(rows, parent, birth):
        me = len(found)
        found.append([parent, {}, 0.0, rows])
        left, now = {}, rows
        while True:
            inner = reach[np.ix_(now, now)] + np.where(np.eye(len(now)) > 0, np.inf, 0)
            parts, cuts = [now], sorted({float(v) for v in inner[np.isfinite(inner)]}, reverse=True)
            for cut in cuts:
                parts = _parts(reach, now, cut)
                if len(parts) > 1:
                    break
            if len(parts) == 1:
                return
            lam = 1.0 / cut
            big = [p for p in parts if len(p) >= least]
            found[me][2] += sum(len(p) for p in parts if len(big) != 1 or p not in big) * (lam - birth)
            found[me][1].update({r: lam for p in parts if p not in big for r in p})
            found[me].append(lam)
            if len(big) == 1:
                # those that go on have been there up to here, too, and are counted when they leave
                now = big[0]
                continue
            for p in big:
                grow(p, me, lam)
            return

    grow(list(range(n)), -1, 0.0)
    return reach, found




def _labels(x, least, k):
    _, found = _brute(x, least, k)
    kids = {}
    for c, (p, *_) in enumerate(found):
        kids.setdefault(p, []).append(c)
    birth = {0: 0.0}
    for c in range(1, len(found)):
        birth[c] = max(found[found[c][0]][4:])
    # a row's share: where it leaves the cluster, less where that began
    score = {}
    for c, (p, gone, _, rows, *lams) in enumerate(found):
        inner = {r for q in kids.get(c, ()) for r in found[q][3]}
        score[c] = sum((gone[r] if r in gone else min(lams, default=0) if r not in inner else birth[kids[c][0]]) - birth[c] for r in rows)
    best, chosen = {}, {}

    def pick(c):
        below = sum(pick(q) for q in kids.get(c, ()))
        chosen[c] = c > 0 and not below > score[c]
        best[c] = max(score[c], below) if c else below
        return best[c]

    pick(0)
    out, sure = np.full(len(x), -1), np.zeros(len(x))

    def leave(r, c):
        while True:
            if r in found[c][1]:
                return found[c][1][r]
            c = next(q for q in kids[c] if r in found[q][3])

    def walk(c):
        if chosen[c]:
            for r in found[c][3]:
                out[r] = c
                sure[r] = min(leave(r, c), max(found[c][4:])) / max(found[c][4:])
        else:
            for q in kids.get(c, ()):
                walk(q)

    walk(0)
    first = {}
    for c in out[out >= 0].tolist():
        first.setdefault(c, len(first))
    return [first.get(c, -1) for c in out.tolist()], sure


def _tree(x, k):
    """A spanning tree of the mutual reachability, by adding the nearest row."""
    reach = _reach(x, k)
    inside, edges = [0], []
    while len(inside) < len(x):
        out = [r for r in range(len(x)) if r not in set(inside)]
        part = reach[np.ix_(inside, out)]
        i, j = np.unravel_index(part.argmin(), part.shape)
        edges.append((part[i, j], inside[i], out[j]))
        inside.append(out[j])
    return [np.array(v) for v in zip(*edges)]


def _blobs(seed, sizes, spread=0.3, noise=6, d=3):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=(n, d)) * spread + rng.normal(size=d) * 4 for n in sizes]
    return np.concatenate([*x, rng.uniform(-12, 12, (noise, d))])


@pytest.mark.parametrize("seed,least,k", [(1, 5, 2), (2, 4, 3), (3, 8, 4), (4, 3, 1), (5, 2, 1), (6, 12, 6)])
def test_hierarchy(seed, least, k):
    x = _blobs(seed, [14, 25, 9, 11])
    ids, cluster, sure = density.hierarchy(*_tree(x, k), least)
    want, sure_ = _labels(x, least, k)
    assert ids.tolist() == list(range(len(x))) and cluster.tolist() == want
    assert np.allclose(sure, sure_)
    assert cluster.max() >= 1


@pytest.fixture(scope="module")
def bags():
    return {"a": _blobs(7, [160, 150, 120], noise=70), "b": _blobs(8, [12, 15]), "c": np.zeros((9, 3)), "d": np.ones((1, 3))}


@pytest.fixture(scope="module")
def rows(spark, bags):
    return spark.createDataFrame([(b, k, [float(v) for v in row]) for b, x in bags.items() for k, row in enumerate(x)], "bag string, vec_id long, x array<double>").repartition(3)


def test_clusters_of_bags(spark, bags, rows):
    blocks = bagwise.block(rows, 3 * 8 * 60)
    assert blocks.packed.where("bag = 'a'").count() > 4
    params = spark.createDataFrame([("a", 15, 7), ("b", 4, 2), ("c", 3, 2), ("d", 2, 1)], "bag string, least int, k int")
    got = {}
    for r in density.density_clusters(rows, blocks, params).collect():
        got.setdefault(r.bag, {})[r.vec_id] = r
    for b, least, k in (("a", 15, 7), ("b", 4, 2)):
        x = bags[b]
        want = density.hierarchy(*_tree(x, k), least) if len(x) > 100 else (None, *_labels(x, least, k))
        assert [got[b][j].cluster for j in range(len(x))] == list(want[1])
        assert np.allclose([got[b][j].confidence for j in range(len(x))], want[2])
    assert {r.cluster for r in got["d"].values()} == {-1} and len(got["c"]) == 9


def test_forest_is_lightest(spark, bags, rows):
    blocks = bagwise.block(rows, 3 * 8 * 60)
    params = spark.createDataFrame([("a", 7), ("b", 2), ("c", 2), ("d", 1)], "bag string, k int")
    edges = density.spanning_forest(blocks, density.core_distances(blocks, params)).toPandas()
    for b, k in (("a", 7), ("b", 2), ("c", 2)):
        own = edges[edges.bag == b]
        assert len(own) == len(bags[b]) - 1
        assert np.allclose(np.maximum(own.w.to_numpy(), 1e-9).sum(), _tree(bags[b], k)[0].sum())


def test_sample(rows, bags):
    got = {}
    for r in density.density_sample(rows, 0.1).collect():
        got.setdefault(r.bag, []).append((r.vec_id, r.how))
    assert {b: len(v) for b, v in got.items()} == {b: max(1, round(len(x) * 0.1)) for b, x in bags.items()}
    assert all(len({v for v, _ in rows_}) == len(rows_) for rows_ in got.values())
    assert {how for _, how in got["a"]} <= {"cluster", "filled"} and {how for _, how in got["d"]} == {"all"}
    assert {how for _, how in got["c"]} & {"kmeans", "cluster"}
    by_means = density.density_sample(rows, 0.1, by="kmeans").collect()
    assert len(by_means) == sum(map(len, got.values())) == len({(r.bag, r.vec_id) for r in by_means})
    assert {r.how for r in by_means} <= {"kmeans", "filled", "all"}
    with pytest.raises(ValueError):
        density.density_sample(rows, 0.1, by="luck")


def test_least_of_parts():
    """The least of each row, from parts of either side, are those of the whole matrix."""
    rng = np.random.default_rng(2)
    d, ids = rng.random((70, 900)), rng.permutation(900)
    for axis in (0, 1):
        found = density._Least(70, 5)
        for cut in np.split(np.arange(900), [3, 40, 300, 500, 501]):
            found.add(d[:, cut] if axis else np.ascontiguousarray(d[:, cut].T), ids[cut], axis)
        found.lists()
        first = np.argsort(d, axis=1)[:, :5]
        assert (found.values == np.take_along_axis(d, first, 1)).all() and (found.ids == ids[first]).all()


def test_both_sides_from_one_product(monkeypatch):
    """The lightest edges of both sides of two blocks are those of either side by itself, with ties and tiles."""
    monkeypatch.setattr(density.pairs, "TILE", 200)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, (40, 3)) / 7.0, rng.integers(0, 3, (50, 3)) / 7.0
    core, core_, part, part_ = rng.integers(0, 3, 40) / 9.0, rng.integers(0, 3, 50) / 9.0, rng.integers(0, 3, 40), rng.integers(0, 2, 50)
    for got, want in zip(density.lightest_both(x, y, core, core_, part, part_), (density.lightest_of(x, y, core, core_, part, part_), density.lightest_of(y, x, core_, core, part_, part))):
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_rounds_of_the_forest_ask_few(spark, monkeypatch):
    """Rows join a denser neighbour without a round, and a round doesn't ask a bag's largest component, so few rounds are left."""
    x = _blobs(5, (60, 50))
    rows = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "bag int, vec_id long, x array<double>")
    params = spark.createDataFrame([(1, 5)], "bag int, k int")
    plain, names = density.written, []
    monkeypatch.setattr(density, "written", lambda df, name: names.append(name) or plain(df, name))
    for narrow in (1 << 20, 0):
        monkeypatch.setattr(bagwise, "NARROW_BYTES", narrow)
        names.clear()
        blocks = bagwise.block(rows, 8 * 3 * 20)
        core = plain(density.core_distances(blocks, params), "core")
        edges = density.spanning_forest(blocks, core).toPandas()
        w, _, _ = _tree(x, 5)
        assert np.allclose(np.sort(edges["w"]), np.sort(w), atol=1e-9) and len(edges) == len(x) - 1
        assert names.count("lightest") <= 3
