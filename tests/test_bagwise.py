"""Clustering of all bags at once against plain numpy runs of each bag."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagsieve.operators import bagwise
from bagsieve.operators.bagwise import Medoids

D = 9


def _d2(a, b):
    return np.square(a[:, None] - b[None]).sum(2)


@pytest.fixture(scope="module")
def bags():
    """Bags of unequal size, one with repeated rows, one smaller than a block and one of one row."""
    rng = np.random.default_rng(5)
    out = {1: rng.normal(size=(150, 6)) + rng.integers(0, 4, (150, 1)) * 3.0, 2: rng.normal(size=(31, 6)), 3: np.repeat(rng.normal(size=(5, 6)), 6, 0), 4: rng.normal(size=(1, 6))}
    return {b: (np.arange(len(x)) * 10 + b, x) for b, x in out.items()}


@pytest.fixture(scope="module")
def rows(spark, bags):
    return spark.createDataFrame([(b, int(i), [float(v) for v in x]) for b, (ids, xs) in bags.items() for i, x in zip(ids, xs)], "bag int, vec_id long, x array<double>").repartition(5)


@pytest.fixture(scope="module")
def blocks(rows):
    return bagwise.block(rows, 6 * 8 * 20)


def _first(bags, k, shift=0):
    return {b: [int(ids[(j * 7 + shift) % len(ids)]) for j in range(min(k, len(ids)))] for b, (ids, _) in bags.items()}


def _frame(spark, bags, starts):
    """(bag, start, cluster, vec_id, centre) for a list of starts by bag."""
    at = {b: {int(i): x for i, x in zip(ids, xs)} for b, (ids, xs) in bags.items()}
    rows = [(b, s, c, v, [float(w) for w in at[b][v]]) for s, start in enumerate(starts) for b, ids in start.items() for c, v in enumerate(ids)]
    return spark.createDataFrame(rows, "bag int, start int, cluster int, vec_id long, centre array<double>")


def _assign(x, centres):
    d = np.round(_d2(x, centres), D)
    label = d.argmin(1)
    own = d[np.arange(len(x)), label]
    d[np.arange(len(x)), label] = np.inf
    return label, own, np.where(np.isinf(d.min(1)), 0.0, d.min(1))


def _pick(ids, score):
    return min(range(len(ids)), key=lambda k: (round(float(score[k]), D), ids[k]))


def _shortlist(name, m, o, ids, size, how):
    order = lambda s, some: sorted(some, key=lambda k: (round(float(s[k]), D), ids[k]))
    ratio, every = m / np.maximum(o, 1e-12), range(len(ids))
    if name == "mean":
        return order(m, every)[:size]
    if name == "mean_margin":
        return order(ratio, every)[:size]
    if name == "margin_max":
        return order(m - o, every)[:size]
    wide = order(m, every)[: max(size, min(round(size * how.multiple), len(ids)))]
    second = ratio if name == "knn_mean_ratio" else m - how.weight * o
    return sorted(wide, key=lambda k: (round(float(second[k]), D), wide.index(k)))[:size]


def _refined(ids, x, centres, label, other, how, step, only=None, plain=False):
    k, sizes = len(centres), np.bincount(label, minlength=len(centres))
    own = np.sqrt(np.square(x - centres[label]).sum(1))
    spread = {c: round(float(own[label == c].mean()), D) for c in range(k) if sizes[c]}
    rank = {c: r for r, c in enumerate(sorted(spread, key=lambda c: (-spread[c], c)))}
    out = {}
    for c in range(k):
        mine = np.flatnonzero(label == c)
        n = len(mine)
        if not n or (only is not None and c not in only):
            continue
        m, o, who = np.square(x[mine] - x[mine].mean(0)).sum(1), other[mine], ids[mine]
        if n < how.least and not plain:
            out[c] = who[_pick(who, m)]
            continue
        push = how.push
        if not plain and how.push_mode == "adaptive":
            push *= min(max(np.sqrt(n / sizes[sizes > 0].mean()), how.scale[0]), how.scale[1])
        if not plain and how.push_mode == "density":
            push = how.low + (how.high - how.low) * rank[c] / max(len(rank) - 1, 1)
        size = how.size if plain or not how.adaptive_size else int(min(max(round(np.sqrt(n)), how.floor), how.cap))
        name = "mean_margin" if how.two_stage and step == 0 and not plain else how.strategy
        if how.large and how.threshold and n >= how.threshold and not plain:
            name = how.large
        if k == 1:
            name, push = "mean", 0.0
        some = list(range(n)) if size <= 0 or size >= n else _shortlist(name, m, o, who, size, how)
        best = _pick(who[some], ((1 + how.pull) * m - push * o)[some])
        out[c] = who[some][best]
    return out


def _kmedoids(ids, x, start, how):
    now = list(start)
    for step in range(how.rounds):
        centres = np.array([x[list(ids).index(v)] for v in now])
        label, own, other = _assign(x, centres)
        found = _refined(ids, x, centres, label, other, how, step)
        free = sorted((k for k in range(len(ids)) if ids[k] not in set(found.values())), key=lambda k: (-round(float(own[k]), D), ids[k]))
        for c in range(len(now)):
            if c not in found:
                found[c] = ids[free.pop(0)]
        after = [int(found[c]) for c in range(len(now))]
        if after == now:
            break
        now = after
    return now


def _told(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r.bag, r.start), {})[r.cluster] = r.vec_id
    return {k: [v[c] for c in range(len(v))] for k, v in out.items()}


HOWS = [
    Medoids(rounds=4),
    Medoids(rounds=3, strategy="mean", size=3, pull=0.3),
    Medoids(rounds=3, strategy="mean_margin", size=4, push_mode="adaptive"),
    Medoids(rounds=3, strategy="knn_mean_margin", size=3, multiple=2.5, weight=0.7, push_mode="density"),
    Medoids(rounds=3, strategy="knn_mean_ratio", adaptive_size=True, floor=2, cap=5, two_stage=True),
    Medoids(rounds=3, strategy="margin_max", large="knn_mean_margin", threshold=12, size=5, least=4),
    Medoids(rounds=3, size=0, push=0.5),
]


@pytest.mark.parametrize("how", HOWS)
def test_medoids(spark, bags, rows, blocks, how):
    starts = [_first(bags, 5), _first(bags, 3, 2)]
    got = _told(bagwise.kmedoids(rows, blocks, _frame(spark, bags, starts), how))
    assert got == {(b, s): _kmedoids(*bags[b], start[b], how) for s, start in enumerate(starts) for b in bags}


def test_blocks_are_many_and_whole(rows, blocks):
    assert blocks.packed.where("bag = 1").count() > 3
    assert blocks.packed.select("bag", F.explode("own.vec_id")).count() == rows.count()


def test_kmeans(spark, bags, rows, blocks):
    start = _first(bags, 4)
    got = {}
    for r in bagwise.kmeans(blocks, _frame(spark, bags, [start]), 8).collect():
        got.setdefault(r.bag, {})[r.cluster] = r.centre
    for b, (ids, x) in bags.items():
        centres = np.array([x[list(ids).index(v)] for v in start[b]])
        for _ in range(8):
            label = _assign(x, centres)[0]
            after = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
            still, centres = np.square(after - centres).sum(1).max() <= 1e-8, after
            if still:
                break
        assert np.allclose([got[b][c] for c in range(len(centres))], centres, atol=1e-9)


def test_starts_and_representatives(spark, bags, rows, blocks):
    counts = spark.createDataFrame([(1, 6), (2, 4), (3, 9), (4, 1)], "bag int, k int")
    first = bagwise.seeded_starts(rows, blocks, counts, starts=2)
    got = _told(first)
    assert {k: len(v) for k, v in got.items() if k[0] != 3} == {(b, s): k for b, k in ((1, 6), (2, 4), (4, 1)) for s in (0, 1)}
    assert all(len(set(v)) == len(v) for v in got.values()) and len(got[3, 0]) <= 5 and got[1, 0] != got[1, 1]
    assert got == _told(bagwise.seeded_starts(rows.repartition(2), blocks, counts, starts=2))
    centres = bagwise.kmeans(blocks, first)
    for key, ids in _told(bagwise.representatives(rows, blocks, centres)).items():
        own_ids, x = bags[key[0]]
        mine = np.array([r.centre for r in centres.where((F.col("bag") == key[0]) & (F.col("start") == key[1])).orderBy("cluster").collect()])
        label = _assign(x, mine)[0]
        for c, v in enumerate(ids):
            some = np.flatnonzero(label == c) if (label == c).any() else np.arange(len(x))
            assert v == own_ids[some][_pick(own_ids[some], _d2(x[some], mine[c : c + 1])[:, 0])]


@pytest.mark.parametrize("batch", [1, 5])
def test_farthest_starts_keep_the_exact_order(spark, bags, rows, blocks, batch):
    from bagsieve.operators import kernels

    first = _first(bags, 1, 4)
    counts = spark.createDataFrame([(1, 14), (2, 40), (3, 7), (4, 2)], "bag int, k int")
    got = _told(bagwise.farthest_starts(rows, blocks, _frame(spark, bags, [first]), counts, batch))
    for b, k in ((1, 14), (2, 31), (3, 5), (4, 1)):  # bag 3 has five different rows
        ids, x = bags[b]
        at = list(ids).index(first[b][0])
        rest = [j for j in range(len(ids)) if j != at]
        order = [rest[j] for j in kernels.farthest_points(x[rest], x[[at]], x.mean(0), k - 1)]
        assert got[b, 0] == [int(ids[j]) for j in [at, *order]]


@pytest.mark.parametrize("by", ["inertia", "dispersion"])
def test_best_start(spark, bags, blocks, by):
    starts = [_first(bags, 4), _first(bags, 4, 3), _first(bags, 4)]  # the last equals the first: the first wins
    got = {r.bag: r.start for r in bagwise.best_start(blocks, _frame(spark, bags, starts), by).collect()}
    for b, (ids, x) in bags.items():
        score = []
        for start in starts:
            m = np.array([x[list(ids).index(v)] for v in start[b]])
            far = np.sqrt(_d2(m, m)) + np.where(np.eye(len(m)) > 0, np.inf, 0)
            score.append(round(float(_assign(x, m)[1].sum() if by == "inertia" else -far.min()), D))
        assert got[b] == score.index(min(score))


@pytest.mark.parametrize("forward", [1, 3])
@pytest.mark.parametrize("by", sorted(bagwise.CRITERIA))
def test_polish(spark, bags, rows, blocks, by, forward):
    how, start, most, passes = Medoids(size=4, push=0.4), _first(bags, 6), 2, 2
    got = _told(bagwise.polish(rows, blocks, _frame(spark, bags, [start]), how, most, by, passes, forward))
    for b, (ids, x) in bags.items():
        now = list(start[b])
        for _ in range(passes):
            medoids = np.array([x[list(ids).index(v)] for v in now])
            label, _, other = _assign(x, medoids)
            k = len(now)
            means = np.array([x[label == c].mean(0) if (label == c).any() else np.zeros(x.shape[1]) for c in range(k)])
            far = lambda a, z: np.sqrt(_d2(a, z)) + np.where(np.eye(k) > 0, np.inf, 0)
            own = np.sqrt(np.square(medoids - means).sum(1))
            near = far(medoids, means).min(1)
            score = {
                "closest_pair": far(medoids, medoids).min(1),
                "cluster_size": -np.bincount(label, minlength=k).astype(float),
                "centroid_dist": -np.square(own),
                "silhouette": np.where(np.isinf(near), 1, (np.minimum(near, 1e300) - own) / np.maximum(np.minimum(near, 1e300) + own, 1e-8)),
                "within_variance": -np.array([np.square(x[label == c] - medoids[c]).sum() / max((label == c).sum(), 1) for c in range(k)]),
            }[by]
            top = sorted(range(k), key=lambda c: (round(float(score[c]), D), c))[:most] if k > 1 else []
            top = [c for c in top if (label == c).sum() > 1]
            if forward > 1:
                found = {}
                for c in top:
                    mine = np.flatnonzero(label == c)
                    m = np.square(x[mine] - x[mine].mean(0)).sum(1)
                    near_ = sorted(range(len(mine)), key=lambda j: (round(float(m[j]), D), ids[mine[j]]))[:forward]
                    best = max(near_, key=lambda j: (round(float(np.sqrt(other[mine[j]])), D), -near_.index(j)))
                    found[c] = ids[mine[best]]
            else:
                found = _refined(ids, x, medoids, label, other, how, 1, only=top, plain=True)
            after = [int(found.get(c, now[c])) for c in range(k)]
            if after == now:
                break
            now = after
        assert got[b, 0] == now, (b, by, forward)


def test_faults(spark, rows, blocks):
    assert bagwise.kmedoids(rows, blocks, _frame(spark, {}, [])).count() == 0
    for bad in (dict(strategy="other"), dict(push_mode="other"), dict(large="other")):
        with pytest.raises(ValueError):
            Medoids(**bad)
    with pytest.raises(ValueError):
        bagwise.contested(rows, "other")
    with pytest.raises(ValueError):
        bagwise.best_start(blocks, rows, "other")


def test_nearest_two_measures_close_calls_exactly():
    x = np.array([[1e6 + 1e-4, 0.0], [1e6, 0.0], [5.0, 5.0]])
    centres = np.array([[1e6, 0.0], [1e6 + 1e-4, 0.0], [1e6, 0.0], [5.0, 5.0]])
    label, d2, other = bagwise.nearest_two(x, centres)
    assert label.tolist() == [1, 0, 3] and np.allclose(d2, 0)


def test_rounds_ship_narrow_centres(spark, bags, rows, blocks, monkeypatch):
    """Rounds ship few centres to the blocks, whose vectors aren't shuffled then; many are joined with them. The medoids are the same."""
    how, first = HOWS[0], _frame(spark, bags, [_first(bags, 5)])
    plain, narrow, found = bagwise._sent, [], []
    monkeypatch.setattr(bagwise, "_sent", lambda blocks, centres, ship=False: narrow.append(ship) or plain(blocks, centres, ship))
    for most in (1 << 20, 0):
        narrow.clear()
        monkeypatch.setattr(bagwise, "NARROW_BYTES", most)
        found.append(_told(bagwise.kmedoids(rows, blocks, first, how)))
        assert narrow and set(narrow) == {most > 0}
    assert found[0] == found[1]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [plain(blocks, first.drop("vec_id"), ship)._jdf.queryExecution().executedPlan().toString() for ship in (True, False)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ["SortMergeJoin" in p for p in plans] == [False, True]


def test_nearest_two_holds_tiles_of_many_centres():
    """What is held at once is a tile, however many centres there are; labels and distances are those of the whole matrix."""
    import tracemalloc

    rng = np.random.default_rng(4)
    x, centres = rng.normal(size=(2048, 8)), rng.normal(size=(6000, 8))
    tracemalloc.start()
    label, d2, other = bagwise.nearest_two(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # the whole matrix has 98 MB
    for k in range(0, 2048, 97):
        far = np.square(centres - x[k]).sum(1)
        assert label[k] == far.argmin() and np.isclose(d2[k], far.min()) and np.isclose(other[k], np.sort(far)[1])
