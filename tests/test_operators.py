"""Kernels against brute force, quotas, degenerate inputs, sources and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagsieve.operators import budget, catalogue, cluster, fill, kernels, metrics, refine, sample
from bagsieve.plans.sampler import SamplerSpec
from bagsieve.sources import bags as source


def _points(seed, n=20, d=3):
    return np.random.default_rng(seed).normal(size=(n, d))


def test_farthest_points_brute():
    for seed in range(5):
        x = _points(seed)
        picks = kernels.farthest_points(x, np.zeros((0, 3)), x.mean(0), 6)
        far, want = np.square(x - x.mean(0)).sum(1), []
        for _ in range(6):
            best = max((k for k in range(len(x)) if k not in want), key=lambda k: (round(far[k], 9), -k))
            want.append(best)
            far = np.minimum(far, np.square(x - x[best]).sum(1))
        assert picks == want


def test_farthest_points_variants():
    x = _points(1)
    assert kernels.farthest_points(x, x[:0], x.mean(0), 0) == []
    assert sorted(kernels.farthest_points(x, x[:2], x.mean(0), 99)) == list(range(20))
    scaled = x * np.linspace(0.1, 9, 20)[:, None]
    assert kernels.farthest_points(scaled, x[:0], x.mean(0), 3, beta=2.0)[0] == int((np.square(scaled - x.mean(0)).sum(1) * np.linalg.norm(scaled, axis=1) / kernels.lower_median(np.linalg.norm(scaled, axis=1))).argmax())
    assert kernels.farthest_points(x, x[:3], x.mean(0), 1, median=True)[0] == int(np.sort([np.square(x - s).sum(1) for s in x[:3]], 0)[1].argmax())
    same = np.ones((4, 2))
    assert kernels.farthest_points(same, same[:0], same.mean(0), 4) == [0, 1, 2, 3]


def test_facility_location_equals_plain_greedy():
    for seed in range(6):
        x = _points(seed, 25)
        x = np.round(x, 1) if seed % 2 else x  # ties
        near, want = np.sqrt(np.square(x - x[0]).sum(1)), []
        far = kernels.pairwise(x, x)
        for _ in range(9):
            gain = np.round(np.maximum(near - far, 0.0).sum(1), 9)
            gain[want] = -np.inf
            want.append(int(gain.argmax()))
            near = np.minimum(near, far[want[-1]])
        assert kernels.facility_location(x, x[:1], None, 9) == want


def _objective(x, labels, chosen):
    total = 0.0
    for c in np.unique(labels):
        inside, outside = x[(labels == c) & chosen], x[(labels == c) & ~chosen]
        others = x[(labels != c) & chosen]
        if len(inside) and len(outside) and len(others):
            total += (kernels.pairwise(inside, others).mean(1) - kernels.pairwise(inside, outside).mean(1)).sum()
    return total


def test_best_swap_is_the_exact_best():
    for seed in range(4):
        x, labels = _points(seed, 14), np.arange(14) % 2
        chosen = np.arange(14) % 3 == 0
        own = np.flatnonzero(labels == 0)
        inside, outside = own[chosen[own]], own[~chosen[own]]
        found = kernels.best_swap(x[inside], x[outside], x[chosen & (labels == 1)], sign=1)

        def part(sel):
            i, o, t = x[own[sel[own]]], x[own[~sel[own]]], x[chosen & (labels == 1)]
            return (kernels.pairwise(i, t).mean(1) - kernels.pairwise(i, o).mean(1)).sum()

        best = {}
        for a in inside:
            for b in outside:
                new = chosen.copy()
                new[a], new[b] = False, True
                best[a, b] = part(new) - part(chosen)
        top = max(best.values())
        if top > 1e-9:
            assert abs(found[0] - top) < 1e-6 and abs(best[inside[found[1]], outside[found[2]]] - top) < 1e-6
        else:
            assert found is None


def test_sequential_swaps_keep_sizes():
    x, labels = _points(3, 30), np.arange(30) % 3
    chosen = np.arange(30) % 4 == 0
    for how in ({}, {"chain": True}, {"median": True}, {"separate": True}):
        new = kernels.sequential_swaps(x, labels, chosen, 2, **how)
        assert [new[labels == c].sum() for c in range(3)] == [chosen[labels == c].sum() for c in range(3)]


def _exhaustive(x, labels, chosen, passes, sign, cross=0, nearest=0, sample=0, centres=False, skip=0.0, active=False):
    """Sequential swaps with every objective made in full for every pair."""
    chosen, asked = chosen.copy(), sorted(set(labels))
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(-1))
    to = {c: np.linalg.norm(x - x[labels == c].mean(0), axis=1) for c in asked}
    if skip:
        intra = {c: to[c][labels == c].mean() for c in asked}
        middle = sorted(intra.values())[(len(intra) - 1) // 2]
        asked = [c for c in asked if intra[c] >= skip * middle]
    for p in range(passes):
        changed = set()
        drawn = np.flatnonzero(chosen)
        if sample and len(drawn) > sample:
            drawn = np.random.default_rng([42, p]).permutation(drawn)[:sample]
        before = chosen.copy()
        for c in asked:
            inside, outside = [list(np.flatnonzero((labels == c) & side)) for side in (chosen, ~chosen)]
            if not inside or not outside:
                continue
            outside += sorted(np.flatnonzero((labels != c) & ~chosen), key=lambda k: (round(to[c][k] ** 2, 9), k))[:cross]
            if nearest:
                outside = sorted(outside, key=lambda k: (round(to[c][k] ** 2, 9), k))[:nearest]
            if centres:
                means = [(x[before & (labels == k)].mean(0), (before & (labels == k)).sum()) for k in sorted(set(labels)) if k != c and (before & (labels == k)).any()]
                far = sum(n * np.linalg.norm(x - y, axis=1) for y, n in means) / sum(n for _, n in means)
            else:
                others = [k for k in (drawn if sample else np.flatnonzero(chosen)) if labels[k] != c]
                if not others:
                    continue
                far = d[:, others].mean(1)

            def worth(s, u):
                return sign * sum(far[k] - d[k, u].mean() for k in s)

            best = None
            for i in inside:
                for u in sorted(outside):
                    gain = round(worth([k for k in inside if k != i] + [u], [k for k in outside if k != u] + [i]) - worth(inside, outside), 9)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, i, u
            if best:
                chosen[best[1]], chosen[best[2]] = False, True
                changed.add(c)
        if not changed:
            break
        if active:
            asked = [c for c in asked if c in changed]
    return chosen


@pytest.mark.parametrize("how", [{}, {"cross": 3}, {"nearest": 4}, {"cross": 4, "nearest": 5}, {"sample": 4}, {"centres": True}, {"skip": 1.1}, {"active": True}, {"cross": 2, "sample": 3, "active": True}])
@pytest.mark.parametrize("sign", [-1, 1])
def test_sequential_swaps_against_exhaustive_search(how, sign):
    for seed in range(3):
        x, labels = _points(seed, 26) + 0.0, np.arange(26) % 3
        chosen = np.arange(26) % 4 == 0
        got = kernels.sequential_swaps(x, labels, chosen, 3, sign, **how)
        assert (got == _exhaustive(x, labels, chosen, 3, sign, **how)).all()
        assert got.sum() == chosen.sum()


def test_best_swap_in_blocks(monkeypatch):
    x, labels = _points(8, 60), np.arange(60) % 2
    chosen = np.arange(60) % 3 == 0
    args = [x[(labels == 0) & chosen], x[(labels == 0) & ~chosen], x[(labels == 1) & chosen]]
    for how in ({}, {"sign": 1}, {"median": True}, {"separate": True}, {"weights": np.arange(1.0, 11.0)}):
        whole = kernels.best_swap(*args, **how)
        monkeypatch.setattr(kernels, "_BLOCK", 3)
        assert kernels.best_swap(*args, **how) == whole
        monkeypatch.undo()


def test_polish_extras_keeps_size():
    x, labels = _points(4, 12), np.arange(12) % 2
    new = kernels.polish_extras(x, labels, [0, 1], [2, 3])
    assert len({0, 1, *new}) == 4 and [labels[k] for k in new] == [0, 1]


def test_quotas(spark):
    rng = np.random.default_rng(5)
    drawn = [(b, c, int(rng.integers(0, 9)), float(rng.random())) for b in range(6) for c in range(5)]
    rows = [(*r, min(20, sum(a for b, _, a, _ in drawn if b == r[0]))) for r in drawn]
    got = budget.largest_remainder(spark.createDataFrame(rows, "bag int, cluster int, available long, weight double, total int")).toPandas()
    for b, part in got.groupby("bag"):
        room = {r[1]: r[2] for r in rows if r[0] == b}
        assert part.quota.sum() == min(20, sum(room.values()))
        assert all(q <= room[c] for c, q in zip(part.cluster, part.quota))


def test_budget_edges(spark):
    assert spark.range(1).select(budget.target(0.29, F.lit(100))).first()[0] == 28
    with pytest.raises(Exception, match="selects none"):
        spark.range(1).select(budget.target(0.01, F.lit(5))).collect()
    with pytest.raises(ValueError):
        SamplerSpec(ratio=0)
    with pytest.raises(ValueError):
        SamplerSpec(allocation="proportional")


def _line(spark):
    rows = [(0, 0, [0.0]), (1, 0, [1.0]), (2, 0, [2.0]), (3, 1, [10.0]), (4, 1, [11.0]), (5, 1, [12.0])]
    return spark.createDataFrame(rows, "vec_id long, cluster int, x array<double>")


def test_representatives_and_empty_cluster(spark):
    centres = spark.createDataFrame([(0, [1.2]), (1, [11.0]), (2, [100.0])], "cluster int, centre array<double>")
    got = {r.cluster: r.vec_id for r in cluster.representatives(_line(spark), centres).collect()}
    assert got == {0: 1, 1: 4, 2: 5}
    with pytest.raises(Exception, match="centres"):
        cluster.assign(_line(spark), centres).crossJoin(cluster.packed(centres, bound=2)).collect()


def test_kmedoid_settles(spark):
    start = spark.createDataFrame([(0, 0), (1, 3)], "cluster int, vec_id long")
    got = cluster.kmedoid(_line(spark), start, push=0.0)
    assert sorted(r.vec_id for r in got.collect()) == [1, 4]


def test_knn_swap_never_worsens(spark):
    x = _points(6, 24)
    rows = spark.createDataFrame([(1, k, k % 2, [float(v) for v in x[k]], k % 3 == 0) for k in range(24)], "bag int, vec_id long, cluster int, x array<double>, selected boolean")
    chosen = [k for k in range(24) if k % 3 == 0]
    total = lambda s: kernels.pairwise(x[s], x[s]).sum()
    swap = refine.knn_swap(rows).first()
    assert swap and total([k for k in chosen if k != swap.out_id] + [swap.in_id]) < total(chosen)


def test_single_row_and_all_selected(spark):
    one = spark.createDataFrame([(1, 7, 0, [1.0, 2.0], False, 1)], "bag int, vec_id long, cluster int, x array<double>, is_seed boolean, quota int")
    assert [r.vec_id for r in fill.fill_clusters(one).collect()] == [7]
    full = one.withColumn("selected", F.lit(True))
    assert refine.swaps(full).count() == 0
    flat = spark.createDataFrame([(1, k, 3.0, 3.0) for k in range(9)], "bag int, vec_id long, px double, py double")
    assert sample.grid(flat, 0.5).count() == 4
    assert sample.random_k(flat, 1.0).count() == 9


def test_auroc_edges(spark):
    one = spark.createDataFrame([(True, 0.2), (True, 0.4)], "positive boolean, score double")
    assert np.isnan(metrics.auroc(one).first()[0])
    tied = spark.createDataFrame([(True, 1.0), (False, 1.0), (True, 2.0), (False, 0.0)], "positive boolean, score double")
    assert metrics.auroc(tied).first()[0] == pytest.approx(0.875)


def test_folds_of_known_sizes(spark):
    rows = spark.range(270).select("id", (F.col("id") < 111).cast("int").alias("label"))
    got = catalogue.stratified_folds(rows, "id", "label").groupBy("fold", "label").count().collect()
    assert sorted((r.label, r["count"]) for r in got) == [(0, 31)] + [(0, 32)] * 4 + [(1, 22)] * 4 + [(1, 23)]


def test_selection_round_trip(spark, tmp_path):
    chosen = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "bag string, index long")
    path = str(tmp_path / "out")
    source.write_selection(chosen, path)
    source.write_selection(chosen, path)
    assert spark.read.parquet(path).count() == 3
    sizes = spark.createDataFrame([("a", 3), ("b", 5)], "bag string, n long")
    with pytest.raises(ValueError, match="bag b"):
        source.read_selection(spark, path, sizes)


def test_labels_csv_and_names(spark, tmp_path):
    (tmp_path / "l.csv").write_text("patient,stage\np_1.tif , x\np_2.tif,y\n")
    got = source.labels_csv(spark, str(tmp_path / "l.csv"), "patient", "stage", ".tif").collect()
    assert [tuple(r) for r in got] == [("p_1", "x"), ("p_2", "y")]


def test_stream_selects_each_bag_once(spark, tmp_path):
    from bagsieve.streaming.arrivals import select_arrivals

    rows = spark.range(40).select((F.col("id") % 2).cast("int").alias("bag"), F.col("id").alias("vec_id"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        query = select_arrivals(spark, str(tmp_path / "in"), "bag int, vec_id long", str(tmp_path / "out"), str(tmp_path / "check"), lambda d: sample.random_k(d, 0.25), once=True)
        query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


@pytest.mark.parametrize("total,weights", [(9, [1.0, 1.0]), (3, [0.0, 0.0])])
def test_budgets_that_cannot_be_met_are_errors(spark, total, weights):
    rows = spark.createDataFrame([(1, k, 4, w, total) for k, w in enumerate(weights)], "bag int, cluster int, available long, weight double, total long")
    with pytest.raises(Exception, match="available|positive weight"):
        budget.largest_remainder(rows).collect()


@pytest.mark.parametrize("total,available", [(0, 4), (5, 0), (-1, 4)])
def test_nothing_to_give_or_nowhere_to(spark, total, available):
    rows = spark.createDataFrame([(1, k, available, 1.0, total) for k in range(2)], "bag int, cluster int, available long, weight double, total long")
    assert [r.quota for r in budget.largest_remainder(rows).collect()] == [0, 0]
