"""Kept results: only what is new is computed, what isn't whole is never read; splits, listings and models made once."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from bagsieve.operators import metrics
from bagsieve.sources import results
from bagsieve.sources.results import BagResults


def _bags(spark, rows):
    return spark.createDataFrame(rows, "bag string, vec_id long, x array<double>")


ROWS = [("a", 1, [1.0, 2.0]), ("a", 2, [3.0, None]), ("b", 1, [5.0, 1.0]), ("c", 1, None), (None, 1, [2.0, 2.0])]


def _sums(seen):
    def compute(some):
        seen.append(sorted(str(r.bag) for r in some.select("bag").distinct().collect()))
        return some.where("bag <> 'c'").groupBy("bag").agg(F.sum("vec_id").alias("total"))  # nothing for c

    return compute


def test_computes_only_what_is_new(spark, tmp_path):
    seen, kept = [], BagResults(spark, str(tmp_path), "sums", {"k": 1, "by": "id"})
    first = kept.of(_bags(spark, ROWS[:2] + ROWS[3:4]), _sums(seen))
    assert {tuple(r) for r in first.collect()} == {("a", 3)} and seen == [["a", "c"]]
    again = BagResults(spark, str(tmp_path), "sums", {"by": "id", "k": 1})
    both = again.of(_bags(spark, ROWS[:4]).repartition(3), _sums(seen))
    assert {tuple(r) for r in both.collect()} == {("a", 3), ("b", 1)} and seen[1:] == [["b"]]
    again.of(_bags(spark, ROWS[3::-1]), _sums(seen))
    assert len(seen) == 2  # nothing is new, the bag without results included
    changed = again.of(_bags(spark, ROWS[:1] + [("a", 4, [3.0, 0.0])]), _sums(seen))
    assert {tuple(r) for r in changed.collect()} == {("a", 5)} and seen[2:] == [["a"]]
    BagResults(spark, str(tmp_path), "sums", {"k": 2, "by": "id"}).of(_bags(spark, ROWS[2:3]), _sums(seen))
    assert seen[3:] == [["b"]]


def test_what_is_not_whole_is_not_read(spark, tmp_path):
    seen, kept = [], BagResults(spark, str(tmp_path), "sums", {})
    rows = _bags(spark, ROWS[:2])

    def late(some):  # another job makes the same results meanwhile
        kept.of(rows, _sums(seen)).collect()
        return _sums(seen)(some)

    assert kept.of(rows, late).count() == 1 and len(seen) == 2 and len(os.listdir(kept.folder)) == 2
    assert kept.of(rows, _sums(seen)).count() == 1 and len(seen) == 2
    for entry in os.listdir(kept.folder):
        if os.path.exists(f"{kept.folder}/{entry}/bags"):
            os.remove(f"{kept.folder}/{entry}/bags/_SUCCESS")
    assert kept.known() is None
    assert {tuple(r) for r in kept.of(_bags(spark, ROWS[:2]), _sums(seen)).collect()} == {("a", 3)} and len(seen) == 3
    broken = BagResults(spark, str(tmp_path), "broken", {})
    with pytest.raises(ZeroDivisionError):
        broken.of(_bags(spark, ROWS[:2]), lambda some: 1 / 0)
    assert broken.known() is None


def test_no_bags(spark, tmp_path):
    kept = BagResults(spark, str(tmp_path), "none", {})
    assert kept.of(_bags(spark, []), _sums([])).count() == 0


@pytest.mark.parametrize("other", [ROWS[:1], ROWS[:2] + ROWS[:1], [("a", 1, [1.0, 2.0]), ("a", 2, [3.0])], [("a", 1, [2.0, 1.0]), ("a", 2, [3.0, None])]])
def test_digest_tells_bags_apart(spark, other):
    told = [_bags(spark, rows).agg(results.digest("vec_id", "x").alias("d")).first().d for rows in (ROWS[:2], ROWS[1::-1], other)]
    assert told[0] == told[1] != told[2]


def test_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert results.once(spark, str(tmp_path), "t", {"a": 1}, make).count() == 3
    assert len(calls) == 1
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "one.pt").write_bytes(b"xyz")
    for _ in range(2):
        assert [(r.path.rsplit("/", 1)[1], r.length) for r in results.listing(spark, str(tmp_path / "kept"), str(tmp_path / "in"), "*.pt").collect()] == [("one.pt", 3)]
        (tmp_path / "in" / "two.pt").write_bytes(b"x")  # a kept listing doesn't look again


def test_probe_is_fitted_once(spark, tmp_path):
    rows = spark.createDataFrame([(k % 2, [float(k % 2), float(k % 5)]) for k in range(40)], "label int, x array<double>")
    calls = []

    def fit():
        calls.append(1)
        return metrics.fit_probe(rows)

    with pytest.raises(FileNotFoundError):
        results.fitted(spark, str(tmp_path), "probe", {"cost": 1.0}, fit, required=True)
    got = [metrics.apply_probe(results.fitted(spark, str(tmp_path), "probe", {"cost": 1.0}, fit), rows).select("label", "p").collect() for _ in range(2)]
    assert len(calls) == 1 and got[0] == got[1] and all(r.label == r.p for r in got[0])


def test_split_names():
    name = results.split_name
    assert name("d", "center_holdout", 5) == "d_center_holdout_n5"
    assert name("d", "all_stratified_kfold", 3, seed=7) == "d_all_stratified_kfold_seed7_n3"
    assert name("d", "patient_stratified_shuffle", 5, share=0.05) == "d_patient_stratified_shuffle_seed42_n5_test05"
    with pytest.raises(ValueError):
        name("d", "luck", 5)


@pytest.mark.parametrize("mode", sorted(results.MODES))
def test_splits_are_loaded_or_made(spark, tmp_path, mode):
    rows = spark.createDataFrame([(f"s{k}", k % 2, k % 4) for k in range(40)], "name string, label int, place int")
    how = dict(name="name", label="label", n=4, share=0.25, group="place" if mode in ("center_holdout", "patient_stratified_shuffle") else None)
    told = lambda df: sorted((r.fold, r.split, r["name"]) for r in df.collect())
    first = told(results.splits_once(rows, str(tmp_path), "d", mode, **how))
    assert len(first) == 160 and {s for _, s, _ in first} == {"train", "test"}
    assert sum(s == "test" for _, s, _ in first) == 40
    # a written bundle decides, whatever the labels are now
    other = rows.withColumn("label", F.lit(1))
    assert told(results.splits_once(other, str(tmp_path), "d", mode, **how)) == first
    with pytest.raises(Exception, match="unknown"):
        results.splits_once(rows.where("name <> 's3'"), str(tmp_path), "d", mode, **how).collect()
    if how["group"]:
        with pytest.raises(ValueError):
            results.splits_once(rows, str(tmp_path / "x"), "d", mode, **(how | {"group": None}))
