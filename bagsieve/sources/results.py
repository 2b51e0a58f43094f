"""Results that are kept: of bags, of whole tables, of fitted models and of splits.

An entry is found by a digest of everything it depends on.  It lies in a folder of its own that nobody else writes to,
and counts from the moment when its last part is whole (Spark's ``_SUCCESS`` in it); what a lost job left behind is never
read.  Two jobs that make the same entry at once leave two; readers take the one of the least name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue
from .bags import write_splits


def key_of(name: str, parameters: dict) -> str:
    """A folder name: that of the result and the digest of its parameters, in whatever order they are given."""
    told = json.dumps(parameters, sort_keys=True, default=str)
    return f"{name}-{hashlib.sha256(told.encode()).hexdigest()[:32]}"


def digest(*columns: str) -> Column:
    """Aggregate: a digest of rows in any order, repeats counted: the count and the sums of both halves of each row's md5."""
    each = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    half = lambda start: F.sum(F.conv(F.substring(each, start, 16), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.md5(F.concat_ws("|", F.count(F.lit(1)).cast("string"), half(1), half(17)))


def _whole(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a pattern and hold a whole table, in the order of their names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath().getParent()) for f in found or [])


class BagResults:
    """Results of bags under ``root``, for one name and one set of parameters.

    ``of(rows, compute)`` gives the results of the bags of ``rows``.  ``compute`` maps rows of some bags to results with the
    bag's column, bag by bag; it sees bags without a kept result for just these rows, and what it gives for them (be it
    nothing) is kept.  Equal rows in another order are the same bag; a bag with a changed row is a new one.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, parameters: dict, bag: str = "bag"):
        self.spark, self.bag, self.folder = spark, bag, f"{root.rstrip('/')}/{key_of(name, parameters)}"

    def known(self) -> DataFrame | None:
        """(bag, digest, entry) of the kept results."""
        parts = _whole(self.spark, f"{self.folder}/*/bags")
        return self.spark.read.parquet(*parts).groupBy(self.bag, "digest").agg(F.min("entry").alias("entry")) if parts else None

    def of(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        bags = rows.groupBy(self.bag).agg(digest(*sorted(rows.columns)).alias("digest"))
        known = self.known()
        missing = bags if known is None else bags.join(known, [self.bag, "digest"], "left_anti")
        entry = uuid.uuid4().hex
        target = f"{self.folder}/{entry}"
        missing.withColumn("entry", F.lit(entry)).write.parquet(f"{target}/missing")
        missing = self.spark.read.parquet(f"{target}/missing")
        if not missing.isEmpty():
            new = compute(rows.join(missing.select(self.bag), self.bag, "left_semi"))
            new.withColumn("_entry", F.lit(entry)).write.parquet(f"{target}/results")
            missing.write.parquet(f"{target}/bags")  # the last part: from here on the entry counts
        known = self.known()
        if known is None:  # no bags at all, now or ever
            return compute(rows)
        parts = sorted({part.rsplit("/", 1)[0] + "/results" for part in _whole(self.spark, f"{self.folder}/*/bags")})
        wanted = known.join(bags, [self.bag, "digest"]).select(self.bag, F.col("entry").alias("_entry"))
        return self.spark.read.parquet(*parts).join(wanted, [self.bag, "_entry"], "left_semi").drop("_entry")


def once(spark: SparkSession, root: str, name: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, made for the first call with these parameters and read by later ones."""
    folder = f"{root.rstrip('/')}/{key_of(name, parameters)}"
    if not _whole(spark, f"{folder}/*"):
        make().write.parquet(f"{folder}/{uuid.uuid4().hex}")
    return spark.read.parquet(_whole(spark, f"{folder}/*")[0])


def listing(spark: SparkSession, root: str, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under a folder at any depth, listed once and kept under ``root``."""

    def make() -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")

    return once(spark, root, "listing", {"path": path.rstrip("/"), "pattern": pattern}, make)


def fitted(spark: SparkSession, root: str, name: str, parameters: dict, fit: Callable[[], PipelineModel], required: bool = False) -> PipelineModel:
    """The model that ``fit`` gives, fitted once; with ``required`` a model that isn't kept yet is an error."""
    folder = f"{root.rstrip('/')}/{key_of(name, parameters)}"
    done = _whole(spark, f"{folder}/*/done")
    if not done:
        if required:
            raise FileNotFoundError(f"no kept model {name!r} with these parameters under {root}")
        target = f"{folder}/{uuid.uuid4().hex}"
        fit().save(f"{target}/model")
        spark.range(1).write.parquet(f"{target}/done")
        done = _whole(spark, f"{folder}/*/done")
    return PipelineModel.load(done[0].rsplit("/", 1)[0] + "/model")


#: How a bundle of splits is made, and what its name tells besides its number of folds.
MODES = {
    "center_holdout": (),
    "official_train_stratified_kfold": ("seed",),
    "all_stratified_kfold": ("seed",),
    "stratified_shuffle": ("seed", "test"),
    "patient_stratified_shuffle": ("seed", "test"),
}


def split_name(dataset: str, mode: str, n: int, seed: int = 42, share: float = 0.2) -> str:
    """The name of a bundle: held-out centres have neither seed nor share, folds no share."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    told = [f"seed{seed}"] * ("seed" in MODES[mode]) + [f"n{n}"] + [f"test{round(share * 100):02d}"] * ("test" in MODES[mode])
    return "_".join([dataset, mode, *told])


def splits_once(rows: DataFrame, root: str, dataset: str, mode: str, name: str, label: str, n: int = 5, seed: int = 42, share: float = 0.2, group: str | None = None) -> DataFrame:
    """Rows with fold and split: as the bundle under ``root`` says, which is made and written where there is none.

    ``group`` is the patients' column for ``patient_stratified_shuffle`` and the centres' for ``center_holdout`` (whose folds
    are the centres, so ``n`` has to be their number).  A bundle holds names: rows that it doesn't name are left out, and a
    name in it that ``rows`` hasn't is an error when it is read.
    """
    spark, path = rows.sparkSession, f"{root.rstrip('/')}/{split_name(dataset, mode, n, seed, share)}"
    if mode in ("center_holdout", "patient_stratified_shuffle") and group is None:
        raise ValueError(f"{mode} needs the column of the groups")
    if not _whole(spark, path):
        if mode == "center_holdout":
            centres = rows.select(group).distinct().count()
            if centres != n:
                raise ValueError(f"{n} folds of {centres} centres")
            made = catalogue.holdout(rows, group)
        elif mode == "patient_stratified_shuffle":
            made = catalogue.grouped_shuffles(rows, group, label, repeats=n, share=share, seed=seed)
        elif mode == "stratified_shuffle":
            made = catalogue.stratified_shuffles(rows, name, label, repeats=n, share=share, seed=seed)
        else:
            held = catalogue.stratified_folds(rows, name, label, n, seed).withColumnRenamed("fold", "_held")
            turns = held.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            made = turns.withColumn("split", F.when(F.col("fold") == F.col("_held"), "test").otherwise("train"))
        write_splits(made.select("fold", "split", name), path)
    bundle = spark.read.parquet(path).select(F.col("fold"), "split", F.col(name).cast(rows.schema[name].dataType).alias(name))
    return catalogue.resolve_folds(bundle, rows, name)
