"""Reading bags of vectors, their coordinates, labels and selections; writing selections and splits.

A bag is a group of rows (bag, row_id, features); the name of a file stands for its bag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import shuffle_key
from ..functions.vectors import doubles


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def scan(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.parquet") -> DataFrame:
    """Bags under a folder, with the file's stem as ``bag`` where the files don't name it; no files is an error."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).parquet(path)
    return rows if "bag" in rows.columns else rows.withColumn("bag", stem(F.input_file_name()))


def duplicate_names(paths: DataFrame, path: str = "path") -> DataFrame:
    """Stems that more than one path would be written to."""
    return paths.groupBy(stem(F.col(path)).alias("stem")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def vectors(rows: DataFrame, features: str = "features", width: int | None = None) -> DataFrame:
    """Features in double precision; a vector of another width is an error when it is read."""
    rows = rows.withColumn(features, doubles(features))
    if width is None:
        return rows
    wrong = F.raise_error(F.concat(F.lit(f"a vector of {width} entries was expected, not "), F.size(features)))
    return rows.withColumn(features, F.when(F.size(features) == width, F.col(features)).otherwise(wrong.cast("array<double>")))


def pick_file(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """For each bag its file: an exact name first, then the least of those that start with ``bag.``."""
    rows = wanted.join(files.withColumn("_key", F.element_at(F.split(F.col("stem"), r"\."), 1)), F.col("bag") == F.col("_key"))
    best = F.struct((F.col("stem") != F.col("bag")).alias("other"), F.col("path"))
    return rows.groupBy("bag").agg(F.min(best)["path"].alias("path"), F.count(F.lit(1)).alias("candidates"))


def with_coordinates(rows: DataFrame, coordinates: DataFrame, on: str) -> DataFrame:
    """Rows that have coordinates, the least of several; rows without are dropped."""
    others = [c for c in coordinates.columns if c != on]
    least = coordinates.groupBy(on).agg(F.min(F.struct(*others)).alias("_least")).select(on, *[F.col("_least")[c].alias(c) for c in others])
    return rows.join(least, on)


def resolve(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(bag, path, candidates) for (bag, relative): the file of that path, else the only one of the bag's stem.

    ``candidates`` counts files of the stem; path is null where none is, or several without the named one.
    """
    named = files.select("path", stem(F.col("path")).alias("bag"))
    rows = wanted.join(named, "bag", "left").groupBy("bag").agg(F.max(F.when(F.col("path") == F.col("relative"), F.col("path"))).alias("exact"), F.min("path").alias("one"), F.count("path").alias("candidates"))
    return rows.select("bag", F.coalesce("exact", F.when(F.col("candidates") == 1, F.col("one"))).alias("path"), "candidates")


def resolved(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(bag, path), where a bag without one certain file is an error when it is read."""
    wrong = F.raise_error(F.concat("bag", F.lit(" has "), F.col("candidates").cast("string"), F.lit(" files and none by its path")))
    return resolve(wanted, files).select("bag", F.coalesce("path", wrong.cast("string")).alias("path"))


def labelled_head(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in a shuffled order that is the same anywhere."""
    return rows.orderBy(shuffle_key(seed, key), key).limit(n)


def bounded(selection: DataFrame, sizes: DataFrame) -> DataFrame:
    """Indices of a selection (bag, index) inside their bag (bag, n)."""
    return selection.join(sizes, "bag").where("index >= 0 AND index < n").select("bag", "index")


def read_selection(spark: SparkSession, path: str, sizes: DataFrame) -> DataFrame:
    """A written selection, bounds checked; a bag that ends up empty is an error when it is read."""
    rows = bounded(spark.read.parquet(path), sizes)
    kept = sizes.join(rows.groupBy("bag").agg(F.count(F.lit(1)).alias("kept")), "bag", "left")
    empty = kept.where("kept IS NULL").limit(1).collect()
    if empty:
        raise ValueError(f"the selection of bag {empty[0]['bag']} has no index inside it")
    return rows


def pending(bags: DataFrame, done: DataFrame) -> DataFrame:
    """Bags whose selection isn't written yet."""
    return bags.join(done.select("bag").distinct(), "bag", "left_anti")


def write_selection(selection: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes a selection by bag; without ``overwrite``, only bags that the folder doesn't hold yet."""
    spark = selection.sparkSession
    if overwrite:
        selection.write.mode("overwrite").partitionBy("bag").parquet(path)
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        selection = pending(selection, spark.read.parquet(path).withColumn("bag", F.col("bag").cast(selection.schema["bag"].dataType)))
    selection.write.mode("append").partitionBy("bag").parquet(path)


def write_splits(folds: DataFrame, path: str) -> None:
    """Writes (fold, split, ...) as one folder per fold and split; an existing bundle is never overwritten."""
    folds.write.mode("errorifexists").partitionBy("fold", "split").parquet(path)


def labels_csv(spark: SparkSession, path: str, name: str, label: str, strip: str = "") -> DataFrame:
    """(name, label) of a label file with a header; ``strip`` is cut off the names' end."""
    rows = spark.read.option("header", True).csv(path)
    own = F.trim(F.col(name))
    if strip:
        own = F.regexp_replace(own, F.lit(strip.replace(".", r"\.") + "$"), F.lit(""))
    return rows.select(own.alias("name"), F.trim(F.col(label)).alias("label"))


def images(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff")) -> DataFrame:
    """Paths and bytes of pictures under a folder, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)


def member_ids(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """Stems of the members of zip archives that end in ``suffix``."""
    import io
    import zipfile

    import pandas as pd

    def names(batches):
        for frame in batches:
            found = [n for body in frame["content"] for n in zipfile.ZipFile(io.BytesIO(body)).namelist() if n.endswith(suffix)]
            yield pd.DataFrame({"bag": [n.rsplit("/", 1)[-1][: -len(suffix)] for n in found]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(names, "bag string").distinct()
