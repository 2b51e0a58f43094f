"""Labels, identifiers and splits of a catalogue of bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import shuffle_key


def folder_label(path: Column) -> Column:
    """The name of the folder that a file is in."""
    return F.element_at(F.split(path, "/"), -2)


def prefix_label(rows: DataFrame, name: str, prefixes: dict[str, int]) -> DataFrame:
    """Rows with the label of their name's prefix; names with none are dropped."""
    label = F.lit(None).cast("int")
    for prefix, value in sorted(prefixes.items()):
        label = F.when(F.col(name).startswith(prefix), F.lit(value)).otherwise(label)
    return rows.withColumn("label", label).where("label IS NOT NULL")


def membership_label(rows: DataFrame, positive: DataFrame, key: str) -> DataFrame:
    """Rows with label 1 if their key is in ``positive``, else 0."""
    found = positive.select(F.col(key).alias("_key")).distinct()
    return rows.join(found, F.col(key) == F.col("_key"), "left").withColumn("label", F.col("_key").isNotNull().cast("int")).drop("_key")


def dense_labels(rows: DataFrame, name: str) -> DataFrame:
    """Rows with ``label``: the place of their class name among the sorted distinct ones, from 0."""
    classes = rows.select(F.col(name).alias("_class")).where("_class IS NOT NULL").distinct()
    classes = classes.withColumn("label", F.row_number().over(Window.orderBy("_class")) - 1)
    return rows.join(F.broadcast(classes) if classes.count() <= 100_000 else classes, F.col(name) == F.col("_class")).drop("_class")


def patient(name: Column) -> Column:
    """The first three parts of a name between dashes; fewer is an error."""
    parts = F.split(name, "-")
    short = F.raise_error(F.concat(F.lit("no patient in "), name)).cast("string")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "-")).otherwise(short)


def mixed_labels(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with more than one label."""
    return rows.groupBy(group).agg(F.countDistinct(label).alias("labels")).where("labels > 1")


def join_labels(files: DataFrame, labels: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Files with labels, and the labels without a file."""
    return files.join(labels, on), labels.join(files.select(on), on, "left_anti")


def stratified_folds(rows: DataFrame, key: str, label: str, k: int = 5, seed=42) -> DataFrame:
    """Rows with the fold that holds them out; classes are dealt round, in the hash's order.

    The running place over all classes is the place within the class plus the sizes of the classes before, so that
    no task sees more than a class.
    """
    sizes = rows.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(label).orderBy(shuffle_key(seed, key), key))
    return rows.withColumn("_place", within).join(sizes, F.col(label) == F.col("_class")).withColumn("fold", ((F.col("_before") + F.col("_place") - 1) % k).cast("int")).drop("_place", "_before", "_class")


def stratified_shuffles(rows: DataFrame, key: str, label: str, repeats: int = 5, share: float = 0.2, seed=42) -> DataFrame:
    """(fold, split, rows): repeated splits with ceil(share * n) test rows, shared by largest remainder over classes."""
    counts = rows.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    all_ = Window.partitionBy()
    goal = F.ceil(F.lit(share) * F.sum("_n").over(all_))
    counts = counts.withColumn("_goal", goal).withColumn("_ideal", F.round(F.col("_n") * F.col("_goal") / F.sum("_n").over(all_), 9))
    counts = counts.withColumn("_left", F.col("_goal") - F.sum(F.floor("_ideal")).over(all_))
    counts = counts.withColumn("_k", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_ideal") - F.floor("_ideal"), 9)), "_class")))
    counts = counts.select("_class", (F.floor("_ideal") + (F.col("_k") <= F.col("_left")).cast("long")).alias("_test"))
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = Window.partitionBy("fold", label).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "fold", F.col(key).cast("string"))), key)
    each = each.withColumn("_k", F.row_number().over(order)).join(counts, F.col(label) == F.col("_class"))
    return each.withColumn("split", F.when(F.col("_k") <= F.col("_test"), "test").otherwise("train")).drop("_k", "_test", "_class")


def grouped(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label): one row for each group; a group takes its least label."""
    return rows.groupBy(group).agg(F.min(label).alias(label))


def grouped_folds(rows: DataFrame, group: str, label: str, k: int = 5, seed=42) -> DataFrame:
    """Rows with fold; all rows of a group are in one."""
    folds = stratified_folds(grouped(rows, group, label), group, label, k, seed)
    return rows.join(folds.select(group, "fold"), group)


def grouped_shuffles(rows: DataFrame, group: str, label: str, **how) -> DataFrame:
    splits = stratified_shuffles(grouped(rows, group, label), group, label, **how)
    return rows.join(splits.select(group, "fold", "split"), group)


def holdout(rows: DataFrame, centre: str) -> DataFrame:
    """(fold, split, rows): for each centre in turn, its rows are the test."""
    folds = rows.select(F.col(centre).alias("fold")).distinct()
    return rows.crossJoin(F.broadcast(folds) if folds.count() <= 1000 else folds).withColumn("split", F.when(F.col(centre) == F.col("fold"), "test").otherwise("train"))


def resolve_folds(folds: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Saved folds (fold, split, name) with the rows of their names; an unknown name is an error when it is read."""
    both = folds.join(rows.withColumn("_known", F.lit(True)), name, "left")
    unknown = F.raise_error(F.concat(F.lit("a fold names the unknown "), F.col(name)))
    return both.withColumn(name, F.when(F.col("_known"), F.col(name)).otherwise(unknown.cast(rows.schema[name].dataType))).drop("_known")


def group_column(name: Column) -> Column:
    """The group that a name implies: ``patient_`` and its number, or the first three parts between dashes."""
    number = F.regexp_extract(name, r"^(patient_\d+)", 1)
    three = F.regexp_extract(name, r"^([^-]+-[^-]+-[^-]+)", 1)
    return F.when(number != "", number).when(three != "", three)
