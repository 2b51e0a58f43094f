"""Classification metrics, aggregation of runs, a linear probe, and measures between two sets of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import softmax
from . import pairs, relations


def confusion(rows: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def class_scores(rows: DataFrame) -> DataFrame:
    """(class, precision, recall, f1) of every class that is true or predicted; 0 where a share is of nothing."""
    cells = confusion(rows)
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.lit("t").alias("side")), F.struct(F.col("p").alias("class"), F.lit("p").alias("side")))).alias("c"), "n", (F.col("y") == F.col("p")).alias("right"))
    by = sides.groupBy("c.class").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for c, a in ((F.col("c.side") == "t", "t"), (F.col("c.side") == "p", "p"), ((F.col("c.side") == "t") & F.col("right"), "tp"))])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return by.select("class", share(F.col("tp"), F.col("p")).alias("precision"), share(F.col("tp"), F.col("t")).alias("recall"), share(2 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"))


def macro(rows: DataFrame) -> DataFrame:
    return class_scores(rows).agg(*[F.avg(c).alias("macro_" + c) for c in ("precision", "recall", "f1")])


def _areas(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auroc) for (keys, positive, score): the share of pairs in the right order, ties half; NaN without pairs.

    Counts by distinct score come first, so that what is ranked is scores, not rows.
    """
    by = rows.groupBy(*keys, "score").agg(F.sum(F.col("positive").cast("long")).alias("pos"), F.sum((~F.col("positive")).cast("long")).alias("neg"))
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    sums = by.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2.0)).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).otherwise(F.lit(float("nan"))).alias("auroc"))


def auroc_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auroc) of each group of (keys, positive, score); NaN for a group of one class."""
    return _areas(rows, keys)


def auroc(rows: DataFrame) -> DataFrame:
    """One AUROC for (positive, score)."""
    return _areas(rows.withColumn("_all", F.lit("all")), ["_all"]).select("auroc")


def auroc_rest(rows: DataFrame, scores: str = "scores") -> DataFrame:
    """(class, auroc), each class against the rest, for (y, scores)."""
    each = rows.select("y", F.posexplode(scores).alias("class", "score"))
    return _areas(each.select("class", (F.col("y") == F.col("class")).alias("positive"), "score"), ["class"])


def auroc_pairs(rows: DataFrame, classes: int, scores: str = "scores") -> DataFrame:
    """(a, b, auroc) of each pair of classes: the mean of both directions, rows of the two classes only."""
    others = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(c.alias("other")))
    each = rows.select("y", scores, F.explode(others).alias("o")).select("y", F.col("o.other").alias("other"), scores).where("y <> other")
    pair = [F.least("y", "other").alias("a"), F.greatest("y", "other").alias("b")]
    both = each.select(*pair, F.explode(F.array(F.struct(F.lit(0).alias("way"), (F.col("y") < F.col("other")).alias("positive"), F.get(scores, F.least("y", "other")).alias("score")), F.struct(F.lit(1).alias("way"), (F.col("y") > F.col("other")).alias("positive"), F.get(scores, F.greatest("y", "other")).alias("score")))).alias("d")).select("a", "b", "d.*")
    return _areas(both, ["a", "b", "way"]).groupBy("a", "b").agg(F.avg("auroc").alias("auroc"))


def run_aggregate(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, mean, std, n) with the population's deviation; NaN is skipped and groups of NaN alone vanish."""
    real = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*keys).agg(F.avg(real).alias("mean"), F.stddev_pop(real).alias("std"), F.count(real).alias("n")).where("n > 0")


def two_level_aggregate(rows: DataFrame, keys: list[str], fold: str, value: str = "value") -> DataFrame:
    """Means over the runs of a fold first, then mean and deviation over folds."""
    folds = run_aggregate(rows, [*keys, fold], value).select(*keys, fold, F.col("mean").alias("value"))
    return run_aggregate(folds, keys)


def costs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kept, latency, latency_each): mean of rows kept, and the seconds in all and for each row of (kept, seconds)."""
    return rows.groupBy(*keys).agg(F.avg("kept").alias("kept"), F.sum("seconds").alias("latency"), F.avg("seconds").alias("latency_each"))


def evaluation(rows: DataFrame, scores: str = "scores") -> DataFrame:
    """One row (loss, accuracy, n) of (y, p, scores): mean cross-entropy of the softmax, and the share of right ones."""
    loss = -F.log(F.get(softmax(scores), F.col("y")))
    return rows.agg(F.avg(loss).alias("loss"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def told(mean, std, digits: int = 4):
    """mean +- std with fixed digits."""
    return F.format_string(f"%.{digits}f +- %.{digits}f", mean, std)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, weight) with weight n / (classes * n of the class)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy()
    return counts.select(label, (F.sum("n").over(all_) / (F.count(F.lit(1)).over(all_) * F.col("n"))).alias("weight"))


def fit_probe(train: DataFrame, label: str = "label", cost: float = 1.0):
    """A balanced logistic regression on scaled vectors ``x``, as a model that can be saved.

    Scaling uses the population's deviation, and the penalty is that of ``cost`` for a sum over rows.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    n = train.count()
    weights = class_weights(train, label)
    data = train.select(label, array_to_vector("x").alias("raw")).join(F.broadcast(weights), label)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(data)
    # The scaler divides by the sample's deviation; as all entries shrink alike, the penalty takes the difference.
    factor = n / max(n - 1, 1)
    model = LogisticRegression(labelCol=label, weightCol="weight", standardization=False, regParam=1.0 / (cost * n) / factor, maxIter=200, probabilityCol="_probs", predictionCol="_p").fit(scaler.transform(data))
    return PipelineModel([scaler, model])


def apply_probe(model, test: DataFrame) -> DataFrame:
    """``test`` with probs and p of a fitted probe."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    found = model.transform(test.withColumn("raw", array_to_vector("x")))
    return found.withColumn("probs", vector_to_array("_probs")).withColumn("p", F.col("_p").cast("int")).select(*test.columns, "probs", "p")


def linear_probe(train: DataFrame, test: DataFrame, label: str = "label", cost: float = 1.0) -> DataFrame:
    """``test`` with probs and p: fitted on ``train`` and applied."""
    return apply_probe(fit_probe(train, label, cost), test)


def smoothed(rows: DataFrame, order: str, value: str, count: str, window: int = 20) -> DataFrame:
    """Rows with average (running, weighted by count) and median of the last ``window`` values."""
    by = Window.partitionBy("series").orderBy(order)
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    last = by.rowsBetween(-(window - 1), 0)
    rows = rows.withColumn("average", F.sum(F.col(value) * F.col(count)).over(run) / F.sum(count).over(run))
    rows = rows.withColumn("_last", F.array_sort(F.collect_list(value).over(last)))
    half = F.size("_last") / 2
    middle = (F.get("_last", F.ceil(half).cast("int") - 1) + F.get("_last", F.floor(half).cast("int"))) / 2
    return rows.withColumn("median", middle).drop("_last")


def best_epoch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, epoch, score) of the largest auroc + f1, the first on ties."""
    score = F.round(F.col("auroc") + F.col("f1"), 9)
    return rows.groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.col("epoch")).alias("minus"))).alias("m")).select(*keys, (-F.col("m.minus")).alias("epoch"), "m.score")


def linear_cka(pairs: DataFrame, a: str = "xa", b: str = "xb") -> DataFrame:
    """One row cka of centred linear kernels, from sums of products of entries.

    Each task sums the products of its rows in numpy and gives one row for each entry, whatever the number of rows;
    these are summed by place.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = cross = None
        n = 0
        for batch in batches:
            if batch.num_rows:
                both = np.hstack([batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in range(2)])
                sums, cross = (both.sum(0), both.T @ both) if cross is None else (sums + both.sum(0), cross + both.T @ both)
                n += batch.num_rows
        if n:
            for i in range(len(sums)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([sums[i]]), pa.array([cross[i]], pa.list_(pa.float64()))], names=["i", "n", "s", "products"])

    parts = pairs.select(F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b")).mapInArrow(products, "i int, n long, s double, products array<double>")
    means = parts.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    width = pairs.select(F.size(a).alias("width")).limit(1)
    cross = parts.select("i", F.posexplode("products").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    rows = cross.join(means, "i").join(means.select(F.col("i").alias("j"), F.col("mean").alias("other")), "j").crossJoin(F.broadcast(width))  # one row
    square = F.pow(F.col("v") - F.col("n") * F.col("mean") * F.col("other"), 2)
    left, right = F.col("i") < F.col("width"), F.col("j") < F.col("width")
    part = lambda where: F.sum(F.when(where, square))
    return rows.agg((part(left & ~right) / (F.sqrt(part(left & right)) * F.sqrt(part(~left & ~right)))).alias("cka"))


def pairwise_mse(rows: DataFrame, key: str) -> DataFrame:
    """(key, mse) of the distances of two sets of vectors over the pairs of each batch."""
    return pairs.mean_squared_gap(rows, key)


def relation_kl(rows: DataFrame, key: str, temperature: float = 4.0) -> DataFrame:
    """(key, kl): mean over rows of KL(teacher || student) of tempered softmaxes of the products, times T squared."""
    return relations.structure_loss(rows, key, (temperature,), distance=False, scaled=False).select(key, F.col("affinity").alias("kl"))


def softmax_pool(rows: DataFrame, key: str, score: str) -> DataFrame:
    """(key, pooled): mean of the vectors ``x`` weighted by the softmax of the scores of a bag.

    Sums are weighted with exp(score - largest), so a bag's rows needn't meet.
    """
    top = rows.groupBy(key).agg(F.max(score).alias("_top"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    both = rows.join(top, key).withColumn("_w", F.exp(F.col(score) - F.col("_top")))
    return both.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector("x"), F.col("_w"))).alias("pooled"))


def predicted(rows: DataFrame, logits: str) -> DataFrame:
    return rows.withColumn("probs", softmax(logits))


def half_cosine(epoch, rate: float, least: float, warm: float, total: float):
    """Learning rate at an epoch: linear up to ``warm``, then half a cosine down to ``least``."""
    return F.when(epoch < warm, rate * epoch / warm).otherwise(least + (rate - least) * 0.5 * (1.0 + F.cos(F.lit(3.141592653589793) * (epoch - warm) / (total - warm))))


def cosine_schedule(step, total: int, warm: int, least: float):
    """Factor at a step: linear from 0 over ``warm`` steps, then half a cosine, not below ``least``."""
    progress = F.least(F.greatest((step - warm) / float(max(total - warm, 1)), F.lit(0.0)), F.lit(1.0))
    after = F.lit(1.0) if warm >= total else F.greatest(F.lit(least), 0.5 * (1.0 + F.cos(F.lit(3.141592653589793) * progress)))
    return F.when(step < warm, step / float(max(warm, 1))).otherwise(after)
