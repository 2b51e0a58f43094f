"""Audit of filters that are applied one after another: what each removes, by part and in every order.

Five flags tell by which filters a document fails.  One pass makes them; counting documents by part and flags leaves at most
32 cells (times labels) for each part.  A CUBE over part and the flags then has a row for every subset of filters, and the row in which all of a
subset's flags are false counts the survivors of that subset.  A step of an order is a pair of subsets, without and with
its filter, so all orders come from joins of the survivors with themselves.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .mixing import WORD
from .scratch import written

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails: A fewer than 200 words, B under half of its words distinct, C over 2 % of its characters in A-Z,
    D any of ``#$%&*|``. An empty text fails by A only."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.length(text) * 2,
        "D": F.length(text) > F.length(F.translate(text, "#$%&*|", "")),
    }


def cells(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """Documents counted by part and the flags A to E: part, A .. E, n, good, toxic.

    E: some smaller doc_id has an equal text, wherever it is. Null text counts as empty and null part as the empty string; a
    null doc_id has no smaller one and is none. Rows that repeat a doc_id are counted one by one; a document is good or toxic if any label row of its id
    says so. Texts are told apart by SHA-256 and don't move; a text's rows are counted by id before they meet, and
    what meets of one text is a row for each of its parts and labels.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    told = labels.groupBy(F.col("doc_id").alias("id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), *(c.alias(n) for n, c in failures(body).items()))
    rows = rows.join(told, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["digest", "part", "A", "B", "C", "D", "good", "toxic"]
    by_id = rows.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"), first.alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    by_text = by_text.withColumn("fresh", F.col("without_id") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("fresh").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("fresh")).alias("n"))))
    counted = by_text.select(*kind[1:], split.alias("two")).select("part", "A", "B", "C", "D", "two.E", "good", "toxic", "two.n")
    return counted.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("good", "toxic")))


def survivors(counted: DataFrame) -> DataFrame:
    """Per part and subset of filters (a bit each, A the lowest): documents that fail none of them; zeros included."""
    cube = counted.cube("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in COUNTS), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"no_{f}") for f in FILTERS))
    passes = F.lit(True)
    mask = F.lit(0)
    for k, f in enumerate(FILTERS):
        passes &= (F.col(f"no_{f}") == 1) | ~F.col(f)
        mask += F.when(F.col(f"no_{f}") == 0, 1 << k).otherwise(0)
    found = cube.where((F.col("all_parts") == 0) & passes).select("part", mask.alias("mask"), *COUNTS)
    every = counted.select("part").distinct().withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))))
    return every.join(found, ["part", "mask"], "left").fillna(0, list(COUNTS))


def audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """One row per part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    See ``cells`` for nulls, repeats and ties. Very long texts cost their length; columns beyond those named play no part; without documents there are
    no rows, without labels nothing good or toxic is lost.
    """
    counted = written(cells(docs, labels, **names), "audit-cells")
    known = written(survivors(counted), "audit-survivors")
    k, every = len(FILTERS), 2 ** len(FILTERS) - 1
    bits = F.array(*(F.lit(1 << i) for i in range(k)))
    before = known.withColumn("bit", F.explode(F.filter(bits, lambda b: F.col("mask").bitwiseAND(b) == 0)))
    after = known.select("part", F.col("mask").alias("mask_after"), *(F.col(c).alias(f"{c}_after") for c in COUNTS))
    pairs = before.withColumn("mask_after", F.col("mask").bitwiseOR(F.col("bit"))).join(after, ["part", "mask_after"])
    weights = F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)))
    pairs = pairs.withColumn("removed", F.col("n") - F.col("n_after")).withColumn("weighted", F.element_at(weights, F.bit_count("mask") + 1) * F.col("removed"))
    one = pairs.groupBy("part", "bit").agg(
        F.max(F.when(F.col("mask") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("mask_after") == every, F.col("removed"))).alias("unique_fails"),
        F.sum("weighted").alias("shapley"),
    )
    steps = [("".join(order), i + 1, sum(1 << FILTERS.index(f) for f in order[:i]), 1 << FILTERS.index(order[i])) for order in permutations(FILTERS) for i in range(k)]
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, mask int, bit int")
    return (
        pairs.join(one, ["part", "bit"])
        .join(F.broadcast(steps), ["mask", "bit"])
        .select(
            "part", "filter_order", "step", F.col("n_after").alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
            (F.col("good") - F.col("good_after")).alias("good_lost"), (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"), F.col("shapley").cast("long").alias("shapley"),
        )
    )


#: DuckDB's form of the query.
ORACLE = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
g AS (SELECT c.*, filter_order, coalesce((SELECT min(i) FROM range(1, 6) r(i) WHERE contains(fails, filter_order[i])), 6) AS gone FROM c, o),
s AS (SELECT part, filter_order, step::INT AS step, filter_order[step] AS f, sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN gone < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM g, range(1, 6) r(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM s
"""
