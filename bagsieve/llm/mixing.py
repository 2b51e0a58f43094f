"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies.  The expectations are summed along the
source, one offset drawn per source is added, and a document is emitted once for every integer that its step of
the sum crosses.  The order within a source is (size class, three digits of a hash of the id, size, id), which is nearly that of the size:
documents of every size then get their share evenly, so that the words taken come near the target, not only
the documents.

The running sum needs no single task per source.  A row's place is its place within its (source, size class,
hash class) plus the rows of the classes before it.  There are 4096 hash classes, so that documents of one size spread,
too; only the classes that have rows are in the table that is summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import fresh, other_columns_apart
from .scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: str = "size") -> Column:
    """Sixteen classes for each power of two, ascending with the size."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.when(bits > 5, F.expr(f"cast(shiftright(`{size}`, length(bin(`{size}`)) - 5) & 15 AS int)")).otherwise(0)).cast("int")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Water-filled targets for a table (source, source_size), one row per source.

    Sources share ``share`` times the sum of all sizes by weight; none gets more than ``cap`` times its size, and
    what that leaves over goes to the others by weight until none is above.  Sources fill up in the order of
    cap / weight, so the level follows from running sums over the sources alone.  A source of size 0 gets 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(cap))
    full = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("rest", F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("open_weight"))
        .withColumn("is_full", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    # The first source in this order that isn't full fixes the level of all after it.
    level = F.min(F.when(~F.col("is_full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())["level"]
    target = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


@other_columns_apart("doc_id", "source", made=("size", "source_size", "target", "copies", "taken"))
def mix(docs: DataFrame, text: str = "text", seed: str = "mix", **shares) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size * copies).

    Null text has size 0 and is placed like any other; null source is a source, last in order; a null doc_id is
    placed as the empty string.  Repeated rows are sampled as separate documents; rows of equal size and doc_id stand
    in the order of a hash of all their columns, so that only rows equal in all could change places.  An empty table
    gives none.  Columns of those five names that ``docs`` already has are replaced.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*own)
    key, kind, digits, place, key_, kind_, digits_, before = fresh(docs.withColumns({c: F.lit(0) for c in own}), "key", "kind", "digits", "place", "key_of", "kind_of", "digits_of", "before")
    rows = docs.withColumn("size", word_count(F.col(text)))
    rows = rows.withColumn(kind, size_class()).withColumn(digits, F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 3))
    # A key without nulls lets the join below use the partitioning of the window: rows move once.
    rows = rows.withColumn(key, F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")))
    classes = rows.groupBy("source", F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(digits).alias("digits")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    classes = written(classes, "mix-classes")  # words are counted once for it and once for the rows
    earlier = Window.partitionBy("source").orderBy("kind", "digits").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), **shares)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("\u0000")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    plan = (
        classes.alias("c")
        .join(targets.alias("t"), F.expr("c.source <=> t.source"))
        .select(F.col("c.key").alias(key_), F.col("c.kind").alias(kind_), F.col("c.digits").alias(digits_), F.col("before").alias(before), "t.source_size", "t.target")
    )
    within = Window.partitionBy(key, kind, digits).orderBy("size", "doc_id", F.xxhash64(*(F.col(c).cast("string") if "map<" in kind_of else F.col(c) for c, kind_of in docs.dtypes)))
    placed = rows.withColumn(place, F.row_number().over(within))
    placed = placed.join(plan, (F.col(key) == F.col(key_)) & (F.col(kind) == F.col(kind_)) & (F.col(digits) == F.col(digits_)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col(place) + F.col(before)
    copies = (F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset)).cast("long")
    placed = placed.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return placed.select(*docs.columns, *own)


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes, numbered from 1 in ``copy`` (a column of that name is replaced)."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


#: DuckDB's form of the query.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  substr(md5(doc_id::VARCHAR), 1, 3) AS h FROM documents),
k AS (SELECT *, b * 16 + CASE WHEN b > 5 THEN (size >> (b - 5)) & 15 ELSE 0 END AS c FROM (SELECT *, (CASE WHEN size = 0 THEN 1 ELSE length(bin(size)) END)::INT AS b FROM d)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE NOT cap <= level * weight ORDER BY cap / weight, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * weight, cap))::DOUBLE AS target,
             ('0x' || substr(md5('mix|' || coalesce(source, chr(0))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u FROM l),
p AS (SELECT k.*, row_number() OVER (PARTITION BY source ORDER BY c, h, size, doc_id) AS place FROM k)
SELECT p.doc_id, p.size, t.source_size, t.target,
       (p.size * (floor(place * (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) + u)
        - floor((place - 1) * (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) + u)))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
