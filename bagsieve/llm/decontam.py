"""Benchmark decontamination with DataFrame operations only.

The n-grams of the benchmark become a hash set that travels with the tasks.  Every window of training tokens is
hashed inside its row and looked up there, so that a document leaves its row only with the few windows that hit;
those are then compared by their words with the benchmark's (a broadcast join on the distinct texts of windows), which
makes the result independent of hash collisions.  Items are joined to the windows that were hit after that, by
shuffle: however many items share a window, it is shipped once.

The set is shipped only while it has at most ``SET_BOUND`` windows, which is counted first.  Beyond that, window
hashes of the documents are joined with those of the benchmark by shuffle, and the rest is the same.

The scan hashes the text lowered by ``lower()``, which is quick but lowers more than A-Z.  Only the capital sigma has a
lower case that depends on its neighbours, so it is replaced first; what is left is letter by letter.  Texts
that are equal with A-Z lowered are thus equal there too, and no letter turns into a separator or back, so no hit is
lost; the comparison of words then uses A-Z only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh, other_columns_apart

GRAM = 10
#: Windows of the benchmark that are shipped to the tasks at most (about 8 MB of longs as a set).
SET_BOUND = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, before A-Z is lowered.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def _plain(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _scan_form(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def benchmark_windows(items: DataFrame, gram: int = GRAM, text: str = "text") -> DataFrame:
    """(item_id, len, window, hash): every window of ``gram`` words, or the whole of a shorter item."""
    rows = items.select("item_id", _tokens(_plain(F.col(text))).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("len", F.least(F.size("w"), F.lit(gram)))
    rows = rows.select("item_id", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    rows = rows.select("item_id", "len", F.slice("w", F.col("at"), F.col("len")).alias("part"))
    # The scan lowers more than A-Z, so the looked-up hash is that of the fully lowered words.
    hashed = F.xxhash64(F.transform("part", _scan_form))
    return rows.select("item_id", "len", F.array_join("part", " ").alias("window"), hashed.alias("hash")).distinct()


def _set_scan(rows: DataFrame, by_len: dict[int, list[int]]) -> DataFrame:
    """Adds cand: the (at, len) whose window hash is in the set."""
    parts = [
        f"CASE WHEN n_words >= {size} THEN transform(filter(sequence(1, n_words - {size - 1}), i -> xxhash64(slice(_low, i, {size})) IN ({', '.join(f'{h}L' for h in hashes)})), i -> struct(i AS at, {size} AS len)) ELSE array() END"
        for size, hashes in sorted(by_len.items())
    ]
    none = "cast(array() AS array<struct<at:int,len:int>>)"
    return rows.withColumn("cand", F.expr(f"concat({', '.join([*parts, none])})"))


def _join_scan(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same by a shuffled join, for benchmarks beyond SET_BOUND."""
    each = [
        rows.where(F.col("n_words") >= size).select("doc_id", "_row", F.lit(size).alias("len"), F.expr(f"posexplode(transform(sequence(1, n_words - {size - 1}), i -> xxhash64(slice(_low, i, {size}))))").alias("at", "hash"))
        for size in sizes
    ]
    union = each[0]
    for more in each[1:]:
        union = union.unionByName(more)
    keys = windows.select(F.col("hash").alias("_h"), F.col("len").alias("_l")).distinct()
    hits = union.join(keys, (F.col("hash") == F.col("_h")) & (F.col("len") == F.col("_l")), "left_semi")
    hits = hits.groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_r")).agg(F.collect_set(F.struct((F.col("at") + 1).alias("at"), "len")).alias("cand"))
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_row").eqNullSafe(F.col("_r")), "left").drop("_id", "_r").withColumn("cand", F.coalesce("cand", F.expr("cast(array() AS array<struct<at:int,len:int>>)")))


def hits(docs: DataFrame, items: DataFrame, gram: int = GRAM, text: str = "text", set_bound: int = SET_BOUND, with_items: bool = True) -> DataFrame:
    """Per doc_id: n_words, hits (sorted distinct (at, len), words counted from 1) and items (sorted strings).

    Null and empty texts have no words.  Rows that repeat a doc_id are one document: the hits unite and n_words is
    the largest.  Each row with a null doc_id is a document of its own.  Empty tables give empty results or no hits.
    ``with_items=False`` leaves the items out.
    """
    windows = benchmark_windows(items, gram)
    known = windows.groupBy("len").agg(F.countDistinct("window").alias("n")).collect()  # at most ``gram`` rows
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = docs.select("doc_id", row.alias("_row"), F.col(text).alias("_text")).withColumn("_low", _tokens(_scan_form(F.col("_text")))).withColumn("n_words", F.size("_low"))
    table = windows.select(F.col("window").alias("_w")).distinct()
    if sum(r["n"] for r in known) <= set_bound:
        by_len: dict[int, list[int]] = {}
        for size, h in windows.select("len", "hash").distinct().collect():
            by_len.setdefault(size, []).append(h)
        rows = _set_scan(rows, by_len)
        table = F.broadcast(table)
    else:
        rows = _join_scan(rows, windows, [r["len"] for r in known])
    rows = rows.withColumn("_own", F.when(F.size("cand") > 0, _tokens(_plain(F.col("_text")))))
    found = F.when(F.size("_own") > 0, F.transform("cand", lambda c: F.struct(c["at"].alias("at"), c["len"].alias("len"), F.array_join(F.slice("_own", c["at"], c["len"]), " ").alias("window"))))
    rows = rows.select("doc_id", "_row", "n_words", F.explode_outer(found).alias("hit"))
    rows = rows.join(table, F.col("hit.window") == F.col("_w"), "left")
    is_hit = F.col("_w").isNotNull()
    rows = rows.groupBy("doc_id", "_row").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(is_hit, F.struct("hit.at", "hit.len")))).alias("hits"),
        F.collect_set("_w").alias("_windows"),
    )
    if not with_items:
        return rows.select("doc_id", "n_words", "hits")
    told = rows.where(F.size("_windows") > 0).select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r"), F.explode("_windows").alias("window")).join(windows.select("item_id", "window"), "window")
    told = told.groupBy("_id", "_r").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = rows.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_row").eqNullSafe(F.col("_r")), "left")
    return rows.select("doc_id", "n_words", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(found: Column) -> Column:
    """Words inside any of the sorted (at, len)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, h: Column) -> Column:
        end = h["at"] + h["len"]
        more = F.greatest(F.lit(0), end - F.greatest(h["at"], acc["end"]))
        return F.struct((acc["n"] + more).cast("long").alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(found, start, step)["n"]


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    rows = hits(docs, items, **how).withColumn("n_hit", covered(F.col("hits")))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with what tells its documents apart: the doc_id, or the text where that is null."""
    own = F.concat(F.lit("t"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return docs.withColumn(key, F.when(F.col("doc_id").isNull(), own).otherwise(F.concat(F.lit("i"), F.col("doc_id").cast("string"))))


@other_columns_apart("doc_id")
def remove_documents(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that contain a window of the benchmark.

    Rows that repeat a doc_id go or stay together; rows with a null doc_id are judged by their own texts.
    Empty tables give empty results, names of other columns don't matter, very long texts are scanned whole in their row.
    """
    key, bad = fresh(docs, "key", "bad")
    rows = _keyed(docs, key, text)
    found = hits(rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), items, with_items=False, **how)
    return rows.join(found.where(F.size("hits") > 0).select(F.col("doc_id").alias(bad)), F.col(key) == F.col(bad), "left_anti").drop(key)


@other_columns_apart("doc_id")
def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with the hit words, and the gap before each, cut out of the text.

    Rows that repeat a doc_id repeat its text; rows with a null doc_id are judged by their own texts.
    """
    key, bad, at, pieces = fresh(docs, "key", "bad", "at", "pieces")
    rows = _keyed(docs, key, text)
    found = hits(rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), items, with_items=False, **how)
    rows = rows.join(found.where(F.size("hits") > 0).select(F.col("doc_id").alias(bad), F.col("hits").alias(at)), F.col(key) == F.col(bad), "left")
    word = _GAP[:-1].replace("[", "[^", 1) + "+"
    split = F.regexp_extract_all(F.col(text), F.lit(f"(?:{_GAP[:-1]}*{word}|{_GAP}$)"), F.lit(0))
    rows = rows.withColumn(pieces, F.when(F.size(at) > 0, split))
    clean = F.array_join(F.filter(pieces, lambda p, i: ~F.exists(at, lambda h: (i + 1 >= h["at"]) & (i + 1 < h["at"] + h["len"]))), "")
    return rows.withColumn(text, F.when(F.size(pieces) > 0, clean).otherwise(F.col(text))).select(docs.columns)


#: DuckDB's form of the query.
ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
