"""Substring deduplication by seed and extend.

A window is ``WINDOW`` consecutive words; a word goes if a window over it also starts in a document of a smaller id.

Seeds: 5-grams of words, winnowed over 9 places.  Any window of 13 words has 9 such places, so two documents that
share a window share a seed in it, and only a fifth of the places are seeds.  Seeds are joined by their hash.

Extension: with each seed goes a digest of the words around it, as far as windows over the seed can reach (8 to
each side, less at the ends of the text).  Where that extension is equal in a smaller document, all windows over the
seed are repeats and no more is compared; that settles the inside of long repeats, whatever the number of
copies.  The first document of each extension, where others share the seed with another one, is extended window by
window: those few windows meet by two hashes of 64 bits, as do extensions (those of the seed and of the words around
it).  Windows that hang together are one maximal repeat.

Every step is linear in the number of seeds: no pairs of documents are made.  Documents are read three times and
their texts shuffled once (both joins use the same exchange).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .flattext import flat, gram_hashes, mix, slices, span_hashes, value_sums, window_minima, word_hashes, words
from .scratch import written

WINDOW = 13
SEED = 5
#: Places of seeds in a window, and words that a window reaches beyond a seed.
PLACES = WINDOW - SEED + 1
REACH = WINDOW - SEED


def seeds(docs: DataFrame) -> DataFrame:
    """(seed, around, doc_id, at): winnowed seeds, the digest of their extension, and their word position."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, off = flat(batch.column("text"))
            starts, ends, first = words(data, off)
            hashes = word_hashes(data, starts, ends)
            grams = gram_hashes(hashes, SEED)
            count = np.diff(first)
            doc = np.repeat(np.arange(len(count)), count)[: len(grams)]
            at = np.arange(len(grams))
            fits = (at + SEED <= first[doc + 1]) & (count[doc] >= WINDOW)
            chosen = np.flatnonzero(window_minima(np.where(fits, grams, np.uint64(0xFFFFFFFFFFFFFFFF)), PLACES) & fits)
            if not len(chosen):
                continue
            own = doc[chosen]
            low = np.maximum(chosen - REACH, first[own])
            high = np.minimum(chosen + SEED + REACH, first[own + 1])
            around = span_hashes(value_sums(hashes), low, high)
            with np.errstate(over="ignore"):
                around = mix(around + (chosen - low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[chosen].view(np.int64)), pa.array(around.view(np.int64)), pa.array(ids[own]), pa.array((chosen - first[own]).astype(np.int32))],
                names=["seed", "around", "doc_id", "at"],
            )

    return docs.mapInArrow(run, "seed long, around long, doc_id long, at int")


def joined(found: DataFrame) -> DataFrame:
    """(doc_id, settled, open): positions of shared seeds by document; open ones are to be extended by window."""
    rows = found.repartition("seed")
    same, all_ = Window.partitionBy("seed", "around"), Window.partitionBy("seed")
    rows = (
        rows.withColumn("first", F.min("doc_id").over(same))
        .withColumn("lo", F.min("doc_id").over(all_))
        .withColumn("hi", F.max("doc_id").over(all_))
        .withColumn("varied", F.min("around").over(all_) != F.max("around").over(all_))
    )
    rows = rows.where("lo < hi AND (first < doc_id OR varied)")
    settled = F.col("first") < F.col("doc_id")
    return rows.groupBy("doc_id").agg(F.collect_list(F.when(settled, F.col("at"))).alias("settled"), F.collect_list(F.when(~settled, F.col("at"))).alias("open"))


def open_windows(rows: DataFrame) -> DataFrame:
    """(window, check, doc_id, start) of every window over an open seed, for rows (doc_id, text, open)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, off = flat(batch.column("text"))
            starts, ends, first = words(data, off)
            hashes = word_hashes(data, starts, ends)
            windows, checks = gram_hashes(hashes, WINDOW), gram_hashes(hashes, WINDOW, 0x51ED270B)
            lists = batch.column("open")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy().astype(np.int64)
            spread = (at[:, None] - np.arange(REACH + 1)[None, :]).ravel()
            doc = np.repeat(doc, REACH + 1)
            fits = (spread >= 0) & (spread + WINDOW <= np.diff(first)[doc])
            key = np.unique(first[doc[fits]] + spread[fits])
            if not len(key):
                continue
            doc = np.searchsorted(first, key, "right") - 1
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[key].view(np.int64)) for x in (windows, checks)), pa.array(ids[doc]), pa.array((key - first[doc]).astype(np.int32))], names=["window", "check", "doc_id", "start"]
            )

    return rows.mapInArrow(run, "window long, check long, doc_id long, start int")


def repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with settled (seed positions) and starts (of repeated windows); null if none."""
    shared = written(joined(seeds(docs.where("doc_id IS NOT NULL"))), "substring-seeds")
    opened = open_windows(docs.join(shared.where(F.size("open") > 0).select("doc_id", "open"), "doc_id").select("doc_id", "text", "open"))
    opened = opened.withColumn("first", F.min("doc_id").over(Window.partitionBy("window", "check"))).where("first < doc_id")
    starts = opened.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    return docs.join(shared.select("doc_id", "settled"), "doc_id", "left").join(starts, "doc_id", "left").select("doc_id", "text", "settled", "starts")


def removed_words(count: int, settled, starts) -> np.ndarray:
    """Which of ``count`` words lie in a repeated window."""
    if count < WINDOW:
        return np.zeros(count, bool)
    edge = np.zeros(count + 1, np.int64)
    for at in (np.asarray(settled if settled is not None else (), np.int64),):
        low, high = np.maximum(at - REACH, 0), np.minimum(at, count - WINDOW)
        fits = low <= high
        np.add.at(edge, low[fits], 1)
        np.add.at(edge, high[fits] + WINDOW, -1)
    at = np.asarray(starts if starts is not None else (), np.int64)
    at = at[at + WINDOW <= count]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, kept, n_words, n_removed, n_repeats): the words left, joined by one space.

    Null text has no words; texts of fewer than 13 words lose none.  A row with a null doc_id loses none and is not
    looked at for others, as it has no place in the order.  Rows that repeat a doc_id repeat its text and give a row each; they aren't repeats
    of one another.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, count, removed, runs = [], [], [], []
            for t, settled, starts in zip(batch.column("text"), batch.column("settled"), batch.column("starts")):
                own = (t.as_py() or "").encode().split()
                count.append(len(own))
                if not settled.is_valid and not starts.is_valid:
                    kept.append(b" ".join(own))
                    removed.append(0)
                    runs.append(0)
                    continue
                gone = removed_words(len(own), settled.values.to_numpy() if settled.is_valid else None, starts.values.to_numpy() if starts.is_valid else None)
                kept.append(b" ".join([own[k] for k in np.flatnonzero(~gone)]))
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
                names=["doc_id", "kept", "n_words", "n_removed", "n_repeats"],
            )

    return repeats(rows).mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long, n_repeats long")


#: DuckDB's form of the query.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM x JOIN m USING (g) WHERE first < doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
j AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) FILTER (WHERE r.k IS NULL) AS kept, count(r.k) AS n_removed FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.k = r.k GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""
