"""Suffix-array deduplication of repeated byte strings over a length, across a corpus.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else.  A suffix array of all positions
isn't needed for that: positions are sampled so that every such string holds a sample at the same place in all its
copies (the least hash of 32 bytes in 369 places), and only suffixes that start at samples are sorted.

1. Samples are joined by the hash of their 32 bytes; one that stands alone repeats nothing.
2. With each sample goes a digest of all text that strings over it can reach.  Where it is equal for two samples, all
   strings over both are repeats; one of them stands for the rest below.
3. Where samples agree in their 32 bytes but not in that text, a string over both has more than half of its
   bytes on one side: the samples then agree in the 216 bytes to the right or in the 184 to the left, and those
   that do form a group for that side.  In each group the texts to the right and to the left are sorted by
   deep-shallow sorting (suffix_sort), and the order tells which strings are repeats.
   Groups of more than ``GROUP`` different texts don't go to one task: their strings meet by hash instead.

Documents' texts are shuffled once: both joins use the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .flattext import SLICE_BYTES, flat, mix, prefix_sums, slices, span_hashes, window_minima
from .scratch import written
from .suffix_sort import repeated_starts

LENGTH = 400
SAMPLE = 32
#: Different texts around one sample that one task sorts at most (16 MB).
GROUP = 20_000


def samples(docs: DataFrame, length: int) -> DataFrame:
    """(seed, around, right, left, doc_id, at): sampled byte positions and hashes of what is around them.

    seed is that of the sample, around that of all text in reach, right and left those of the near text to one
    side, or null where the text ends before.
    """
    ship(docs.sparkSession)
    places = length - SAMPLE + 1
    near_left, near_right = _near(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, off, shift, low_core, high_core in (part for batch in slices(batches) for part in _parts(batch, 2 * length)):
            if len(data) < length:
                continue
            sums = prefix_sums(data)
            at = np.arange(len(data) - SAMPLE + 1)
            hashes = span_hashes(sums, at, at + SAMPLE)
            size = np.diff(off)
            doc = np.repeat(np.arange(len(size)), size)[: len(at)]
            fits = (at + SAMPLE <= off[doc + 1]) & (size[doc] >= length)
            chosen = np.flatnonzero(window_minima(np.where(fits, hashes, np.uint64(0xFFFFFFFFFFFFFFFF)), places) & fits)
            chosen = chosen[(chosen >= low_core) & (chosen < high_core)]
            if not len(chosen):
                continue
            own = doc[chosen]
            low, high = np.maximum(chosen - (length - SAMPLE), off[own]), np.minimum(chosen + length, off[own + 1])
            around = span_hashes(sums, low, high)
            with np.errstate(over="ignore"):
                around = mix(around + (chosen - low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            right = span_hashes(sums, chosen, np.minimum(chosen + near_right, high))
            left = span_hashes(sums, np.maximum(chosen - near_left, low), chosen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[chosen].view(np.int64)),
                    pa.array(around.view(np.int64)),
                    pa.array(right.view(np.int64), mask=chosen + near_right > high),
                    pa.array(left.view(np.int64), mask=chosen - near_left < low),
                    pa.array(ids[own]),
                    pa.array((chosen + shift - off[own]).astype(np.int32)),
                ],
                names=["seed", "around", "right", "left", "doc_id", "at"],
            )

    return docs.mapInArrow(run, "seed long, around long, right long, left long, doc_id long, at int")


def _parts(batch: pa.RecordBatch, margin: int) -> Iterator[tuple]:
    """(doc_ids, bytes, offsets, shift, core's start and end) of a slice; long texts come in parts that overlap.

    Places of the core have ``margin`` bytes around them, or the end of the text.
    """
    data, off = flat(batch.column("text"))
    ids = batch.column("doc_id").to_numpy()
    if len(data) <= 4 * SLICE_BYTES:
        yield ids, data, off, 0, 0, len(data)
        return
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        for at in range(a, b, SLICE_BYTES):
            low, high = max(a, at - margin), min(b, at + SLICE_BYTES + margin)
            yield ids[k : k + 1], data[low:high], np.array([0, high - low]), low - a, at - low, min(b, at + SLICE_BYTES) - low


def _near(length: int) -> tuple[int, int]:
    """Bytes to the left and to the right of a sample of which strings over it have all of one or the other."""
    left = (length - SAMPLE) // 2
    return left, length - left


def joined(found: DataFrame, group: int) -> DataFrame:
    """(doc_id, settled, open): by document, positions of samples that are repeats as far as strings reach, and
    (at, key, side, wide) of those to be compared, once for each side on which others agree."""
    rows = found.repartition("seed")
    same = Window.partitionBy("seed", "around")
    rows = rows.withColumn("equal", F.count(F.lit(1)).over(same)).withColumn("one", (F.row_number().over(same.orderBy("doc_id", "at")) == 1).cast("int"))
    for side in ("right", "left"):
        rows = rows.withColumn("n_" + side, F.when(F.col(side).isNotNull(), F.sum("one").over(Window.partitionBy("seed", side))).otherwise(0))
    rows = rows.where("equal > 1 OR n_right > 1 OR n_left > 1")

    def entry(side: str):
        n = F.col("n_" + side)
        return F.when((F.col("one") == 1) & (n > 1), F.struct("at", F.xxhash64("seed", side).alias("key"), F.lit(side).alias("side"), (n > group).alias("wide")))

    rows = rows.select("doc_id", F.when(F.col("equal") > 1, F.col("at")).alias("at"), F.filter(F.array(entry("right"), entry("left")), lambda x: x.isNotNull()).alias("open"))
    return rows.groupBy("doc_id").agg(F.collect_list("at").alias("settled"), F.flatten(F.collect_list("open")).alias("open"))


def snippets(rows: DataFrame, length: int) -> DataFrame:
    """(key, wide, doc_id, at, left, right): the text around open samples, left reversed, for (doc_id, text, open).

    A group of the right side is for strings with the near text to the right, one of the left for all others.
    """
    ship(rows.sparkSession)
    near_left, near_right = _near(length)
    reach = {"right": (near_left, length), "left": (length - SAMPLE, near_right - 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("open").to_pylist()):
                raw = (text or "").encode()
                for x in found:
                    at, (back, ahead) = x["at"], reach[x["side"]]
                    for to, v in zip(out, (x["key"], x["wide"], doc, at, raw[max(0, at - back) : at][::-1], raw[at : at + ahead])):
                        to.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary())],
                names=["key", "wide", "doc_id", "at", "left", "right"],
            )

    return rows.mapInArrow(run, "key long, wide boolean, doc_id long, at int, left binary, right binary")


_STARTS = "doc_id long, low int, high int"


def _batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    ids, low, high = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["doc_id", "low", "high"])


def sorted_starts(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, low, high): first and last start of repeated strings, by sorting each sample's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def close() -> None:
            if len(group) > 1:
                for (doc, at, _, _), starts in zip(group, repeated_starts([x[2] for x in group], [x[3] for x in group], length)):
                    out.extend((doc, at - high, at - low) for low, high in starts)

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "at", "left", "right"))):
                if key != now:
                    close()
                    now, group = key, []
                group.append(row)
            if len(out) > 10_000:
                yield _batch(out)
                out.clear()
        close()
        if out:
            yield _batch(out)

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, _STARTS)


def hashed_starts(found: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: every string over an open sample meets its copies by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, at, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "at", "left", "right"))):
                data = np.frombuffer(left[::-1] + right, np.uint8)
                starts = np.arange(len(data) - length + 1)
                if len(starts):
                    hashes = mix(span_hashes(prefix_sums(data), starts, starts + length) ^ mix((len(left) - starts).astype(np.uint64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(starts), key)), pa.array(hashes.view(np.int64)), pa.array(np.full(len(starts), doc)), pa.array((starts + at - len(left)).astype(np.int32))],
                        names=["key", "string", "doc_id", "start"],
                    )

    rows = found.mapInArrow(run, "key long, string long, doc_id long, start int")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "string"))).where("n > 1")
    return rows.select("doc_id", F.col("start").alias("low"), F.col("start").alias("high"))


def removed_bytes(count: int, settled, low, high, length: int) -> np.ndarray:
    """Which of ``count`` bytes lie in a repeated string."""
    edge = np.zeros(count + 1, np.int32)
    at = np.asarray(settled, np.int64)
    low = np.concatenate([np.maximum(at - (length - SAMPLE), 0), np.asarray(low, np.int64)])
    high = np.concatenate([np.minimum(at, count - length), np.asarray(high, np.int64)])
    fits = (low <= high) & (high + length <= count)
    np.add.at(edge, low[fits], 1)
    np.add.at(edge, high[fits] + length, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): the bytes left (binary: a cut may split a character).

    Null text is empty; texts of fewer than ``length`` bytes lose nothing.  A row with a null doc_id loses nothing and
    isn't another place for other texts.
    Rows that repeat a doc_id repeat its text, and so are repeats of one another.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = written(joined(samples(rows.where("doc_id IS NOT NULL"), length), group), "suffix-samples")
    near = snippets(rows.join(shared.where(F.size("open") > 0).select("doc_id", "open"), "doc_id").select("doc_id", "text", "open"), length)
    starts = sorted_starts(near.where("NOT wide"), length)
    if not shared.where(F.exists("open", lambda x: x["wide"])).isEmpty():
        starts = starts.unionByName(hashed_starts(near.where("wide"), length))
    starts = starts.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("starts"))
    rows = rows.join(shared.where(F.size("settled") > 0).select("doc_id", "settled"), "doc_id", "left").join(starts, "doc_id", "left").select("doc_id", "text", "settled", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, count, removed, spans = [], [], [], []
            for t, settled, found in zip(batch.column("text"), batch.column("settled"), batch.column("starts")):
                raw = (t.as_py() or "").encode()
                count.append(len(raw))
                if len(raw) < length or not (settled.is_valid or found.is_valid):
                    kept.append(raw)
                    removed.append(0)
                    spans.append(0)
                    continue
                at = settled.values.to_numpy() if settled.is_valid else ()
                low = found.values.field("low").to_numpy() if found.is_valid else ()
                high = found.values.field("high").to_numpy() if found.is_valid else ()
                gone = removed_bytes(len(raw), at, low, high, length)
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return rows.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


