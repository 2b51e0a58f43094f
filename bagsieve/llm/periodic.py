"""Periodic runs of words in documents, by the divide and conquer of Main and Lorentz.

A text's words are interned as numbers.  At the midpoint m of a segment, a repetition of period p that crosses it is a
stretch on which words p apart are equal, and it holds or borders the pair of places (m - p, m) or (m, m + p).  So for
every place j of the segment two lengths tell all: how far the words from j and from m on agree (the Z-function of the
right half), and how far those before j and before m agree backward (the same of the reversed left half).
Halves are searched in turn.  A run is found whole at the topmost midpoint that it crosses; a piece that the border of
a segment cuts is passed over.  Of several periods of one stretch the smallest counts.

All segments of a level, of all texts at hand, are compared at once: most agreements end within a few words.  Segments in which
one goes on for ``ROUNDS`` words get the linear Z-function instead, so a text takes n log n whatever is in it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .flattext import flat, slices
from .mixing import WORD

#: Words of an agreement that are compared for all segments at once.
ROUNDS = 48


def z_function(pattern: list[int], text: list[int]) -> list[int]:
    """For every place of ``text``, how many of its items from there on agree with the start of ``pattern``."""
    s = [*pattern, -1, *text]
    z = [0] * len(s)
    left = right = 0
    for k in range(1, len(s)):
        n = min(z[k - left], right - k) if k < right else 0
        if k + n >= right:
            while k + n < len(s) and s[n] == s[k + n]:
                n += 1
            left, right = k, k + n
        z[k] = n
    return z[len(pattern) + 1 :]


def _agreements(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, edge: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the words from ``lo`` and ``hi`` on agree in the direction of ``step`` before ``edge``; and which went on."""
    n, at = np.zeros(len(lo), np.int64), np.arange(len(lo))
    for k in range(ROUNDS):
        x, y = lo[at] + step * k, hi[at] + step * k
        inside = y < edge[at] if step > 0 else x >= edge[at]
        at, x, y = at[inside], x[inside], y[inside]
        at = at[ids[x] == ids[y]]
        if not len(at):
            break
        n[at] += 1
    return n, at


def runs(ids: np.ndarray, off: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, end, period) of the runs of all texts; text k holds the places off[k] to off[k + 1] of ``ids``.

    A run is a stretch of at least ``least`` words and of two of its smallest periods that no neighbouring word extends.  Rows
    are ordered by start, then period.
    """
    low, top, found = off[:-1], off[1:], []
    first, last = low, top
    while True:
        big = top - low >= max(least, 2)
        low, top, first, last = (x[big] for x in (low, top, first, last))
        if not len(low):
            break
        mid = (low + top) // 2
        size = top - low + 1
        seg = np.repeat(np.arange(len(low)), size)
        j = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size - low, size)
        at_top, at_low = np.cumsum(size) - 1, np.cumsum(size) - size
        ahead = ids[np.minimum(j, len(ids) - 1)] == np.repeat(ids[mid], size)
        ahead[at_top] = False  # no word of the segment stands there
        behind = ids[np.maximum(j - 1, 0)] == np.repeat(ids[mid - 1], size)
        behind[at_low] = False
        near = np.flatnonzero((ahead | behind) & (j != np.repeat(mid, size)))
        j, seg = j[near], seg[near]
        lo, hi = np.minimum(j, mid[seg]), np.maximum(j, mid[seg])
        f, on = _agreements(ids, lo, hi, top[seg], 1)
        b, on_ = _agreements(ids, lo - 1, hi - 1, low[seg], -1)
        for s in np.unique(seg[np.concatenate([on, on_])]).tolist():
            a, m, z = int(low[s]), int(mid[s]), int(top[s])
            rows = slice(*np.searchsorted(seg, [s, s + 1]))
            whole, places = ids[a:z].tolist(), j[rows] - a
            f[rows] = np.array([*z_function(whole[m - a :], whole), 0])[places]
            b[rows] = np.array([*z_function(whole[: m - a][::-1], whole[::-1]), 0])[(z - a) - places]
        p = hi - lo
        fits = (f + b >= p) & (f + b + p >= least)
        start, end, p, s = (lo - b)[fits], (hi + f)[fits], p[fits], seg[fits]
        cut = (start > first[s]) & (ids[start - 1] == ids[start - 1 + p]) | (end < last[s]) & (ids[np.minimum(end, len(ids) - 1)] == ids[end - p])
        found.append(np.stack([start, end, p], 1)[~cut])
        low, top = np.concatenate([low, mid]), np.concatenate([mid, top])
        first, last = np.tile(first, 2), np.tile(last, 2)
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
    rows = rows[np.concatenate([[True], ~same])[: len(rows)]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def interned(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of every text, their numbers in one array, and each text's place in it."""
    parts = [t.split() for t in texts]  # bytes are split at space and 0x09 to 0x0D alone
    known = defaultdict()
    known.default_factory = known.__len__
    off = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    ids = np.fromiter((known[w] for words in parts for w in words), np.int64, int(off[-1]))
    return parts, ids, off


def find_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period by start, then period) and collapsed.

    ``collapsed`` joins by one space the words that no run holds after its first period.  Null and empty texts have
    no words, no runs and an empty collapsed text.  Rows are judged one by one: repeated rows and null ids pass through, other
    columns are left out whatever their names, an empty table gives none.  Very long texts are handled one at a time.
    """
    ship(docs.sparkSession)
    kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = flat(batch.column("text"))
            data = data.tobytes()
            parts, ids, off = interned([data[a:b] for a, b in zip(at.tolist(), at[1:].tolist())])
            start, end, period = runs(ids, off, least).T
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, np.minimum(start + period, end), 1)
            np.add.at(change, end, -1)
            kept = np.cumsum(change[:-1]) == 0
            left = np.add.reduceat(np.append(kept, False), np.minimum(off[:-1], len(kept))) if len(kept) else off[:-1]
            clean = [b" ".join(words if k == b - a else compress(words, kept[a:b].tolist())) for words, a, b, k in zip(parts, off.tolist(), off[1:].tolist(), left.tolist())]
            owner = np.searchsorted(off, start, "right") - 1
            cuts = np.searchsorted(owner, np.arange(len(parts) + 1))
            values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - off[owner], end - start, period)], fields=list(kind))
            columns = [batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of the greatest length; ties: the smallest start, then period. Null where there is none."""
    ranked = F.array_min(F.transform(runs, lambda r: F.struct((-r.length).alias("minus"), r.start.alias("start"), r.period.alias("period"))))
    return F.when(ranked.isNotNull(), F.struct(ranked["start"].alias("start"), (-ranked["minus"]).alias("length"), ranked["period"].alias("period")))


def runs_told(runs: Column) -> Column:
    """A line ``start,length,period`` for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")


def repeat_some(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by crc32 of its id, ends in a repetition, so that whole tables hold runs.

    With h the crc32, g = h div 10 and n words, the words from a = g mod n on repeat the first p = 1 + (n - a) div (3 + g mod 8)
    of them.  Other texts, those without words and those of null ids stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when((h % 10 == 0) & F.col("text").rlike(WORD), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), words.alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("CASE WHEN words IS NOT NULL THEN int(g % n) END"))
    rows = rows.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    edited = F.expr("array_join(slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p))))), 1, n), ' ')")
    return rows.select("doc_id", F.coalesce(edited, "text").alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run (start, length, period, exponent_milli; nulls without one) and the digests of
    all runs and of the collapsed text."""
    found = find_runs(docs).withColumn("best", longest(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs_told(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
