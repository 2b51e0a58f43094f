"""Language identification by prediction by partial matching.

For every language a context tree of bytes is learned: contexts of up to ``ORDER`` bytes with the counts of the
byte that followed.  The probability of a byte is that of the longest context in the tree where it was seen, times
an escape probability for each longer context where it was not (escape method C: distinct / (total + distinct)),
down to the uniform distribution over 256 values.  The trees are frozen after training, so the code length of a
text under a language is the exact sum of its bytes' code lengths, and a byte's code length depends on the last
``ORDER + 1`` bytes alone.  That makes it a table: one row of code lengths, a column for each language, for every
(context, byte) that any language has seen, reached through small dense tries.  Scoring is a few table look-ups
for each byte, vectorised over whole batches.

Training reads a bounded sample of the labelled rows: for each language the ``per_language`` rows of the
lowest hash of doc_id and text, and of a text of over ``max_chars`` characters a slice of so many.  Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .flattext import flat, slices
from .names import other_columns_apart
from .scratch import written

ORDER = 3
UNKNOWN = "und"


def _history(data: np.ndarray, off: np.ndarray, back: int) -> np.ndarray:
    """The byte ``back`` places before each byte; 0 before the start of its text."""
    out = np.zeros(len(data), np.uint8)
    out[back:] = data[: len(data) - back] if back < len(data) else 0
    starts = off[:-1]
    for k in range(back):
        at = starts + k
        out[at[at < off[1:]]] = 0
    return out


class Model:
    """Frozen code length tables of a set of languages; ``languages`` are the columns."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = sorted(texts)
        grams = [self._count(texts[x]) for x in self.languages]  # by language: [{order: (codes, counts)}]
        n = len(self.languages)
        length = [np.full((256, n), 8.0)]  # code lengths below order 0
        self.codes: list[np.ndarray] = []  # by order: sorted codes that any language has seen
        self.length: list[np.ndarray] = []  # by order: their code lengths
        self.escape: list[np.ndarray] = []  # by order: code length of the escape from the context with that code
        below_codes, below = np.arange(256, dtype=np.uint32), length[0]
        for k in range(ORDER + 1):
            codes = np.unique(np.concatenate([g[k][0] for g in grams]))
            contexts = np.unique(codes >> np.uint32(8)) if k else np.zeros(1, np.uint32)
            table, escape = np.zeros((len(codes), n)), np.zeros((len(contexts), n))
            shorter = codes & np.uint32((1 << (8 * k)) - 1) if k else codes
            fall = below[np.searchsorted(below_codes, shorter)]
            for j, g in enumerate(grams):
                seen, counts = g[k]
                own = np.searchsorted(contexts, seen >> np.uint32(8)) if k else np.zeros(len(seen), np.int64)
                total, distinct = np.bincount(own, counts, len(contexts)), np.bincount(own, minlength=len(contexts))
                known = total > 0
                both = np.maximum(total + distinct, 1)
                escape[known, j] = -np.log2(distinct[known] / both[known])
                at = np.searchsorted(contexts, codes >> np.uint32(8)) if k else np.zeros(len(codes), np.int64)
                table[:, j] = fall[:, j] + escape[at, j]
                table[np.searchsorted(codes, seen), j] = -np.log2(counts / both[own])
            self.codes.append(codes)
            self.length.append(table.astype(np.float32))
            self.escape.append(escape.astype(np.float32))
            if k == 0:  # every byte value has a code length from here on
                full = np.repeat(escape + 8.0, 256, 0)
                full[codes] = table
                below_codes, below = np.arange(256, dtype=np.uint32), full
                self.zero = full.astype(np.float32)
            else:
                below_codes, below = codes, table
        #: By language, bits per byte beyond which a text isn't in it: (of a long text, more by the root of the bytes).
        self.limits = np.array([np.full(n, np.inf), np.zeros(n)])
        self._tries()

    @staticmethod
    def _count(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        data, off = flat(pa.array(texts, pa.large_string()))
        code = np.zeros(len(data), np.uint32)
        out = []
        for k in range(ORDER + 1):
            code = code | (_history(data, off, k).astype(np.uint32) << np.uint32(8 * k))
            out.append(np.unique(code, return_counts=True))
        return out

    def _tries(self) -> None:
        """Dense tries: two bytes give a pair, a third a triple, a fourth the row of the table; 0 is unseen.

        Pairs and triples are what was seen and, as texts start after zeros, the contexts.
        """
        quads = self.codes[3]
        triples = np.union1d(self.codes[2], quads >> np.uint32(8))
        pairs = np.union1d(self.codes[1], triples >> np.uint32(8))
        self.pair = np.zeros(1 << 16, np.int32)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.triple = np.zeros((len(pairs) + 1) << 8, np.int32)
        self.triple[(self.pair[triples >> np.uint32(8)].astype(np.int64) << 8) + (triples & np.uint32(255))] = np.arange(1, len(triples) + 1)
        symbols = np.unique(self.codes[0])
        self.symbol = np.zeros(256, np.int32)
        self.symbol[symbols] = np.arange(1, len(symbols) + 1)
        self.width = len(symbols) + 1
        third = self._triple(quads >> np.uint32(24), (quads >> np.uint32(16)) & np.uint32(255), (quads >> np.uint32(8)) & np.uint32(255))
        self.quad = np.zeros((len(triples) + 1) * self.width, np.int32)
        self.quad[third.astype(np.int64) * self.width + self.symbol[quads & np.uint32(255)]] = np.arange(1, len(quads) + 1)
        n = len(self.languages)
        self.cost4 = np.concatenate([np.zeros((1, n), np.float32), self.length[3]])
        self.cost3, self.known3 = np.zeros((len(triples) + 1, n), np.float32), np.zeros(len(triples) + 1, bool)
        at = 1 + np.searchsorted(triples, self.codes[2])
        self.cost3[at], self.known3[at] = self.length[2], True
        # Escapes lie by context; a context of two bytes is a pair and one of three bytes a triple.
        self.esc2, self.esc3 = np.zeros((len(pairs) + 1, n), np.float32), np.zeros((len(triples) + 1, n), np.float32)
        self.esc2[1 + np.searchsorted(pairs, np.unique(self.codes[2] >> np.uint32(8)))] = self.escape[2]
        self.esc3[1 + np.searchsorted(triples, np.unique(quads >> np.uint32(8)))] = self.escape[3]
        dense = np.tile(self.zero, (256, 1))  # by (context byte, byte): code lengths at order 1
        ctx = np.unique(self.codes[1] >> np.uint32(8))
        dense.reshape(256, 256, -1)[ctx] += self.escape[1][:, None, :]
        dense[self.codes[1]] = self.length[1]
        self.cost2 = dense
        del self.codes, self.length, self.escape

    def _triple(self, a, b, c) -> np.ndarray:
        return self.triple[(self.pair[(a.astype(np.int32) << 8) + b.astype(np.int32)] << 8) + c.astype(np.int32)]

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of every text under every language."""
        if not len(data):
            return np.zeros((len(off) - 1, len(self.languages)))
        b1, b2, b3 = (_history(data, off, k) for k in (1, 2, 3))
        context = self._triple(b3, b2, b1)
        row = self.quad[context * self.width + self.symbol[data]]
        row[self.symbol[data] == 0] = 0
        cost = self.cost4[row]
        (miss,) = np.nonzero(row == 0)
        if len(miss):
            third = self._triple(b2[miss], b1[miss], data[miss])
            rest = self.cost3[third]
            (more,) = np.nonzero(~self.known3[third])
            if len(more):
                at = miss[more]
                pair = (b2[at].astype(np.int32) << 8) + b1[at]
                rest[more] = self.esc2[self.pair[pair]] + self.cost2[(b1[at].astype(np.int32) << 8) + data[at]]
            cost[miss] = self.esc3[context[miss]] + rest
        out = np.zeros((len(off) - 1, len(self.languages)))
        full = off[1:] > off[:-1]
        out[full] = np.add.reduceat(cost, off[:-1][full], axis=0, dtype=np.float64)
        return out


PART = 16


def limits(texts: dict[str, list[str]]) -> np.ndarray:
    """(2, languages): what texts of a language cost at most, from texts that the model of their other half codes.

    The first is the median of bits per byte and five times the way from there to the 90th percentile (half a bit at
    least), far beyond an exponential tail.  The second is four deviations of the mean over ``PART`` bytes, which
    divided by the root of the number of bytes is what chance adds in a short text.  Both are from percentiles, which
    some texts with a wrong label don't move.  A language of one text is
    halved inside it.
    """
    halves = {k: (v[::2], v[1::2]) if len(v) > 1 else (v[:1], v[:1]) if len(v[0]) < 2 else ([v[0][: len(v[0]) // 2]], [v[0][len(v[0]) // 2 :]]) for k, v in texts.items()}
    found: dict[str, tuple[list, list]] = {k: ([], []) for k in texts}
    for h in (0, 1):
        model = Model({k: v[h] for k, v in halves.items()})
        for j, k in enumerate(model.languages):
            for t in halves[k][1 - h]:
                data = np.frombuffer(t.encode(), np.uint8)
                found[k][0].append(model.lengths(data, np.array([0, len(data)]))[0, j] / len(data))
                off = np.arange(0, min(len(data), 2_000) + 1, PART)
                if len(off) > 1:
                    found[k][1].append(model.lengths(data[: off[-1]], off)[:, j] / PART)
    out = np.zeros((2, len(texts)))
    for j, k in enumerate(sorted(texts)):
        middle, high = np.quantile(found[k][0], [0.5, 0.9])
        spread = np.diff(np.quantile(np.concatenate(found[k][1]), [0.16, 0.84]))[0] / 2 if found[k][1] else 0.0
        out[:, j] = middle + 5 * max(high - middle, 0.5), 4 * max(spread, 1.0) * PART**0.5
    return out


def known(model: Model, bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each text is in some language: the likeliest isn't ``und``, and its cost is within a language's limit."""
    size = np.maximum(sizes, 1)[:, None]
    named = np.array([x != UNKNOWN for x in model.languages])
    return named[bits.argmin(1)] & ((bits / size <= model.limits[0] + model.limits[1] / np.sqrt(size)) & named).any(1)


def training_sample(labelled: DataFrame, per_language: int, max_chars: int) -> dict[str, list[str]]:
    """A bounded sample of texts by language; ``labelled`` has doc_id, text and lang.

    Of each language the ``per_language`` rows of the least hash of doc_id and text, whatever repeats: rows aren't joined by
    their ids, so repeated and null ids are rows like others.  The first pass ranks hashes only and keeps the last one of each language;
    the second reads the texts up to it.
    """
    rows = labelled.select(F.col("doc_id").cast("string").alias("id"), "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    rows = rows.withColumn("place", F.xxhash64("id", "text"))
    first = Window.partitionBy("lang").orderBy("place")
    last = rows.select("lang", "place").withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language)
    last = written(last.groupBy("lang").agg(F.max("place").alias("last")), "languages")
    # A long text gives a slice from a place by hash.
    start = F.pmod("place", F.greatest(F.length("text") - max_chars + 1, F.lit(1))).cast("int") + 1
    few = rows.join(last, "lang").where(F.col("place") <= F.col("last")).select("lang", "place", F.substring("text", start, F.lit(max_chars)).alias("text"))
    few = few.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language)  # rows that are equal throughout
    found: dict[str, list[str]] = {}
    for lang, text in few.select("lang", "text").collect():
        found.setdefault(lang, []).append(text)
    return {k: sorted(v) for k, v in found.items()}


def train(labelled: DataFrame, per_language: int = 400, max_chars: int = 20_000) -> Model | None:
    """A model of every language in ``labelled``; None if it has no labelled text."""
    texts = training_sample(labelled, per_language, max_chars)
    if not texts:
        return None
    model = Model(texts)
    model.limits = limits(texts)
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) for every row of ``docs``.

    score is the posterior probability of the language under equal priors.  A text that is null or has no letter,
    and every text if there is no model, gets ``und``, 0 and null.  Ties go to the first language by name.
    Repeated rows are predicted each; a null doc_id stays null.
    """
    schema = "doc_id long, lang_pred string, score double, bits_per_byte double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # size bounded by the tree's order and the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in slices(batches):
            data, off = flat(batch.column("text"))
            bits = own.lengths(data, off)
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            best = bits.argmin(1)
            low = bits.min(1)
            score = 1.0 / np.exp2(np.maximum(low[:, None] - bits, -1000.0)).sum(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names[np.where(letters, best, len(names) - 1)], pa.string()),
                    pa.array(np.where(letters, score, 0.0)),
                    pa.array(low / np.maximum(off[1:] - off[:-1], 1), mask=~letters),
                ],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    return rows.mapInArrow(run, schema)


@other_columns_apart()
def keep_identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs``, all columns, without texts that are no language: null, without a letter, or not ``known``.

    What counts is the cost for each byte, not the posterior, which compares the languages with each other only: a
    text in none of them can have almost 1, and a short text that suits two has half.  Rows are judged one by one where they lie: repeated rows share
    their fate, null ids don't matter, and nothing is joined or moved.  Without a model nothing is kept; an empty table stays empty.
    Very long texts are judged one at a time; names of other columns don't matter.
    """
    if model is None:
        return docs.limit(0)
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, off = flat(batch.column(text))
            yield batch.filter(pa.array(known(shipped.value, shipped.value.lengths(data, off), off[1:] - off[:-1])))

    return rows.mapInArrow(run, docs.schema)
