"""Byte-level BPE encoding and decoding with the tables of a public tokenizer file.

A word (a match of the splitting pattern) is held as two contiguous lists: the ids of its parts, of which each boundary
is implied by its neighbours, and the ranks of the merges of adjacent parts.  The least rank is looked for again
and again; its boundary is deleted and the two ranks beside it are refreshed.  For the short words of texts that
is faster than any heap.  A word of over ``LONG`` bytes takes a heap of (rank, place) over linked parts instead, with the same
merges in the same order, so that its cost stays n log n.  Words are remembered, up to ``REMEMBERED`` of them at a time.

The file is read once, in the driver; executors get its tables (of the vocabulary's size) by broadcast.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .flattext import slices

#: Bytes of a word that is scanned; longer ones take a heap.
LONG = 200
#: Words whose ids are remembered at a time, and the characters of such a word.
REMEMBERED, SHORT = 1 << 18, 40
#: The public splitting pattern of byte-level BPE. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 40


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in tokenizer files, by the public rule.

    Bytes that print stand for themselves, the others for the signs from U+0100 on, in order.
    """
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in prints)}


class Tables:
    """What encoding and decoding need of a tokenizer file: bytes of every id, ranks of pairs, special strings."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> None:
        signs = byte_signs()
        self.special = special
        self.width = max([*vocabulary.values(), *special.values()], default=0) + 1
        self.bytes = [b""] * self.width
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        for token, k in special.items():
            self.bytes[k] = token.encode()
        self.single = [vocabulary[c] for c, _ in sorted(signs.items(), key=lambda x: x[1])]
        self.merged = [vocabulary[a + b] for a, b in merges]
        #: Ranks by the right part's id, for every left part.
        self.rank: list[dict[int, int]] = [{} for _ in range(self.width)]
        for k, (a, b) in enumerate(merges):
            self.rank[vocabulary[a]][vocabulary[b]] = k
        self.first = [[self.rank[a].get(b, _NONE) for b in self.single] for a in self.single]

    @classmethod
    def read(cls, path: str) -> Tables:
        """Tables of a tokenizer file; ValueError where the file asks for what isn't byte-level BPE with plain special strings."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, before = told["model"], told["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or told["normalizer"] or odd:
            raise ValueError(f"{path} isn't plain byte-level BPE {odd}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("special strings that take in their surroundings aren't supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in told["added_tokens"]})

    def merge(self, word: bytes) -> list[int]:
        """Ids of a short word: the least rank is merged, leftmost first, until no pair has one."""
        ids = [*map(self.single.__getitem__, word)]
        ranks = [self.first[a][b] for a, b in zip(word, word[1:])]
        rank, merged = self.rank, self.merged
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            k = ranks.index(least)
            ids[k] = new = merged[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank[ids[k - 1]].get(new, _NONE)
            if k < len(ranks):
                ranks[k] = rank[new].get(ids[k + 1], _NONE)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same for a word of any length, by a heap; an entry whose parts have changed since is passed over."""
        ids = [self.single[b] for b in word]
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank[ids[k]].get(ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right >= n or rank[ids[k]].get(ids[right]) != r:
                continue
            ids[k], ids[right] = self.merged[r], -1
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if (r := rank[ids[k]].get(ids[right])) is not None:
                    heapq.heappush(heap, (r, k))
            if (left := before[k]) >= 0 and (r := rank[ids[left]].get(ids[k])) is not None:
                heapq.heappush(heap, (r, left))
        return [k for k in ids if k >= 0]

    @cached_property
    def words(self) -> _Words:
        return _Words(self)

    @cached_property
    def _split(self):
        return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special strings in it get their own ids."""
        if not self._split:
            return list(chain.from_iterable(map(self.words.__getitem__, _FIND(text))))
        out = []
        for k, piece in enumerate(self._split.split(text)):
            if k % 2:
                out.append(self.special[piece])
            else:
                out += chain.from_iterable(map(self.words.__getitem__, _FIND(piece)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, as cut characters do."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "_split")}


_FIND = regex.compile(PATTERN).findall


class _Words(dict):
    """Ids by word, found where they are missing.

    When half of the room is full, what it holds becomes the older half, and words move back from there as they come, so that
    common words stay.
    """

    def __init__(self, tables: Tables) -> None:
        super().__init__()
        self.tables, self.older = tables, {}

    def __missing__(self, word: str) -> list[int]:
        ids = self.older.get(word)
        if ids is None:
            raw = word.encode()
            ids = self.tables.merge(raw) if len(raw) <= LONG else self.tables.merge_long(raw)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int) of the whole text.

    Null and empty texts have no ids.  Rows are encoded one by one: repeated rows and null ids pass through, other
    columns are left out whatever their names, an empty table gives none.  Very long texts are handled one at a
    time, words of any length in n log n.
    """
    return _mapped(docs.select("doc_id", F.col(text).alias("text")), tokenizer, "ids array<int>", lambda tables, batch: [pa.array([tables.encode(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))])


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, ids, decoded. Null ids count as none; an id outside the vocabulary is an IndexError."""
    return _mapped(tokens.select("doc_id", "ids"), tokenizer, "ids array<int>, decoded string", lambda tables, batch: [batch.column("ids"), pa.array(map(tables.decode, _lists(batch.column("ids"))), pa.string())])


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The lists of a column as Python lists, nulls as empty ones; by way of one flat array."""
    flat, sizes = column.flatten().to_numpy(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    return (flat[b - n : b].tolist() for n, b in zip(sizes.tolist(), ends.tolist()))


def _mapped(rows: DataFrame, tokenizer: str, schema: str, made) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(Tables.read(tokenizer))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    names = ["doc_id", *(part.split()[0] for part in schema.split(", "))]
    sized = rows.columns[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shipped.value
        for batch in slices(batches) if sized == "text" else batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made(tables, batch)], names=names)

    return rows.mapInArrow(run, f"doc_id long, {schema}")
