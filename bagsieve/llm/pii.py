"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

The values that the patterns find are the protected entities.  A term close to an entity discloses it as far as it
tells about it: with probabilities estimated over the corpus, the term is a disclosure if

    PMI(entity, term) >= alpha * IC(entity),   PMI = log2(n_et * N / (n_e * n_t)),   IC = log2(N / n_e)

where all numbers count documents, that is rows: N all, n_t those with the term anywhere, n_e those with the entity, and
n_et those where the term stands near it.  Copies thus weigh alike on both sides.  Apart from that, a term has to stand
in ``support`` distinct neighbourhoods of the entity, which count once however often they are copied, since a single
one would make every rare word a disclosure.  Disclosing terms are
generalised or, at ``removal`` * IC, removed.

The counts cover all documents.  Terms to count are found first; a fixed-size bitmap of their hashes goes to the
tasks, so that a document only reports words that may be among them, and a join on the words settles it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .flattext import LOWER, flat, prefix_sums, separators, slices, span_hashes, words
from .names import fresh, other_columns_apart
from .scratch import written

KINDS = ("email", "ip", "card", "phone")
#: Slots of the bitmap of terms: its size is the bound on what is shipped to the tasks.
SLOTS = 1 << 20
#: Distinct terms that a task counts before it hands its counts on and starts anew: bounds its memory, not the terms.
HELD = 1 << 17
#: Terms to each side of an entity, on whatever line, that are its neighbourhood.
REACH = 6

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match starts where a run of digits starts, as a later start in the run would reach no further.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Letters of terms: A-Z, a-z and everything beyond ASCII.
_TERM = re.compile("[A-Za-z\x80-\U0010ffff]{3,}")
_NOT_TERM = separators(bytes(x for x in range(128) if not chr(x).isalpha()))
_AZ = {x: x + 32 for x in range(65, 91)}


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches around each @, in time linear in the text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return found


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


def _told(found) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


@lru_cache(1 << 16)
def _term_slot(term: str) -> int:
    data = np.frombuffer(term.encode(), np.uint8)
    return int(span_hashes(prefix_sums(data), np.array([0]), np.array([len(data)]))[0]) % SLOTS


def neighbourhoods(text: str, found: list[tuple[str, int, int]]) -> list[dict]:
    """The terms near each entity, with the digest of their neighbourhood.

    Terms are whole words outside all entities; the nearest ``REACH`` on either side count, however far they are.
    """
    starts, ends = [], []  # entities as disjoint spans
    for a, b in sorted((a, b) for _, a, b in found):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    terms, at = [], []
    for m in _TERM.finditer(text):
        k = bisect_left(starts, m.end())
        if not k or ends[k - 1] <= m.start():
            terms.append((m.group(), m.start(), m.end()))
            at.append(m.start())
    out = []
    for kind, a, b in found:
        low, high = bisect_left(at, a), bisect_right(at, b - 1)
        near = terms[max(0, low - REACH) : low] + terms[high : high + REACH]
        entity = f"{kind}:{text[a:b]}"
        place = hashlib.sha1("\0".join(x[0] for x in near).encode()).hexdigest()[:16]
        if not near:  # the entity counts all the same
            out.append({"entity": entity, "place": place, "term": None, "slot": None, "start": a, "end": b})
        for word, x, y in near:
            term = word.translate(_AZ)
            out.append({"entity": entity, "place": place, "term": term, "slot": _term_slot(term), "start": x, "end": y})
    return out


_SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, near array<struct<entity:string,place:string,term:string,slot:long,start:long,end:long>>"
_NEAR = pa.list_(pa.struct([("entity", pa.string()), ("place", pa.string()), ("term", pa.string()), ("slot", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: the counts and digest of the fixed patterns, their spans and the terms near them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [base_spans(t) for t in texts]
            told = [_told(x) for x in found]
            counts = [pa.array([sum(x[0] == kind for x in row) for row in found], pa.int64()) for kind in KINDS]
            near = pa.array([neighbourhoods(t, x) if x else [] for t, x in zip(texts, found)], _NEAR)
            digest = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in told], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array(told, pa.string()), near], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "near"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _SCAN)


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text", held: int = HELD) -> DataFrame:
    """(term, n_docs) over all documents for a table of (term, slot); the counts don't depend on ``held``."""
    ship(docs.sparkSession)
    slots = np.zeros(SLOTS, bool)
    slots[[r[0] for r in terms.select("slot").distinct().collect()]] = True  # at most SLOTS numbers
    shipped = docs.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shipped.value).astype(bool)
        if not wanted.any():
            return
        counts: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.decode() for x in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])

        for batch in slices(batches):
            data, off = flat(batch.column("text"))
            data = LOWER[data]
            starts, ends, _ = words(data, off, _NOT_TERM)
            hit = wanted[span_hashes(prefix_sums(data), starts, ends) % np.uint64(SLOTS)]
            starts, ends = starts[hit], ends[hit]
            doc = np.searchsorted(off, starts, "right")
            raw = data.tobytes()
            counts.update(term for _, term in {(d, raw[a:b]) for d, a, b in zip(doc.tolist(), starts.tolist(), ends.tolist())})
            if len(counts) >= held:
                yield told()
                counts.clear()
        if counts:
            yield told()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "term string, n long")
    # Not a semi join: that would be pushed below the sum, to the counts of single batches.
    return counted.groupBy("term").agg(F.sum("n").alias("n_docs")).join(terms.select("term").distinct(), "term")


def disclosures(docs: DataFrame, scanned: DataFrame, alpha: float = 0.9, removal: float = 0.99, support: int = 2, text: str = "text") -> DataFrame:
    """(entity, term, level) for the terms that disclose an entity; level is ``remove`` or ``generalise``."""
    near = scanned.select("row", F.explode("near").alias("x")).select("row", "x.*")
    entities = near.select("row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    total = F.lit(float(max(1, docs.count())))
    content = F.log2(total / F.col("n_e"))

    def pmi(n_t: str):
        return F.log2(F.col("n_et") * total / (F.col("n_e") * F.greatest(n_t, "n_et")))

    # A term is in as many documents as it is near any entity in, at least.  Terms that fail on that number already,
    # such as the common words, fail on the true one, and needn't be counted.
    near = near.where("term IS NOT NULL")
    least = near.select("row", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pairs = near.groupBy("entity", "term", "slot").agg(F.countDistinct("row").alias("n_et"), F.countDistinct("place").alias("n_places")).where(F.col("n_places") >= support)
    pairs = pairs.join(entities, "entity").join(least, "term").where((content > 0) & (pmi("n_near") >= alpha * content))
    pairs = written(pairs.select("entity", "term", "slot", "n_et", "n_e"), "pii-pairs")
    pairs = pairs.join(term_counts(docs, pairs, text), "term")
    pairs = pairs.where(pmi("n_docs") >= alpha * content)
    return pairs.select("entity", "term", F.when(pmi("n_docs") >= removal * content, "remove").otherwise("generalise").alias("level"))


def report(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_terms.

    spans holds the patterns' spans and, after them, ``term:start:end`` of disclosing terms.  Null text counts as
    empty: no spans and the digest of the empty string.  Each row has its own spans, whatever its doc_id.  Empty
    tables give empty results.
    """
    scanned = written(scan(docs, text).withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    near = scanned.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term", "x.start", "x.end")
    told = near.join(disclosures(docs, scanned, text=text, **how), ["entity", "term"])
    told = told.groupBy(F.col("row").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start", "end", "level"))).alias("terms"))
    rows = scanned.drop("near").join(told, F.col("row") == F.col("_id"), "left")
    more = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"], F.lit(":"), t["end"])), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), more)
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"), "terms")


@other_columns_apart()
def sanitise(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with entities replaced by their kind and disclosing terms generalised to [TERM] or removed.

    Null texts stay null; an empty table stays empty; names of other columns don't matter; rows are numbered and written first, so that each gets its own spans, whatever its doc_id.
    """
    number, number_, spans, levels = fresh(docs, "number", "number_of", "spans", "levels")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "pii-rows")
    found = report(rows.select(F.col(number).alias("doc_id"), F.col(text).alias("text")), **how)
    found = found.select(F.col("doc_id").alias(number_), F.col("spans").alias(spans), F.transform("terms", lambda t: F.concat(t["start"], F.lit(":"), t["level"])).alias(levels))
    rows = rows.join(found, F.col(number) == F.col(number_), "left").drop(number, number_)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            clean = []
            for t, told, level in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), batch.column(levels).to_pylist()):
                gone = {x.split(":")[0] for x in level or () if x.endswith("remove")}
                out, end = [], 0
                for kind, a, b in sorted((x.split(":") for x in (told or "").split(",") if x), key=lambda x: (int(x[1]), -int(x[2]))):
                    if int(a) >= end:
                        out += [t[end : int(a)], "" if a in gone else f"[{kind.upper()}]"]
                        end = int(b)
                clean.append(t if t is None else "".join(out) + t[end:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type)).select(columns)

    return rows.mapInArrow(run, docs.schema)
