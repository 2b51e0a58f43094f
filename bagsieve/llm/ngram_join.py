"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word n-grams.  All n-grams stand in one global order, by hash, which is cut at fixed
places into ``FRAGMENTS`` fragments, so that every set falls into segments.  Segments of one fragment are joined with
each other, which counts the partial overlaps of the candidate pairs there; their sum by pair is the intersection.
The order is the same at any size of the input, and its fragments hold equal shares of any set.

How work stays small:

* Equal sets are joined by their digest and only one of them, of the least doc_id, goes on.
* Let ``spare = n - ceil(t * n)``, the most n-grams that a set of ``n`` may have outside one that it links with.  The
  head of a set is its first ``2 * spare + 1`` n-grams.  Of two linked sets, take the one whose head ends first: all of
  its head but ``spare`` is in the other's head, too.  Heads are dealt out by n-gram, which counts the sets that hold
  each; a document with more than ``spare`` n-grams in its head that nobody else has links with none, and ends here.
  Most documents do.
* Two linked sets thus have at least ``least`` n-grams of their heads in common, where ``least`` follows from the
  smaller size that a partner may have.  With the n-grams of a head in the order rarest first, one of those in
  common is among the first ``head - least + 1``; those that nobody else has come first and needn't be looked at.
  The others are the keys of candidates: passages that many documents share come last and rarely are.
* Documents that share a key, and are in neighbouring classes of size, form a bucket, but aren't compared all with
  all.  Each bucket has a centre P, the member whose n-grams are the most common, and the others are compared with P
  only.  Links give components.  Take two members X and Y that aren't in one component then.
  Their overlap is at most min(|X & P|, |Y & P|) plus what they share outside P.  So either that minimum alone is
  enough, which the numbers tell and which is rare (then the two are compared); or they share n-grams outside P.
  Those that no member of another component has are left out; the others stand rarest first, and with them as many of
  X's first ones as may hold the first that a linked Y shares make the buckets of the next round.  What X has inside
  P and from a key on bounds what it shares with those whose first key in common that is: most documents have no such
  key, and most pairs of a bucket aren't made.
  A passage, or the original of many near copies, is inside P and thus makes no candidates any more.
  There, the centre is the member most like the centre before: of near copies of one original, that is the original
  or what differs least from it, so that what two copies share outside it is theirs alone, and few go on.
  In rounds after the third, buckets get ``GROWTH`` times as many further centres, which are compared with the members of other
  components only; a bucket with no more members than centres is done.  Documents that are all like each other, but
  not enough to link, thus take a few rounds.  Every link between different components is found, and links inside one aren't needed:
  components are exact.

No task holds all rows of a frequent n-gram.  Those of a head that may be in one of ``OFTEN`` documents or more are
listed by the first scan (at most ``OFTEN`` times the mean size of a head; the list is shipped); they are known to be
shared, aren't counted, and are dealt out with the document instead.

Hashes have 64 bits.  A collision inside one of the compared pairs would change its overlap by one n-gram; for sets
of 10,000 that has a chance below 1 in 10**11 for a pair.  Collisions elsewhere only make candidates.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .components import components
from .flattext import LOWER, flat, gram_hashes, mix, slices, word_hashes, words
from .scratch import discard, written

#: Fragments of the global order: ranges of equal width.
FRAGMENTS = 4
#: An n-gram in the heads of one of so many documents, or more, isn't dealt out by itself.
OFTEN = 256
#: Centres of a bucket, times as many in each round after the third.
GROWTH = 32
#: n-grams of heads that are packed at once, and that a bucket gathers, about.
DEALT = 1 << 19
_FREQUENT = (1 << 31) - 1


def _grams(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes of a batch in order, with the first and the end index for every text.

    A text of fewer than ``n`` words, but not none, has its whole sequence as one n-gram.
    """
    data, off = flat(batch.column("text"))
    data = LOWER[data]
    starts, ends, first = words(data, off)
    hashes = word_hashes(data, starts, ends)
    grams = gram_hashes(hashes, n)
    count = np.diff(first)
    lo = first[:-1].astype(np.int64)
    hi = lo + np.maximum(count - n + 1, 0)
    lo, hi = np.minimum(lo, len(grams)), np.minimum(hi, len(grams))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([gram_hashes(hashes[first[d] : first[d + 1]], int(count[d]))[0] for d in short], np.uint64)
        lo[short] = len(grams) + np.arange(len(short))
        hi[short] = lo[short] + 1
        grams = np.concatenate([grams, extra])
    return grams.view(np.int64), lo, hi


def _spare(size, percent: int):
    return size - (percent * size + 99) // 100


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each slice of the documents with their sets, in the global order."""
    for batch in slices(batches):
        grams, lo, hi = _grams(batch, n)
        yield batch, [np.unique(grams[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]


def _head(own: np.ndarray, percent: int) -> np.ndarray:
    return own[: 2 * _spare(len(own), percent) + 1]


def _digest(own: np.ndarray) -> tuple[int, int, int]:
    """Size, xor and sum of a set's hashes."""
    return len(own), int(np.bitwise_xor.reduce(own)) if len(own) else 0, int(own.sum(dtype=np.int64))


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, size, low, high, head, often): set size, digest and size of the head; often lists n-grams that many
    heads of a slice of the documents hold, with how many do, and stands with one document of each slice."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _sets(batches, n):
            size, low, high = zip(*map(_digest, found))
            heads = [_head(own, percent) for own in found]
            gram, count = np.unique(np.concatenate(heads), return_counts=True)
            many = count >= max(4, len(found) // (OFTEN // 4))
            often = pa.StructArray.from_arrays([pa.array(gram[many]), pa.array(count[many].astype(np.int64))], names=["gram", "n"])
            ends = np.full(len(found) + 1, len(often))
            ends[0] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(x, pa.int64()) for x in (size, low, high)),
                    pa.array([len(x) for x in heads], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), often),
                ],
                names=["doc_id", "size", "low", "high", "head", "often"],
            )

    return docs.mapInArrow(run, "doc_id long, size long, low long, high long, head long, often array<struct<gram:long,n:long>>")


def _deal(buckets: int, to: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Arrays as one row of binaries for each bucket that ``to`` names."""
    order = np.argsort(to.astype(np.uint16) if buckets < 1 << 16 else to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    parts = [np.split(c[order], cuts) for c in columns]
    keys = to[order][np.concatenate([[0], cuts])] if len(order) else to
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([x.tobytes() for x in p], pa.binary()) for p in parts)], names=["bucket", *(f"c{k}" for k in range(len(columns)))])


def _gathered(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[list[np.ndarray]]:
    """The arrays of each bucket, for rows sorted by bucket."""
    now, held = None, [[] for _ in kinds]
    for batch in batches:
        for bucket, *own in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
            if bucket != now and held[0]:
                yield [np.frombuffer(b"".join(x), kind) for x, kind in zip(held, kinds)]
                held = [[] for _ in kinds]
            now = bucket
            for to, x in zip(held, own):
                to.append(x)
    if held[0]:
        yield [np.frombuffer(b"".join(x), kind) for x, kind in zip(held, kinds)]


def _by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def heads(docs: DataFrame, n: int, percent: int, frequent, buckets: int) -> DataFrame:
    """The heads' (n-gram, doc_id, set size), packed by bucket of the n-gram; of equal sets in one task, only one."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = frequent.value, set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            grams, ids, sizes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            to = grams.view(np.uint64) + np.where(_among(grams, often), mix(ids.view(np.uint64)), np.uint64(0))
            yield from _deal(buckets, (to % np.uint64(buckets)).astype(np.int32), [grams, ids, sizes.astype(np.int32)])

        for batch, found in _sets(batches, n):
            for i, own in zip(batch.column("doc_id").to_pylist(), found):
                key = _digest(own)
                if len(own) and key not in seen:
                    seen.add(key)
                    head = _head(own, percent)
                    held.append((head, np.full(len(head), i, np.int64), np.full(len(head), len(own))))
            if sum(len(x[0]) for x in held) >= DEALT:
                yield from out()
        if held:
            yield from out()

    return docs.mapInArrow(run, "bucket int, c0 binary, c1 binary, c2 binary")


def shared(dealt: DataFrame, frequent, buckets: int) -> DataFrame:
    """(n-gram, doc_id, set size, number of sets) of the n-grams that several sets have, packed by bucket of the doc_id."""
    kinds = [np.int64, np.int64, np.int32]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for grams, ids, sizes in _gathered(batches, kinds):
            order = np.argsort(grams, kind="stable")
            grams, ids, sizes = grams[order], ids[order], sizes[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            count = np.diff(np.append(first, len(grams)))
            count[_among(grams[first], often)] = _FREQUENT
            count = np.repeat(count, np.diff(np.append(first, len(grams))))
            keep = count > 1
            own = ids[keep]
            to = (mix(own.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield from _deal(buckets, to, [grams[keep], own, sizes[keep], count[keep].astype(np.int32)])

    return dealt.mapInArrow(run, "bucket int, c0 binary, c1 binary, c2 binary, c3 binary")


def open_documents(dealt: DataFrame, percent: int) -> DataFrame:
    """(doc_id, size, weight, keys) of documents that may link: their keys, rarest first, and how common their n-grams are."""
    kinds = [np.int64, np.int64, np.int32, np.int32]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, ids, sizes, counts in _gathered(batches, kinds):
            order = np.lexsort((grams, counts, ids))
            grams, ids, sizes, counts = (x[order] for x in (grams, ids, sizes, counts))
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            found = np.diff(np.append(first, len(ids)))
            size = sizes[first].astype(np.int64)
            spare = _spare(size, percent)
            head, need = np.minimum(2 * spare + 1, size), size - spare
            least = np.minimum(_spare(need, percent) + 1, need - _spare(need, percent))
            alone = head - found
            keep = np.where(alone <= spare, head - least + 1 - alone, 0)
            weight = np.add.reduceat(np.log2(counts.astype(np.float64)), first) / found
            some = np.flatnonzero(keep > 0)
            keys = [grams[a : a + k] for a, k in zip(first[some].tolist(), keep[some].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[first][some]), pa.array(size[some]), pa.array(weight[some]), _list(keys)], names=["doc_id", "size", "weight", "keys"])

    return dealt.mapInArrow(run, "doc_id long, size long, weight double, keys array<long>")


def segments(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, fragment, grams): the set of each document cut at the fixed places of the global order."""
    ship(docs.sparkSession)
    cuts = np.array([(k << 64) // FRAGMENTS - (1 << 63) for k in range(1, FRAGMENTS)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _sets(batches, n):
            parts = [np.split(own, np.searchsorted(own, cuts)) for own in found]
            ids = np.repeat(batch.column("doc_id").to_numpy(), FRAGMENTS)
            which = np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(found))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(which), _list([x for p in parts for x in p])], names=["doc_id", "fragment", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fragment int, grams array<long>").where(F.size("grams") > 0)


def _met(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) by fragment, with the segments ``sb`` of b and ``sa`` of a (null where a has none)."""
    right = pairs.join(cut.select(F.col("doc_id").alias("b"), "fragment", F.col("grams").alias("sb")), "b")
    return right.join(cut.select(F.col("doc_id").alias("a"), "fragment", F.col("grams").alias("sa")), ["a", "fragment"], "left")


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """Pairs (a, b, size_a, size_b, more) with ``common``: segments are joined by fragment, partial overlaps summed by pair."""
    key = ["a", "b", "size_a", "size_b", "more"]
    partial = _met(pairs, cut).select(*key, F.when(F.col("sa").isNotNull(), F.size(F.array_intersect("sa", "sb"))).otherwise(0).alias("part"))
    return partial.groupBy(*key).agg(F.sum("part").alias("common"))


def outside(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id, size, weight, inner, rest) for pairs (a, b, size_b, weight, inner, b_c): keys of b's n-grams outside a.

    Of those only the ones that members of a in other components have, too, count.  They stand in one order for all
    members of a, rarest first.  rest is how many of b's come from that key on; keys for which inner and rest don't
    reach the overlap that b has with anything it links with are left out.
    """
    beyond = F.when(F.col("sa").isNull(), F.col("sb")).otherwise(F.array_except("sb", "sa"))
    parts = written(_met(pairs.select("a", "b", "b_c"), cut).select("a", "b", "b_c", beyond.alias("grams")), "gram-outside")
    single = parts.select("a", "b", "b_c", F.explode("grams").alias("gram"))
    held = single.groupBy("a", "gram").agg(F.count(F.lit(1)).alias("n"), F.min("b_c").alias("lo"), F.max("b_c").alias("hi")).where("lo < hi").select("a", "gram", "n")
    own = single.select("a", "b", "gram").join(held, ["a", "gram"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("own"))
    need = F.floor((percent * F.col("size_b") + 99) / 100)
    first = F.greatest(F.col("inner") + F.size("own") - need + 1, F.lit(0)).cast("int")
    found = own.join(pairs.drop("b_c"), ["a", "b"]).withColumn("total", F.size("own")).select("*", F.posexplode(F.slice("own", F.lit(1), first)).alias("place", "x"))
    key, rest = F.xxhash64("a", "x.gram"), (F.col("total") - F.col("place")).cast("long")
    return found.select(key.alias("key"), F.col("b").alias("doc_id"), F.col("size_b").alias("size"), "weight", "inner", rest.alias("rest"))


def _with_components(rows: DataFrame, found: DataFrame | None, *ids: str) -> DataFrame:
    """``rows`` with ``<id>_c``, the component that each id is in so far."""
    for name in ids:
        if found is None:
            rows = rows.withColumn(name + "_c", F.col(name))
        else:
            rows = rows.join(found.select(F.col("node").alias(name), F.col("component").alias(name + "_c")), name, "left").withColumn(name + "_c", F.coalesce(name + "_c", name))
    return rows


def _learned(links: DataFrame, found: DataFrame | None) -> DataFrame | None:
    """(node, component) after links (a, b); those between components so far are solved as a graph of components."""
    new = _with_components(links.select("a", "b"), found, "a", "b").where("a_c <> b_c")
    new = written(new.select(F.col("a_c").alias("a"), F.col("b_c").alias("b")).distinct(), "gram-links")
    if new.isEmpty():
        return found
    joined = written(components(new), "gram-components")
    if found is None:
        return joined
    moved = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(moved.unionByName(joined.join(found, "node", "left_anti")), "gram-components")


def _candidates(state: DataFrame, centres: int, percent: int) -> DataFrame:
    """(a, b, size_a, size_b, more) for buckets (key, doc_id, size, weight, inner, rest, doc_id_c) that hold two components.

    inner is the overlap with the centre before, rest the number of n-grams outside it from the key on that others have.
    Two members whose first key in common is this one share at most the lesser inner and the lesser rest; pairs for
    which that is too little aren't made here.

    a is the first centre of a bucket of b, and more tells whether such a bucket has more members than are centres.
    For the pairs of further centres with members in other components, more is null.
    """
    typical = F.struct("weight", (-F.col("doc_id")).alias("minus"), "size")
    groups = state.groupBy("key").agg(F.max(typical).alias("c"), F.min("doc_id_c").alias("lo"), F.max("doc_id_c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    groups = groups.select("key", (-F.col("c.minus")).alias("a"), F.col("c.size").alias("size_a"), (F.col("n") > centres + 1).alias("more"))
    rows = state.join(groups, "key").where("doc_id <> a")
    pairs = rows.select("a", F.col("doc_id").alias("b"), "size_a", F.col("size").alias("size_b"), "more")
    if centres > 1:
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "doc_id"))
        others = rows.select("key", "weight", F.col("doc_id").alias("doc_id"), F.col("size").alias("size_a"), F.col("doc_id_c").alias("a_c"), "inner", "rest").withColumn("place", place).where(F.col("place") < centres)
        others = others.select("key", F.col("doc_id").alias("x"), F.col("size_a").alias("size_x"), "a_c", F.col("inner").alias("inner_x"), F.col("rest").alias("rest_x"))
        most = F.least("inner", "inner_x") + F.least("rest", "rest_x")
        more = rows.join(others, "key").where((F.col("doc_id_c") != F.col("a_c")) & ((100 + percent) * most >= percent * (F.col("size") + F.col("size_x"))))
        one, two = F.struct("doc_id", "size"), F.struct(F.col("x").alias("doc_id"), F.col("size_x").alias("size"))
        more = more.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
        pairs = pairs.unionByName(more.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.col("a.size").alias("size_a"), F.col("b.size").alias("size_b"), F.lit(None).cast("boolean").alias("more")))
    return pairs.groupBy("a", "b", "size_a", "size_b").agg(F.max("more").alias("more"))


def _inside(told: DataFrame, percent: int, found: DataFrame | None) -> DataFrame:
    """Pairs (a, b, size_a, size_b) of members of one centre for which the overlaps with the centre alone could do.

    Only members that are mostly inside the centre matter, and only where they are in several components; then those
    outside the component that most are in are paired with all.
    """
    inner = _with_components(told.where(100 * F.col("common") >= percent * F.col("size_b")).select("a", "b", "size_b", "common"), found, "b")
    groups = inner.groupBy("a", "b_c").agg(F.count(F.lit(1)).alias("n"))
    most = groups.groupBy("a").agg(F.max(F.struct("n", "b_c"))["b_c"].alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1")
    some = inner.join(most, "a")
    other = some.where("b_c <> most").select("a", F.col("b").alias("d"), F.col("size_b").alias("size_d"), F.col("common").alias("common_d"), F.col("b_c").alias("d_c"))
    enough = (100 + percent) * F.least("common", "common_d") >= percent * (F.col("size_b") + F.col("size_d"))
    both = some.join(other, "a").where((F.col("b_c") != F.col("d_c")) & enough)
    low, high = F.least(F.struct("b", "size_b"), F.struct(F.col("d").alias("b"), F.col("size_d").alias("size_b"))), F.greatest(F.struct("b", "size_b"), F.struct(F.col("d").alias("b"), F.col("size_d").alias("size_b")))
    return both.select(low.alias("x"), high.alias("y")).select(F.col("x.b").alias("a"), F.col("y.b").alias("b"), F.col("x.size_b").alias("size_a"), F.col("y.size_b").alias("size_b")).distinct()


def _linked(percent: int):
    return 100 * F.col("common") >= percent * (F.col("size_a") + F.col("size_b") - F.col("common"))


def _frequent(table: DataFrame) -> tuple[np.ndarray, int]:
    """The n-grams that may be in the heads of many documents, and the number of n-grams in all heads.

    Slices of the documents name those that many of their own documents hold.  As these are true holders, the list
    has at most ``OFTEN`` times the mean head.  An n-gram that no slice names is counted as any other: whether it is
    listed changes which task sees it, not the result.
    """
    n, total = table.where("size > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("head"), F.lit(0))).first()
    named = table.select(F.explode("often").alias("x")).groupBy("x.gram").agg(F.sum("x.n").alias("n")).where(F.col("n") >= max(64, n // OFTEN))
    return np.sort(np.array([r[0] for r in named.select("gram").collect()], np.int64)), total


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): components of links of Jaccard similarity >= percent / 100.

    Null texts and texts without words have empty sets and link with nothing.  A row with a null doc_id links with
    nothing, as a component couldn't name it, and its component is null.  Rows that repeat a doc_id repeat its text;
    they are one node and give a row each.
    """
    spark = docs.sparkSession
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = every.where("doc_id IS NOT NULL")
    table = written(sets(every, n, percent), "gram-sets")
    digest = ["size", "low", "high"]
    first = table.where("size > 0 AND doc_id IS NOT NULL").groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    equal = written(table.select("doc_id", *digest).join(first, digest, "left").select("doc_id", "size", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "gram-equal")

    often, total = _frequent(table)
    discard(table)
    frequent = spark.sparkContext.broadcast(often)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / DEALT))
    counted = shared(_by_bucket(heads(rows, n, percent, frequent, buckets), buckets), frequent, buckets)
    alive = open_documents(_by_bucket(counted, buckets), percent)
    reps = equal.where("rep IS NOT NULL").select("doc_id", "rep").distinct()
    alive = alive.join(reps, "doc_id").drop("doc_id").withColumnRenamed("rep", "doc_id").dropDuplicates(["doc_id"])
    alive = written(alive, "gram-open")
    cut = segments(rows.join(alive.select("doc_id"), "doc_id", "left_semi"), n)
    if not equal.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        cut = cut.dropDuplicates(["doc_id", "fragment"])
    cut = written(cut, "gram-segments")

    # Sizes in a ratio of t at least are in one class or in neighbouring ones; a key holds a class and the one below.
    size_class = F.floor(F.log(F.col("size").cast("double")) / F.lit(1.001 * math.log(100.0 / percent)))
    state = alive.select("doc_id", "size", "weight", F.explode("keys").alias("gram"), F.array(size_class, size_class + 1).alias("classes"))
    state = state.select("gram", F.explode("classes").alias("class"), "doc_id", "size", "weight").select(F.xxhash64("gram", "class").alias("key"), "doc_id", "size", "weight", F.lit(0).cast("long").alias("inner"), F.col("size").alias("rest"))
    found = direct = None
    for step in itertools.count():
        centres = GROWTH ** max(0, step - 2)
        state = written(_with_components(state, found, "doc_id"), "gram-buckets")
        pairs = _candidates(state, centres, percent)
        if direct is not None:
            pairs = pairs.unionByName(direct.withColumn("more", F.lit(None).cast("boolean")))
            pairs = pairs.groupBy("a", "b", "size_a", "size_b").agg(F.max("more").alias("more"))
        pairs = written(pairs, "gram-pairs")
        discard(state)
        if pairs.isEmpty():
            break
        told = written(overlaps(pairs, cut), "gram-overlaps")
        found = _learned(told.where(_linked(percent)), found)
        told = told.where("more IS NOT NULL")  # those with the first centre
        direct = _inside(told, percent, found)
        # Around a centre whose members are in one component, or that has one member, nothing is open.
        alike = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
        members = _with_components(told.where("more").select("a", "b", "size_b", alike.alias("weight"), F.col("common").alias("inner")), found, "b")
        apart = members.groupBy("a").agg(F.min("b_c").alias("lo"), F.max("b_c").alias("hi")).where("lo < hi").select("a")
        state = outside(members.select("a", "b", "size_b", "weight", "inner", "b_c").join(apart, "a", "left_semi"), cut, percent)
    if found is None:
        return equal.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("component_id"))
    done = equal.join(found, F.col("rep") == F.col("node"), "left")
    return done.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """``docs`` with one document, of the least doc_id, for every component; a null doc_id is kept.

    Rows that repeat the kept doc_id all stay.
    """
    others = similar_components(docs, n, percent, text).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, docs["doc_id"].cast("long") == others["doc_id"], "left_anti")


#: DuckDB's form of the query, for tables small enough for a join of all shingles.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT s.doc_id, g, count(*) OVER (PARTITION BY g) AS df FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND a.df > 1 AND b.df > 1 GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS MATERIALIZED (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON r.u = e.u WHERE r.c < e.v),
m AS (SELECT u, min(c) AS c FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c::BIGINT AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON d.doc_id = m.u
"""
