"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame operations only.

A text is the set of its paragraphs; a long paragraph is cut at the first sentence end after ``PIECE`` characters,
again and again, so that an edit leaves the pieces before it as they were.  A piece's digest holds a hash and its
length.  The sketch has three tables of cells; a digest goes into one cell of each, where the number of digests,
the xor of digests and the xor of their check values are kept.  Two sketches subtract cell by cell: what both texts
have cancels.  Cells with one digest left are peeled, which frees others, until nothing is left: the digests
that differ are then known, and with them their lengths.  Likeness is the share of the two texts' (distinct)
pieces, by length, that doesn't differ.

``bounded_digests`` cuts on where no sentence ends for long, by the hash of words (of characters in scripts without
spaces), so that no piece is longer than the weight can tell, and counts each occurrence of a repeated piece.

The fingerprint is the sketch of ``3 * CELLS`` cells, which peels about fifteen differing pieces.  Pairs that it can't
peel (most of two unlike texts, about half of all pairs) are retried with sketches that grow with the number of
pieces, then four times as large under other hashes, again and again until none is left.  The first try is made inside the row (higher-order functions over at most 24 cells), retries by
aggregation over cells: a round of peeling is one expansion and two aggregations, all in one partitioning.

The next document by id is found by a window inside ranges of ids.  The ranges are quantiles of the ids, and the
first document of each range, of which there are ``RANGES`` at most, is joined to the last of the range before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Cells of each of the three tables of a fingerprint.
CELLS = 8
#: A piece of a paragraph ends with the first sentence after so many characters.
PIECE = 120
RANGES = 4096
#: Rounds of peeling in one stage.
ROUNDS = 8
#: Documents in a range of ids, about.
RANGE_ROWS = 1000
_WEIGHT = 4095  # low bits of a digest: the length of its piece
_PATTERN = r"[^\n]{%d,}?[.!?](?=[ \n]|$)|[^\n]+" % PIECE
#: Longer pieces are cut at words (in words beyond WORD, at characters) whose hash is 0 modulo so many, about.
#: Where that leaves more (one word again and again), by length.  The bound is below ``_WEIGHT``: lengths are true.
BOUND, WORD, WORDS, CHARS = 256, 64, 16, 128
#: Sentence ends of other scripts stand without a space after them.
_SIGNS = "\u3002\uff01\uff1f\uff61\u0964\u0965\u061f\u06d4\u1362\u104b\u17d4"
_ANY_SENTENCE = rf"[^\n]{{{PIECE},}}?(?:[.!?\u2026](?=[ \n]|$)|[{_SIGNS}])|[^\n]+"
_CHECK = "xxhash64({k}, 99)"
_CELL = "struct<n:int,k:bigint,c:bigint>"


def digests(text: Column) -> Column:
    """Distinct digests of the pieces of a text: 52 bits of hash and 12 bits of length."""
    pieces = F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p).bitwiseAND(~_WEIGHT).bitwiseOR(F.least(F.length(p), F.lit(_WEIGHT)).cast("long"))))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bounded_pieces(text: Column) -> Column:
    """The pieces of a text in order, none longer than ``BOUND``; what ends a piece depends on the text nearby.

    A line feed, which no piece holds, marks a cut inside what has no sentence end for ``BOUND`` characters.
    """

    def cut(unit: Column, at: Column) -> Column:
        return F.when(at, F.concat(unit, F.lit("\n"))).otherwise(unit)

    def by_chars(word: Column) -> Column:
        near = lambda cs, i: F.pmod(F.xxhash64(*(F.get(cs, i - k) for k in range(4))), F.lit(CHARS)) == 0
        return _with(F.split(word, ""), lambda cs: F.array_join(F.transform(cs, lambda c, i: cut(c, near(cs, i))), ""))

    def by_words(piece: Column) -> Column:
        units = F.regexp_extract_all(piece, F.lit(r"[^ \t]+[ \t]*|[ \t]+"), F.lit(0))
        marked = F.transform(units, lambda w: F.when(F.length(w) > WORD, by_chars(w)).otherwise(cut(w, F.pmod(F.xxhash64(w), F.lit(WORDS)) == 0)))
        return F.regexp_extract_all(F.array_join(marked, ""), F.lit(rf"[^\n]{{1,{BOUND}}}"), F.lit(0))

    pieces = F.regexp_extract_all(text, F.lit(_ANY_SENTENCE), F.lit(0))
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > BOUND, by_words(p)).otherwise(F.array(p))))


def bounded_digests(text: Column) -> Column:
    """Digests of ``bounded_pieces``: a piece that comes again has another digest each time, of its number."""

    def digest(h: Column, length: Column) -> Column:
        return h.bitwiseAND(~_WEIGHT).bitwiseOR(length.cast("long"))

    def numbered(ds: Column) -> Column:
        def runs(at: Column) -> Column:
            def run(p: Column, r: Column) -> Column:
                end = F.coalesce(F.get(at, r + 1), F.size(ds)) - 1
                return F.transform(F.sequence(p, end), lambda i: F.when(i == p, F.get(ds, p)).otherwise(digest(F.xxhash64(F.get(ds, p), i - p), F.get(ds, p).bitwiseAND(_WEIGHT))))

            return F.flatten(F.transform(at, run))

        return _with(F.filter(F.transform(ds, lambda d, i: F.when((i == 0) | (F.get(ds, i - 1) != d), i)), lambda i: i.isNotNull()), runs)

    found = F.transform(bounded_pieces(text), lambda p: digest(F.xxhash64(p), F.length(p)))
    return _with(found, lambda ds: F.when(F.size(F.array_distinct(ds)) == F.size(ds), ds).otherwise(_with(F.array_sort(ds), numbered)))


def _place(digest: str, table: str) -> str:
    return f"cast(shiftright(xxhash64({digest}), {table} * 8) & {CELLS - 1} AS int)"


def sketch(column: str) -> Column:
    """The cells of a column of digests."""
    parts = [
        f"""transform(sequence(0, {CELLS - 1}), i -> aggregate(filter({column}, d -> {_place('d', str(r))} = i),
            cast(named_struct('n', 0, 'k', 0L, 'c', 0L) AS {_CELL}), (a, d) -> cast(named_struct('n', a.n + 1, 'k', a.k ^ d, 'c', a.c ^ {_CHECK.format(k='d')}) AS {_CELL})))"""
        for r in range(3)
    ]
    return F.expr(f"concat({', '.join(parts)})")


def text_form(cells: str) -> Column:
    """A sketch as a string: for each cell the count, the digests' xor and six digits of the checks'."""
    return F.expr(f"array_join(transform({cells}, x -> concat(hex(x.n), ':', lower(hex(x.k)), ':', lower(right(hex(x.c), 6)))), ' ')")


def peeled(left: str, right: str, rounds: int = 6) -> Column:
    """struct(cells, pure, w): what is left of the difference of two sketches, and the length of what was peeled.

    Steps alternate: one lists the pure cells, the next takes their digests out of all cells.
    """
    start = f"""named_struct('cells', zip_with({left}, {right}, (x, y) -> cast(named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c) AS {_CELL})),
                'pure', cast(array() AS array<{_CELL}>), 'w', 0L)"""
    pure = f"array_distinct(filter(s.cells, x -> abs(x.n) = 1 AND x.c = {_CHECK.format(k='x.k')}))"
    hit = " OR ".join(f"(j = {r * CELLS} + {_place('p.k', str(r))})" for r in range(3))
    apply = f"transform(s.cells, (x, j) -> aggregate(filter(s.pure, p -> {hit}), x, (a, p) -> cast(named_struct('n', a.n - p.n, 'k', a.k ^ p.k, 'c', a.c ^ p.c) AS {_CELL})))"
    weight = f"aggregate(s.pure, s.w, (t, p) -> t + (p.k & {_WEIGHT}L))"
    step = f"""CASE WHEN size(s.pure) = 0 THEN named_struct('cells', s.cells, 'pure', {pure}, 'w', s.w)
               ELSE named_struct('cells', {apply}, 'pure', cast(array() AS array<{_CELL}>), 'w', {weight}) END"""
    return F.expr(f"aggregate(sequence(1, {2 * rounds}), {start}, (s, i) -> {step})")


def decode(pairs: DataFrame, seed: int, grow: int, rounds: int) -> DataFrame:
    """(doc_id, pair, w, rest) for (doc_id, pair, a, b): length of the digests in one of a and b only, and the cells left.

    Sketches have three tables of a power of two of cells, ``grow`` times what the digests may need.
    """
    key = ["doc_id", "pair", "per"]
    per = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(16.0), (F.size("a") + F.size("b")) * 0.75)))).cast("int") * grow
    both = F.concat(F.transform("a", lambda d: F.struct(d.alias("k"), F.lit(1).alias("n"))), F.transform("b", lambda d: F.struct(d.alias("k"), F.lit(-1).alias("n"))))
    # A fixed number of partitions: the rows are small but grow some hundred times when they are expanded.
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 20_000)
    rows = pairs.repartition(parts, "doc_id").select("doc_id", "pair", per.alias("per"), F.explode(both).alias("x")).select(*key, "x.k", F.col("x.n").cast("long").alias("n"))

    def cell(r: int) -> str:
        return f"cast({r} * per + pmod(xxhash64(k, {seed + r}), per) AS int)"

    rows = rows.withColumn("cell", F.expr(f"explode(array({', '.join(cell(r) for r in range(3))}))"))
    rows = rows.groupBy(*key, "cell").agg(F.sum("n").alias("n"), F.expr("bit_xor(k)").alias("k"), F.expr(f"bit_xor({_CHECK.format(k='k')})").alias("c"))
    live = "(n <> 0 OR k <> 0 OR c <> 0)"
    rows = rows.where(live).withColumn("kind", F.lit(0))
    for step in range(rounds):
        if step and step % ROUNDS == 0:  # a task holds the memory of every round of its stage at once
            rows = written(rows, "iblt-cells").repartition(parts, "doc_id")
        # A pure cell (kind 0) sends its digest to its three cells (kind 1) and to the sum of lengths (kind 2).
        sent = ", ".join(f"named_struct('kind', 1, 'cell', {cell(r)}, 'n', -n, 'k', k, 'c', c, 'mk', k)" for r in range(3))
        own = "named_struct('kind', kind, 'cell', cell, 'n', n, 'k', k, 'c', c, 'mk', 0L)"
        told = f"named_struct('kind', 2, 'cell', -1, 'n', k & {_WEIGHT}L, 'k', 0L, 'c', 0L, 'mk', k)"
        rows = rows.select(*key, F.expr(f"explode(CASE WHEN kind = 0 AND abs(n) = 1 AND c = {_CHECK.format(k='k')} THEN array({own}, {sent}, {told}) ELSE array({own}) END)").alias("x")).select(*key, "x.*")
        # Two pure cells of one digest send the same; it counts once.
        rows = rows.groupBy(*key, "kind", "cell", "mk").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.max("c").alias("c"))
        rows = rows.withColumn("kind", F.when(F.col("kind") == 2, 2).otherwise(0))
        rows = rows.groupBy(*key, "kind", "cell").agg(F.sum("n").alias("n"), F.expr("bit_xor(k)").alias("k"), F.expr("bit_xor(c)").alias("c"))
        rows = rows.where(f"kind = 2 OR {live}")
    done = rows.groupBy("doc_id", "pair").agg(F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(0)).alias("w"), F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("rest"))
    return done


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): each text and that of the next document by id; the first's for the last."""
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    n = ids.count()
    if not n:
        return docs.select("doc_id", "text", F.col("text").alias("next"))
    ranges = max(256, min(RANGES, n // RANGE_ROWS))
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100_000)).first()[0]))
    # The range of an id, by a search over every 64th cut and then over 64 cuts.
    coarse = ", ".join(f"{x}L" for x in cuts[63::64]) or "9223372036854775807L"
    fine = ", ".join(f"{x}L" for x in cuts)
    span = F.expr(f"(size(filter(array({coarse}), x -> x <= doc_id)) * 64) AS int")
    at = F.expr(f"at + size(filter(slice(array({fine}), at + 1, 64), x -> x <= doc_id))")
    ranged = lambda rows: rows.withColumn("at", span).withColumn("span", at).drop("at")
    heads = sorted(ranged(ids).groupBy("span").agg(F.min("doc_id")).collect())  # RANGES rows at most
    after = ", ".join(f"({a}, {b}L)" for (a, _), (_, b) in zip(heads, heads[1:] + heads[:1]))
    after = spark.sql(f"SELECT * FROM VALUES {after} AS t(_span, _id)")
    first = docs.where(F.col("doc_id").isin([x for _, x in heads])).groupBy(F.col("doc_id").alias("_id")).agg(F.min("text").alias("_head"))
    after = after.join(first, "_id").select("_span", "_head")
    order = Window.partitionBy("span").orderBy("doc_id", "text")
    rows = ranged(docs).select("doc_id", "text", "span", F.lead("text").over(order).alias("_next"))
    rows = rows.join(after, F.col("span") == F.col("_span"))
    return rows.select("doc_id", "text", F.coalesce("_next", "_head").alias("next"))


def fingerprints(docs: DataFrame, text: str = "text", digest=digests) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by the start of the next document.  Null text is empty; two empty
    texts are alike (1).  A single document is its own next, and so is a row with a null doc_id, which has no place
    in the order.  Rows that repeat a doc_id stand in the order of their texts.
    ``digest`` makes the digests: ``digests`` of whole distinct pieces, or ``bounded_digests``, which op5 uses.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nameless = rows.where("doc_id IS NULL").withColumn("next", F.col("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    rows = with_next(rows.where("doc_id IS NOT NULL")).unionByName(nameless).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next", F.lit(1), quarter)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("text")).alias("a"), digest(F.col("edited")).alias("e"), digest(F.col("next")).alias("x"))
    rows = rows.withColumns({f"s{c}": sketch(c) for c in "aex"})
    rows = rows.withColumn("pe", peeled("sa", "se")).withColumn("px", peeled("sa", "sx"))
    clear = lambda c: F.when(F.forall(c + ".cells", lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)), F.col(c + ".w"))
    table = written(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "edited_sha256", text_form("sa").alias("fingerprint"), text_form("se").alias("edited_fingerprint"), "a", "e", "x", clear("pe").alias("we"), clear("px").alias("wx")),
        "iblt-rows",
    )
    failed = table.where("we IS NULL").select(F.col("row").alias("doc_id"), F.lit(0).alias("pair"), "a", F.col("e").alias("b")).unionByName(table.where("wx IS NULL").select(F.col("row").alias("doc_id"), F.lit(1).alias("pair"), "a", F.col("x").alias("b")))
    left, solved, seed, grow, rounds = failed, None, 1000, 1, 8
    while True:
        tried = written(decode(left, seed, grow, rounds), "iblt-solved")
        whole = tried.where("rest = 0")
        solved = whole if solved is None else solved.unionByName(whole)
        again = tried.where("rest > 0").select("doc_id", "pair")
        if again.isEmpty():
            break
        left, seed, grow, rounds = failed.join(again, ["doc_id", "pair"], "left_semi"), seed + 1000, grow * 4, rounds + 4
    solved = solved.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when(F.col("pair") == 0, F.col("w"))).alias("we1"), F.max(F.when(F.col("pair") == 1, F.col("w"))).alias("wx1"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda t, k: t + k.bitwiseAND(_WEIGHT))
    slim = table.select("row", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "we", "wx", (total("a") + total("e")).alias("te"), (total("a") + total("x")).alias("tx"))
    rows = slim.join(solved, F.col("row") == F.col("_id"), "left")
    near = lambda w, w1, t: F.when(F.col(t) == 0, 1.0).otherwise(1.0 - F.coalesce(F.col(w), F.col(w1), F.lit(0)) / F.col(t))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("we", "we1", "te").alias("near_edited"), near("wx", "wx1", "tx").alias("near_next"))
