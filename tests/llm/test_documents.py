"""The document operators against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import datetime
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagsieve.llm import components, decontam, iblt, langid, mixing, ngram_join, pii, queries, secrets, substring, suffix_dedup, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(120))
    texts = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 40, 150, 400]))]
        if k % 5 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage.split()[rng.randint(0, 9) : rng.randint(60, 120)]
        text = ""
        for w in words:
            text += w + rng.choice([" ", " ", "  ", "\n", ". ", "\t"])
        if k % 7 == 3:
            text = texts[k // 2]
        if k % 7 == 5:
            own = texts[k // 2].split(" ")
            own[rng.randrange(len(own))] = "zzz"
            text = " ".join(own)
        texts.append(text)
    texts += ["", None, "   \n ", "x", "the same line " * 400, "the same line " * 400, "a" * 5000, "é" * 900]
    return [(k * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s2", "s2", None]), len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    frame = spark.createDataFrame(rows, SCHEMA)
    inside = "size seed hits window text_ component open kept _id node score key bad at pieces kind digits place before rep other number spans levels row _row _key _hash _before _k _other _bad _hits"
    for name in inside.split():
        frame = frame.withColumn(name, F.lit("own"))
    return frame.repartition(3)


def _empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def _words(text):
    return (text or "").encode().split()


def test_substring(spark, docs, rows):
    got = _by_id(substring.deduplicate(docs))
    first = {}
    for i, t, *_ in rows:
        w = _words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t, *_ in rows:
        w = _words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), kept)
    assert len(got) == len(rows)
    assert substring.deduplicate(_empty(spark)).count() == 0


@pytest.mark.parametrize("group", [20_000, 1])
def test_suffix(spark, docs, rows, group):
    got = _by_id(suffix_dedup.deduplicate(docs, length=100, group=group))
    raws = {i: (t or "").encode() for i, t, *_ in rows}
    counts = Counter(r[k : k + 100] for r in raws.values() for k in range(len(r) - 99))
    for i, r in raws.items():
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 99):
            if counts[r[k : k + 100]] > 1:
                gone[k : k + 100] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(r) else 0
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(r), gone.sum(), spans)
        assert bytes(got[i].kept) == bytes(np.frombuffer(r, np.uint8)[~gone])
    assert suffix_dedup.deduplicate(_empty(spark)).count() == 0


def _sets(rows, n):
    out = {}
    for i, t, *_ in rows:
        w = [x.lower() for x in _words(t)]
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("n,percent,fragments", [(4, 85, 4), (5, 80, 1), (2, 50, 4), (2, 60, 7), (1, 90, 3)])
def test_ngram_join(spark, docs, rows, n, percent, fragments, monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENTS", fragments)
    sets = _sets(rows, n)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = _by_id(ngram_join.similar_components(docs, n, percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in sets}
    kept = ngram_join.keep_one(docs, n, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if find(i) == i) and kept.columns == docs.columns


def test_ngram_join_edges(spark):
    assert ngram_join.similar_components(_empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.similar_components(twice).collect() if r.doc_id) == [(1, 1), (1, 1), (2, 1)]
    assert [(r.n_shingles, r.component_id) for r in ngram_join.similar_components(twice).collect() if r.doc_id is None] == [(2, None)]


def test_ngram_join_keys_outside_a_centre(spark):
    """Members 1 to 6 share too little outside centre 0 to link with any other; 7 and 8 share enough with each other."""
    common, both = list(range(1000, 1005)), list(range(2000, 2012))
    own = {i: list(range(10000 * i, 10000 * i + 25)) for i in range(1, 7)} | {i: both + list(range(10000 * i, 10000 * i + 13)) for i in (7, 8)}
    cut = spark.createDataFrame([(i, 0, list(range(70)) + common + x) for i, x in own.items()] + [(0, 0, list(range(90)))], "doc_id long, fragment int, grams array<long>")
    pairs = spark.createDataFrame([(0, i, 100, 0.5, 70, i) for i in own], "a long, b long, size_b long, weight double, inner long, b_c long")
    state = ngram_join.outside(pairs, cut, 80)
    assert {r.doc_id for r in state.collect()} == {7, 8}
    assert {i: sorted((r.rest for r in state.collect() if r.doc_id == i), reverse=True) for i in own} == {i: [] for i in range(1, 7)} | {i: list(range(17, 9, -1)) for i in (7, 8)}
    found = ngram_join._candidates(state.withColumn("doc_id_c", F.col("doc_id")), 32, 80).collect()
    assert [(r.a, r.b) for r in found if {r.a, r.b} == {7, 8}] and len(found) == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(50)}}


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "Short ITEM here"), (3, None), (4, "..."), (10, "één twee"), (12, "ΑΣ.ΒΓ ΔΕ"), (11, "one two three four five six seven eight nine TEN eleven twelve")]
CASES = [
    (0, "zero one, two three-four five six seven eight nine ten then"),
    (1, "a short item here and a SHORT item here"),
    (2, "ÉÉN twee"),
    (3, "één twee één twee"),
    (4, None),
    (5, ""),
    (6, "one two three four five six seven eight nine"),
    (7, "Kelvin short item here"),
    (8, "one two three four five six seven eight nine ten eleven twelve"),
    (9, "xx ΑΣ.ΒΓ ΔΕ yy"),
    (10, "ας.βγ δε ΑΣ ΒΓ ΔΕ"),
]


@pytest.mark.parametrize("bound", [100_000, 0])
def test_decontam(spark, bound):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(CASES, "doc_id long, text string").withColumn("hits", F.lit(1)).withColumn("window", F.lit(2))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = {x: x + 32 for x in range(65, 91)}
    split = lambda t: word.findall((t or "").translate(low))
    windows = {}
    for i, t in ITEMS:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    got = _by_id(decontam.report(docs, items, set_bound=bound))
    for i, t in CASES:
        w, hit, found = split(t), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert tuple(got[i]) == (i, len(w), len(hit), len(found), digest, bool(hit))
    clean = decontam.remove_documents(docs, items, set_bound=bound)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 6]
    cut = _by_id(decontam.remove_spans(docs, items, set_bound=bound))
    assert cut[1].text == "a and a" and cut[0].text == "zero then" and cut[4].text is None


@pytest.mark.parametrize("bound", [100_000, 0])
def test_decontam_null_id(spark, bound):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(None, "nothing of the kind"), (None, "now a short item here"), (1, "short"), (2, "short item here")], "doc_id long, text string")
    got = decontam.report(docs, items, set_bound=bound).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == [(0, 4, 0, 0, False), (0, 5, 3, 1, True), (1, 1, 0, 0, False), (2, 3, 3, 1, True)]
    assert sorted(r.text for r in decontam.remove_documents(docs, items, set_bound=bound).collect()) == ["nothing of the kind", "short"]
    assert "now a" in {r.text for r in decontam.remove_spans(docs, items, set_bound=bound).collect()}


def test_decontam_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.where("false")
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    assert decontam.report(docs.where("false"), items).count() == 0
    assert decontam.report(docs, none).where("contaminated").count() == 0
    assert decontam.remove_documents(docs, none).count() == len(CASES)


def test_fingerprints(spark, docs, rows):
    got = _by_id(iblt.fingerprints(docs))
    pieces = lambda t: {(m, min(len(m), 4095)) for m in re.findall(r"[^\n]{120,}?[.!?](?=[ \n]|\Z)|[^\n]+", t)}
    weight = lambda s: sum(x[1] for x in s)
    texts = [t or "" for _, t, *_ in rows]
    for k, (i, *_) in enumerate(rows):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        for other, near in ((e, r.near_edited), (n, r.near_next)):
            a, b = pieces(t), pieces(other)
            assert near == pytest.approx(1 - weight(a ^ b) / (weight(a) + weight(b)) if a or b else 1.0)
    prints = {}
    for k, (i, *_) in enumerate(rows):
        assert prints.setdefault(texts[k], got[i].fingerprint) == got[i].fingerprint
    assert iblt.fingerprints(_empty(spark)).count() == 0
    one = iblt.fingerprints(docs.where("doc_id = 0")).first()
    assert one.near_next == 1.0


def test_fingerprints_of_unpunctuated_and_repeated_texts(spark, docs):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(1000)), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(4000)), "a" * 5000]
    texts += ["同じ文です。" * 300, "one and the same line\n" * 100, "word " * 30_000 + "end", "", "\n\n"]
    more = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string")
    own = docs.select("doc_id", "text").unionByName(more)
    found = own.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", iblt.bounded_pieces(F.col("text")).alias("p"), iblt.bounded_digests(F.col("text")).alias("d")).orderBy("doc_id").collect()
    for r in found:
        assert "".join(r.p) == r.text.replace("\n", "") and max(map(len, r.p), default=0) <= iblt.BOUND < 4096
        assert len(set(r.d)) == len(r.d) and sum(x & 4095 for x in r.d) == sum(map(len, r.p))
    got = _by_id(iblt.fingerprints(own, digest=iblt.bounded_digests))
    edits = [(r.doc_id, r.text[: len(r.text) - len(r.text) // 4] + n.text[: len(r.text) // 4]) for r, n in zip(found, found[1:] + found[:1])]
    edits = {r.doc_id: Counter(r.p) for r in spark.createDataFrame(edits, "doc_id long, text string").select("doc_id", iblt.bounded_pieces(F.col("text")).alias("p")).collect()}
    weight = lambda c: sum(len(p) * n for p, n in c.items())
    for r, n in zip(found, found[1:] + found[:1]):
        a = Counter(r.p)
        for b, near in ((edits[r.doc_id], got[r.doc_id].near_edited), (Counter(n.p), got[r.doc_id].near_next)):
            assert near == pytest.approx(1 - weight((a - b) + (b - a)) / (weight(a) + weight(b)) if a or b else 1.0)
    assert all(got[1000 + k].near_edited > 0.6 for k in range(6))


def test_null_ids_stand_alone(spark):
    text = " ".join(f"word{k}" for k in range(90))
    rows = spark.createDataFrame([(None, text), (None, text), (3, text), (None, None), (5, text)], "doc_id long, text string")
    got = substring.deduplicate(rows).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 0, 0), (0, 90, 0), (0, 90, 0), (3, 90, 0), (5, 90, 90)]
    got, size = suffix_dedup.deduplicate(rows).collect(), len(text)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 0, 0), (0, size, 0), (0, size, 0), (3, size, size), (5, size, size)]
    got = iblt.fingerprints(rows, digest=iblt.bounded_digests).collect()
    assert sorted((r.doc_id or 0, r.near_next) for r in got) == [(0, 1.0)] * 3 + [(3, 1.0), (5, 1.0)]
    assert len({r.fingerprint for r in got if r.n_chars}) == 1


def test_long_texts(spark):
    """Two texts of over 2 MB with a common end, one of a single word."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    one, two, end = (" ".join(rng.choice(words) for _ in range(n)) for n in (330_000, 330_000, 200))
    texts = [one + " " + end, two + " " + end, "x" * 2_500_000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = _by_id(substring.deduplicate(rows))
    assert [(got[k].n_words, got[k].n_removed) for k in range(4)] == [(330_200, 0), (330_200, 200), (1, 0), (0, 0)]
    got = _by_id(suffix_dedup.deduplicate(rows))
    assert [(got[k].n_removed, got[k].n_spans) for k in range(4)] == [(len(end) + 1, 1), (len(end) + 1, 1), (2_500_000, 1), (0, 0)]
    got = _by_id(ngram_join.similar_components(rows))
    assert [got[k].component_id for k in range(4)] == [0, 1, 2, 3] and got[2].n_shingles == 1


def test_iblt_retries(spark):
    rng = random.Random(3)
    pairs = [(k, 0, [rng.getrandbits(62) for _ in range(n)], [rng.getrandbits(62) for _ in range(m)]) for k, (n, m) in enumerate([(0, 1), (1, 0), (40, 3), (500, 700), (3000, 10)])]
    frame = spark.createDataFrame(pairs, "doc_id long, pair int, a array<long>, b array<long>")
    got = _by_id(iblt.decode(frame, 1, 1, 10))
    for k, _, a, b in pairs:
        assert got[k].rest > 0 or got[k].w == sum(x & 4095 for x in a + b)
    assert sum(got[k].rest == 0 for k in range(5)) >= 4


def test_mixing(spark, docs, rows):
    got = _by_id(mixing.mix(docs.withColumn("taken", F.lit("own"))))
    size = {i: len(_words(t)) for i, t, *_ in rows}
    total = Counter()
    for i, _, _, s, _ in rows:
        total[s] += size[i]
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 2.0 * total[s] for s in full})
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    taken = Counter()
    for i, _, _, s, _ in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], total[s]) and r.target == pytest.approx(target[s])
        assert r.taken % max(size[i], 1) == 0 and 0 <= r.taken <= 2 * size[i]
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.1 * total[s] + 2 * max(size.values())
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in _by_id(mixing.mix(docs.repartition(7))).items()}
    assert mixing.emit(mixing.mix(docs)).count() == sum(r.copies for r in got.values())
    assert mixing.mix(_empty(spark)).count() == 0


def test_mixing_comes_near_with_many_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(pmod(id * 7919, 97) AS int))").alias("text"), F.expr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END").alias("source"))
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.01)


def test_language_model_is_exact():
    model = langid.Model({"a": ["abracadabra"], "b": ["banana", "bandana"]})
    trees = {}
    for name, texts in (("a", ["abracadabra"]), ("b", ["banana", "bandana"])):
        tree = trees[name] = {}
        for t in texts:
            raw = b"\0\0\0" + t.encode()
            for k in range(3, len(raw)):
                for n in range(4):
                    tree.setdefault((n, raw[k - n : k]), Counter())[raw[k]] += 1

    def bits(tree, text):
        raw, total = b"\0\0\0" + text, 0.0
        for k in range(3, len(raw)):
            for n in (3, 2, 1, 0):
                seen = tree.get((n, raw[k - n : k]))
                if seen is None:
                    continue
                size, kinds = sum(seen.values()), len(seen)
                if raw[k] in seen:
                    total -= np.log2(seen[raw[k]] / (size + kinds))
                    break
                total -= np.log2(kinds / (size + kinds))
            else:
                total += 8.0
        return total

    texts = [b"abra", b"bandit", "née".encode(), b"zzzz", b"", b"ab"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = model.lengths(data, off)
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx([bits(trees["a"], t), bits(trees["b"], t)], abs=1e-3)


def test_language_edges(spark, docs):
    found = langid.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the cat"), (None, "le chat")], "doc_id long, text string"), langid.Model({"en": ["the dog and the cat"], "fr": ["le chien et le chat"]}))
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "und", 2: "und", 3: "und", 4: "en", None: "fr"}
    assert langid.train(_empty(spark)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.keep_identified(docs, None).count() == 0
    kept = langid.keep_identified(docs, langid.Model({"en": ["abc"], "fr": ["éde"]}))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_language_of_long_texts_is_learned(spark):
    rng = random.Random(1)
    vocabulary = {"en": "the dog and cat with house".split(), "xx": "zork blimp quazz vrem ytt".split()}
    rows = [(k, " ".join(rng.choice(vocabulary[x]) for _ in range(n)), x) for k, (x, n) in enumerate([("en", 50)] * 5 + [("xx", 9000)] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs, 400, 20_000)
    assert {k: {len(t) for t in v} for k, v in sample.items() if k == "xx"} == {"xx": {20_000}} and len(sample["en"]) == 5
    assert all(any(t in r[1] for r in rows) for t in sample["xx"]) and len({t[:99] for t in sample["xx"]}) == 3
    found = langid.identify(spark.createDataFrame([(1, "blimp zork vrem"), (2, "the cat and dog")], "doc_id long, text string"), langid.train(docs))
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "xx", 2: "en"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = langid.identify(docs, langid.train(docs.where(~out))).join(docs.select("doc_id", "lang"), "doc_id").where(out)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_language_unknown_is_dropped(spark):
    learned = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = learned.unionByName(learned.limit(9).select("doc_id", F.lit("lorem 77 ipsum 88 " * 9).alias("text"), F.lit("und").alias("lang"), "source", "n_chars"))
    model = langid.train(learned)
    bad = ["aGVsbG8gd29ybGQ4J3k1", "我们今天去公园散步吧", "Привет, как дела сегодня?", "0f3a9c zxqj ###", "lorem 77 ipsum 88 lorem", None, "", "12"]
    good = ["A.", "De.", "the of and", "the"]
    docs = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    assert sorted(r.text for r in langid.keep_identified(docs, model).collect()) == sorted(good)
    clean = learned.where(r"lang <> 'und' AND text RLIKE '\\p{L}'")
    assert langid.keep_identified(clean, model).count() >= 0.995 * clean.count()


PII = [
    "mail a.b+c@d-e.fr.uk, x@y and @@ u@v.w@z.q plus a@b.c.",
    "ip 1.2.3.4 999.1.1.1 1.2.3.4.5 01.02.03.004 12345678901234567890.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111111",
    "phone +1 (743) 555-3824 éeux +12 +1234567890123456 +1((((2))))345678 9",
    "a" * 3000 + "@", "1" * 3000, "+" * 2000 + "1", "", None, "é@é.fr é1.2.3.4",
]


def _pii(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_pii_patterns(spark, docs):
    got = _by_id(pii.report(spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("near", F.lit(1))))
    for k, t in enumerate(PII):
        want = _pii(t)
        told = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(x[0] == kind for x in want) for kind in pii.KINDS)
        assert got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[k].spans.startswith(told)
    assert pii.report(_empty(spark)).count() == 0


def test_pii_disclosing_terms(spark):
    texts = [f"word{k} filler here about nothing much" for k in range(60)]
    texts += ["contact Quillfeather at q@example.com today", "please write Quillfeather via q@example.com now", "the boss Quillfeather has q@example.com indeed", "see only r@example.com there", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = _by_id(pii.report(docs))
    for k in (60, 61, 62):
        at = texts[k].index("Quillfeather")
        assert f"term:{at}:{at + 12}" in got[k].spans and got[k].n_terms == 1
    assert sum(r.n_terms for r in got.values()) == 3
    clean = _by_id(pii.sanitise(docs))
    assert pii.sanitise(docs.withColumns({c: F.lit(1) for c in ("_id", "_spans", "spans", "number", "levels")})).columns == ["doc_id", "text", "_id", "_spans", "spans", "number", "levels"]
    assert clean[60].text == "contact  at [EMAIL] today" and clean[63].text == "see only [EMAIL] there" and clean[0].text == texts[0] and clean[64].text is None


@pytest.mark.parametrize("copies", [1, 3, 40])
def test_pii_disclosing_terms_of_copies(spark, copies):
    own = ["contact Quillfeather at q@example.com today", "please write Quillfeather via q@example.com now"]
    texts = [f"word{k} filler here about nothing much" for k in range(300)] + own * copies
    got = _by_id(pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [r.n_terms for k, r in sorted(got.items())] == [0] * 300 + [1] * (2 * copies)


@pytest.mark.parametrize("held", [1, pii.HELD])
def test_pii_term_counts(spark, held):
    texts = [f"alpha Beta{'x' * (k % 7)} beta, ALPHA gamma{'y' * (k % 11)} été" for k in range(400)] + [None, "", "1 2 3"]
    wanted = ["alpha", "beta", "betaxxx", "gammay", "été", "absent"]
    terms = spark.createDataFrame([(t, pii._term_slot(t)) for t in wanted] * 2, "term string, slot long")
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r.term: r.n_docs for r in pii.term_counts(docs, terms, held=held).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words = [set(re.findall("[a-zé]{3,}", (t or "").lower())) for t in texts]
    assert got == {w: n for w in wanted if (n := sum(w in x for x in words))}


SECRETS = [
    'password = "abcdefghijkl" and PASSWD:short token=secret: "abcdefghijklmn"', "AKIA1234567890ABCD AKIA12 xAKIAAKIA0000000000", "0123456789abcdef 0123456789abcde deadbeefdeadbeefdeadbeef",
    "api_key: ABCDEFGHIJKLMNOP apikey='x=y=z=/+.-_12345'", "ſecret = abcdefghijklmnop toKen = abcdefghijklmnop", "", None,
]


def test_secret_patterns(spark):
    got = _by_id(secrets.scan(spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string").withColumn("spans", F.lit(1))))
    for k, t in enumerate(SECRETS):
        t = t or ""
        want = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        told = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(want))
        assert got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(got[k].spans.split(","))
    assert secrets.scan(_empty(spark)).count() == 0


@pytest.mark.parametrize(
    "text,secret",
    [
        ('k = "Zx9_qwerty77Plm"\nclient.authSecret = k', "Zx9_qwerty77Plm"),
        ('{"dbPassword": "hunter2hunter2!"}', "hunter2hunter2!"),
        ("export DB_PASS=s3cr3t-Val/77x", "s3cr3t-Val/77x"),
        ("private_key := 'Qm1x-77Yu_pPqL0'", "Qm1x-77Yu_pPqL0"),
        ('sessionToken: str = "8Hf2kL0pQz77"', "8Hf2kL0pQz77"),
    ],
)
def test_secret_assignments(text, secret):
    assert secret not in secrets.redacted(text) and secrets.redacted(text) != text


@pytest.mark.parametrize("text", ["hello: world", 'password = "changeme"', "key: value", "the password: it is long", "x = 5", 'token = "${TOKEN_FROM_ENV}"', "ratio 3:4 = 0.75"])
def test_secret_clean(text):
    assert secrets.redacted(text) == text


def test_secret_constants_are_told_once():
    text = 'a = "Zx9_qwerty77Plm"\n' + "a = a + a\n" * 50_000 + "password = a\n"
    assert [x[:3] for x in secrets.spans(text)] == [(5, "named", 20)]
    chain = 'a = "Zx9_qwerty77Plm"\n' + "".join(f'a = a + "q{k}"\n' for k in range(2000)) + "password = a\nsecret = a"
    assert len(secrets.spans(chain)) == 2001


@pytest.mark.parametrize("text", ["key = " + '\\"' * 200_000, "key = '" + "\\'" * 200_000, "a='" * 100_000, "password" * 50_000, "a = b + " * 50_000])
def test_secret_time_is_linear(text):
    began = time.perf_counter()
    secrets.spans(text)
    assert time.perf_counter() - began < 20


def test_neighbourhoods_equal_brute_force_and_are_linear():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["word", "Éa b", "ab ", "\n", " x@y.zz ", "1.2.3.4", "+1 234 567 89", " ", "cd" * rng.randint(1, 5)]) for _ in range(rng.randint(0, 30)))
        found = pii.base_spans(text)
        terms = [m for m in re.finditer("[A-Za-z\x80-\U0010ffff]{3,}", text) if not any(m.start() < b and a < m.end() for _, a, b in found)]
        want = []
        for kind, a, b in found:
            near = [m for m in terms if m.end() <= a][-6:] + [m for m in terms if m.start() >= b][:6]
            want += [(f"{kind}:{text[a:b]}", *m.span()) for m in near] or [(f"{kind}:{text[a:b]}", a, b)]
        assert [(x["entity"], x["start"], x["end"]) for x in pii.neighbourhoods(text, found)] == want
    began, text = time.perf_counter(), " ".join(f"hello there user{k}@example.com my friend" for k in range(20_000))
    assert len(pii.neighbourhoods(text, pii.base_spans(text))) > 200_000 and time.perf_counter() - began < 20


def test_redact_keeps_columns(spark, docs):
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.where("text IS NULL").count() == 1


LOG = [
    ("spam", "Bad.Example.com", 10, "add"), ("spam", "bad.example.com/", 20, "remove"), ("spam", "bad.example.com", 30, "add"),
    ("spam", "example.org/a/b", 5, "add"), ("adult", "example.org", 0, "add"), ("adult", "example.org", 15, "remove"), ("adult", "example.org", 15, "add"),
    ("adult", "http://user@bad.example.com:80/x%61/?q#f", 12, "add"), ("scam", "1.2.3.4", 3, "add"), ("scam", None, 3, "add"), ("scam", "example.com", None, "add"), ("scam", "com/deep", 8, "remove"),
]
URLS = [
    "https://bad.example.com/", "http://www.BAD.example.com:8080/xa/y?z", "//notbad.example.com/", "bad.example.com./x/../xa", "http://example.org/a/bc", "http://example.org//a/./b/c#d",
    "http://q.example.org/a", "http://1.2.3.4/a", "http://9.1.2.3.4/", "http://x@1.2.3.4:1/", "http://", "", None, "mailto:a@example.org", "http://com/deep",
]


@pytest.mark.parametrize("bound", [100_000, 0])
def test_url_filter(spark, bound):
    day = lambda d: None if d is None else datetime.date(2024, 1, 1) + datetime.timedelta(d)
    log = spark.createDataFrame([(a, b, day(c), d) for a, b, c, d in LOG], "list string, entry string, at date, action string")
    cases = [(None if k % 9 == 4 else k // 2, u, day(d)) for k, (u, d) in enumerate((u, d) for u in URLS for d in (None, *range(40)))]
    got = urlfilter.judge(spark.createDataFrame(cases, "page_id long, url string, captured date"), log, bound).collect()
    states = {}
    for name, entry, at, action in sorted((x for x in LOG if x[1] and x[2] is not None), key=lambda x: (x[2], x[3])):
        states.setdefault((name, urlfilter.key(*urlfilter.parts(entry))), []).append((day(at), action))

    def want(url, at):
        labels, segments = urlfilter.parts(url) or ([], [])
        found = []
        for (name, entry), changes in states.items():
            host, *path = entry.split("/")
            own = [host] if host == "1.2.3.4" else host.split(".")
            now = [action for d, action in changes if at and d <= at]
            if now and now[-1] == "add" and labels[-len(own) :] == own and segments[: len(path)] == path:
                found.append((-len(path), -len(own), entry, name))
        names = sorted({x[3] for x in found})
        return len(names), ",".join(names), min(found)[2] if found else None, bool(names)

    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((*c, *want(*c[1:])) for c in cases), key=key)
    assert {r.url for r in got if r.blocked} == {URLS[k] for k in (0, 1, 3, 4, 5, 6, 7, 9)}


def test_url_filter_empty(spark):
    none = spark.createDataFrame([], "list string, entry string, at date, action string")
    pages = spark.createDataFrame([(1, "http://a.b/", datetime.date(2024, 1, 1))], "page_id long, url string, captured date")
    assert [r.blocked for r in urlfilter.judge(pages, none).collect()] == [False]
    assert urlfilter.judge(pages.where("false"), none).count() == 0


def test_url_filter_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    got = queries.queries()["op4_url_filter"](spark, path)
    want = duckdb.sql(urlfilter.ORACLE)
    assert got.columns == want.columns
    got, key = [tuple(r) for r in got.collect()], lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)
    assert len(got) == 250 and 0 < sum(r[-1] for r in got) < 250


def test_iblt_stages_hold_few_rounds(spark, monkeypatch):
    """Retries of many rounds are cut into stages of a few, with the same result."""
    a, b = [k * 4096 + 7 for k in range(1, 60)], [k * 4096 + 7 for k in range(40, 90)]
    frame = spark.createDataFrame([(1, 0, a, b), (2, 1, a, [])], "doc_id long, pair int, a array<long>, b array<long>")
    whole = iblt.decode(frame, 1, 4, 10).collect()
    monkeypatch.setattr(iblt, "ROUNDS", 3)
    cut = iblt.decode(frame, 1, 4, 10)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") <= 2 * 3 + 2
    assert sorted(cut.collect()) == sorted(whole)
    assert {r.doc_id: (r.w, r.rest) for r in whole} == {1: (7 * 69, 0), 2: (7 * 59, 0)}
