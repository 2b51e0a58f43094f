"""BPE against the tokenizers library, the filter audit against SQL and brute force, periodic runs against brute force."""

import hashlib
import random
import time
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bagsieve.llm import bpe, filter_audit, periodic, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(path)


ODD = ["", None, " ", "\n\n\n x", "x", "a<|endoftext|>b<|endoftext|>", "don't WE'LL 'S 's", "é漢字🙂\x00\x1c\x85 　 y", "日本" * 3000, "a" * 5000, "ab" * 300 + " " * 700, "1" * 900 + "²½", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with null and repeated ids, null sources, and extra columns of clashing and dotted names."""
    rows = [(k if k != 3 else None, t, [None, "s", "t"][k % 3]) for k, t in enumerate(ODD)] + [(4, "x", "s"), (4, "y", "s"), (12, "same text", "s")]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("ids", "decoded", "runs", "words", "g", "n", "a", "p", "A", "id", "digest", "part", "good", "best", "meta.url"):
        frame = frame.withColumn(name if name not in frame.columns and name != "A" else name + "_own", F.lit("own"))
    return frame.withColumn("tags", F.create_map(F.lit("k"), F.lit("v"))).repartition(3)


def test_bpe_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_bpe(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), _sha(",".join(map(str, ids))))
        assert got[k].decoded_sha256 == _sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_operator(spark, odd, path, library):
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    want = {t or "": library.encode(t or "", add_special_tokens=False).ids for t in [*ODD, "y"]}
    assert all(r.ids == want[r.decoded] for r in got)
    assert bpe.encode(odd.where("false"), path).count() == 0


def test_bpe_merges(path, library):
    tables, rng = bpe.Tables.read(path), random.Random(5)
    signs = [*"aabcdeothn THE 's'll\n\t,.!?0123éß漢字🙂", "<|endoftext|>", "the ", "ing", " "]
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.choice([1, 5, 30, 200])))
        ids = library.encode(text, add_special_tokens=False).ids
        assert tables.encode(text) == ids and tables.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert tables.merge(text.encode()[:300]) == tables.merge_long(text.encode()[:300])
    cut = tables.encode("漢")[:-1]
    assert tables.decode(cut) == library.decode(cut, skip_special_tokens=False)
    began = time.perf_counter()
    assert tables.encode("ab" * 100_000) == library.encode("ab" * 100_000, add_special_tokens=False).ids
    assert time.perf_counter() - began < 20


def test_bpe_forgets(path, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    tables = bpe.Tables.read(path)
    text = " ".join(f"w{k % 7}" for k in range(50))
    assert tables.decode(tables.encode(text)) == text and len(tables.words) + len(tables.words.older) <= 3


def test_bpe_refuses(tmp_path):
    import json

    told = {"added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE", "vocab": {}, "merges": []}}
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError):
        bpe.Tables.read(str(tmp_path / "t.json"))


def _audited(rows, labels):
    """The audit, one document after another."""
    fails, first = [], {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, part in rows:
        text = text or ""
        w = text.encode().split()
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + "D" * any(c in text for c in "#$%&*|")
        bad += "E" * (i is not None and i > first[text])
        own = [x for x in labels if i is not None and x[0] == i]
        fails.append((part or "", bad, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, left_ = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, order, step] = [len(left_), len(gone), redundant, sum(x[1] == f for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                left = left_
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, odd):
    rng = random.Random(3)
    more = [(100 + k, " ".join(rng.choice(["a", "b c", "D", "e#", "ff gg hh"]) for _ in range(rng.choice([1, 100, 300]))), rng.choice(["s", "t", ""])) for k in range(60)]
    more += [(300 - k, *more[k % 5][1:]) for k in range(40)]
    docs = odd.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [*range(0, 300, 2), 4, 4, 104, None]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, table).collect()
    want = _audited([(r.doc_id, r.text, r.source) for r in docs.collect()], labels)
    assert len(got) == len(want) == 3 * 600
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want
    none = filter_audit.audit(docs, table.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)
    assert filter_audit.audit(docs.where("false"), table).count() == 0


def test_audit_steps_add_up(spark):
    got = queries.op12_filter_audit(spark, SF)
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    ends = got.groupBy("filter_order").agg(F.sum("removed").alias("gone"), F.sum(F.when(F.col("step") == 5, F.col("kept"))).alias("left")).collect()
    assert len(ends) == 120 and {r.gone + r.left for r in ends} == {total}
    assert len({r.left for r in ends}) == 1


def _runs(words, least=12):
    """All runs as (start, length, period), by comparing the words with themselves at every distance."""
    w = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    found = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a + q >= max(least, 2 * q):
                found.setdefault((a, b - a + q), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def _told(i, text, edit=True):
    """What the query has to say of a document."""
    w, n = (text or "").encode().split(), len((text or "").encode().split())
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if edit and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
    found = _runs(w)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in found), default=None)
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    return (len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else [None] * 4), _sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), _sha(kept))


def test_runs_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_periodic_runs(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {k: _told(k, t) for k, t in docs.items()}
    assert sum(r.n_runs > 0 for r in got) >= len(got) // 20


@pytest.mark.parametrize("rounds", [48, 1])
def test_runs_operator(spark, odd, rounds, monkeypatch):
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.choice([5, 13, 70]))) + " " + "x y z \t" * rng.randint(0, 9) for _ in range(80)] + ["\x0b".join("ab" * 8), "a\xa0b " * 20, "one " * 11, "one " * 12]
    docs = odd.unionByName(spark.createDataFrame([(500 + k, t, None) for k, t in enumerate(texts)], SCHEMA), allowMissingColumns=True)
    got = periodic.report(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r.doc_id, *_told(r.doc_id, r.text, edit=False))) for r in docs.collect())
    assert periodic.report(docs.where("false")).count() == 0
    edited = periodic.report(periodic.repeat_some(docs)).collect()
    assert sorted(map(str, map(tuple, edited))) == sorted(str((r.doc_id, *_told(r.doc_id, r.text))) for r in docs.collect())


@pytest.mark.parametrize("rounds", [48, 2])
def test_run_kernel(rounds, monkeypatch):
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    rng = random.Random(1)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.choice([0, 1, 5, 13, 60]))]
            docs.append((w[: rng.randint(1, 8)] * 30)[: rng.randint(1, 80)] + w if w and rng.random() < 0.5 else w)
        off = np.cumsum([0, *map(len, docs)])
        got = periodic.runs(np.array(sum(docs, []), np.int64), off, 2)
        want = [(int(off[d]) + s, int(off[d]) + s + n, q) for d, w in enumerate(docs) for s, n, q in _runs([str(x) for x in w], 2)]
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_runs_of_long_texts_take_n_log_n():
    for ids in (np.zeros(50_000, np.int64), np.arange(50_000) % 7, np.arange(50_000) % 9001):
        began = time.perf_counter()
        assert len(periodic.runs(ids, np.array([0, len(ids)]))) == 1
        assert time.perf_counter() - began < 15


def test_audit_sql_agrees_on_small_files(spark, tmp_path):
    """The SQL form reads the same rows as the operator where ids repeat."""
    con = duckdb.connect()
    con.sql("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'a b', 's'), (1, 'a b', 's'), (2, 'a b', NULL), (3, NULL, 's'), (4, '', 's')) t(doc_id, text, source)")
    con.sql("CREATE TABLE labels AS SELECT * FROM (VALUES (1, 1, 0), (1, 0, 1), (4, 0, 1)) t(doc_id, quality, toxic)")
    docs = spark.createDataFrame(con.sql("SELECT * FROM documents").fetchall(), SCHEMA)
    labels = spark.createDataFrame(con.sql("SELECT * FROM labels").fetchall(), "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(filter_audit.ORACLE).select(*got.columns).fetchall())
