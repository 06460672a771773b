"""Compression quality, source divergence and fill-in-middle against brute force, with odd rows, partitions and empty tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import compression_quality, divergence, fim, queries

UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, lang string, source string, n long, output string, score double, form string, term string"


@pytest.fixture(scope="module")
def odd(spark, sf):
    """Real rows, with nulls, empty, very long and repeated ones, and columns named like the operators' own."""
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", *(F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("output", "string"), ("score", "double"), ("form", "string"), ("term", "string"))))
    text = real.where("doc_id = 3").first()["text"]
    extra = [
        (None, "A null id.", "en", None), (9001, None, None, None), ((1 << 60) + 1, "a great id", "en", "s"), (9002, "", "en", "alone"), (9003, " \n\t ", "xx", "s"), (9003, "12 !!", "xx", "t"),
        (9005, text * 40, "fr", "s"), (9006, text, "fr", "s"), (9006, text, "fr", "s"), (9007, "with <S> inside", "en", "s"), (9008, "<" * 50 + "P>S>é\U0001f600x", "en", "s"), (9009, "ab" * 30_000, "en", "s"),
        (9010, "über" * 9 + " über" * 3 + " überall", "yy", "u"), (9011, "über" * 9 + " überall", "yy", "v"), (9012, "über" * 9 + "s " + "über" * 9 + " überall", "yy", "v"), (9013, "über" * 9 + "s " + "über" * 9 + "s", "yy", ""),
    ]
    return real.unionByName(spark.createDataFrame([(*x, 7, "o", 0.5, "f", "t") for x in extra], DOCS)).repartition(5).cache()


def cut(doc_id, text):
    """n, form, the parts and the output, token by token."""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(odd, monkeypatch):
    want = collections.Counter((d.doc_id, *cut(d.doc_id, d.text or ""), d.text or "") for d in odd.collect())
    got = fim.transform(odd, ["doc_id"])
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = got.withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    assert collections.Counter(map(tuple, found)) == want
    assert {"plain", "psm", "spm"} == {r.form for r in found}
    assert fim.transform(odd.limit(0), ["doc_id"]).collect() == []


@pytest.mark.parametrize(("chunk", "group"), [(1, 1), (2, 3), (3, 64), (7, 7), (4096, 1 << 20)])
def test_chunks_of_any_size_agree(chunk, group, monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    monkeypatch.setattr(fim, "GROUP", group)
    texts = ["", "a", "ab", "a b", "é", "éa", "aé", "ab cd\nef", "", "zz\U0001f600zz  q", "...", "abcdefghijklmnop", "A1b2", "x"]
    raw = "".join(texts).encode()
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    chunks = fim.Chunks(np.frombuffer(raw, np.uint8), offs)
    for i, t in enumerate(texts):
        starts = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", t)] + [len(t)]
        assert chunks.count()[i] == len(starts) - 1
        assert [chunks.start_of(i, r) for r in range(len(starts))] == [(len(t[:s].encode()), s) for s in starts]


def test_fill_in_middle_query(spark, sf):
    rows = queries.QUERIES["op13_fill_in_middle"](spark, sf).collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(rows) == len(text)
    for r in rows:
        *own, output = cut(r.doc_id, text[r.doc_id])
        assert tuple(r) == (r.doc_id, *own, sha(output), sha(text[r.doc_id]))


def audited(docs, least, best):
    """The contract, group by group, in Python's integers."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, held = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        words = term.findall((text or "").translate(UPPER))
        counts[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        own = {s: c for (x, s), c in counts.items() if x == lang}
        share = lambda c: (lambda whole: {t: 1 + 10**9 * (c[t] + 1) // whole for t in kept})(sum(c[k] for k in kept) + len(kept))
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), collections.Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:best]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found)]
    return collections.Counter(out)


@pytest.mark.parametrize(("least", "best", "small"), [(3, 200, False), (2, 5, True), (1, 40, True)])
def test_divergence(odd, least, best, small, monkeypatch):
    if small:  # many tries, ranges, pieces and blocks
        for name, value in (("LEAVES", 997), ("RANGE_ROWS", 6_000), ("CELLS", 900), ("MAX_NODES", 1)):
            monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(odd, least, best)
    assert collections.Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == audited([(d.text, d.lang, d.source) for d in odd.collect()], least, best)


def test_divergence_of_nothing(odd, spark):
    assert divergence.audit(odd.limit(0)).collect() == []
    two = spark.createDataFrame([("12", "xx", "a", 1), (None, "xx", None, 2)], "text string, lang string, source string, piece long")
    assert sorted(map(tuple, divergence.audit(two).collect())) == [("xx", "", "pair", "a", 0, 1), ("xx", "a", "pair", "", 0, 1)]


def test_trie_walks_in_utf8_order():
    rng, letters = np.random.default_rng(3), ["a", "b", "z", "é", "ß", "\U0001f600"]
    terms = ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(400)] + ["a", "ab", "a" * 24, "a" * 25, "a" * 300]
    trie = divergence.Trie()
    for part in (terms[:150], terms[150:], terms[:40]):
        raw, offs = "".join(part).encode(), np.concatenate(([0], np.cumsum([len(t.encode()) for t in part])))
        leaf = trie.leaves(np.frombuffer(raw, np.uint8), offs[:-1], np.diff(offs), np.full(len(part), trie.root("en")))
        trie.count(leaf, np.full(len(leaf), trie.source(-5)), np.full(len(leaf), 2))
        trie.count(leaf, np.full(len(leaf), -1), np.ones(len(leaf), np.int64))
    want = collections.Counter(terms) + collections.Counter(terms[:40])
    ((lang, docs, found, size, sources, counts),) = trie.walk()
    assert lang == "en" and found.to_pylist() == sorted(want, key=str.encode)
    assert docs.tolist() == [want[t] for t in found.to_pylist()] and counts.tolist() == [2 * x for x in docs] and set(sources) == {-5} and set(size) == {1}


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    count, whole = rng.integers(0, 10**15, 500), int(9 * 10**15)
    assert divergence.share(count, whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in count.tolist()]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op11_compression_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    tested = [(got[i].score, got[i].predicted, y) for i, y in labels.items() if held(i)]
    assert np.mean([p == y for _, p, y in tested]) > 0.93
    good, bad = ([s for s, _, y in tested if y == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95


def test_quality_scores_are_those_of_plain_compression(spark, odd):
    """The scores of a model, block by block, whatever the partitions; labels of held-out rows change nothing."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = compression_quality.train(docs, labels)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression_quality.train(docs.repartition(7), turned.repartition(3)) == model
    good, bad = (compression_quality.compressor(model[k]) for k in ("good", "bad"))
    got = compression_quality.score(odd, model, ["doc_id", "text"])
    assert got.columns == ["doc_id", "text", "difference", "score"]
    found = got.withColumnRenamed("score", "said").collect()
    for r in found:
        raw = (r.text or "").encode()
        size = [sum(len(c.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096)) for c in (good, bad)]
        assert r.difference == ((size[1] - size[0]) / len(raw) if raw else 0.0)
    order = sorted(found, key=lambda r: r.difference)
    assert all(a.said <= b.said for a, b in zip(order, order[1:], strict=False))
    assert compression_quality.score(odd.limit(0), model, ["doc_id"]).collect() == []


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([(1, 1), (2, 1)], 2.5 / 3), ([(1, 1), (2, 0), (1, 0), (2, 1)], 0.5), ([(1, None), (None, 0)], 0.5)])
def test_quality_without_two_labels(spark, labels, want):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    model = compression_quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), folds=1, held=5)
    assert {round(r.score, 3) for r in compression_quality.score(docs, model, ["doc_id"]).collect()} == {round(0.98 * want + 0.02 * 0.5, 3)}
