"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight.llm import ann, bpe, decontaminate, html_extract, language_id, ngram_join, queries, secret_scan, suffix_dedup, textscan, token_shards, url_filters
from sievelight.operators.clusters import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def odd(spark, sf):
    """Real rows, with nulls, empty, very long and repeated ones added."""
    real = spark.read.parquet(f"{sf}/documents.parquet")
    text = real.where("doc_id = 3").first()["text"]
    extra = [
        (None, "A null id with words that nobody else has here at all.", "en", None, None), (9001, None, None, None, 0), ((1 << 60) + 1, "a great id", "en", "s", 10), (9002, "", "en", "s", 0), (9003, " \n\t ", "en", "s", 4),
        (9004, "12 34 !!", "de", "s", 8), (9005, text * 30, "fr", "s", 1), (9006, text, "fr", "s", 2), (9006, text, "fr", "s", 2), (9007, "one two", "en", "s", 7), (9008, "ONE two", "en", "s", 7), (9006, "another text under the same id", "en", "s", 3),
    ]
    return real.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, DOCS)).repartition(5).cache()


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("most", [10**6, 3])
def test_decontamination(spark, sf, odd, most):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(501, None), (502, "Two Words"), (503, ""), (504, "another text"), (504, "another text")], "item_id long, text string"))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    grams = collections.defaultdict(set)
    for b in bench.collect():
        w = word.findall((b.text or "").translate(UPPER))
        k = min(len(w), 13)
        for i in range(len(w) - k + 1) if w else ():
            grams[tuple(w[i : i + k])].add(str(b.item_id))
    sizes = {len(g) for g in grams}
    want = collections.Counter()
    for d in odd.collect():
        w = word.findall((d.text or "").translate(UPPER))
        hit, items = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit |= set(range(i, i + k))
                    items |= grams[g]
        want[d.doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit and 20 * len(hit) >= len(w))] += 1
    got = decontaminate.scan(odd, bench, ["doc_id"], max_broadcast=most).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert sum(n for k, n in want.items() if k[-1]) > 0
    assert decontaminate.remove_contaminated(odd, bench).count() == sum(n for k, n in want.items() if not k[-1])
    cut = decontaminate.remove_contaminated(odd, bench, mode="spans")
    assert cut.count() == odd.count() and cut.columns == odd.columns


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs, bench, ["doc_id"]).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rows(decontaminate.scan(one, bench, ["doc_id"]))[0]["n_words"] == 2


@pytest.mark.parametrize("bucket", [6 << 20, 5000])
def test_suffix_dedup(spark, odd, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    seen = collections.Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = collections.Counter()
    for i, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        want[i, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in suffix_dedup.dedup(odd, ["doc_id"]).collect()) == want
    assert suffix_dedup.dedup(odd.limit(0), ["doc_id"]).count() == 0


def test_multikey_sort():
    rng = np.random.default_rng(1)
    words = rng.integers(-2, 3, (500, 4))
    order, shared = suffix_dedup.multikey_sort(words)
    ordered = words[order]
    assert [tuple(r) for r in ordered] == sorted(tuple(r) for r in words)
    for i in range(1, len(ordered)):
        equal = ordered[i] == ordered[i - 1]
        assert shared[i] == (4 if equal.all() else int(equal.argmin()))


def test_nearest_neighbours(spark, sf):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6))
    x[100:400] = x[7]  # a third are copies
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    data += [(2000, None), (2020, [0.0] * 6), (2040, [float("nan")] * 6), (2060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2080, [1.0]), (2100, [1e300] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(6)
    got = collections.defaultdict(list)
    for r in ann.search(df, "vec_id % 20 = 0", probe=200).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in range(900) if i % 20 == 0} | {2100}
    full = np.vstack([x, [[1e300] * 6]])
    ids = np.append(np.arange(900), 2100)
    recall = []
    for q, hits in got.items():
        s = full @ full[list(ids).index(q)]
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert [h[0] for h in hits] == list(range(1, 21)) and q not in [h[1] for h in hits]
        assert hits == sorted(hits, key=lambda h: (-h[2], h[1]))
        recall.append(len(set(best) & {h[1] for h in hits}) / 20)
    assert np.mean(recall) >= 0.9
    assert ann.search(df.limit(0), "vec_id % 20 = 0").count() == 0
    assert ann.search(df.where("vec_id < 5"), "vec_id = 0").count() == 4


def test_neighbours_of_repeated_ids(spark):
    """Only a query's own row is left out: other rows of its id, on its vector or another, are candidates."""
    rng = np.random.default_rng(6)
    rows = [(0, [1.0, 0.5, 0.0])] * 30 + [(20, [1.0, 0.5, 0.0]), (0, [0.0, 0.0, 2.0]), (40, [1.0, 0.5, 0.0]), (7, [1.0, 0.5, 0.0])] + [(100 + i, rng.normal(size=3).tolist()) for i in range(40)]
    got = collections.Counter(tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), "vec_id % 20 = 0").select("query_id", "rank", "vec_id").collect())
    want = collections.Counter()
    for i, v in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
        own = rows.index((i, list(v)))
        order = sorted((-float(np.dot(v, w)), j) for k, (j, w) in enumerate(rows) if k != own)
        want.update((i, n + 1, j) for n, (_, j) in enumerate(order[:20]))
    assert got == want


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=5), rng.normal(size=7)
    size = rng.integers(0, 3, 35)
    cells = ann.walk(a, b, size, 10**9)
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums, reverse=True) and sorted(cells) == np.flatnonzero(size).tolist()


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = df.collect()
    v, ids = np.array([r.embedding for r in data], float), np.array([r.vec_id for r in data])
    got = collections.defaultdict(set)
    for r in ann.search(df, "vec_id % 20 = 0", probe=150).collect():
        got[r.query_id].add(r.vec_id)
    recall = [len(got[int(ids[q])] & {int(ids[i]) for i in [i for i in np.lexsort((ids, -(v @ v[q]))) if i != q][:20]}) / 20 for q in np.flatnonzero(ids % 20 == 0)]
    assert np.mean(recall) > 0.5  # 150 of 500 entries; production ranks at least 4,000


@pytest.mark.parametrize("block", [4096, 64])
def test_recall_beyond_the_least_probe(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    x = np.random.default_rng(11).normal(size=(16_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(set)
    for r in ann.search(df, "vec_id % 100 = 0").collect():
        got[r.query_id].add(r.vec_id)
    recall = [len(got[q] & set(np.argsort(-(x @ x[q]), kind="stable")[1:21].tolist())) / 20 for q in range(0, len(x), 100)]
    assert np.mean(recall) >= 0.9


def test_language_id(spark, sf, odd):
    model = language_id.train(odd)
    out = rows(language_id.predict(odd, model, ["doc_id", "lang", "text"]))
    assert len(out) == odd.count()
    held = [r for r in out if r["doc_id"] is not None and language_id.held_out(r["doc_id"]) and any(c.isalpha() for c in r["text"] or "")]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    for r in out:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    none = language_id.train(odd.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in rows(language_id.predict(odd, none, ["doc_id"]))} == {"und"}
    one = language_id.train(odd.where("lang = 'en'"))
    assert {r["lang_pred"] for r in rows(language_id.predict(odd, one, ["doc_id"]))} == {"und", "en"}


def test_language_does_not_depend_on_neighbours(spark, odd):
    model = language_id.train(odd)
    other = language_id.train(odd.orderBy(F.desc("doc_id")).coalesce(1))
    assert np.array_equal(model["weights"], other["weights"])
    words = sorted({w for r in odd.limit(20).collect() for w in (r.text or "").split()})[:150] + ["a", "é", "", "ab c"]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    alone = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in language_id.predict(docs.repartition(len(words), "doc_id"), model, ["doc_id"]).collect()}
    for order in (F.asc("doc_id"), F.desc("doc_id"), F.xxhash64("doc_id")):
        assert alone == {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in language_id.predict(docs.orderBy(order).coalesce(1), model, ["doc_id"]).collect()}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(gaps) >= 1 if n == 2 else min(gaps) >= 2
    margins = code.astype(float)
    assert (language_id.decode(margins, code)[0] == np.arange(n)).all()


def shingles(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(data, percent=90, k=3):
    sets = [shingles(t, k) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(data):
        least[find(i)].append(d)
    return [(d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(data)]


@pytest.mark.parametrize("block", [512, 3])
def test_ngram_jaccard_join(spark, odd, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    variants = []
    for i in range(40):  # a cloud of near copies around the threshold
        w = list(base)
        for p in rng.integers(0, 60, rng.integers(0, 4)):
            w[p] = f"x{rng.integers(0, 9)}"
        variants.append((20_000 + i, " ".join(w), "en", "s", 1))
    docs = odd.unionByName(spark.createDataFrame(variants, DOCS))
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = ngram_join.join(docs)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == collections.Counter(want)
    assert len({w[2] for w in want}) < len(want) - 20
    assert ngram_join.join(docs.limit(0)).count() == 0
    sets = [shingles(r.text) for r in docs.collect()]
    links = sorted(sum(bool(x) and 100 * len(x & y) >= 90 * len(x | y) for y in sets) - bool(x) for x in sets)
    assert sorted(r.n_links for r in got.collect()) == links
    if block == 512:
        kept = ngram_join.keep_one(docs)
        assert kept.columns == docs.columns
        empty = sum(not shingles(r.text) for r in docs.collect())
        # Every component with words, as brute force finds them over row numbers (ids repeat), keeps one row.
        texts = [r.text for r in docs.collect()]
        comps = {w[2] for w in brute_components(list(enumerate(texts))) if w[1]}
        assert kept.count() == len(comps) + empty


def batches_of(token, f1, df, cuts):
    order = np.lexsort((f1, token))
    for part in np.array_split(order, cuts):
        yield pa.RecordBatch.from_arrays([pa.array(token[part]), pa.array(f1[part]), pa.array(df[part])], ["token", "f1", "df"])


@pytest.mark.parametrize("percent", [50, 70, 80, 90])
@pytest.mark.parametrize("hot", [False, True])
def test_similar_sets_share_a_prefix_under_every_order(percent, hot):
    rng = np.random.default_rng(percent)
    sets = []
    for n in (*range(1, 40), 100, 137, 400):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        sets.append(x)
        for _ in range(6):
            gone = rng.integers(0, len(x) * (100 - percent) // 100 + 1)
            sets.append(np.unique(np.concatenate((x[rng.permutation(len(x))[gone:]], rng.integers(0, 1 << 63, rng.integers(0, 3)).astype(np.uint64)))))
    common = np.sort(rng.permutation(np.unique(np.concatenate(sets)))[:300]) if hot else np.zeros(0, np.uint64)
    own = [ngram_join.offered(s, common, percent) for s in sets]
    token, f1, df = np.concatenate([t for t, _ in own]).view(np.int64), np.repeat(np.arange(len(sets)), [len(t) for t, _ in own]), np.concatenate([d for _, d in own])
    found = collections.defaultdict(lambda: ([], []))
    for b in ngram_join.frequencies(batches_of(token, f1, df, 7)):
        for f, t, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            found[f][0].append(t)
            found[f][1].append(d)
    firsts = [ngram_join.prefixes(np.array(found[i][0], np.int64).view(np.uint64), np.array(found[i][1], np.int32), len(s), int(ngram_join.ranked(s, percent).sum()), percent) for i, s in enumerate(sets)]
    met = 0
    for i, x in enumerate(sets):
        for j in range(i):
            inter, union = len(np.intersect1d(x, sets[j])), len(np.union1d(x, sets[j]))
            if 100 * inter >= percent * union and inter < union:
                met += 1
                assert all(np.intersect1d(p, q).size for p, q in zip(firsts[i], firsts[j], strict=True))
    assert met > 100


def test_frequencies_of_common_tokens(monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 5)
    rng = np.random.default_rng(3)
    token, f1 = rng.integers(0, 40, 900) ** 2 // 40, rng.integers(0, 60, 900)
    sets = collections.defaultdict(set)
    for t, f in zip(token.tolist(), f1.tolist(), strict=True):
        sets[t].add(f)
    want = {(f, t, min(5, len(s))) for t, s in sets.items() for f in s if len(s) > 1}
    for cuts in (1, 4, 50, 300):
        got = [x for b in ngram_join.frequencies(batches_of(token, f1, np.zeros(900, np.int32), cuts)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    import itertools

    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for start in got:
        seen, work = {start}, [start]
        while work:
            for y in near[work.pop()] - seen:
                seen.add(y)
                work.append(y)
        assert got[start] == min(seen)
    assert set(got) == set(itertools.chain(*(e for e in edges if e[0] != e[1])))


def test_url_rules(spark):
    urls = [
        "http://Example.NET/en/x", "http://a.example.net/fr/", "https://x.net", "https://x.net/", "http://www.example.com/de/q?x#y", "http://example.com/en/", "ftp://b.org/fr/z", "http://b.org/de/", "no url", None, "http://net/en/", "http://myexample.net/en/",
        "x://h?//://b.net/", "http://é.ORG/fr/", "HTTP://A.B?x",
    ]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("example.net", "/en/x", "example.net/en/", "allow"), ("a.example.net", "/fr/", "net/", "block"), ("x.net", "", None, "allow") if got[2][3] == "allow" else ("x.net", "", None, "block"), ("x.net", "/", "net/", "block"),
        ("www.example.com", "/de/q", "example.com/de/", "block"), ("example.com", "/en/", None, "allow"), ("b.org", "/fr/z", "org/fr/", "allow"), ("b.org", "/de/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "/en/", "net/", "block"), ("myexample.net", "/en/", "net/", "block"),
        ("h", "", None, "allow"), ("é.org", "/fr/", "org/fr/", "allow"), ("a.b", "", None, "allow"),
    ]
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_url_link_graph(spark):
    link = lambda *to: "".join(f'<a class=x href="http://{t}/p">t</a>' for t in to)
    pages = spark.createDataFrame([
        (1, "http://good.org/fr/", link("fine.info", "fine.info")), (2, "http://bad.example.com/de/", ""), (3, "http://farm.info/", link("bad.example.com")),
        (4, "http://fine.info/", link("leaf.info")), (5, "http://leaf.info/a", None), (6, "http://far.info/", link("farm.info")),
    ], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, round(r.trust, 4), round(r.distrust, 4)) for r in url_filters.judge(pages).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block"}
    assert got[4][1] > 0 and got[5][1] > 0 and got[6][2] > 0


def test_pagerank_against_matrix(spark):
    rng = np.random.default_rng(8)
    edges = sorted({(f"h{a}", f"h{b}", 1 + int(a) % 3) for a, b in rng.integers(0, 12, (40, 2)) if a != b})
    seeds = [("h0", 0.25), ("h5", 0.75)]
    got = {r.host: r.score for r in url_filters.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, weight double"), rounds=8).collect()}
    m, base = np.zeros((12, 12)), np.zeros(12)
    for a, b, n in edges:
        m[int(b[1:]), int(a[1:])] = n
    m /= np.maximum(1, m.sum(0))
    for h, w in seeds:
        base[int(h[1:])] = w
    score = base.copy()
    for _ in range(8):
        score = 0.15 * base + 0.85 * m @ score
    for i in range(12):
        assert abs(got.get(f"h{i}", 0.0) - score[i]) < 1e-12


@pytest.mark.parametrize("reverse", [False, True])
def test_dangling_hosts_return_their_mass(spark, reverse):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("d", "a", 1), ("d", "e", 3)]  # c and e lead nowhere, d is reached by none
    seeds = {"a": 0.25, "e": 0.25, "d": 0.5}
    found = url_filters.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, weight double"), reverse=reverse)
    got = {r.host: r.score for r in found.collect()}
    m, base = np.zeros((5, 5)), np.array([seeds.get(h, 0.0) for h in "abcde"])
    for a, b, n in edges:
        m["abcde".index(a if reverse else b), "abcde".index(b if reverse else a)] = n
    m = np.where(m.sum(0) > 0, m / np.maximum(1, m.sum(0)), base[:, None])
    score = base.copy()
    for _ in range(8):
        score = 0.15 * base + 0.85 * m @ score
    assert sum(got.values()) == pytest.approx(1) and [got.get(h, 0.0) for h in "abcde"] == pytest.approx(score.tolist())


TEXTS = ["", "  lead", "a", "x<|endoftext|>y  z", "tab\t\tfoo \n\n bar  ", "é è x\u00a0y  z", "日本語 テスト", "a" * 3000, "it's  I'll\r\n  don't", "\u3000x \u3000 y", "x\x1cy", "x  y\u2028z", "'s 't", "🙂 ok🙂", "\x00\x01 a"]


@pytest.mark.parametrize("repeat", [1, 2, 70])
def test_bpe_equals_the_library(repeat):
    tok, coder = bpe.load(bpe.default_path()), bpe.Coder(bpe.default_path())
    texts = [t * repeat for t in TEXTS] + ["".join(TEXTS) * repeat]
    texts = texts + texts[:5]
    got = dict(coder.encode_batch(pa.array([*texts, None])))
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i].tolist() == ids, t
        assert bpe.decode_ids(got[i], bpe.default_path()) == tok.decode(ids, skip_special_tokens=False)
    assert got[len(texts)].tolist() == []


def test_bpe_repairs_joins_of_any_chunking(monkeypatch):
    rng = np.random.default_rng(6)
    tok = bpe.load(bpe.default_path())
    words = ["the", " of", "  x", "'ll", "1234", "é", "\n\n", "...", " ", "über", "<|endoftext|>", "don't"]
    for bits in (1, 3, 8):
        monkeypatch.setattr(bpe, "CHUNK_BITS", bits)
        coder = bpe.Coder(bpe.default_path())
        texts = ["".join(rng.choice(words, rng.integers(0, 120))) for _ in range(60)]
        for i, ids in coder.encode_batch(pa.array(texts * 2)):
            assert ids.tolist() == tok.encode((texts * 2)[i], add_special_tokens=False).ids
        assert coder.reused > 0


def test_bpe_query(spark, odd):
    tok = bpe.load(bpe.default_path())
    want = collections.Counter()
    for r in odd.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.digests(odd, ["doc_id"]).collect()) == want
    back = bpe.encode(odd, keep=["doc_id", "text"], decode=True).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_html_extract(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
    <header><p>The name of this very site in a long line.</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav>
    <div class="ad banner">Buy many good things here today.</div><article><h1>A  title</h1><p><b>First &amp; best</b> text of the
    article,&nbsp;with words.<p>Second <i>paragraph</i> here<br>goes on.<ul><li>One item</li><li>Two items</li></ul><!-- x --><p>Short.</p></article>
    <section id="comments"><p>I liked this article very much indeed, thank you.</p></section><aside><p>Related stories of the day to read on.</p></aside>
    <form><label>Mail</label></form><div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div><footer>&copy; us</footer></body></html>"""
    want = "A title\n\nFirst & best text of the article, with words.\n\nSecond paragraph here goes on.\n\nOne item\n\nTwo items\n\nShort."
    assert html_extract.main_text(page) == want
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "plain text, not a page at all, with some words."), (4, "u", "<p" * 2000), (5, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df, ["page_id", "url"]).collect())
    assert got[0] == (1, want, len(want)) and got[1] == (2, "", 0) and got[2][1] == "" and got[3][1].startswith("plain")
    assert html_extract.extract(df.limit(0), ["page_id", "url"]).count() == 0


_NOISE = [
    '<div class="ad">{}</div>', '<div class="advert"><p>{}</p></div>', '<aside><p>{}</p></aside>', '<div class="cookie-notice"><p>{}</p></div>', '<div id="sidebar"><p>{}</p></div>', '<section class="comments"><h3>Comments</h3><p>{}</p></section>',
    '<div class="comments"><article class="comment"><p>{}</p></article><article><p>{}</p></article></div>', '<nav><a href="/x">{}</a></nav>', '<footer><p>{}</p></footer>', '<form><p>{}</p></form>', '<div class="ad"><div class="content"><p>{}</p></div></div>', '<ul class="share-buttons"><li>{}</li></ul>',
    '<div class="related-posts"><h4>More</h4><p>{}</p></div>', '<div role="complementary"><p>{}</p></div>',
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div class="with-sidebar"><article>{}</article></div>', "<main>{}</main>", '<div id="content">{}</div>', '<body class="has-sidebar left"><main><article class="post">{}</article></main></body>'])
def test_html_noise_of_every_kind_anywhere(wrap):
    """Pages made of an article and noise of each kind inside it, before it and after it: the article alone comes out, whole."""
    rng = np.random.default_rng(len(wrap))
    sentence = lambda n: " ".join("".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9))) for _ in range(n)).capitalize() + "."
    for noise in _NOISE:
        for words in (6, 60):
            own = [sentence(int(rng.integers(25, 60))) for _ in range(4)]
            title, said = "A title of the page", sentence(words)
            bad = noise.replace("{}", said)
            body = f'<header class="entry-header"><h1>{title}</h1></header><p>{own[0]}</p>{bad}<p>{own[1]}</p><blockquote>{own[2]}</blockquote>{bad}{bad}<p>{own[3]}</p>{bad}'
            page = f"<html><head><title>t</title></head>{bad}{wrap.format(body)}{bad}</html>"
            assert html_extract.main_text(page) == "\n\n".join([title, *own]), (noise, words)


def test_html_extract_on_pages(spark, sf):
    import html

    for r in queries.op8_html_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("(?s)<article>(.*?)</article>", r.html)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_min_cut_is_least():
    rng = np.random.default_rng(9)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        costs = rng.normal(size=n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(costs, side, strict=True)) + sum(w for u, v, w in edges if side[u] != side[v])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.min_cut(costs, edges)) - best) < 1e-9


def labelled(page):
    """(text, sign of its own costs, side of the cut) of each block."""
    found = html_extract.Page(page)
    costs = [html_extract.score(b, found.has_article) for b in found.blocks]
    return [(b.text, c > 0, k) for b, c, k in zip(found.blocks, costs, html_extract.min_cut(costs, html_extract.ties(found)), strict=True)]


def test_the_cut_decides_blocks_without_telling_features():
    long = "The committee met again on Tuesday and agreed, after a long debate, that the bridge should be rebuilt within two years."
    kept = ["See the full table of results", "Part two", "by our staff"]
    inside = f"<div class=x1><p>{long}</p><p><a href=/t>{kept[0]}</a></p><p>{long}</p><div>{kept[1]}</div><p>{long}</p><span><em>{kept[2]}</em></span><p>{long}</p></div>"
    dropped = ["Buy now.", "Tell a friend about it"]
    around = f"<div class=x2><ul><li><a href=/1>Home page</a></li><li><p>{dropped[0]}</p></li><li><a href=/2>All our topics</a></li></ul></div>"
    page = f"<body>{around}{inside}<div class=x3><a href=/3>More of this</a><p>{dropped[1]}</p><a href=/4>Even more of it</a></div></body>"
    sides = {text: (own, cut) for text, own, cut in labelled(page)}
    assert [sides[t] for t in kept] == [(False, True)] * 3  # their own costs say boilerplate, the cut says content
    assert sides[dropped[0]][1] is False and sides["Home page"] == (False, False)
    assert sides[dropped[1]][1] is False


def test_pages_reach_the_flow(monkeypatch):
    rng = np.random.default_rng(4)
    flows, real = [], html_extract._source_side
    monkeypatch.setattr(html_extract, "_source_side", lambda n, *a: flows.append(n - 2) or real(n, *a))
    flips = 0
    for _ in range(200):
        parts = []
        for _ in range(rng.integers(3, 12)):
            words = " ".join(["word"] * int(rng.integers(1, 14))) + rng.choice(["", "."])
            tag = rng.choice(["p", "div", "li", "h2"])
            parts.append(f"<{tag}>" + (f"<a href=x>{words}</a>" if rng.random() < 0.3 else words) + f"</{tag}>")
        flips += any(own != cut for _, own, cut in labelled("<body><div>" + "".join(parts[:4]) + "</div><section>" + "".join(parts[4:]) + "</section></body>"))
    assert flips > 40 and len(flows) > 40 and max(flows) > 3


def test_long_and_broken_pages_take_linear_time():
    import time

    n = 100_000
    for page in ("<div>x" * n, "<p " * n, "<b>" * n + "<p>x" * n, "<a '" * n + ">" * 9, "<a \">x" * n, "<!--" * n, "<script>" * n, "<li>word" * n, "<p>w " * (2 * n), "&amp" * n, "</p></div>" * n + "<span>y" * n, "<p><a href=x>two words</a>one" * n):
        began = time.perf_counter()
        html_extract.main_text(page)
        assert time.perf_counter() - began < 25, page[:20]


def test_token_starts_of_large_ids_beside_nulls(spark, tmp_path):
    """Ids around 2**60 and up to the greatest, with nulls in every batch, over several batches and shards."""
    ids = [None, (1 << 63) - 1, -(1 << 63) + 1, *((1 << 60) + i for i in range(400)), None]
    docs = spark.createDataFrame([(x, f"text {i}" * (i % 5)) for i, x in enumerate(ids)], "doc_id long, text string").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = token_shards.document_stats(token_shards.write(docs, str(tmp_path / "w"), shards=6), spark).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    code = bpe.load(bpe.default_path())
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text, r.doc_id) for r in docs.collect()))
    want, at = [], 0
    for _, _, text, doc_id in rows:
        n = len(code.encode(text, add_special_tokens=False).ids) + 1
        want.append((doc_id, at, n))
        at += n
    assert collections.Counter((r.doc_id, r.start, r.n_tokens) for r in got) == collections.Counter(want)


def test_token_shards(spark, odd, tmp_path):
    tok = bpe.load(bpe.default_path())
    folder = token_shards.write(odd, str(tmp_path / "t"), shards=3)
    data = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in odd.collect()))
    want, at = collections.Counter(), 0
    for known, i, _, t in data:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want[i if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert collections.Counter(tuple(r) for r in token_shards.document_stats(folder, spark).collect()) == want
    foreign = spark.createDataFrame([(77_777_777, 0), (3, 99)], "doc_id long, occurrence int")
    assert token_shards.lookup(foreign, folder).count() == 0
    assert token_shards.document_stats(token_shards.write(odd.limit(0), str(tmp_path / "e")), spark).count() == 0


def test_keys_with_equal_hashes():
    h = token_shards.key_hash(np.arange(50), np.zeros(50, np.int64))
    h[7] = h[33] = h[3]
    key, occ, slot = np.arange(50), np.zeros(50, np.int32), np.zeros(50, token_shards.SLOT)
    slot["mark"], slot["offset"] = h & np.uint64(0xFFFFFFFF), np.arange(50)
    bucket = token_shards.index_bucket(h, key, occ, slot)
    got, ok = token_shards.find_slots(h, key, occ, *bucket)
    assert ok.all() and got["offset"].tolist() == list(range(50)) and len(bucket[2]) == 3
    only = token_shards.index_bucket(h[[3, 7]], key[[3, 7]], occ[:2], slot[[3, 7]])
    assert token_shards.find_slots(h[[3, 7, 9]], key[[3, 7, 9]], occ[:3], *only)[1].tolist() == [True, True, False]


@pytest.mark.parametrize("n", [1, 2, 7, 500, 5000])
def test_minimal_perfect_hash(n):
    h = token_shards.key_hash(np.arange(n), np.zeros(n, np.int64))
    assert sorted(token_shards.slot_of(h, token_shards.build_mph(h), n).tolist()) == list(range(n))


def test_secret_base_kinds():
    base, _ = secret_scan.scan_text("é token: \"abcdef12\" secret=token:abcdef API_KEY = 'q1w2e3' passwd=short AKIA" + "A" * 16 + " AKIAX " + "0f" * 12 + " ſecret=abcdef1")
    assert [(k, e - s) for s, e, k in base] == [(0, 16), (0, 17), (1, 20), (2, 24)]
    assert base[0][0] == 2


def test_secret_layers():
    inner = "password=hunter22"
    one = base64.b64encode(inner.encode()).decode()
    two = base64.b64encode(one.encode()).decode()
    zipped = base64.b64encode(gzip.compress(b"api_key: zzzzzzzz and more text", mtime=0)).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in inner)
    percent = "".join(f"%{ord(c):02X}" for c in one)
    for wrapped in (one, two, zipped, escaped, percent):
        text = f"é before {wrapped} after"
        base, spans = secret_scan.scan_text(text)
        assert not [b for b in base if b[2] == 0] and [s for s in spans if s[2] == 0], wrapped
        start, end, _ = next(s for s in spans if s[2] == 0)
        assert 9 <= start < end <= 9 + len(wrapped)
        assert wrapped not in secret_scan.mask(text, spans)
    assert secret_scan.scan_text(None) == ([], []) == secret_scan.scan_text("")
    assert secret_scan.scan_text("%2525252541" * 5)[0] == []
    assert secret_scan.mask("a token=abcdef b", secret_scan.scan_text("a token=abcdef b")[1]) == "a [SECRET] b"


def test_equal_secret_layers_all_have_spans():
    one = base64.b64encode(b"password=hunter22").decode()
    two = base64.b64encode(one.encode()).decode()
    zipped = base64.b64encode(gzip.compress(two.encode(), mtime=0)).decode()
    for wrapped in (two, zipped, "".join(f"%{ord(c):02X}" for c in one)):
        text = f"{wrapped} middle {wrapped}\n{wrapped}"
        starts = [m.start() for m in re.finditer(re.escape(wrapped), text)]
        spans = secret_scan.scan_text(text)[1]
        assert len(starts) == 3 and all(any(at <= s < e <= at + len(wrapped) for s, e, _ in spans) for at in starts), wrapped
        assert wrapped not in secret_scan.mask(text, spans)
    # An equal layer inside another one, met before or after it.
    outer = base64.b64encode(f"see {two} there".encode()).decode()
    for text in (f"{two} {outer}", f"{outer} {two}"):
        masked = secret_scan.mask(text, secret_scan.scan_text(text)[1])
        assert two not in masked and outer not in masked


@pytest.mark.parametrize(("width", "end"), [(16, "\n"), (64, "\n"), (76, "\r\n"), (64, " \n\t")])
def test_secret_in_wrapped_base64(width, end):
    rng = np.random.default_rng(4)
    for at in range(40, 60):
        inner = bytes(rng.integers(97, 123, at).astype(np.uint8)) + b" password=hunter22 " + bytes(rng.integers(97, 123, 70).astype(np.uint8))
        code = base64.b64encode(inner).decode()
        text = "é key:\n" + end.join(code[i : i + width] for i in range(0, len(code), width)) + " end"
        _, spans = secret_scan.scan_text(text)
        assert any(k == 0 and "".join(text[s:e].split()) in code and base64.b64decode("".join(text[s:e].split()))[:0] == b"" and b"password=hunter22" in base64.b64decode("".join(text[s:e].split())) for s, e, k in spans), (at, spans)


def test_secret_lines_without_end_are_linear():
    import time

    for text in ("A" * 2_000_000, ("A" * 15 + "\n") * 100_000, ("A" * 40 + "\n") * 20_000, "A" * 20 + " " * 1_000_000, ("A" * 16 + " " * 16) * 30_000):
        t = time.process_time()
        secret_scan.scan_text(text)
        assert time.process_time() - t < 8


def test_secret_cycles_end(monkeypatch):
    # a's layer is b, b's are a and c, c's is a: a cycle that must not hide what c holds where c also occurs outside.
    links = {b"root": [b"a", b"c"], b"a": [b"b"], b"b": [b"a", b"c"], b"c": [b"a", b"token=abcdef"]}
    monkeypatch.setattr(secret_scan, "_layers", lambda raw: iter([(x, lambda s, e, i=i: (i, i + 1)) for i, x in enumerate(links.get(raw, []))]))
    assert secret_scan.all_spans(b"root") == {(0, 1, 0), (1, 2, 0)}


def brute_layers(raw):
    """The layers of a text by plain loops: (bytes, start of each byte, end of each byte)."""
    out, at = [], 0
    while at < len(raw):
        for lead, n in ((b"%", 2), (b"\\u", 4)):
            digits = raw[at + len(lead) : at + len(lead) + n]
            if raw.startswith(lead, at) and re.fullmatch(b"[0-9a-fA-F]{%d}" % n, digits):
                x = bytes([int(digits, 16)]) if n == 2 else chr(int(digits, 16)).encode("utf-8", "replace")
                out += [(c, at, at + len(lead) + n) for c in x]
                at += len(lead) + n
                break
        else:
            out.append((raw[at], at, at + 1))
            at += 1
    if len(out) < len(raw):
        yield bytes(c for c, _, _ in out), [a for _, a, _ in out], [z for _, _, z in out]
    alphabet = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    at = 0
    while at < len(raw):
        end = at
        while end < len(raw) and raw[end] in alphabet + b"-_":
            end += 1
        word = raw[at:end]
        if len(word) >= 16 and not (word.isalpha() and (word.islower() or word[1:].islower())):
            pad = min(2, len(raw[end:]) - len(raw[end:].lstrip(b"=")))
            for skip in range(4):
                bits, x, lo, hi = 0, [], [], []
                chars = [alphabet.index({45: 43, 95: 47}.get(c, c)) for c in word[skip:]]
                for i in range(0, len(chars), 4):
                    four = chars[i : i + 4]
                    bits = sum(c << 18 - 6 * j for j, c in enumerate(four))
                    for j in range(len(four) - 1):
                        x.append(bits >> 16 - 8 * j & 255)
                        lo.append(at + skip + i)
                        hi.append(min(at + skip + i + 4, end + pad))
                yield bytes(x), lo, hi
        at = max(end, at + 1)
    at = 0
    while at < len(raw):
        if raw.startswith(b"\x1f\x8b\x08", at) or raw[at : at + 1] == b"x" and raw[at + 1 : at + 2] in (b"\x01", b"\x5e", b"\x9c", b"\xda"):
            whole, data = b"", raw[at:]
            try:
                while data[:3] == b"\x1f\x8b\x08" or data[:1] == b"x":
                    z = zlib.decompressobj(47)
                    whole += z.decompress(data)
                    data = z.unused_data
            except zlib.error:
                pass
            if whole:
                end = len(raw) - len(data)
                yield whole, [at] * len(whole), [end] * len(whole)
                at = end - 1
        at += 1


def brute_spans(raw, around=()):
    found = set(secret_scan.base_matches(raw))
    for inner, lo, hi in brute_layers(raw):
        if inner and inner not in around:
            found |= {(lo[s], hi[e - 1], k) for s, e, k in brute_spans(inner, (*around, raw))}
    return found


def wrap(rng, raw):
    how = rng.integers(0, 7)
    if how == 0:
        return base64.b64encode(raw)
    if how == 1:
        return base64.urlsafe_b64encode(raw).rstrip(b"=")
    if how == 2:
        return b"".join(b"%%%02x" % c if rng.random() < 0.6 or c > 127 else bytes([c]) for c in raw)
    if how == 3 and max(raw, default=0) < 128:
        return b"".join(b"\\u%04X" % c if rng.random() < 0.6 else bytes([c]) for c in raw)
    if how == 4:
        return base64.b64encode(gzip.compress(raw, mtime=0) + gzip.compress(b" and more", mtime=0))
    if how == 5:
        return b"".join(b"%%%02X" % c for c in zlib.compress(raw))
    return b"path/to_" + base64.b64encode(bytes([rng.integers(0, 32)]) + raw)


def test_secret_spans_of_generated_nestings():
    rng = np.random.default_rng(12)
    secrets = [b"password=hunter22", b"AKIA" + b"Q" * 17, b"0123456789abcdef" * 2, b"token: 'abcdefg1'"]
    hidden = 0
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 4)):
            x = b"a " + secrets[rng.integers(0, 4)] + b" z"
            for _ in range(rng.integers(0, 5)):
                x = wrap(rng, x)
                if rng.random() < 0.3:
                    x = b"see " + x + b" or " + x
            parts += [x] * int(rng.integers(1, 3))
        text = " ".join(p.decode() for p in parts) if all(p.isascii() for p in parts) else ""
        want = brute_spans(text.encode())
        assert secret_scan.all_spans(text.encode()) == want, text
        hidden += len(want) > len(secret_scan.base_matches(text.encode()))
    assert hidden > 80


def test_secret_escapes_nested_without_end():
    import time

    for text in ("%" + "25" * 2000 + "41", "%" + "25" * 500_000 + "41", "%4" + "%3" * 200_000 + "%31", "\\u005c" + "u005c" * 100_000 + "u0041", "%5cu0025" * 50_000, "aZ9" * 300_000 + " %41"):
        began = time.perf_counter()
        deep = [x for x in secret_scan.scan_text("x " + text + " pass%2577ord%3Dhunter22 ")[1] if x[2] == 0]
        assert deep == [(len(text) + 3, len(text) + 26, 0)]
        assert time.perf_counter() - began < 30
    for raw in (b"%252541", b"%4%3%31", b"\\u005cu0041", b"%5cu0041x%", b"%%341%zz", b"a%2"):
        form, lo, hi = secret_scan.normal_form(raw)
        deep = raw
        while (more := secret_scan.unescaped(deep)[0]) != deep:
            deep = more
        assert form == deep and len(lo) == len(hi) == len(form) and all(lo < hi)


def test_secret_layers_that_were_lost():
    inner = b"password=hunter22"
    one = base64.b64encode(inner).decode()
    percent = lambda raw: "".join(f"%{c:02X}" for c in raw)
    lost = [
        f"https://host/path/{one}", f"https://host/a_b/{one}/c", f"x-{one}", base64.b64encode(b"\x01" + inner).decode(), percent(gzip.compress(inner, mtime=0)), percent(zlib.compress(inner)),
        base64.b64encode(gzip.compress(b"first", mtime=0) + gzip.compress(inner, mtime=0)).decode(), f"{percent(percent(one.encode()).encode())} {percent(percent(one.encode()).encode())}",
    ]
    for text in lost:
        base, spans = secret_scan.scan_text(text)
        assert not base and [k for _, _, k in spans] == [0] * (2 if " " in text else 1), text
        assert one not in secret_scan.mask(text, spans)
    big = gzip.compress(b"x " * (9 << 20) + inner + b" y" * (9 << 20))
    assert secret_scan.scan_text(base64.b64encode(big).decode())[1]


def test_secret_in_base64_of_a_text_that_begins_like_zlib():
    deep = base64.b64encode(b"password=hunter22").decode()
    for inner in ("x-token: AbCdEf123456", "x^ token=abcdef12", f"x marks {deep}", f"x^3 {deep}"):
        wrapped = base64.b64encode(inner.encode()).decode()
        spans = secret_scan.scan_text(f"a {wrapped} b")[1]
        assert [k for _, _, k in spans] == [0] and all(2 <= s < e <= 2 + len(wrapped) for s, e, _ in spans), inner
    for level in (0, 1, 6, 9):
        zipped = base64.b64encode(zlib.compress(b"token=abcdef12 " * 9, level)).decode()
        spans = secret_scan.scan_text(f"a {zipped} b")[1]
        # Data stored without compression also shows its text in the layer above.
        assert (2, 2 + len(zipped), 0) in spans and (level == 0 or len(spans) == 1)


def test_secret_query(spark, odd):
    extra = spark.createDataFrame([(1, "token=abcdef, x"), (2, None), (3, "AKIA" + "Z" * 30)], "doc_id long, text string")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.spans) for r in secret_scan.scan(extra, ["doc_id"]).collect()}
    assert got == {1: (1, 0, 0, "assign:0:12"), 2: (0, 0, 0, ""), 3: (0, 1, 0, "access:0:34")}
    assert secret_scan.scan(extra, ["doc_id"]).where("doc_id = 1").first().base_sha256 == hashlib.sha256(b"assign:0:12").hexdigest()
    assert secret_scan.redact(odd).columns == odd.columns and secret_scan.redact(odd).count() == odd.count()


def test_word_hashes_do_not_depend_on_place():
    a = pa.array(["one two one", None, "", "zwei one", "x" * 5000 + " two"])
    seen = collections.defaultdict(set)
    for limit in (1, 10, 1 << 20):
        for lo, _hi, buf, offs in textscan.text_slices(a, limit):
            s, e, d = textscan.find_words(buf, offs, textscan.ALNUM)
            for x, y, h in zip(s, e, textscan.range_hash(textscan.prefix_sums(buf), s, e), strict=True):
                seen[bytes(buf[x:y])].add(int(h))
    assert all(len(v) == 1 for v in seen.values()) and len({*map(frozenset, seen.values())}) == len(seen) == 4


def test_queries_return_the_contract(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_benchmark_decontamination", "op4_language_id", "op7_bpe", "op10_secret_scan"):
        assert queries.QUERIES[name](spark, sf).count() == n
    r = queries.op4_language_id(spark, sf).first()
    assert r.held_out == language_id.held_out(r.doc_id)
