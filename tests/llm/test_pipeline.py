"""The pipeline's rows against a brute-force version of its stages."""

from __future__ import annotations

import collections
import hashlib
import re

import corpus_pipeline
from sievelight.llm import bpe
from tests.llm.test_operators import DOCS, UPPER, brute_components, brute_spans


def masked(text):
    """The text with the spans of the brute-force worklist replaced."""
    raw = text.encode()
    hit = [False] * (len(raw) + 1)
    begins = set()
    end = -1
    for s, e, _ in sorted(brute_spans(raw)):
        if s >= end:
            begins.add(s)
        end = max(end, e)
        hit[s:e] = [True] * (e - s)
    return b"".join(b"[SECRET]" if i in begins else b"" if hit[i] else raw[i : i + 1] for i in range(len(raw))).decode()


def test_pipeline(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [d for d in docs if any(c.isalpha() for c in d["text"] or "")]
    comps = brute_components([(d["doc_id"], d["text"]) for d in docs], percent=80, k=5)
    docs = [d for d, (i, n, c) in zip(docs, comps, strict=True) if i == c or not n]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    grams = set()
    for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word.findall((b.text or "").translate(UPPER))
        k = min(13, len(w))
        grams |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    want = collections.Counter()
    tok = bpe.load(bpe.default_path())
    for d in docs:
        w = word.findall(d["text"].translate(UPPER))
        hit = {j for k in {len(g) for g in grams} for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in grams for j in range(i, i + k)}
        if hit and 20 * len(hit) >= len(w):
            continue
        text = masked(d["text"])
        ids = tok.encode(text, add_special_tokens=False).ids
        want[d["doc_id"], d["lang"], d["source"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, sf)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    at = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == columns and at.count() == 0


def five_word_components(texts, k=5, percent=80):
    """The least member of each text's component, and whether the text has words."""
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UPPER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(find(i), bool(s)) for i, s in enumerate(sets)]


def test_near_duplicates_of_five_words(spark, sf):
    """Near copies between 0.8 on five words and 0.9 on three are linked, which op5's own parameters miss."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words, *(f"x{i}" for i in range(15))]), " ".join([*words[:50], "other", *words[51:]]), " ".join(words[::-1]), "one two three four", "one two three four", ""]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect())
    want = [i for i, (least, has) in enumerate(five_word_components(texts)) if least == i or not has]
    assert kept == want and 1 not in kept and {0, 3, 4, 6} <= set(kept)


#: Names that the operators use for columns of their own.
CLASHING = ("score", "lang_pred", "ambiguous", "held_out", "n_shingles", "n_ranked", "common", "f1", "f2", "key", "id", "none", "root", "near", "token", "df", "contaminated", "n_words", "n_hit", "hit_spans", "spans", "found", "ids", "n_tokens", "__text", "__row", "__h", "k1", "h")


def test_stages_keep_extra_columns_of_any_name(spark, sf):
    words = "the quick brown fox jumps over the lazy dog and runs away from the old house near the river today".split()
    long = " ".join(words[(i * i + i // 7) % len(words)] + str(i % 911) for i in range(60_000))
    rows = [(1, " ".join(words), "en", "s", 5), (1, " ".join(words), "en", "s", 5), (2, " ".join([*words, "more"]), "en", "s", 5), (None, "nothing else is like this password=hunter22 at all", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "12 34", "de", "s", 1), (6, long, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"doc_id * 10 + {i} AS `{c}`" for i, c in enumerate(CLASHING)), "'x' AS `a b.c`")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 6, None} and docs.count() == 3  # near and repeated copies, null and letterless texts are gone
    assert all(got[1][c] == 10 + i for i, c in enumerate(CLASHING)) and got[6].text == long and got[6].n_chars == 1
    assert got[None].text == "nothing else is like this [SECRET] at all" and got[None].n_chars is not None
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
