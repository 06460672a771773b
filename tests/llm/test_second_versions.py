"""Whole operators against second versions in plain Python: url verdicts (op6) and languages (op4)."""

from __future__ import annotations

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sievelight.llm import language_id, queries, url_filters

HREF = re.compile(r"""<a\s[^>]*?href\s*=\s*["']?([^"'>\s]*://[^"'>\s]+)""", re.I | re.S | re.A)
UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
    return rest[:end].translate(UPPER), re.split(r"[?#]", rest[end:], maxsplit=1)[0]


def walked(edges, base, rounds=8):
    """Personalised PageRank over {(src, dst): n} by dictionaries; what has nowhere to go returns to the seeds."""
    if not edges:
        return dict(base)
    total = collections.Counter()
    for (a, _), n in edges.items():
        total[a] += n
    score = dict(base)
    for _ in range(rounds):
        stuck = math.fsum(s for h, s in score.items() if h not in total)
        new = {h: w * (0.15 + 0.85 * stuck) for h, w in base.items()}
        for (a, b), n in edges.items():
            if a in score:
                new[b] = new.get(b, 0.0) + 0.85 * score[a] * n / total[a]
        score = new
    return score


def judged(pages):
    """{page_id: (host, path, rule, verdict)} and the score differences of the hosts."""
    known, ruled, edges = [], collections.Counter(), collections.Counter()
    for page_id, url, html in pages:
        host, path = split_url(url)
        fits = [r for r in url_filters.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        known.append((page_id, host, path, rule))
        if host and rule:
            ruled[host, rule[0]] += 1
        for to in set(HREF.findall(html or "")):
            dst = split_url(to)[0]
            if host and dst and dst != host:
                edges[host, dst] += 1
    seeds = {}
    for kind in ("allow", "block"):
        all_of = sum(n for (_, k), n in ruled.items() if k == kind)
        seeds[kind] = {h: n / all_of for (h, k), n in ruled.items() if k == kind}
    trust = walked(edges, seeds["allow"])
    distrust = walked({(b, a): n for (a, b), n in edges.items()}, seeds["block"])
    off = {h: distrust.get(h, 0.0) - trust.get(h, 0.0) for h in {*trust, *distrust}}
    return {i: (h, p, r and r[1] + r[2], r[0] if r else "block" if off.get(h, 0.0) > 0 else "allow") for i, h, p, r in known}, off


def odd_pages(spark, sf):
    real = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    link = lambda *to: " ".join(f"<A rel=x\nHREF = '{t}'>t</a>" for t in to)
    extra = [
        (9001, None, link("http://x.net/")), (9002, "http://farm.info/", link("http://x.net/", "http://X.NET/", "https://y.example.com/de/q")), (9003, "http://x.net/", None), (9004, "http://farm.info/b", link("http://x.net/") * 3 + link("//no.scheme/", "/local", "http://farm.info/self")),
        (9005, "no url", link("http://x.net/")), (9006, "http://far.info", "x" * 400_000 + link("http://farm.info/") + "y" * 400_000), (9007, "http://good.org/fr/", link("http://shared.info/a")), (9008, "http://shared.info/", link("http://x.net/")), (9009, "", ""),
        (9010, "http://y.example.com/de/", link("http://shared.info/")), (9011, "http:///path", link("http://x.net/")), (9002, "http://farm.info/", link("http://x.net/")), (None, "http://far.info/?q", ""),
    ]
    return real.unionByName(spark.createDataFrame(extra, real.schema))


@pytest.mark.parametrize("clashing", [False, True])
def test_url_verdicts(spark, sf, clashing):
    pages = odd_pages(spark, sf)
    want, off = judged([tuple(r) for r in pages.collect()])
    assert {v[3] for v in want.values()} == {"allow", "block"} and min(abs(x) for x in off.values() if x) > 1e-9
    assert sum(1 for v in want.values() if v[2] is None and v[3] == "block") > 1  # by the links alone
    if clashing:
        pages = pages.withColumns({c: F.lit("z") for c in ("host", "path", "rule", "by_rule", "verdict", "trust", "distrust", "score", "src", "dst", "n", "weight", "total")})
    got = url_filters.judge(pages)
    assert got.count() == pages.count()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == want
    if clashing:
        assert {r[0] for r in got.select("score").distinct().collect()} == {"z"}


def test_url_query(spark, sf):
    want, _ = judged([tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()])
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.QUERIES["op6_url_filter"](spark, sf).collect()} == want


def grams(text):
    """Buckets of the trigrams of a text whose letters (and bytes beyond ASCII) are kept, from each byte on."""
    folded = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()) + b"  "
    keys = (int.from_bytes(folded[i : i + 3], "big") for i in range(len(folded) - 2))
    return [0 if k == 0x202020 else (k * 0x9E3779B1 % (1 << 32)) >> 17 for k in keys]


def plain_model(data):
    counts = {}
    for doc_id, text, lang in data:
        if lang is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5:
            counts.setdefault(lang, collections.Counter()).update(g for g in grams(text or "") if g)
    langs, n = sorted(counts), language_id.BUCKETS
    share = {x: {g: (c + 0.5) / (sum(counts[x].values()) + 0.5 * n) for g, c in counts[x].items()} for x in langs}
    none = {x: 0.5 / (sum(counts[x].values()) + 0.5 * n) for x in langs}
    return langs, language_id.codewords(len(langs)).tolist(), share, none


def plain_prediction(text, model):
    """Language, score and the lead over the second by plain loops."""
    langs, code, share, none = model
    if not langs or not any(c.isalpha() for c in text or ""):
        return "und", 0.0, 1.0
    used = [g for g in grams(text) if g]
    margins = []
    for bit in range(len(code[0])):
        sides = {s: [x for x, word in zip(langs, code, strict=True) if word[bit] == s] for s in (1, -1)}
        mean = lambda g, s: sum(share[x].get(g, none[x]) for x in sides[s]) / len(sides[s])  # noqa: B023, E731
        known = {g: math.log(mean(g, 1)) - math.log(mean(g, -1)) for g in set(used)} if all(sides.values()) else {}
        margins.append(4.0 * math.fsum(known.get(g, 0.0) for g in used) / max(1, len(used)))
    weight = [abs(math.tanh(m / 2)) + 1e-3 for m in margins]
    loss = [sum(w * math.log1p(math.exp(-b * m)) for w, b, m in zip(weight, word, margins, strict=True)) / sum(weight) for word in code]
    p = [math.exp(-len(margins) * (x - min(loss))) for x in loss]
    p = [x / sum(p) for x in p]
    best = max(range(len(p)), key=lambda i: (p[i], -i))
    return langs[best], p[best], p[best] - max((x for i, x in enumerate(p) if i != best), default=-1.0)


@pytest.mark.parametrize("only", [None, ("en", "fr"), ("de",), ()])
def test_languages(spark, sf, only):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    if only is not None:
        real = real.withColumn("lang", F.when(F.col("lang").isin(*only), F.col("lang")))
    extra = [(9001, None, "en"), (9002, "", "de"), (9003, "12 !? \n", "fr"), (9004, "é", None), (9005, "日本語", "en"), (9006, "ab", "en"), (9006, "ab", "en"), (9007, "word " * 3000, "en" if only is None or "en" in only else None), (None, "no id at all", "fr"), (9008, "ſ", None)]
    data = real.unionByName(spark.createDataFrame([(i, t, x if only is None or x in only else None) for i, t, x in extra], real.schema)).repartition(3)
    model = plain_model([tuple(r) for r in data.collect()])
    out = language_id.predict(data, language_id.train(data), ["doc_id", "text"]).collect()
    assert len(out) == data.count()
    told = 0
    for r in out:
        lang, score, lead = plain_prediction(r.text, model)
        assert r.score == pytest.approx(score, abs=1e-4)
        if lead > 1e-3:
            told += 1
            assert r.lang_pred == lang, r
    assert told > 0.9 * len(out)
