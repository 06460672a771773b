"""Source divergence audit over mergeable radix tries.

Terms are runs of letters (A-Z lower-cased) and of non-ASCII characters. Every task counts the terms of its documents
in a byte trie: a node for each prefix, and at each term's leaf the number of documents and a counter for each source.
The leaves of these tries, in UTF-8 order, go to ranges of prefixes; there tries are merged by adding them to a trie of
the range, whose leaves with at least ``least`` documents are kept. A walk over a range in UTF-8 order gives the sums of
all pairs of sources and, for each source, the range's best terms; ties keep the order of the walk. Sums and best terms
of the ranges are added up and ranked at the end.

Bytes beyond ``DEPTH`` of a term are one edge of the trie. A trie that has grown to ``MAX_NODES`` is sent off, and a new
one begun. One term makes at most one row for each trie, however often it occurs, so a frequent one can't flood a task.

Arithmetic is in integers: p = 1 + floor(SCALE * (count + 1) / (N + V)) is divided in three steps of a thousand, exact
for N + V below 9e15; a group's squares over all terms sum to less than 2**63, since its p sum to about SCALE.

Edge cases: null text, lang and source count as ''; a group without terms is audited like the rest (its p are all
alike), and in a language without kept terms every pair has value 0; a source alone in its language has no pairs;
repeated rows are documents of their own; texts and terms of any length count whole; an empty table gives an empty
result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts
from sievelight.session import discard, settled, shared_folder

SCALE = 1_000_000_000
#: Levels of a trie that have a node for each byte.
DEPTH = 24
MAX_NODES = 2_000_000
#: Leaves that a walk holds at once, and partial leaves in a range on average.
LEAVES = 20_000
RANGE_ROWS = 400_000
#: Cells of a block of leaves x sources.
CELLS = 1 << 20

_TERM = np.zeros(256, bool)
_TERM[0x61:0x7B] = _TERM[0x80:] = True


class Trie:
    """A byte trie with counters (documents, and occurrences for each source) at its leaves.

    Level d holds the nodes of d bytes, numbered as they come; ``keys[d]`` are the sorted (parent << 8 | byte) of its
    children and ``kids[d]`` their numbers. Level 0 has a root for each language.
    """

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.keys = [np.zeros(0, np.int64) for _ in range(DEPTH)]
        self.kids = [np.zeros(0, np.int64) for _ in range(DEPTH)]
        self.tails: dict[tuple[int, bytes], int] = {}
        self.sources: dict[int, int] = {}
        self.n = 0
        self.found: list[tuple[np.ndarray, ...]] = []  # (leaf, source, count) and (leaf, -1, documents)
        self.held = 0

    def root(self, lang: str) -> int:
        if lang not in self.langs:
            self.langs[lang] = self.n
            self.n += 1
        return self.langs[lang]

    def source(self, key: int) -> int:
        return self.sources.setdefault(key, len(self.sources))

    def leaves(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """The leaf of each term (buf[start : start + size] below its root), made where it is new: all terms descend a level at a time."""
        node, live = roots.astype(np.int64), np.flatnonzero(sizes)
        for d in range(DEPTH):
            if not len(live):
                return node
            which, asked = pd.factorize(node[live] << 8 | buf[starts[live] + d])
            node[live] = self._children(d, asked)[which]
            live = live[sizes[live] > d + 1]
        for i in live.tolist():
            tail = (int(node[i]), buf[starts[i] + DEPTH : starts[i] + sizes[i]].tobytes())
            if tail not in self.tails:
                self.tails[tail] = self.n
                self.n += 1
            node[i] = self.tails[tail]
        return node

    def _children(self, d: int, asked: np.ndarray) -> np.ndarray:
        keys, kids = self.keys[d], self.kids[d]
        at = np.searchsorted(keys, asked)
        known = keys[np.minimum(at, len(keys) - 1)] == asked if len(keys) else np.zeros(len(asked), bool)
        if known.all():
            return kids[at]
        fresh = np.sort(asked[~known])
        where = np.searchsorted(keys, fresh)
        self.keys[d] = np.insert(keys, where, fresh)
        self.kids[d] = np.insert(kids, where, np.arange(self.n, self.n + len(fresh)))
        self.n += len(fresh)
        return self.kids[d][np.searchsorted(self.keys[d], asked)]

    def count(self, leaf: np.ndarray, source: np.ndarray, n: np.ndarray) -> None:
        """Adds n at the counters of leaves; source -1 counts documents."""
        self.found.append((leaf, source, n))
        self.held += len(leaf)
        if self.held > 4_000_000:
            self._settle()

    def _settle(self) -> None:
        if len(self.found) != 1:
            leaf, source, n = (np.concatenate([f[i] for f in self.found]) if self.found else np.zeros(0, np.int64) for i in range(3))
            width = len(self.sources) + 1
            key, inverse = np.unique(leaf * width + source + 1, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, inverse, n)
            self.found = [(key // width, key % width - 1, total)]
        self.held = 0  # what has been added up already isn't added up again until as much is new

    def walk(self, least: int = 1) -> Iterator[tuple[str, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(lang, documents, terms, number of counters, source keys, counts), by lang and in UTF-8 order, at most LEAVES leaves at once."""
        self._settle()
        leaf, source, n = self.found[0]  # sorted by leaf, then source
        docs, ends, counted = np.zeros(self.n, np.int64), np.zeros(self.n, bool), source >= 0
        docs[leaf[~counted]], ends[leaf] = n[~counted], True
        leaf, source, n = leaf[counted], source[counted], n[counted]
        parent, byte, depth = np.full(self.n, -1), np.zeros(self.n, np.uint8), np.zeros(self.n, np.int64)
        for d in range(DEPTH):
            parent[self.kids[d]], byte[self.kids[d]], depth[self.kids[d]] = self.keys[d] >> 8, self.keys[d] & 0xFF, d + 1
        tails = sorted((node, tail, at) for (node, tail), at in self.tails.items())
        last = np.array([at for _, _, at in tails], np.int64)
        parent[last], depth[last] = np.array([node for node, _, _ in tails], np.int64), DEPTH
        below = ends.astype(np.int64)  # leaves at and below each node
        for kids in (last, *reversed(self.kids)):
            np.add.at(below, parent[kids], below[kids])
        names = sorted(self.langs)
        roots = np.array([self.langs[x] for x in names], np.int64)
        first, lang = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)  # place of a node's first leaf in the order, its language
        first[roots], lang[roots] = np.cumsum(below[roots]) - below[roots], np.arange(len(roots))
        for kids in (*self.kids, last):  # sorted by parent, then byte
            if len(kids):
                up, before = parent[kids], np.cumsum(below[kids]) - below[kids]
                opens = np.concatenate(([True], up[1:] != up[:-1]))
                first[kids], lang[kids] = first[up] + ends[up] + before - np.maximum.accumulate(np.where(opens, before, 0)), lang[up]
        own = np.flatnonzero(docs >= max(1, least))
        own = own[np.argsort(first[own])]
        lo, size = np.searchsorted(leaf, own), np.searchsorted(leaf, own, "right") - np.searchsorted(leaf, own)
        keys, tail_of = np.array(list(self.sources), np.int64), {at: tail for _, tail, at in tails}
        for x in range(len(names)):
            begin, end = np.searchsorted(lang[own], (x, x + 1))
            for a in range(begin, end, LEAVES):
                z = min(a + LEAVES, end)
                cells = np.repeat(lo[a:z] - np.cumsum(size[a:z]) + size[a:z], size[a:z]) + np.arange(size[a:z].sum())
                yield names[x], docs[own[a:z]], _spelt(own[a:z], parent, byte, depth, tail_of), size[a:z], keys[source[cells]], n[cells]


def _spelt(nodes: np.ndarray, parent: np.ndarray, byte: np.ndarray, depth: np.ndarray, tail_of: dict[int, bytes]) -> pa.Array:
    """The terms of leaves, read upwards."""
    deep, at = depth[nodes], nodes.copy()
    tails = {i: tail_of[x] for i, x in enumerate(nodes.tolist()) if x in tail_of} if tail_of else {}
    size = deep.copy()
    for i, tail in tails.items():
        size[i] += len(tail)
        at[i] = parent[at[i]]
    offs = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(offs[-1], np.uint8)
    for d in reversed(range(DEPTH)):
        some = np.flatnonzero(deep > d)
        out[offs[some] + d], at[some] = byte[at[some]], parent[at[some]]
    for i, tail in tails.items():
        out[offs[i] + DEPTH : offs[i + 1]] = np.frombuffer(tail, np.uint8)
    return pa.LargeStringArray.from_buffers(len(nodes), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


_PARTIAL = "lang string, term string, docs long, sources array<long>, counts array<long>"


def _lists(size: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(flat, pa.int64()))


def _sent(trie: Trie) -> Iterator[pa.RecordBatch]:
    for lang, docs, terms, size, sources, counts in trie.walk():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(docs), pa.string()), terms, pa.array(docs), _lists(size, sources), _lists(size, counts)], ["lang", "term", "docs", "sources", "counts"])


def count_terms(documents: DataFrame) -> DataFrame:
    """The leaves of every task's tries, from (lang, source key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            roots = np.array([trie.root(x) for x in b.column(0).to_pylist()], np.int64)
            source = np.array([trie.source(x) for x in b.column(1).to_pylist()], np.int64)
            for lo, _, raw, offs in ts.text_slices(b.column(2), 2 << 20):
                buf = ts.LOWER[raw]
                starts, ends, text = ts.find_words(buf, offs, _TERM)
                leaf = trie.leaves(buf, starts, ends - starts, roots[lo + text])
                seen = np.sort(pd.unique(text << 40 | leaf)) & ((1 << 40) - 1)  # a term counts once for each of its documents
                for keys, which in ((leaf * len(trie.sources) + source[lo + text], None), (seen, -1)):
                    key, n = np.unique(keys, return_counts=True)
                    trie.count(key if which else key // len(trie.sources), np.full(len(key), -1) if which else key % len(trie.sources), n)
            if trie.n > MAX_NODES:
                yield from _sent(trie)
                roots, trie = None, Trie()
        yield from _sent(trie)

    return documents.transform(ts.in_batches, run, _PARTIAL)


def merge(partial: DataFrame, least: int) -> DataFrame:
    """The kept leaves of all tries, merged by ranges of prefixes: a row for each piece of a walk.

    (lang, piece, terms, sizes, sources, counts, sum_of, sums): sizes tells how many of sources and counts are a term's;
    sums are the piece's occurrences of each source.
    """
    n = max(1, -(-partial.count() // RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            roots = np.array([trie.root(x) for x in b.column(0).to_pylist()], np.int64)
            for lo, hi, raw, offs in ts.text_slices(b.column(1)):
                leaf = trie.leaves(raw, offs[:-1], np.diff(offs), roots[lo:hi])
                own, ns = b.column(3).slice(lo, hi - lo), b.column(4).slice(lo, hi - lo)
                keys, which = np.unique(own.flatten().to_numpy(), return_inverse=True)
                numbers = np.array([trie.source(x) for x in keys.tolist()], np.int64)
                trie.count(leaf, np.full(len(leaf), -1), b.column(2).slice(lo, hi - lo).to_numpy())
                trie.count(np.repeat(leaf, own.value_lengths().to_numpy()), numbers[which], ns.flatten().to_numpy())
        here, piece = TaskContext.get().partitionId(), 0
        for lang, _, terms, size, sources, counts in trie.walk(least):
            keys, which = np.unique(sources, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, which, counts)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            row = [pa.array([lang], pa.string()), pa.array([here << 32 | piece], pa.int64()), one(terms, pa.string()), *(one(x, pa.int64()) for x in (size, sources, counts, keys, sums))]
            yield pa.RecordBatch.from_arrays(row, ["lang", "piece", "terms", "sizes", "sources", "counts", "sum_of", "sums"])
            piece += 1

    schema = "lang string, piece long, terms array<string>, sizes array<long>, sources array<long>, counts array<long>, sum_of array<long>, sums array<long>"
    return partial.repartitionByRange(n, "lang", "term").transform(ts.in_batches, run, schema)


def share(count: np.ndarray, whole) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole), digit by digit in base 1,000."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def walk_piece(piece: dict, sources: np.ndarray, n: np.ndarray, kept: int, best: int) -> tuple[np.ndarray, list[list[tuple[str, int]]]]:
    """(sums of all pairs of a language's sources over a piece, each source's best terms in it).

    ``sources`` are their sorted keys, ``n`` their occurrences of kept terms, ``kept`` the language's number of kept terms.
    """
    s = len(sources)
    pairs, top = np.zeros((s, s), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(s)]
    sizes, counts = np.asarray(piece["sizes"], np.int64), np.asarray(piece["counts"], np.int64)
    column, ends = np.searchsorted(sources, np.asarray(piece["sources"], np.int64)), np.concatenate(([0], np.cumsum(sizes)))
    step = max(1, CELLS // s)
    for lo in range(0, len(sizes), step):
        hi = min(lo + step, len(sizes))
        cells = np.zeros((s, hi - lo), np.int64)
        cells[column[ends[lo] : ends[hi]], np.repeat(np.arange(hi - lo), sizes[lo:hi])] = counts[ends[lo] : ends[hi]]
        p, all_p = share(cells, (n + kept)[:, None]), share(cells.sum(0), n.sum() + kept)
        for a in range(s):
            gap = p[a] - p
            gap *= gap
            gap //= p
            pairs[a] += gap.sum(1)
            good = np.flatnonzero((cells[a] > 0) & (p[a] > all_p))
            value = (p[a, good] - all_p[good]) ** 2 // all_p[good]
            value, at = np.concatenate((top[a][0], value)), np.concatenate((top[a][1], good + lo))
            order = np.argsort(-value, kind="stable")[:best]
            top[a] = value[order], at[order]
    return pairs, [[(piece["terms"][i], int(v)) for v, i in zip(*x, strict=True)] for x in top]


def audit(documents: DataFrame, least: int = 3, best: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from each other one of its language, and its most typical terms.

    Terms count that at least ``least`` documents of the language hold; terms are ranked to ``best``.
    """
    spark = documents.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = documents.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    folder = f"{shared_folder(spark)}/divergence-{uuid.uuid4().hex}"
    count_terms(docs.select("lang", F.xxhash64("source"), "text")).write.parquet(f"{folder}/partial")
    pieces = settled(merge(spark.read.parquet(f"{folder}/partial"), least))
    discard(spark, folder)

    clash = F.raise_error(F.lit("two sources have one hash"))
    groups = docs.select("lang", "source").distinct().groupBy("lang", F.xxhash64("source").alias("key"))
    groups = groups.agg(F.when(F.count("*") > 1, clash).otherwise(F.min("source")).alias("source"))
    sums = pieces.select("lang", F.explode(F.arrays_zip("sum_of", "sums")).alias("x")).groupBy("lang", F.col("x.sum_of").alias("key")).agg(F.sum("x.sums").alias("n"))
    kept = pieces.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    groups = groups.join(sums, ["lang", "key"], "left").join(kept, "lang", "left").fillna(0, ["n", "kept"])
    groups = settled(groups)  # a row for each source of a language
    # Neighbouring pieces are walked together, about LEAVES leaves in one go, however many ranges they come from.
    upto = Window.partitionBy("lang").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    leaves = pieces.select("lang", "piece", F.size("terms").alias("leaves"))  # a narrow row for each piece
    bundles = leaves.select("lang", "piece", F.floor(F.coalesce(F.sum("leaves").over(upto), F.lit(0)) / LEAVES).alias("bundle"))
    bundled = pieces.join(bundles, ["lang", "piece"]).select(F.col("lang").alias("of"), F.col("bundle").alias("part"), "piece", "terms", "sizes", "sources", "counts")
    # A language without pieces is audited through a bundle without any.
    asked = bundles.select("lang", "bundle").unionByName(groups.select("lang", F.lit(0).cast("long").alias("bundle"))).distinct()

    def walk(key: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("key", kind="stable")
        names, keys, n, kept = own["source"].to_numpy(), own["key"].to_numpy(np.int64), own["n"].to_numpy(np.int64), int(own["kept"].iloc[0])
        pairs, top = np.zeros((len(names), len(names)), np.int64), [[] for _ in names]
        for piece in found.sort_values("piece").to_dict("records"):
            more, best_of = walk_piece(piece, keys, n, kept, best)
            pairs += more
            top = [sorted(x + y, key=lambda f: -f[1])[:best] for x, y in zip(top, best_of, strict=True)]  # ties stay in order
        s = len(names)
        a, b = np.nonzero(~np.eye(s, dtype=bool))
        flat = [(names[i], *x) for i, found in enumerate(top) for x in found]
        source, item = [*names[a], *(f[0] for f in flat)], [*names[b], *(f[1] for f in flat)]
        value = [*pairs[a, b].tolist(), *(f[2] for f in flat)]
        return pd.DataFrame({"lang": key[0], "source": pd.Series(source, dtype=object), "part": pd.Series(["pair"] * len(a) + ["term"] * len(flat), dtype=object), "item": pd.Series(item, dtype=object), "value": np.array(value, np.int64)})

    walked = asked.join(groups, "lang").groupBy("lang", "bundle").cogroup(bundled.groupBy("of", "part"))
    walked = settled(walked.applyInPandas(walk, "lang string, source string, part string, item string, value long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = walked.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = walked.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return pairs.unionByName(terms)
