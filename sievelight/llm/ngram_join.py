"""N-gram Jaccard join by filters under several global token orders.

A text is its set of distinct shingles. Under any global order of the tokens, two sets with a Jaccard similarity of at
least t share a token of their prefixes, the first |x| - ceil(t |x|) + 1 tokens of each. The join asks for that under
every order of ``ORDERS`` before it verifies anything:

1. All orders rank one token in ``FIRST_CLASS`` (by its hash) first, by rising frequency, and break ties by different
   hashes; the other tokens follow by hash. Frequencies are counted over all sets, from the ranked class alone, which is
   what the first shuffle holds. Tokens of one set can't make a pair, so most sets end here.
2. Sets that share a prefix token under the first order are connected through the least set of each token, and the
   components are dealt to pairs of blocks of bounded size (in sets and in tokens).
3. Within two blocks a pair must share prefix tokens under all orders; what remains is verified by the exact
   intersection.

Tokens that a large share of the sets hold are found while the sets are measured. Their frequency is ``COMMON`` from the
start, so they are never gathered by token. Equal sets are one class from the start, so copies never meet each other; a
block pair returns its linked pairs only as a spanning forest and as counts of links.

Edge cases: text without words has an empty set, is linked with nothing and is its own component; with fewer than k
words the whole sequence is the one shingle; repeated rows are copies; a null doc_id names a component only where no
other row of it has one; very long texts are one set each; a similarity of exactly t links; an empty table gives an
empty result; other columns, whatever their names, are ignored by ``join`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts
from sievelight.operators.clusters import components
from sievelight.operators.ranking import meet
from sievelight.session import release, shared_folder

K = 3
#: The similarity in hundredths.
PERCENT = 90
#: Sets and tokens of a block, on average.
BLOCK = 1024
BLOCK_TOKENS = 1_000_000
#: Seeds of the hashes that break ties; one order each.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: One token in so many is ranked by its frequency.
FIRST_CLASS = 3
#: Frequencies from here on count as equal.
COMMON = 1_000
#: A token in one of so many sets is common; at most so many times the mean size of a set are.
HOT_SHARE = 100
#: Common tokens that are broadcast at most (8 bytes each); others are counted like any token.
MAX_HOT = 500_000


def shingle_sets(texts: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, buf, offs in ts.text_slices(texts):
        low = ts.LOWER[buf]
        starts, ends, doc = ts.find_words(low, offs, ts.SOLID)
        words = ts.range_hash(ts.prefix_sums(low), starts, ends)
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        full = ts.shingle_hash(words, k, k)
        for d in range(hi - lo):
            a, n = int(first[d]), int(first[d + 1] - first[d])
            yield np.unique(full[a : a + n - k + 1]) if n >= k else ts.shingle_hash(words[a : a + n], n, n) if n else np.zeros(0, np.uint64)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(tokens))
        a = ts.mix(np.array([ts.mix(tokens).sum() + n], np.uint64))
        b = ts.mix(np.array([ts.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum() ^ n], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def ranked(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which tokens are of the class that all orders rank first."""
    classes = np.uint64(max(1, min(FIRST_CLASS, 60 // max(1, 100 - percent))))
    return ts.mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % classes == 0


def offered(tokens: np.ndarray, hot: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that the set's prefixes may hold, with their frequency, 0 where it's yet to be counted.

    Those are the ranked ones; where a prefix is longer, also the next by each hash. A set too small to have a different
    partner offers none.
    """
    if len(tokens) * (100 - percent) < percent:
        return tokens[:0], np.zeros(0, np.int32)
    inside = ranked(tokens, percent)
    own, rest = tokens[inside], tokens[~inside]
    df = np.where(hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own, COMMON, 0) if len(hot) else np.zeros(len(own), np.int64)
    short = prefix_size(len(tokens), percent) - len(own)
    if short > 0:
        more = np.unique(np.concatenate([rest[np.argsort(ts.mix(rest ^ np.uint64(seed)), kind="stable")[:short]] for seed in ORDERS]))
        own, df = np.concatenate((own, more)), np.concatenate((df, np.full(len(more), COMMON + 1)))
    return own, df.astype(np.int32)


def prefixes(tokens: np.ndarray, df: np.ndarray, size: int, n_ranked: int, percent: int = PERCENT) -> list[np.ndarray]:
    """The shared tokens of the set's prefix under each order, from its offered tokens that other sets hold too."""
    alone = n_ranked - int((df <= COMMON).sum())
    need = prefix_size(size, percent) - alone
    return [tokens[np.lexsort((ts.mix(tokens ^ np.uint64(seed)), df))[:need]] if need > 0 else tokens[:0] for seed in ORDERS]


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f1, token, df) of tokens that several sets hold, from rows (token, f1, df) in order of token and set."""
    token, f1, df = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    last = False
    while not last:
        b = next(batches, None)
        last = b is None
        if not last:
            token, f1, df = (np.concatenate((x, b.column(i).to_numpy())) for i, x in enumerate((token, f1, df)))
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (f1[1:] != f1[:-1])
        token, f1, df = token[new], f1[new], df[new]
        head = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
        times = np.repeat(np.diff(head), np.diff(head))
        seen = np.where(df > 0, df, np.minimum(times, COMMON)).astype(np.int32)
        held = len(token) if last else max(int(head[-2]), len(token) - COMMON - 1)  # enough of the last token's rows to know it for common
        out = np.flatnonzero(seen[:held] > 1)
        yield pa.RecordBatch.from_arrays([pa.array(f1[out]), pa.array(token[out]), pa.array(seen[out])], ["f1", "token", "df"])
        token, f1, df = token[held:], f1[held:], df[held:]


class _Lists:
    """Inverted lists of (token, set), to count what one set shares with each other."""

    def __init__(self, token: np.ndarray, doc: np.ndarray, n_tokens: int, n_docs: int):
        order = np.argsort(token, kind="stable")
        self.doc, self.n = doc[order], n_docs
        self.start = np.searchsorted(token[order], np.arange(n_tokens + 1))

    def shared(self, own: np.ndarray) -> np.ndarray:
        s, size = self.start[own], self.start[own + 1] - self.start[own]
        at = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.doc[at], minlength=self.n)


def linked(sets: list[np.ndarray], firsts: list[list[np.ndarray]], side: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i linked with it); with two sides (blocks), only pairs across them. ``firsts``: prefixes by order and set."""
    size = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(len(sets)), size)
    distinct, token = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    filters = []
    for own in firsts:
        n = np.array([len(p) for p in own], np.int64)
        at = np.searchsorted(distinct, np.concatenate(own))
        lists = _Lists(at, np.repeat(np.arange(len(sets)), n), len(distinct), len(sets))
        filters.append((lists, at, np.concatenate(([0], np.cumsum(n)))))
    lists = _Lists(token, doc, len(distinct), len(sets))
    both = side.min() != side.max()
    later = np.arange(len(sets))
    for i in range(len(sets)):
        may = (later > i) & (size * 100 >= size[i] * percent) & (size[i] * 100 >= size * percent)
        if both:
            may &= side != side[i]
        for f, at, ends in filters:
            if not may.any():
                break
            may &= f.shared(at[ends[i] : ends[i + 1]]) > 0
        if may.any():
            inter = lists.shared(token[start[i] : start[i] + size[i]])
            yield i, np.flatnonzero(may & (100 * inter >= percent * (size[i] + size - inter)))


def join(documents: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, n_links and component_id (the least doc_id reachable by links) of every row."""
    return _judge(documents, k, percent).select("doc_id", "n_shingles", "n_links", "component_id")


def _measured(documents: DataFrame, keep: list[str], k: int, percent: int, once: str | None = None) -> DataFrame:
    """``keep`` with the size of every row's set, its two hashes and the number of its ranked tokens.

    The first row of a batch also has the ranked tokens that are in one of ``HOT_SHARE`` sets of the batch, and how often.
    With ``once``, a task gives rows that are equal in that column and in their set once.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple] = set()
        for b in batches:
            rows, own, seen = [], [], set()
            for s in shingle_sets(b.column(len(keep)), k):
                inside = s[ranked(s, percent)]
                rows.append((len(s), *fingerprint(s), len(inside), None))
                if rows[-1][1] not in seen:
                    seen.add(rows[-1][1])
                    own.append(inside)
            if rows:
                token, n = np.unique(np.concatenate(own), return_counts=True)
                often = n >= max(8, len(own) // HOT_SHARE)
                rows[0] = (*rows[0][:4], list(zip(token[often].view(np.int64).tolist(), n[often].tolist(), strict=True)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))]
            cols = [pa.array([None if x is None else [{"token": t, "n": c} for t, c in x] for x in col] if i == 4 else list(col), t) for i, (col, t) in enumerate(zip(cols, kinds, strict=True))]
            out = pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], [*keep, "n_shingles", "f1", "f2", "n_ranked", "common"])
            if once:
                names = [(i, *r[1:3]) for i, r in zip(out.column(once).to_pylist(), rows, strict=True)]
                at = [i for i, x in enumerate(names) if not (x in told or told.add(x))]
                out = out if len(at) == len(rows) else out.take(pa.array(at, pa.int64()))
            yield out

    schema = ts.widened(documents.select(*keep), "n_shingles long, f1 long, f2 long, n_ranked long, common array<struct<token:long,n:long>>")
    return documents.select(*keep, F.col("text").cast("string").alias("__text")).transform(ts.in_batches, measure, schema)


def _hot_tokens(known: DataFrame) -> np.ndarray:
    """The ranked tokens that at least one of ``2 * HOT_SHARE`` sets are known to hold, in order."""
    n = known.where("n_shingles > 0").count()
    often = known.where("common IS NOT NULL").select(F.explode("common").alias("c")).groupBy("c.token").agg(F.sum("c.n").alias("n"))
    rows = often.where(F.col("n") > max(COMMON, n // (2 * HOT_SHARE))).orderBy(F.desc("n"), "token").limit(MAX_HOT).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def _judge(documents: DataFrame, k: int, percent: int) -> DataFrame:
    spark = documents.sparkSession
    shared_folder(spark)
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    known = _measured(docs, ["doc_id", "key"], k, percent).checkpoint()
    hot = spark.sparkContext.broadcast(_hot_tokens(known))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set of which a task has copies speaks once for it: 8 bytes for each of a task's rows
        for b in batches:
            own, found, held = [], [], 0
            for s in shingle_sets(b.column(0), k):
                f1 = fingerprint(s)[0] if len(s) else None
                if f1 is not None and f1 not in seen:
                    seen.add(f1)
                    own.append(f1)
                    found.append(offered(s, hot.value, percent))
                    held += len(found[-1][0])
                if held >= 100_000:
                    yield _offers(own, found)
                    own, found, held = [], [], 0
            if own:
                yield _offers(own, found)

    tokens = docs.select("text").transform(ts.in_batches, offer, "token long, f1 long, df int")
    # Tokens to be counted meet by token; the frequency of the others is settled, so they are spread by set.
    dealt = tokens.repartition(F.when(F.col("df") > 0, F.xxhash64("f1")).otherwise(F.col("token"))).sortWithinPartitions("token", "f1")
    counted = dealt.transform(ts.in_batches, frequencies, "f1 long, token long, df int")
    lists = counted.groupBy("f1").agg(F.collect_list(F.struct("token", "df")).alias("tokens"))  # of one set
    classes = known.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "key")).alias("one"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("n_ranked").alias("n_ranked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, firsts = [], []
            for i, own in enumerate(b.column(2)):
                flat = own.values
                p = prefixes(flat.field("token").to_numpy().view(np.uint64), flat.field("df").to_numpy(), b.column(0)[i].as_py(), b.column(1)[i].as_py(), percent)
                if len(p[0]):
                    at.append(i)
                    firsts.append([x.view(np.int64) for x in p])
            kept = b.take(pa.array(at, pa.int64()))
            cols = [pa.array([p[i] for p in firsts], pa.list_(pa.int64())) for i in range(len(ORDERS))]
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(3, 8)), kept.column(0), *cols], ["f1", "f2", "doc_id", "key", "copies", "size", "p0", "p1", "p2"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    held = classes.join(lists, "f1").select("size", "n_ranked", "tokens", "f1", "f2", "one.doc_id", "one.key", "copies")
    held = held.transform(ts.in_batches, cut, f"f1 long, f2 long, doc_id {kind}, key long, copies long, size long, p0 array<long>, p1 array<long>, p2 array<long>").checkpoint()
    uses = held.select("f1", F.explode("p0").alias("token"))
    least = uses.groupBy("token").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select("token", "lo")
    pairs = meet(uses, least, "token").where("f1 <> lo").select(F.col("f1").alias("a"), F.col("lo").alias("b")).distinct()
    near = components(pairs).withColumnsRenamed({"node": "f1", "root": "near"})
    dealt = held.join(near, "f1").checkpoint()
    release(spark)
    blocks = dealt.groupBy("near").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_TOKENS)).cast("int").alias("n_blocks"))
    dealt = dealt.join(blocks, "near").withColumn("block", F.pmod(F.xxhash64("f2"), F.col("n_blocks")).cast("int"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets, once for each pair of blocks."""
        names = ["near", "bi", "bj", "block", "f1", "f2", "copies", "tokens", "p0", "p1", "p2"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        seen: set[tuple[int, int]] = set()  # repeated rows: 16 bytes for each of a task's sets
        for b in batches:
            rows = b.select(["f1", "f2", "near", "n_blocks", "block", "copies"]).to_pylist()
            firsts = [b.column(f"p{i}") for i in range(len(ORDERS))]
            out, held = [], 0
            for i, (r, s) in enumerate(zip(rows, shingle_sets(b.column("text"), k), strict=True)):
                name = (r["f1"], r["f2"])
                if name not in seen and fingerprint(s) == name:
                    seen.add(name)
                    raw = [s.tobytes(), *(p[i].values.to_numpy().tobytes() for p in firsts)]
                    out += [(r["near"], min(r["block"], j), max(r["block"], j), r["block"], *name, r["copies"], *raw) for j in range(r["n_blocks"])]
                    held += sum(map(len, raw)) * r["n_blocks"]
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def verify(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["f1", "f2"]).reset_index(drop=True)
        n = len(rows)
        links, top, edges = np.zeros(n, np.int64), list(range(n)), []

        def find(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        crossing = int(_key[1]) != int(_key[2])
        side, copies = rows["block"].to_numpy(), rows["copies"].to_numpy()
        if n > 1 and (not crossing or side.min() != side.max()):
            sets, *firsts = ([np.frombuffer(t, np.uint64) for t in rows[c]] for c in ("tokens", "p0", "p1", "p2"))
            for i, js in linked(sets, firsts, side, percent):
                links[i] += copies[js].sum()
                links[js] += copies[i]
                for j in js.tolist():
                    if (x := find(i)) != (y := find(j)):
                        top[x] = y
                        edges.append((i, j))
        f1, f2 = rows["f1"].to_numpy(), rows["f2"].to_numpy()
        some = np.flatnonzero(links)
        a, b = (np.array([e[s] for e in edges], np.int64) for s in (0, 1))
        return pd.DataFrame({"f1": np.concatenate((f1[some], f1[a])), "f2": np.concatenate((f2[some], f2[a])), "g1": np.concatenate((f1[some], f1[b])), "g2": np.concatenate((f2[some], f2[b])), "links": np.concatenate((links[some], np.zeros(len(a), np.int64)))})

    wanted = dealt.select(F.col("doc_id").alias("id"), F.col("key").alias("own"), "f1", "f2", "near", "n_blocks", "block", "copies", "p0", "p1", "p2").hint("shuffle_hash")
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["id"]) & docs["key"].eqNullSafe(wanted["own"]))
    sets = texts.transform(ts.in_batches, fetch, "near long, bi int, bj int, block int, f1 long, f2 long, copies long, tokens binary, p0 binary, p1 binary, p2 binary")
    found = sets.groupBy("near", "bi", "bj").applyInPandas(verify, "f1 long, f2 long, g1 long, g2 long, links long").checkpoint()
    release(spark)
    name = lambda x, y: F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0"))
    forest = components(found.where("links = 0").select(name("f1", "f2").alias("a"), name("g1", "g2").alias("b")))
    counts = found.groupBy("f1", "f2").agg(F.sum("links").alias("links"))
    rooted = classes.join(counts, ["f1", "f2"], "left").withColumn("node", name("f1", "f2")).join(forest, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    judged = rooted.join(least, "root").select("f1", "f2", "root", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return known.join(judged, ["f1", "f2"], "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), "f1", "f2", "root")


def _offers(own: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    tokens, df = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.repeat(np.array(own, np.int64), [len(t) for t, _ in found])), pa.array(df)], ["token", "f1", "df"])


def keep_one(documents: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: the one with the least doc_id (nulls last), then set hashes.

    Rows without words are components of their own, so all of them stay.
    """
    judged = _judge(documents, k, percent).where("n_shingles > 0")
    first = judged.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "f1", "f2")).alias("one"))
    first = first.select(F.col("one.none"), F.xxhash64("one.doc_id").alias("id"), F.col("one.f1"), F.col("one.f2"))
    boxed = ts.boxed(documents, "doc_id", "text")
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0d]"), F.lit(False))
    rows = _measured(boxed.where(worded), ["__row", "doc_id"], k, percent, once="doc_id")
    keys = ["none", "id", "f1", "f2"]
    rows = rows.select("__row", F.col("doc_id").isNull().alias("none"), F.xxhash64("doc_id").alias("id"), "f1", "f2")
    chosen = rows.join(first, keys, "left_semi").dropDuplicates(keys)  # one shuffle of the texts serves both
    return chosen.select("__row").unionByName(boxed.where(~worded).select("__row")).select("__row.*")
