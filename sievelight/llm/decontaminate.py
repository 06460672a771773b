"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scans the token windows of
training texts; hash hits are verified word by word before anything is reported or removed.

The set is broadcast only while the benchmark's windows number at most ``max_broadcast``; beyond that the
windows of both sides are joined by hash in a shuffle, and the candidate hits return to their texts for the
same verification.

Edge cases: a null or empty text has no words and is clean; an item without words has no window; an item
shorter than ``width`` words is one window; repeated items and repeated rows each keep their own result; a
null item id still makes hits but isn't listed; very long texts are scanned whole; windows equal in several items name
all of them; extra columns of either table are ignored by ``scan`` and, whatever their names, kept by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts

WIDTH = 13
#: Windows of the benchmark (about 150 bytes each) that may be broadcast.
MAX_BROADCAST = 200_000

_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:long,end:long>>"


def _scan(col: pa.Array):
    for lo, hi, buf, offs in ts.text_slices(col):
        low = ts.LOWER[buf]
        starts, ends, doc = ts.find_words(low, offs, ts.ALNUM)
        yield lo, hi, low, offs, starts, ends, doc, ts.range_hash(ts.prefix_sums(low), starts, ends)


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per window of each item: item (string), k (words), h (hash), gram (words joined by a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[tuple] = []
            for lo, hi, low, _, starts, ends, doc, wh in _scan(b.column(1)):
                raw = low.tobytes()
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    i0, n = int(first[d]), int(first[d + 1] - first[d])
                    if not n:
                        continue
                    k = min(n, width)
                    for i, h in enumerate(ts.shingle_hash(wh[i0 : i0 + n], k, k).view(np.int64).tolist()):
                        gram = b" ".join(raw[starts[j] : ends[j]] for j in range(i0 + i, i0 + i + k))
                        out.append((ids[lo + d], k, h, gram))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["item", "k", "h", "gram"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).transform(ts.in_batches, run, "item string, k int, h long, gram binary")


class _Grams:
    """The hash set in the form a scan needs."""

    def __init__(self, rows: list[tuple]):
        self.items: dict[bytes, set] = {}
        by_k: dict[int, set] = {}
        for item, k, h, gram in rows:
            self.items.setdefault(gram, set()).add(item)
            by_k.setdefault(k, set()).add(h)
        self.hashes = {}
        for k, v in by_k.items():
            a = np.sort(np.array(sorted(v), np.int64).view(np.uint64))
            seen = np.zeros(1 << 20, bool)
            seen[(a >> np.uint64(44)).astype(np.int64)] = True
            self.hashes[k] = (a, seen)


def _candidates(wh: np.ndarray, doc: np.ndarray, grams: _Grams):
    for k, (a, seen) in grams.hashes.items():
        h = ts.shingle_hash(wh, k, k)
        if not len(h):
            continue
        at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
        at = at[a[np.minimum(np.searchsorted(a, h[at]), len(a) - 1)] == h[at]]
        yield k, at[doc[at] == doc[at + k - 1]]


def _judge(n_words: int, hit: np.ndarray, items: set) -> tuple:
    n_hit = int(hit.sum())
    named = sorted(x for x in items if x is not None)
    return n_words, n_hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(n_hit > 0 and 20 * n_hit >= n_words)


def _scan_batch(texts: pa.Array, grams: _Grams) -> list[tuple]:
    out: list[tuple] = []
    for lo, hi, low, offs, starts, ends, doc, wh in _scan(texts):
        raw = low.tobytes()
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        edge = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set] = {}
        for k, at in _candidates(wh, doc, grams):
            for i in at.tolist():
                found = grams.items.get(b" ".join([raw[s:e] for s, e in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist(), strict=True)]))
                if found is not None:
                    edge[i] += 1
                    edge[i + k] -= 1
                    items.setdefault(int(doc[i]), set()).update(found)
        hit = np.cumsum(edge[:-1]) > 0
        none = hashlib.sha256(b"").hexdigest()
        for d in range(hi - lo):
            a, z = int(first[d]), int(first[d + 1])
            if d not in items:
                out.append((z - a, 0, 0, none, False, []))
                continue
            own = hit[a:z]
            flips = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).reshape(-1, 2)
            spans = [{"start": int(starts[a + i] - offs[d]), "end": int(ends[a + j - 1] - offs[d])} for i, j in flips.tolist()]
            out.append((*_judge(z - a, own, items[d]), spans))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rows_to_batch(head: list[pa.Array], names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), _SPANS]
    return pa.RecordBatch.from_arrays([*head, *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], [*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])


def scan(documents: DataFrame, benchmark: DataFrame, keep: list[str], width: int = WIDTH, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The columns ``keep`` of every row, with its words, verified hits, hit spans (UTF-8 byte offsets) and verdict."""
    spark: SparkSession = documents.sparkSession
    windows = benchmark_windows(benchmark, width)
    few = windows.limit(max_broadcast + 1).collect()
    if len(few) > max_broadcast:
        return _scan_by_shuffle(documents, windows, keep)
    shared = spark.sparkContext.broadcast([tuple(r) for r in few])
    schema = ts.widened(documents.select(*keep), _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = None
        for b in batches:
            grams = grams or _Grams(shared.value)
            yield _rows_to_batch([b.column(i) for i in range(len(keep))], keep, _scan_batch(b.column(len(keep)), grams))

    return documents.select(*keep, F.col("text").cast("string").alias("__text")).transform(ts.in_batches, run, schema)


def _scan_by_shuffle(documents: DataFrame, windows: DataFrame, keep: list[str]) -> DataFrame:
    """The same result for a benchmark too large to broadcast: a join of window hashes names each text's candidate grams."""
    import pandas as pd

    lengths = sorted(r[0] for r in windows.select("k").distinct().collect())  # at most `width` numbers

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            for lo, _hi, _low, _o, _s, _e, doc, wh in _scan(b.column(1)):
                for k in lengths:
                    h = ts.shingle_hash(wh, k, k)
                    ok = np.flatnonzero(doc[: len(h)] == doc[k - 1 : k - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(lo + doc[ok])), pa.array(np.full(len(ok), k, np.int32)), pa.array(h[ok].view(np.int64))], ["tk", "k", "h"])

    keyed = documents.select(*keep, F.col("text").cast("string").alias("__text")).withColumn("__tk", F.sha2(F.coalesce("__text", F.lit("")), 256))
    texts = keyed.groupBy("__tk").agg(F.first("__text").alias("__text"))
    found = texts.select("__tk", "__text").transform(ts.in_batches, emit, "tk string, k int, h long").distinct().join(windows, ["k", "h"]).select(F.col("tk").alias("__tk"), "item", "k", "h", "gram").distinct()

    def judge(_key: tuple, text: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
        rows = _scan_batch(pa.array(text["__text"], pa.string()), _Grams(list(grams[["item", "k", "h", "gram"]].itertuples(index=False, name=None))))
        return pd.DataFrame([(text["__tk"].iloc[0], *r) for r in rows], columns=["__tk", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])

    verdict = texts.groupBy("__tk").cogroup(found.groupBy("__tk")).applyInPandas(judge, "__tk string, " + _RESULT)
    return keyed.drop("__text").join(verdict, "__tk").drop("__tk")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, mode: str = "documents", **options) -> DataFrame:
    """``documents``: drops contaminated rows. ``spans``: cuts the verified hit spans out of contaminated texts instead."""
    if mode == "documents":
        return scan(ts.boxed(documents, "text"), benchmark, ["__row"], **options).where(~F.col("contaminated")).select("__row.*")
    judged = scan(ts.boxed(documents, "text"), benchmark, ["__row", "text"], **options)

    @F.pandas_udf("string")
    def cut(text, spans, bad):
        def one(t, s, c):
            if t is None or not c:
                return t
            raw, out, at = t.encode(), [], 0
            for x in s:
                out.append(raw[at : x["start"]])
                at = x["end"]
            return b"".join([*out, raw[at:]]).decode()

        return text.combine(spans, lambda t, s: (t, s)).combine(bad, lambda p, c: one(p[0], p[1], c))

    return judged.withColumn("text", cut(F.col("text").cast("string"), "hit_spans", "contaminated")).select(*(F.col("text") if c == "text" else F.col(f"__row.`{c}`") for c in documents.columns))
