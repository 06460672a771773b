"""Exact substring removal by a distributed, sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Sorting every suffix of a corpus
would move each of its bytes hundreds of times, so only sampled suffixes are sorted: in every window of ``LENGTH``
bytes the anchor is the place whose ``GRAM`` bytes hash least. Equal windows choose the same place, so each repeated
window is found through the suffixes at its anchors.

1. Every text gives its anchors (about one in 85 bytes), each with the run of windows that it stands for. Anchors
   whose leading ``GRAM`` bytes occur once are done.
2. Anchors with equal runs (by two independent 64-bit hashes) repeat each other wholly, however many there are.
3. One suffix of each other run is dealt by range to buckets: splitters come from the leading bytes of a sample of
   texts. A task goes through its suffixes by leading bytes and sorts what shares them, with its neighbours up to
   ``BUCKET_BYTES``, by multikey quicksort on 8-byte characters; neighbours that share the whole gram form runs of the
   suffix array, in which the windows are compared.
4. Leading bytes that fill several splitters are dealt over all their buckets; suffixes of these, and of leading bytes
   that too many suffixes share to be held, are then compared across the boundaries, by the fingerprints of their windows.

Texts are identified by two 64-bit hashes, so equal rows are handled once each and repeat each other.

Edge cases: null counts as empty; texts shorter than ``LENGTH`` keep all bytes; matches never cross texts;
repeated rows repeat each other; very long texts are handled whole; equal strings are all removed, whichever comes first;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts
from sievelight.session import release, shared_folder

LENGTH = 200
GRAM = 32
#: Texts from whose suffixes the splitters are drawn.
SAMPLE_TEXTS = 2_000
SAMPLE_LEADS = 500_000
#: Bytes of suffixes that are sorted and compared at once, and the most ranges that splitters make; larger ranges are worked off in parts.
BUCKET_BYTES = 3 << 19
MAX_BUCKETS = 20_000

_B2 = np.uint64(0xC2B2AE3D27D4EB4F)
_B2_INV = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text number, first window, anchor, last window, gram hash, run hash) of each run of windows with the same anchor."""
    n, reach = len(buf), length - gram + 1
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    c1 = ts.prefix_sums(buf)
    at = np.arange(n - gram + 1)
    g = ts.range_hash(c1, at, at + gram)
    key = (g & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    m = n - length + 1
    blocks = -(-len(key) // reach)
    padded = np.full(blocks * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, reach)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[:m], ahead[reach - 1 : reach - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offs, np.arange(m), "right") - 1 if len(offs) > 2 else np.zeros(m, np.int64)
    ok = offs[text + 1] >= np.arange(m) + length
    head = ok.copy()
    head[1:] &= (least[1:] != least[:-1]) | ~ok[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(head)
    tail = ok.copy()
    tail[:-1] &= head[1:] | ~ok[1:]
    last = np.flatnonzero(tail)
    a = least[first]
    c2 = ts.prefix_sums(buf, _B2)
    run = ts.mix(ts.range_hash(c2, first, last + length, _B2_INV) + (a - first).astype(np.uint64))
    return text[first], first - offs[text[first]], a - offs[text[first]], last - offs[text[first]], g[a], run


def _leads(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Leading 8 bytes of suffixes, as integers in the order of the bytes (the sign bit flipped, as columns are signed)."""
    x = np.zeros(len(at), np.uint64)
    for j in range(8):
        x = x << np.uint64(8) | buf[at + j].astype(np.uint64)
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of 8-byte characters, and the number of leading characters each shares with the row before it.

    Multikey quicksort, all parts of a round at once: a part is split three ways by the character of its middle row; the
    smaller and greater rows go on at the same character, the equal ones at the next.
    """
    n, width = words.shape
    order, depth = np.arange(n), np.zeros(n, np.int64)
    part = np.zeros(n, np.int64)  # where each place's part begins
    live = np.arange(n) if n > 1 and width else np.zeros(0, np.int64)
    while len(live):
        own, p = words[order[live], depth[live]], part[live]
        head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        size = np.diff(np.append(head, len(live)))
        pivot = np.repeat(own[head + size // 2], size)
        side = (own > pivot).astype(np.int8) - (own < pivot)
        by = np.lexsort((side, p))
        order[live], side = order[live][by], side[by]
        depth[live] = depth[live] + (side == 0)
        head = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (side[1:] != side[:-1])))
        size = np.repeat(np.diff(np.append(head, len(live))), np.diff(np.append(head, len(live))))
        part[live] = np.repeat(live[head], np.diff(np.append(head, len(live))))
        live = live[(size > 1) & (depth[live] < width)]
    same = words[order[1:]] == words[order[:-1]]
    shared = np.zeros(n, np.int64)
    shared[1:] = np.cumprod(same, axis=1).sum(1) if width else 0
    return order, shared


def _windows(buf: np.ndarray, start: np.ndarray, count: np.ndarray, length: int):
    """(record, window, two hashes) of all windows of the records."""
    rec = np.repeat(np.arange(len(start)), count)
    j = np.arange(len(rec)) - np.repeat(np.cumsum(count) - count, count)
    at = start[rec] + j
    return rec, j, ts.range_hash(ts.prefix_sums(buf), at, at + length), ts.range_hash(ts.prefix_sums(buf, _B2), at, at + length, _B2_INV)


def _repeated(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    order = np.lexsort((h2, h1))
    same = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    out = np.zeros(len(h1), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _compare(rows: pd.DataFrame, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Sorts a bucket's suffixes and compares the windows within each run of the suffix array that shares a gram."""
    data = b"".join(rows["bytes"]) + bytes(length + 8)
    buf = np.frombuffer(data, np.uint8)
    size = rows["bytes"].str.len().to_numpy(np.int64)
    start = np.cumsum(size) - size
    slot = rows["slot"].to_numpy(np.int64)
    a = start + (slot >> 8 & 255)
    width = gram // 8
    words = np.stack([_leads(buf, a + 8 * i) for i in range(width)], 1)
    order, shared = multikey_sort(words)
    tied = np.zeros(len(order), bool)
    tied[1:] = shared[1:] == width
    tied[:-1] |= shared[1:] == width
    return buf, start, slot, order[tied]


def _compared(own: pd.DataFrame, spread: bool, length: int, gram: int) -> pa.RecordBatch:
    """Rows (k1, k2, lo, h1, h2) of a bucket: its repeated spans (h1 is their end, h2 null) or, spread, all its windows' fingerprints."""
    buf, start, slot, tied = _compare(own, length, gram)
    part = np.arange(len(own)) if spread else np.sort(tied)
    k1, k2 = own["k1"].to_numpy(), own["k2"].to_numpy()
    rec, j, h1, h2 = _windows(buf, start[part], (slot[part] & 255) + 1, length)
    if spread:
        r, lo, x, y = part[rec], (slot[part[rec]] >> 16) + j, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))
    else:
        ok = _repeated(h1, h2)
        r, j0, j1 = _ranges(rec[ok], j[ok], length)
        r = part[r]
        lo, x, y = (slot[r] >> 16) + j0, pa.array((slot[r] >> 16) + j1), pa.nulls(len(r), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(k1[r]), pa.array(k2[r]), pa.array(lo), x, y], ["k1", "k2", "lo", "h1", "h2"])


def _ranges(rec: np.ndarray, j: np.ndarray, length: int):
    """Maximal runs of windows of the same record: (record, first window, end of the last window's bytes)."""
    if not len(rec):
        return rec, j, j
    head = np.ones(len(rec), bool)
    head[1:] = (rec[1:] != rec[:-1]) | (j[1:] != j[:-1] + 1)
    tail = np.append(head[1:], True)
    return rec[head], j[head], j[tail] + length


_FOUND = "k1 long, k2 long, lo long, hi long"


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, lo, hi): byte spans, possibly overlapping, that repeated windows cover, by the hashes of the text."""
    spark = documents.sparkSession
    shared_folder(spark)
    docs = _keyed(documents)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _hi, buf, offs in ts.text_slices(b.column(2)):
                t, p0, a, p1, h, run = anchors(buf, offs, length, gram)
                slot = p0 << 16 | (a - p0) << 8 | (p1 - p0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[lo + t], k2[lo + t], slot, h.view(np.int64), run.view(np.int64))], ["k1", "k2", "slot", "h", "c"])

    found = docs.transform(ts.in_batches, find, "k1 long, k2 long, slot long, h long, c long")
    often = found.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    again = _meet(found, often).checkpoint()  # a very common passage gives one hash many rows
    release(spark)  # the shuffle of all anchors
    runs = again.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "slot")).alias("one"))
    whole = _meet(again, runs.where("n > 1").select("h", "c")).select("k1", "k2", F.shiftright("slot", 16).alias("lo"), (F.shiftright("slot", 16) + F.col("slot").bitwiseAND(255) + length).alias("hi"))
    varied = again.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("h")
    ones = _meet(runs, varied).select("one.*").checkpoint()
    release(spark)
    buckets = min(MAX_BUCKETS, max(1, -(-ones.count() * (length + 100) // BUCKET_BYTES)))
    splitters = _splitters(docs, buckets, length, gram)
    shared = spark.sparkContext.broadcast(splitters)
    wanted = ones.groupBy("k1", "k2").agg(F.collect_list("slot").alias("slots"))  # at most the anchors of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The suffixes with the bytes of their windows, dealt to buckets by their leading bytes."""
        for b in batches:
            k1, k2, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            out: list[tuple] = []
            held = 0
            for i, slots in enumerate(b.column(3).to_pylist()):
                raw = texts[i].as_py().encode("utf-8", "surrogatepass")
                for s in slots:
                    p0 = s >> 16
                    own = raw[p0 : p0 + (s & 255) + length]
                    out.append((k1[i], k2[i], s, own))
                    held += len(own)
                if held > 4 << 20 or i == b.num_rows - 1:
                    yield _dealt(out, shared.value)
                    out, held = [], 0

    suffixes = docs.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "slots").transform(ts.in_batches, cut, "k1 long, k2 long, slot long, bytes binary, lead long, bucket int, hot boolean")
    suffixes = suffixes.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lead")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's suffixes in order of their leading bytes, about ``BUCKET_BYTES`` at a time; suffixes that share them
        stay together. Windows of those that were dealt over several buckets, or that are too many to be held, go on as
        fingerprints."""
        at, held, size, spread = None, [], 0, False

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).to_pandas().drop_duplicates(["k1", "k2", "slot"])
                for hot, own in rows.groupby("hot"):
                    yield _compared(own.reset_index(drop=True), bool(hot) or spread, length, gram)

        for b in batches:
            lead, bucket = b.column(4).to_numpy(), b.column(5).to_numpy()
            cuts = [0, *(np.flatnonzero((lead[1:] != lead[:-1]) | (bucket[1:] != bucket[:-1])) + 1).tolist(), b.num_rows]
            ends = np.concatenate(([0], np.cumsum(pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False))))
            lo = 0
            for place, next_place in zip(cuts, cuts[1:], strict=False):
                if next_place == place:
                    continue
                here = (lead[place], bucket[place])
                new = here != at
                if new and (spread or size + ends[place] - ends[lo] >= BUCKET_BYTES):
                    held += [b.slice(lo, place - lo)] if place > lo else []
                    yield from settle()
                    held, size, spread, lo = [], 0, False, place
                at = here
            held.append(b.slice(lo, b.num_rows - lo))
            size += int(ends[-1] - ends[lo])
            if size > 4 * BUCKET_BYTES:
                spread = True
                yield from settle()
                held, size = [], 0
        yield from settle()

    compared = suffixes.transform(ts.in_batches, compare, "k1 long, k2 long, lo long, h1 long, h2 long")
    compared = compared.checkpoint()
    release(spark)  # the shuffles of texts and suffixes
    local = compared.where("h2 IS NULL").select("k1", "k2", "lo", F.col("h1").alias("hi"))
    across = compared.where("h2 IS NOT NULL")
    twice = across.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    met = across.join(twice, ["h1", "h2"]).select("k1", "k2", "lo", (F.col("lo") + length).alias("hi"))
    return whole.unionByName(local).unionByName(met)


def _meet(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` whose h, and other columns of ``groups``, are in ``groups``, which was grouped by them.

    h goes through the join inverted, so that Spark can't reuse the grouping's exchange: it then may divide a partition
    that one hash makes too large.
    """
    turned = F.bitwise_not("h")
    return rows.withColumn("h", turned).join(groups.withColumn("h", turned), groups.columns).withColumn("h", turned)


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), text.alias("text"))


def _splitters(docs: DataFrame, buckets: int, length: int, gram: int) -> np.ndarray:
    """buckets - 1 quantiles of the leading bytes of the suffixes of some texts (SAMPLE_TEXTS or four for each bucket), chosen by their hash.

    Only leading bytes (8 for each suffix) leave the tasks, at most SAMPLE_LEADS of them.
    """
    if buckets == 1:
        return np.zeros(0, np.int64)
    n = docs.count()
    part = docs.where(F.pmod("k2", F.lit(1_000_003)) <= int(1_000_003 * min(1.0, max(SAMPLE_TEXTS, 4 * buckets) / max(1, n)))).select("text")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _lo, _hi, buf, offs in ts.text_slices(b.column(0)):
                t, _p0, a, *_ = anchors(buf, offs, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(_leads(buf, offs[t] + a))], ["lead"])

    rows = part.transform(ts.in_batches, lead, "lead long").limit(SAMPLE_LEADS).toPandas()
    leads = np.sort(rows["lead"].to_numpy(np.int64))
    return leads[(np.arange(1, buckets) * len(leads)) // buckets] if len(leads) else np.zeros(0, np.int64)


def _dealt(out: list[tuple], splitters: np.ndarray) -> pa.RecordBatch:
    k1, k2, slot, own = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
    lead = np.array([int.from_bytes(b[(s >> 8 & 255) : (s >> 8 & 255) + 8], "big") for b, s in zip(own, slot, strict=True)], np.uint64)
    lead = (lead ^ np.uint64(1 << 63)).view(np.int64)
    lo, hi = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
    salt = (np.array(k1, np.int64) ^ np.array(slot, np.int64)) & 0x7FFFFFFF
    hot = hi > lo + 1
    bucket = np.where(hot, lo + salt % np.maximum(1, hi - lo + 1), hi).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(slot, pa.int64()), pa.array(own, pa.binary()), pa.array(lead), pa.array(bucket), pa.array(hot)], ["k1", "k2", "slot", "bytes", "lead", "bucket", "hot"])


def dedup(documents: DataFrame, keep: list[str], length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """``keep`` with n_bytes, n_removed, n_spans and kept_sha256, and with ``texts`` also the bytes kept."""
    spans = repeated_spans(documents, length, gram).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, own in zip(b.column(len(keep)), b.column(len(keep) + 1).to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                kept, at, removed, n = [], 0, 0, 0
                end = -1
                for x in own or ():
                    if x["lo"] > end:
                        n += 1
                        kept.append(raw[at : x["lo"]])
                        removed += x["hi"] - x["lo"]
                    elif x["hi"] > end:
                        removed += x["hi"] - end
                    at = end = max(end, x["hi"])
                kept = b"".join([*kept, raw[max(at, 0) :]])
                rows.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    named = [F.col(c).alias(f"__{i}") for i, c in enumerate(keep)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(*named, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), text.alias("text"))
    joined = docs.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), F.col("text").alias("__text"), "spans")
    out = joined.transform(ts.in_batches, run, ts.widened(documents.select(*keep), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    return out if texts else out.drop("kept")
