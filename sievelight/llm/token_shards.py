"""Token-ID output: raw id payloads in ordered shards, with a minimal perfect hash index for keyed access.

File format (Parquet containers, so that any store Spark writes to will do), in one folder:

``shards/`` rows (shard, block, first_id, n_docs, n_ids, keys, sizes, ids): the documents in ascending doc_id order
(nulls first, equal ids by text digest), cut into blocks of about ``BLOCK_BYTES``. ``ids`` is the raw payload,
little-endian unsigned integers of ``width`` bytes (2 where the vocabulary fits, else 4), each document ended by the
end id; ``keys`` and ``sizes`` are the documents' keys (8-byte) and id counts (4-byte), kept for rebuilding.

``index/`` rows (bucket, seeds, table, extra): documents are dealt to buckets by the hash of their key; in a bucket a
hash-and-displace minimal perfect hash sends each key to its own slot. ``table`` is an array of slots of (fingerprint,
shard, block, offset, count). A lookup reads one seed and one slot; the stored fingerprint rejects foreign keys. Keys
with equal hashes, which only repeated ids can have, are listed in ``extra`` instead.

A key is (doc_id, occurrence), the occurrence telling repeated ids apart.

Edge cases: null text is one end id; a null doc_id has the least key; rows of equal id and text are interchangeable; a
very long text is a block of its own; an empty table writes an empty folder; other columns aren't written. A shard is
streamed, so repeated ids, which share one, take time but no memory.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm import bpe
from sievelight.llm import textscan as ts
from sievelight.llm.textscan import mix
from sievelight.session import shared_folder

BLOCK_BYTES = 1 << 20
#: Bytes of text in a shard, on average, and the most shards (a shard is worked off block by block, however large).
SHARD_BYTES = 32 << 20
MAX_SHARDS = 10_000
#: Documents in an index bucket, on average.
BUCKET_DOCS = 4096
SLOT = np.dtype([("mark", "<u4"), ("shard", "<i4"), ("block", "<i4"), ("offset", "<i4"), ("count", "<i4")])
EXTRA = np.dtype([("key", "<i8"), ("occurrence", "<i4"), ("slot", SLOT)])
_NULL = -(1 << 63)


def key_hash(doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + occurrence.astype(np.uint64))


def _place(h: np.ndarray, seed, n: int) -> np.ndarray:
    return (mix(h ^ (np.asarray(seed, np.uint64) * np.uint64(0xD1B54A32D192ED03))) % np.uint64(n)).astype(np.int64)


def build_mph(h: np.ndarray) -> np.ndarray:
    """Displacement seeds (one for about four keys) of a minimal perfect hash of distinct key hashes."""
    n = len(h)
    groups = max(1, -(-n // 4))
    g = (h >> np.uint64(32)) % np.uint64(groups)
    order = np.argsort(g, kind="stable")
    starts = np.searchsorted(g[order], np.arange(groups + 1, dtype=np.uint64))
    seeds, free = np.zeros(groups, np.uint32), np.ones(n, bool)
    for i in np.argsort(-(starts[1:] - starts[:-1]), kind="stable").tolist():
        own = h[order[starts[i] : starts[i + 1]]]
        if not len(own):
            break
        seed = 1
        while True:
            tries = np.arange(seed, seed + 64, dtype=np.uint64)
            at = _place(own[None, :], tries[:, None], n)
            ok = free[at].all(1)
            for t in np.flatnonzero(ok).tolist():
                if len(own) == 1 or len(set(at[t].tolist())) == len(own):
                    seeds[i], free[at[t]] = seed + t, False
                    break
            else:
                seed += 64
                continue
            break
    return seeds


def slot_of(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    g = ((h >> np.uint64(32)) % np.uint64(len(seeds))).astype(np.int64)
    return _place(h, seeds[g], n)


def write(documents: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2, shards: int | None = None) -> str:
    """Encodes and writes ``documents`` (doc_id, text); returns the folder."""
    spark, path = documents.sparkSession, path or bpe.default_path()
    folder = folder or f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    size = bpe.load(path).get_vocab_size(with_added_tokens=True)
    width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = shards or min(MAX_SHARDS, 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    where = np.unique(np.array(cuts or [], np.int64))  # at most one number for each shard

    @F.arrow_udf("int")  # in pandas, ids beside nulls would be floats and lose their low bits
    def shard_of(x: pa.Array) -> pa.Array:
        return pa.array(np.where(x.is_null(), 0, np.searchsorted(where, x.fill_null(0).to_numpy(), "left")), pa.int32())

    # A repeated doc_id falls into one shard; shards hold equal shares of the distinct ids.
    ordered = docs.withColumn("shard", shard_of("doc_id")).repartitionById(len(where) + 1, F.col("shard"))
    ordered = ordered.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "first_id", "n_docs", "n_ids", "keys", "occurrence", "sizes", "width", "ids"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        held: list[tuple[int, int, np.ndarray]] = []
        state = {"shard": None, "block": 0, "bytes": 0, "last": None, "seen": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys = np.array([k for k, _, _ in held], "<i8")
                row = (state["shard"], state["block"], int(keys[0]), len(held), sum(len(x) + 1 for _, _, x in held), keys.tobytes(), np.array([o for _, o, _ in held], "<i4").tobytes(), np.array([len(x) + 1 for _, _, x in held], "<u4").tobytes(), width, np.concatenate([y for _, _, x in held for y in (x, end)]).astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)
                held.clear()
                state.update(block=state["block"] + 1, bytes=0)

        end = np.array([end_id], np.uint32)
        for b in batches:
            shard_no, ids_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, ids in bpe.coder(path).encode_batch(b.column(2)):
                if shard_no[i] != state["shard"]:
                    yield from flush()
                    state.update(shard=shard_no[i], block=0, last=None)
                key = _NULL if ids_[i] is None else ids_[i]
                state["seen"] = state["seen"] + 1 if key == state["last"] else 0
                state["last"] = key
                held.append((key, state["seen"], ids))
                state["bytes"] += (len(ids) + 1) * width
                if state["bytes"] >= BLOCK_BYTES:
                    yield from flush()
        yield from flush()

    packed = ordered.select("shard", "doc_id", "text").transform(ts.in_batches, pack, "shard int, block int, first_id long, n_docs long, n_ids long, keys binary, occurrence binary, sizes binary, width int, ids binary")
    packed.write.option("compression", "none").mode("overwrite").parquet(f"{folder}/shards")
    _write_index(spark.read.parquet(f"{folder}/shards"), folder)
    return folder


def _write_index(shards: DataFrame, folder: str) -> None:
    n = shards.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_DOCS))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, block, keys, occ, sizes in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                size = np.frombuffer(sizes, "<u4").astype(np.int64)
                h = key_hash(np.frombuffer(keys, "<i8"), np.frombuffer(occ, "<i4"))
                slot = np.zeros(len(h), SLOT)
                slot["mark"], slot["shard"], slot["block"], slot["offset"], slot["count"] = h & np.uint64(0xFFFFFFFF), shard, block, np.cumsum(size) - size, size
                raw = slot.tobytes()
                at = (mix(h) % np.uint64(buckets)).astype(np.int64)
                slots = pa.array([raw[i : i + SLOT.itemsize] for i in range(0, len(raw), SLOT.itemsize)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(h.view(np.int64)), pa.array(np.frombuffer(keys, "<i8")), pa.array(np.frombuffer(occ, "<i4")), slots], ["bucket", "h", "key", "occurrence", "slot"])

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seeds, table, extra = index_bucket(rows["h"].to_numpy(np.int64).view(np.uint64), rows["key"].to_numpy(np.int64), rows["occurrence"].to_numpy(np.int32), np.frombuffer(b"".join(rows["slot"]), SLOT))
        return pd.DataFrame({"bucket": [key[0]], "seeds": [seeds.tobytes()], "table": [table.tobytes()], "extra": [extra.tobytes()]})

    flat = shards.select("shard", "block", "keys", "occurrence", "sizes").transform(ts.in_batches, entries, "bucket long, h long, key long, occurrence int, slot binary")
    flat.groupBy("bucket").applyInPandas(build, "bucket long, seeds binary, table binary, extra binary").write.mode("overwrite").parquet(f"{folder}/index")


def index_bucket(h: np.ndarray, key: np.ndarray, occurrence: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds, table and the entries whose hash another key shares, which no seed could tell apart and which are listed by key."""
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    alone = times[inverse] == 1
    extra = np.zeros(int((~alone).sum()), EXTRA)
    extra["key"], extra["occurrence"], extra["slot"] = key[~alone], occurrence[~alone], slot[~alone]
    h, slot = h[alone], slot[alone]
    seeds, table = build_mph(h).astype("<u4"), np.zeros(len(h), SLOT)
    if len(h):
        table[slot_of(h, seeds, len(h))] = slot
    return seeds, table, extra


def find_slots(h: np.ndarray, key: np.ndarray, occurrence: np.ndarray, seeds: np.ndarray, table: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each key, and whether the bucket holds it."""
    got, ok = np.zeros(len(h), SLOT), np.zeros(len(h), bool)
    if len(table):
        got = table[slot_of(h, seeds, len(table))]
        ok = got["mark"] == (h & np.uint64(0xFFFFFFFF))
    for x in extra:
        same = (key == x["key"]) & (occurrence == x["occurrence"])
        got[same], ok[same] = x["slot"], True
    return got, ok


def _id_of(key: str):
    """Nulls travel as the least number, since pandas would make floats of the other ids."""
    return F.when(F.col(key) != _NULL, F.col(key)).alias("doc_id")


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, occurrence, shard, block, offset, count) of each key found; foreign keys are rejected by their fingerprint."""
    spark = keys.sparkSession
    index = spark.read.parquet(f"{folder}/index")
    n = spark.read.parquet(f"{folder}/shards").agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_DOCS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).fill_null(_NULL)
            h = key_hash(key.to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([key, b.column(1), pa.array(h.view(np.int64)), pa.array((mix(h) % np.uint64(buckets)).astype(np.int64))], ["key", "occurrence", "h", "bucket"])

    def find(_key: tuple, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame(columns=["key", "occurrence", "shard", "block", "offset", "count"])
        bucket = (np.frombuffer(own[c].iloc[0], t) for c, t in (("seeds", "<u4"), ("table", SLOT), ("extra", EXTRA)))
        got, ok = find_slots(asked["h"].to_numpy(np.int64).view(np.uint64), asked["key"].to_numpy(np.int64), asked["occurrence"].to_numpy(np.int32), *bucket)
        return pd.DataFrame({"key": asked["key"], "occurrence": asked["occurrence"]} | {c: got[c] for c in ("shard", "block", "offset", "count")})[ok]

    asked = keys.select(F.col("doc_id").cast("long"), F.col("occurrence").cast("int")).transform(ts.in_batches, place, "key long, occurrence int, h long, bucket long")
    found = asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, "key long, occurrence int, shard int, block int, offset int, count int")
    return found.select(_id_of("key"), "occurrence", "shard", "block", "offset", "count")


def document_stats(folder: str, spark) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, through the index and the payloads."""
    shards = spark.read.parquet(f"{folder}/shards")
    sums = shards.select("shard", "block", "first_id", "n_ids")
    per_shard = sums.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one number for each shard
    before, total = {}, 0
    for shard, n in per_shard:
        before[shard], total = total, total + n
    base = spark.createDataFrame(list(before.items()) or [(0, 0)], "shard int, base long")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, occ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = np.frombuffer(keys, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(k, mask=k == _NULL), pa.array(np.frombuffer(occ, "<i4"))], ["doc_id", "occurrence"])

    found = lookup(shards.select("keys", "occurrence").transform(ts.in_batches, keys_of, "doc_id long, occurrence int"), folder)
    found = found.withColumn("key", F.coalesce("doc_id", F.lit(_NULL)))

    def read(_key: tuple, slots: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, ids in zip(block["width"], block["ids"], strict=True):
            flat = np.frombuffer(ids, f"<u{width}")
            for d, o, c in zip(slots["key"], slots["offset"], slots["count"], strict=True):
                out.append((d, block["start"].iloc[0] + o, c, zlib.crc32(flat[o : o + c].astype("<u4").tobytes())))
        return pd.DataFrame(out, columns=["key", "start", "n_tokens", "ids_crc32"])

    starts = sums.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids"))
    starts = starts.join(F.broadcast(base), "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("start"))
    payload = shards.select("shard", "block", "width", "ids").join(starts, ["shard", "block"])
    rows = found.drop("doc_id").groupBy("shard", "block").cogroup(payload.groupBy("shard", "block")).applyInPandas(read, "key long, start long, n_tokens long, ids_crc32 long")
    return rows.select(_id_of("key"), "start", "n_tokens", "ids_crc32")
