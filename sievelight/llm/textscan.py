"""Vectorised scanning of Arrow text columns, shared by the operators of this subpackage.

Texts are handled as UTF-8 bytes of an Arrow buffer, in slices of bounded size; a text is never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text scanned at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 8 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes after lower-casing: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Everything but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[0x09:0x0E] = SOLID[0x20] = False


def widened(df, more: str) -> StructType:
    """The schema of ``df`` followed by the columns of a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def boxed(df, *own: str):
    """All columns of ``df`` as the one column ``__row``, beside the columns ``own``; helper columns can't clash with them."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), *own)


def tidied(fn):
    """``fn`` over Arrow batches; a reused worker then gives the memory that its task has freed back to the system."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def in_batches(df, fn, schema: str):
    """``df`` through ``fn`` in Arrow batches of at most ``BATCH_BYTES`` (or one longer text), however long the texts."""
    conf = df.sparkSession.conf
    if int(str(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("bB") or 0) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidied(fn), schema)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(base, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(12, int(n - 1).bit_length())
    return _powers(int(base), size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them); nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if n == 0:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def find_words(buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of word bytes; runs end with their text."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = word_bytes[buf]
    st, en = m.copy(), m.copy()
    st[1:] &= ~m[:-1]
    en[:-1] &= ~m[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    st[offsets[full]] = m[offsets[full]]
    last = offsets[full + 1] - 1
    en[last] = m[last]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_sums(buf: np.ndarray, base=_B) -> np.ndarray:
    """Polynomial prefix sums, for hashes of any range of the bytes in constant time."""
    c = np.empty(len(buf) + 1, np.uint64)
    c[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(base, max(1, len(buf)))[: len(buf)], out=c[1:])
    return c


def range_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse=_B_INV) -> np.ndarray:
    """Mixed 64-bit hashes of byte ranges; equal bytes get equal hashes wherever they lie."""
    return mix((c[ends] - c[starts]) * powers(inverse, len(c))[starts] + (ends - starts).astype(np.uint64))


def shingle_hash(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of each k consecutive word hashes (the caller drops those that cross a text's end)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, seed, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(acc)
