"""Secret scans by a recursive decoding worklist.

Every text is scanned for the base kinds; then its layers (the text with its URL and backslash-u escapes replaced, the
bytes behind base64, what gzip and zlib data decompress to) are unwrapped, each layer is scanned again and its own
layers join the worklist, until nothing new appears. A layer that equals one around it is a cycle and isn't followed;
equal layers elsewhere are unwrapped once, and their spans are mapped to every place where they occur.
Every finding maps back to the outermost characters that carry it.

Escapes nested up to ``ESCAPE_LEVELS`` deep are unwrapped a level at a time. Deeper ones are replaced at once, in time
proportional to their length: no two escapes overlap, so every order of replacement ends in the same layer. Base64 is
read at all four alignments of a run, as what stands before it may look like base64 too, and whatever bytes it gives
are scanned; runs of 16 characters and more that follow one another in lines are also read as one. Compressed data is
looked for anywhere in a layer, members and all.

Edge cases: null counts as empty; undecodable regions are left alone; the same span found through several layers is
reported once; very long texts are scanned whole; a decompressed layer longer than ``MAX_LAYER`` bytes is scanned in
pieces that overlap by ``_OVERLAP`` (compressed data inside such a layer is read as far as its piece goes); repeated
rows give equal rows; an empty table gives an empty result; other columns, whatever their names, are kept by ``redact``.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts

KINDS = ("assign", "access", "hex")
# Fixed values of the base kinds.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")

ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})")
BASE64_RUN = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, as mail and key files have it.
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t]*+)+[A-Za-z0-9+/_-]++={0,2}")
COMPRESSED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
ESCAPE_LEVELS = 8
MAX_LAYER = 16 << 20
_OVERLAP = 1 << 16
_URL_SAFE = bytes.maketrans(b"-_", b"+/")
_BASE64 = np.zeros(256, bool)
_BASE64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")] = True
_HEX_DIGITS = frozenset(b"0123456789abcdefABCDEF")


def base_matches(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in bytes, by start then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if m.end() - m.start(1) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(raw)]
    return sorted(found)


def _said_by(m: re.Match) -> bytes:
    return bytes([int(m[1], 16)]) if m[1] else chr(int(m[2], 16)).encode("utf-8", "replace")


def unescaped(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """One level of escapes replaced, with the start and end in ``raw`` of each byte."""
    found = [(m.start(), m.end(), len(_said_by(m))) for m in ESCAPE.finditer(raw)]
    starts, ends, size = np.array(found, np.int64).reshape(-1, 3).T
    inside = np.zeros(len(raw) + 1, np.int64)
    inside[starts] += 1
    inside[ends] -= 1
    weight = (np.cumsum(inside[:-1]) == 0).astype(np.int64)
    weight[starts] = size
    end = np.arange(1, len(raw) + 1)
    end[starts] = ends
    lo = np.repeat(np.arange(len(raw)), weight)
    return ESCAPE.sub(_said_by, raw), lo, end[lo]


def normal_form(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All levels of escapes replaced, in one pass with a stack: a new byte may end an escape that began before it."""
    out, lo, hi = bytearray(), [], []

    def put(x: int, a: int, z: int) -> None:
        while True:
            out.append(x)
            lo.append(a)
            hi.append(z)
            if x not in _HEX_DIGITS:
                return
            if out[-3:-2] == b"%" and out[-2] in _HEX_DIGITS:
                n, said = 3, bytes([int(out[-2:], 16)])
            elif out[-6:-4] == b"\\u" and _HEX_DIGITS.issuperset(out[-4:]):
                n, said = 6, chr(int(out[-4:], 16)).encode("utf-8", "replace")
            else:
                return
            a = lo[-n]
            del out[-n:], lo[-n:], hi[-n:]
            for y in said[:-1]:
                out.append(y)
                lo.append(a)
                hi.append(z)
            x = said[-1]

    at = 0
    for m in re.finditer(rb"[%\\]", raw):  # plain bytes before the first escape can't change
        at = m.start()
        break
    out += raw[:at]
    lo += range(at)
    hi += range(1, at + 1)
    for i in range(at, len(raw)):
        put(raw[i], i, i + 1)
    return bytes(out), np.array(lo, np.int64), np.array(hi, np.int64)


def _layers(raw: bytes) -> Iterator[tuple[bytes, callable]]:
    """The layers directly below one; each with a function from its byte range to this layer's."""
    if ESCAPE.search(raw):
        one, lo, hi = unescaped(raw)
        deep, levels = one, 1
        while levels <= ESCAPE_LEVELS and ESCAPE.search(deep):
            deep, levels = ESCAPE.sub(_said_by, deep), levels + 1
        if levels > ESCAPE_LEVELS:
            one, lo, hi = normal_form(raw)
        yield one, lambda s, e: (int(lo[s]), int(hi[e - 1]))
    for m in BASE64_RUN.finditer(raw):
        body = m[0].rstrip(b"=").translate(_URL_SAFE)
        if body.isalpha() and (body.islower() or body[1:].islower()):
            continue  # a plain word
        for skip in range(4):
            own = body[skip:]
            own = own[: len(own) - (len(own) % 4 == 1)]
            start, end = m.start() + skip, m.end()
            yield base64.b64decode(own + b"=" * (-len(own) % 4)), lambda s, e, a=start, z=end: (a + s // 3 * 4, min(z, a + -(-e // 3) * 4))
    for m in WRAPPED.finditer(raw):
        own = np.frombuffer(m[0], np.uint8)
        where = np.flatnonzero(_BASE64[own])
        body = own[where].tobytes().translate(_URL_SAFE)
        where += m.start()
        for skip in range(4):
            part = body[skip:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            yield base64.b64decode(part + b"=" * (-len(part) % 4)), lambda s, e, w=where[skip : skip + len(part)]: (int(w[s // 3 * 4]), int(w[min(len(w), -(-e // 3) * 4) - 1]) + 1)
    at = 0
    while m := COMPRESSED.search(raw, at):
        at = m.start() + 1
        for piece, end in _inflate(raw, m.start()):
            at = max(at, end)
            yield piece, lambda s, e, w=(m.start(), end): w


def _inflate(raw: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """What the members from ``at`` on decompress to, in pieces of bounded size that overlap, each with the end of what was read for it."""
    data, held, fresh = memoryview(raw)[at:], b"", False
    with contextlib.suppress(zlib.error):
        while COMPRESSED.match(data):
            z = zlib.decompressobj(47)
            while not z.eof:
                piece = z.decompress(data, MAX_LAYER)
                data = z.unused_data if z.eof else z.unconsumed_tail
                held, fresh = held + piece, fresh or bool(piece)
                if len(held) >= MAX_LAYER:
                    yield held, len(raw) - len(data)
                    held, fresh = held[-_OVERLAP:], False
                if not piece:
                    break
            if not z.eof:
                break
    if fresh:
        yield held, len(raw) - len(data)


def all_spans(raw: bytes, base: list[tuple[int, int, int]] | None = None) -> set[tuple[int, int, int]]:
    """The base matches, with the source spans of those found in any decoded layer."""
    # A frame of the walk: digest, spans so far, regions still to come, place in the layer around it, depth of the
    # outermost layer around it that one of its cycles returns to.
    digest = hashlib.blake2b(raw, digest_size=16).digest()
    stack = [[digest, set(base_matches(raw) if base is None else base), _layers(raw), None, 0]]
    around, done = {digest: 0}, {}
    while True:
        frame = stack[-1]
        for inner, place in frame[2]:
            if not inner:
                continue
            digest = hashlib.blake2b(inner, digest_size=16).digest()
            if digest in around:
                frame[4] = min(frame[4], around[digest])
                spans = base_matches(inner)
            elif digest in done:
                spans = done[digest]
            else:
                around[digest] = len(stack)
                stack.append([digest, set(base_matches(inner)), _layers(inner), place, len(stack)])
                break
            frame[1].update((*place(s, e), k) for s, e, k in spans)
        else:
            digest, found, _, place, back = stack.pop()
            del around[digest]
            if not stack:
                return found
            if back == len(stack):
                done[digest] = found
            stack[-1][4] = min(stack[-1][4], back)
            stack[-1][1].update((*place(s, e), k) for s, e, k in found)


_MAYBE = re.compile(rb"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|[A-Za-z0-9+/_-]{16}")


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, in code points, each by start, kind, end."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    base = base_matches(raw)
    spans = sorted(all_spans(raw, base), key=lambda x: (x[0], x[2], x[1])) if _MAYBE.search(raw) else base
    if spans and not raw.isascii():
        at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        point = lambda i: int(at[i - 1]) if i else 0
        base, spans = ([(point(s) , point(e), k) for s, e, k in x] for x in (base, spans))
    return base, spans


def scan(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with counts per base kind, the base digest, all spans as text and as an array of code point spans."""
    schema = ts.widened(documents.select(*keep), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<start:int,end:int,kind:string>>")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))]
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for b in batches:
            rows = []
            for text in b.column(len(keep)):
                base, spans = scan_text(text.as_py())
                if not spans:
                    rows.append((0, 0, 0, none, "", []))
                    continue
                n = [sum(k == i for _, _, k in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), [{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], [*keep, *names])

    return documents.select(*keep, F.col("text").cast("string").alias("__text")).transform(ts.in_batches, run, schema)


def mask(text: str | None, spans: list[tuple[int, int, int]], filler: str = "[SECRET]") -> str | None:
    """The text with every span (merged where they overlap) replaced."""
    if not text or not spans:
        return text
    merged: list[list[int]] = []
    for s, e, _ in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, at = [], 0
    for s, e in merged:
        out += [text[at:s], filler]
        at = e
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """The same rows and columns, with the secrets in ``text`` replaced by a marker."""

    @F.pandas_udf("string")
    def masked(text):
        return text.map(lambda t: mask(t, scan_text(t)[1]))

    return documents.withColumn("text", masked(F.col("text").cast("string")))
