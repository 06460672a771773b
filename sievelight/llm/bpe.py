"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes cuts every text into chunks, so that documents sharing a passage share its
chunks; within a task each distinct chunk is encoded once. A cut may fall inside a token, so each chunk join is
repaired: the bytes around the join are encoded again as far as the nearest places where the encodings of both
sides must agree with that of the whole text. Such a place is white space after a non-space: the pre-tokenizer
never joins the two and looks no further back, so the ids on either side don't depend on each other.

The pieces between such places are looked up in a dictionary of the worker process (bounded by ``MAX_PIECES``)
and encoded where missing: by the tokenizers library, or, where its file is a plain byte-level BPE, by tiktoken over
the same vocabulary, which gives the same ids in a third of the time.

Edge cases: null counts as empty (no ids, empty decoded text); the text of a special token in a document becomes
that token's id, as in the library; a text without white space is one piece; very long texts are encoded whole;
repeated rows give equal rows; an empty table gives an empty result; only the columns asked for are kept.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts

#: Mean chunk length is this power of two, in bytes.
CHUNK_BITS = 8
#: Entries of a worker's dictionaries, beyond which they start afresh.
MAX_PIECES = 250_000
MAX_CHUNKS = 30_000

_B2 = np.uint64(0xC2B2AE3D27D4EB4F)
_B2_INV = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))

_WHITE = np.zeros(256, bool)
_WHITE[0x09:0x0E] = _WHITE[0x20] = True


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _byte_chars() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    tok, chars = load(path), _byte_chars()
    added = {i: t.content.encode() for i, t in tok.get_added_tokens_decoder().items()}
    size = tok.get_vocab_size(with_added_tokens=True)
    return [added[i] if i in added else bytes(chars[c] for c in tok.id_to_token(i)) for i in range(size)]


def _ranked(path: str):
    """A faster public encoder over the file's own vocabulary; None unless it's a plain byte-level BPE whose ids follow its merges."""
    import json

    spec = json.loads(load(path).to_str())
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token") and spec["normalizer"] is None and spec["post_processor"] is None
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    vocab, ids = model["vocab"], []
    for m in model["merges"]:
        ids.append(vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)])
    if ids != sorted(set(ids)) or any(vocab[c] >= ids[0] for c in _byte_chars()) or len(vocab) != 256 + len(ids):
        return None
    import public_tokenizers
    import tiktoken

    chars = _byte_chars()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(chars[c] for c in t): i for t, i in vocab.items()}, special_tokens={})


class _Store:
    """Id sequences under 128-bit keys, in one flat array; starts afresh beyond ``limit`` entries."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.check, self.start, self.size = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Entry numbers; -1 where missing."""
        get = self.at.get
        got = np.fromiter((get(h, -1) for h in h1.tolist()), np.int64, len(h1))
        return np.where((got >= 0) & (self.check[got] == h2), got, -1)

    def add(self, h1: np.ndarray, h2: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        n, m = len(self.at), len(h1)
        while n + m > len(self.check):
            self.check, self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.check, self.start, self.size))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.at.update(zip(h1.tolist(), range(n, n + m), strict=True))
        self.check[n : n + m], self.size[n : n + m] = h2, size
        self.start[n : n + m] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return np.arange(n, n + m)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``flat``, one after another."""
    if not len(size):
        return flat[:0]
    shift = start - (np.cumsum(size) - size)
    return flat[np.repeat(shift, size) + np.arange(int(size.sum()))]


def _sums(size: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums of ``size`` over consecutive groups of so many elements."""
    c = np.concatenate(([0], np.cumsum(size)))
    ends = np.cumsum(groups)
    return c[ends] - c[ends - groups]


class Coder:
    """Encodes batches of texts in one Python worker."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.pieces, self.chunks = _Store(MAX_PIECES), _Store(MAX_CHUNKS)
        self.spaced = any(set(t.content) & set(" \t\n\r\x0b\x0c") for t in self.tok.get_added_tokens_decoder().values())
        self.reused = 0
        self.fast = _ranked(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.digits = [str(i).encode() for i in range(size)]

    def _library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, their number for each text) as the library gives them."""
        flat, size = [], []
        if self.fast is not None:
            whole = b"\0".join(texts)
            special = [x for x in self.special if x in whole]  # mostly none, so that pieces aren't searched one by one
            for t in texts:
                if special and any(x in t for x in special):
                    own = self.tok.encode(t.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
                else:
                    own = self.fast.encode_ordinary(t.decode("utf-8", "surrogatepass"))
                flat += own
                size.append(len(own))
            return np.array(flat, np.uint32), np.array(size, np.int64)
        for at in range(0, len(texts), 4096):
            for e in self.tok.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts[at : at + 4096]], add_special_tokens=False):
                flat += e.ids
                size.append(len(e))
        return np.array(flat, np.uint32), np.array(size, np.int64)

    def _encoded(self, store: _Store, raw: bytes, hashes: tuple, starts: np.ndarray, ends: np.ndarray, how) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, sizes) of byte ranges, each distinct one encoded by ``how`` at most once while the store lasts."""
        h1, h2 = (ts.range_hash(c, starts, ends, inv) for c, inv in hashes)
        order = np.argsort(h1)
        head = np.ones(len(h1), bool)
        head[1:] = h1[order[1:]] != h1[order[:-1]]
        first, inverse = order[head], np.empty(len(h1), np.int64)
        inverse[order] = np.cumsum(head) - 1
        if not np.array_equal(h2[first][inverse], h2):  # two ranges share one of the hashes
            return how(starts, ends)
        if len(store.at) + len(first) > store.limit:
            store.clear()
        at = store.find(h1[first], h2[first])
        new = np.flatnonzero(at < 0)
        self.reused += len(h1) - len(new)
        if len(new):
            at[new] = store.add(h1[first][new], h2[first][new], *how(starts[first][new], ends[first][new]))
        at = at[inverse]
        return _gather(store.flat, store.start[at], store.size[at]), store.size[at]

    def encode_batch(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) in row order."""
        for lo, hi, buf, offs in ts.text_slices(texts, 2 * ts.SLICE_BYTES):
            flat, size = self._slice(buf, offs)
            bounds = np.concatenate(([0], np.cumsum(size)))
            for d in range(hi - lo):
                yield lo + d, flat[bounds[d] : bounds[d + 1]]

    def _slice(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        starts = offs[:-1][np.diff(offs) > 0]
        if self.spaced or not len(buf):  # a special token could hold white space
            return self._library([raw[a:z] for a, z in zip(offs[:-1], offs[1:], strict=True)])
        cuts, agree = self._cuts(buf, offs)
        # Chunks meet at cuts; the bytes from the last place of agreement before a cut to the first after it are the
        # join, encoded anew, and what lies between two joins is the settled body of a chunk.
        k = np.searchsorted(agree, cuts)
        text = np.searchsorted(starts, cuts, "right")
        text_start, text_end = starts[text - 1], np.append(starts[1:], len(buf))[text - 1]
        before = np.maximum(text_start, np.where(k > 0, agree[k - 1] if len(agree) else 0, 0))
        after = np.minimum(text_end, np.where(k < len(agree), agree[np.minimum(k, len(agree) - 1)] if len(agree) else len(buf), len(buf)))
        mark = np.zeros(len(buf) + 1, bool)
        mark[starts] = mark[len(buf)] = mark[before] = mark[after] = True
        edges = np.flatnonzero(mark)
        mark[agree] = True
        places = np.flatnonzero(mark)
        hashes = ((ts.prefix_sums(buf), ts._B_INV), (ts.prefix_sums(buf, _B2), _B2_INV))

        def by_pieces(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i, j = np.searchsorted(places, s), np.searchsorted(places, e)
            n = j - i
            at = _gather(np.arange(len(places)), i, n)
            flat, size = self._encoded(self.pieces, raw, hashes, places[at], places[at + 1], by_library)
            return flat, _sums(size, n)

        def by_library(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self._library([raw[a:z] for a, z in zip(s.tolist(), e.tolist(), strict=True)])

        flat, size = self._encoded(self.chunks, raw, hashes, edges[:-1], edges[1:], by_pieces)
        c = np.concatenate(([0], np.cumsum(size)))
        i = np.searchsorted(edges, offs)
        return flat, c[i[1:]] - c[i[:-1]]

    def _cuts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Content-defined cuts (before a character, by a hash of the four bytes before it) and places of agreement."""
        if len(buf) < 5:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w = _WHITE[buf]
        place = w[1:] & ~w[:-1] & (buf[:-1] < 0x80)
        inner = offs[(offs > 0) & (offs < len(buf))]
        place[inner - 1] = False
        agree = np.flatnonzero(place) + 1
        b = buf.astype(np.uint32)
        roll = (b[:-4] | b[1:-3] << 8 | b[2:-2] << 16 | b[3:-1] << 24) * np.uint32(0x9E3779B1)
        cuts = np.flatnonzero((roll >> np.uint32(32 - CHUNK_BITS) == 0) & (buf[4:] & 0xC0 != 0x80)) + 4
        cuts = cuts[cuts - offs[np.searchsorted(offs, cuts, "right") - 1] >= 4]
        return cuts, agree


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One coder for all tasks of a Python worker."""
    return Coder(path)


def ids_digest(ids: np.ndarray, digits: list[bytes]) -> str:
    return hashlib.sha256(b",".join(map(digits.__getitem__, ids.tolist()))).hexdigest()


@lru_cache(maxsize=2)
def _decoder(path: str) -> list[bytes] | None:
    """Bytes by id, where the library's decoder is the byte-level one."""
    import json

    decoder = json.loads(load(path).to_str())["decoder"] or {}
    return token_bytes(path) if decoder.get("type") == "ByteLevel" else None


def decode_ids(ids: np.ndarray, path: str) -> str:
    """As the library's decode with special tokens kept."""
    table = _decoder(path)
    if table is None:
        return load(path).decode(ids.tolist(), skip_special_tokens=False)
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(documents: DataFrame, path: str | None = None, keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """``keep`` with ids (array<int>) of each text and, if asked for, the text decoded from them."""
    path, keep = path or default_path(), documents.columns if keep is None else keep
    schema = ts.widened(documents.select(*keep), "ids array<int>" + ", decoded string" * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [ids for _, ids in coder(path).encode_batch(b.column(len(keep)))]
            cols, names = [pa.array(rows, pa.list_(pa.int32()))], ["ids"]
            if decode:
                cols.append(pa.array([decode_ids(ids, path) for ids in rows], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], [*keep, *names])

    return documents.select(*keep, F.col("text").cast("string").alias("__text")).transform(ts.in_batches, run, schema)


def digests(documents: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` with the number of ids and the digests of ids and decoded text; the ids never leave the task."""
    path = path or default_path()
    schema = ts.widened(documents.select(*keep), "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, said, back = [], [], []
            for _, ids in coder(path).encode_batch(b.column(len(keep))):
                n.append(len(ids))
                said.append(ids_digest(ids, coder(path).digits))
                back.append(hashlib.sha256(decode_ids(ids, path).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(*keep, F.col("text").cast("string").alias("__text")).transform(ts.in_batches, run, schema)
