"""Fill-in-middle transformation by overlapping chunks.

A text's tokens are its runs of A-Z and a-z and every other code point alone. Where a token begins can be told from a
character and the one before it, so the bytes of a batch of texts are cut into chunks that overlap by one byte, and
each chunk counts its token starts and its code points without regard to the others. Prefix sums of those counts say
which chunk of a document holds the start of its k-th token; both cut ranks are routed there, and those chunks alone
are scanned again for the byte. Nothing is shuffled: a document's chunks are counted where its row is read.

The cuts come from a digest of the document's id, so they don't depend on partitions, retries or row order.

Edge cases: null texts count as empty, and empty ones are plain; texts that hold a marker are plain; texts of any
length are cut whole, with temporary memory for ``GROUP`` bytes; a null id is hashed as an empty one; repeated rows give
equal rows; an empty table gives an empty result; other columns, whatever their names, are only kept if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and of the chunks that are looked at in one go.
CHUNK = 4096
GROUP = 1 << 20
#: Of 100 documents, how many are changed; of those, how many have the suffix first.
RATE, SPM_RATE = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def chunk_marks(buf: np.ndarray, first: int, end: int, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a token starts here, a code point starts here) of the bytes first..end; ``opens``: the starts of texts among them.

    Reads one byte before ``first``: that is the overlap of neighbouring chunks.
    """
    own = buf[first:end]
    letter, point = _LETTER[own], (own & 0xC0) != 0x80
    before = np.empty(len(own), bool)
    before[1:], before[0] = letter[:-1], first > 0 and _LETTER[buf[first - 1]]
    before[opens - first] = False
    return point & ~(letter & before), point


class Chunks:
    """The chunks of a slice of texts, with their counts and prefix sums."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        size = np.diff(offs)
        per = -(-size // CHUNK)
        self.first = np.concatenate(([0], np.cumsum(per)))  # the first chunk of each text
        text = np.repeat(np.arange(len(size)), per)
        self.lo = offs[text] + (np.arange(len(text)) - self.first[text]) * CHUNK
        self.hi = np.minimum(self.lo + CHUNK, offs[text + 1])
        n = len(text)
        tokens, points = np.zeros(n, np.int64), np.zeros(n, np.int64)
        step = max(1, GROUP // CHUNK)
        at = 0
        while at < n:
            end = min(n, max(at + step, int(np.searchsorted(self.hi, self.lo[at] + GROUP, "right"))))
            a, z = int(self.lo[at]), int(self.hi[end - 1])
            token, point = chunk_marks(buf, a, z, self._opens(a, z))
            cuts = self.lo[at:end] - a
            tokens[at:end], points[at:end] = np.add.reduceat(token, cuts, dtype=np.int64), np.add.reduceat(point, cuts, dtype=np.int64)
            at = end
        self.tokens, self.points = (np.concatenate(([0], np.cumsum(x))) for x in (tokens, points))

    def _opens(self, a: int, z: int) -> np.ndarray:
        i, j = np.searchsorted(self.offs, (a, z))
        return self.offs[i:j]

    def count(self, texts: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Tokens of each text."""
        return (self.tokens[self.first[1:]] - self.tokens[self.first[:-1]])[texts]

    def start_of(self, text: int, rank: int) -> tuple[int, int]:
        """Byte and code point, from the text's start, where its token number ``rank`` starts; its end for the number of its tokens."""
        lo, hi = int(self.first[text]), int(self.first[text + 1])
        begin = int(self.offs[text])
        if rank == self.tokens[hi] - self.tokens[lo]:
            return int(self.offs[text + 1]) - begin, int(self.points[hi] - self.points[lo])
        want = int(self.tokens[lo]) + rank
        c = int(np.searchsorted(self.tokens, want, "right")) - 1  # the owning chunk
        a = int(self.lo[c])
        token, point = chunk_marks(self.buf, a, int(self.hi[c]), np.array([begin] if begin == a else [], np.int64))
        at = int(np.flatnonzero(token)[want - int(self.tokens[c])])
        return a + at - begin, int(self.points[c] - self.points[lo]) + int(point[:at].sum())


def transform(documents: DataFrame, keep: list[str], id_col: str = "doc_id", seed: str = "1") -> DataFrame:
    """``keep`` with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]
    schema = ts.widened(documents.select(*keep), "n long, form string, prefix_chars long, middle_chars long, output string")
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [b.column(k + i).to_numpy() for i in range(4)]
            for lo, hi, buf, offs in ts.text_slices(b.column(k + 4)):
                chunks = Chunks(buf, offs)
                n = chunks.count()
                ranks = np.sort(np.stack([h[0][lo:hi] % (n + 1), h[1][lo:hi] % (n + 1)]), axis=0)
                form, chars, out = [], ([], []), []
                for d in range(hi - lo):
                    text = buf[offs[d] : offs[d + 1]].tobytes()
                    if not text or h[2][lo + d] % 100 >= RATE or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
                        form.append("plain")
                        chars[0].append(None)
                        chars[1].append(None)
                        out.append(text.decode())
                        continue
                    (x, x_chars), (y, y_chars) = (chunks.start_of(d, int(r)) for r in ranks[:, d])
                    parts = {PREFIX: text[:x], MIDDLE: text[x:y], SUFFIX: text[y:]}
                    form.append("spm" if h[3][lo + d] % 100 < SPM_RATE else "psm")
                    order = (SUFFIX, PREFIX, MIDDLE) if form[-1] == "spm" else (PREFIX, SUFFIX, MIDDLE)
                    chars[0].append(x_chars)
                    chars[1].append(y_chars - x_chars)
                    out.append(b"".join(m.encode() + parts[m] for m in order).decode())
                own = [b.column(i).slice(lo, hi - lo) for i in range(k)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(form, pa.string()), *(pa.array(c, pa.int64()) for c in chars), pa.array(out, pa.string())], [*keep, "n", "form", "prefix_chars", "middle_chars", "output"])

    return documents.select(*keep, *hashes, F.col("text").cast("string").alias("__text")).transform(ts.in_batches, run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Markers can't be part of a changed text, nor arise where a part meets one."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
