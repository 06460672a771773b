"""Language identification by error-correcting output codes over byte n-gram classifiers.

Every language has a codeword of +1/-1 bits. For each bit a binary classifier tells the languages with +1 from
those with -1: a naive-Bayes log-odds weight per hashed letter trigram. Its margin on a text is the mean weight
of the text's trigrams. Loss-weighted decoding picks the codeword with the least weighted logistic loss; a text
whose two best codewords are nearly equal is flagged ambiguous.

Training needs no sample: every task sums the trigram counts of its texts per language (a matrix of fixed size),
and the matrices are added. What reaches the driver is one matrix of languages x ``BUCKETS``.

Edge cases: null or letterless text is ``und`` with score 0; null languages don't train; without any training
text everything is ``und``; one language alone is always predicted; ties go to the first language by name; very long
texts count whole; repeated rows count and are judged each; an empty table gives an empty result; only the columns
asked for are kept, and none of them is an input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts

BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Margins are multiplied by this before the logistic loss.
SHARPNESS = 4.0
AMBIGUOUS = 0.55
#: Distinct languages that the model may hold (it grows by BUCKETS weights for each).
MAX_LANGUAGES = 512

#: Letters keep their (lower-cased) byte, everything else becomes a space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def codewords(n: int) -> np.ndarray:
    """A matrix of n rows of bits: all splits of the languages where few, else fixed random balanced columns, spread apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        cols = [[1 if i == 0 else (-1 if c >> (i - 1) & 1 else 1) for i in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(cols, np.int8).T
    rng, width, best = np.random.default_rng(7), 10 + 5 * int(np.ceil(np.log2(n))), None
    for _ in range(64):
        m = np.where(rng.random((n, width)) < 0.5, -1, 1).astype(np.int8)
        gap = (width - (m.astype(np.int32) @ m.T - 2 * width * np.eye(n, dtype=np.int32))).min()
        if best is None or gap > best[0]:
            best = (gap, m)
    return best[1]


def _trigrams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte (the last two of a text see spaces)."""
    b = np.full(len(buf) + 2, 0x20, np.uint32)
    b[: len(buf)] = _FOLD[buf]
    second, third = b[1:-1].copy(), b[2:].copy()
    size = np.diff(offs)
    second[offs[1:][size > 0] - 1] = third[offs[1:][size > 0] - 1] = third[offs[1:][size > 1] - 2] = 0x20
    key = b[:-2] << 16 | second << 8 | third
    bucket = (key * np.uint32(0x9E3779B1)) >> np.uint32(17)
    bucket[key == 0x202020] = 0
    return bucket.astype(np.int32)


def train(documents: DataFrame, id_col: str = "doc_id", folds: int = 5) -> dict:
    """The model, from all rows with a language whose crc32(id) modulo ``folds`` isn't 0."""
    rows = documents.where(F.col("lang").isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != 0))
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return {"langs": [], "code": codewords(0), "weights": None}
    number = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            which = [number[x] for x in b.column(0).to_pylist()]
            for lo, hi, buf, offs in ts.text_slices(b.column(1)):
                grams = _trigrams(buf, offs)
                lang = np.repeat(np.array(which[lo:hi], np.int64), np.diff(offs))
                total += np.bincount(lang * BUCKETS + grams, minlength=total.size).reshape(total.shape)
        for i, row in enumerate(total):
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row.tobytes()], pa.binary())], ["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(raw, np.int64)
        for i, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row.tobytes()], pa.binary())], ["lang", "counts"])

    part = rows.select("lang", F.col("text").cast("string")).transform(ts.in_batches, count, "lang int, counts binary")
    part = part.repartition(len(langs) * 8, "lang", F.crc32("counts") % 8).transform(ts.in_batches, add, "lang int, counts binary")
    part = part.repartition(len(langs), "lang").transform(ts.in_batches, add, "lang int, counts binary")
    counts = np.zeros((len(langs), BUCKETS))
    for i, raw in part.collect():  # one row of BUCKETS numbers for each language
        counts[i] += np.frombuffer(raw, np.int64)
    counts[:, 0] = 0
    code = codewords(len(langs))
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)  # each language weighs the same
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        up, down = share[code[:, bit] > 0], share[code[:, bit] < 0]
        if len(up) and len(down):
            weights[:, bit] = np.log(up.mean(0)) - np.log(down.mean(0))
    weights[0] = 0
    return {"langs": langs, "code": code, "weights": weights}


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language number and its score from 0 to 1, by loss over the bits weighted by their certainty."""
    m = margins * SHARPNESS
    weight = np.abs(np.tanh(m / 2)) + 1e-3
    loss = (weight[:, None, :] * np.logaddexp(0, -code[None, :, :] * m[:, None, :])).sum(2) / weight.sum(1, keepdims=True)
    p = np.exp(-code.shape[1] * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return best, p[np.arange(len(p)), best]


def predict(documents: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` with lang_pred, score and ambiguous, from the text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES x 64 bits x BUCKETS floats
    schema = ts.widened(documents.select(*keep), "lang_pred string, score double, ambiguous boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, code, weights = (shared.value[k] for k in ("langs", "code", "weights"))
        for b in batches:
            n, texts = b.num_rows, b.column(len(keep))
            pred, score = ["und"] * n, np.zeros(n)
            for lo, hi, buf, offs in ts.text_slices(texts) if langs else ():
                grams = _trigrams(buf, offs)
                live = grams != 0
                size = np.diff(offs)
                full = np.flatnonzero(size)
                used = np.add.reduceat(live.astype(np.int32), offs[full]) if len(full) else np.zeros(0)
                bits = np.zeros((hi - lo, code.shape[1]))
                for bit in range(code.shape[1]):
                    if len(full):
                        bits[full, bit] = np.add.reduceat(weights[:, bit][grams].astype(np.float64), offs[full]) / np.maximum(1, used)
                best, sure = decode(bits, code)
                letters = np.zeros(hi - lo, bool)
                if len(full):
                    ascii_letter = (buf | 0x20) - np.uint8(0x61) < 26
                    letters[full] = np.add.reduceat(ascii_letter.astype(np.int32), offs[full]) > 0
                for d in range(hi - lo):
                    if not letters[d] and not any(c.isalpha() for c in texts[lo + d].as_py() or ""):
                        continue
                    pred[lo + d], score[lo + d] = langs[best[d]], float(sure[d])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], [*keep, "lang_pred", "score", "ambiguous"])

    return documents.select(*keep, F.col("text").cast("string").alias("__text")).transform(ts.in_batches, run, schema)


def held_out(doc_id, folds: int = 5) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == 0
