"""A quality classifier by compression.

Two Zstandard dictionaries are trained, one on texts labelled good, one on texts labelled bad. A text is cut into
blocks, every block is compressed with each dictionary, and the difference of the compressed sizes, divided by the
text's own size, says whose language it speaks: a good text is shortened more by the good dictionary, and noise that
neither knows, or that is nothing but repetition, is shortened alike by both and comes out near 0. A calibration curve,
fitted on labelled texts that went into neither dictionary, turns the difference into the probability of label 1.

What is learned comes from a bounded sample: at most ``TRAIN_ROWS`` texts of each label, the first by a hash of their
ids, none longer than ``TRAIN_BYTES`` (so at most a fixed amount of text, in one task for each label). Scores cover
every block of every text.

Edge cases: null texts count as empty, and an empty one has difference 0; labels that are null or repeated for an id
with different values don't teach; with one label alone, or none, every score is that label's smoothed share (0.5 with
none); texts of any length are scored block by block; repeated rows are scored alike; an empty table gives an empty
result; columns that aren't asked for don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts
from sievelight.session import settled

#: Bounds of the sample that the dictionaries and the curve are fitted on: texts of each label, bytes of a text.
TRAIN_ROWS = 3_000
TRAIN_BYTES = 32_768
DICTIONARY_BYTES = 1 << 16
BLOCK = 4096
LEVEL = 3
#: One labelled text in so many goes to the curve instead of the dictionaries.
CURVE_SHARE = 4
#: Weight of the logistic curve in a score.
ORDERING = 0.02


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts; where they are too few to train one, their own last bytes serve as one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    """Blocks are compressed with the dictionary alone; frames carry no other fields, which would blur the sizes."""
    kind = zstandard.ZstdCompressionDict(raw)
    kind.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=kind, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(size with the bad dictionary - size with the good one) / size, over all blocks."""
    n, gain = len(text), 0
    for at in range(0, n, BLOCK):
        block = text[at : at + BLOCK]
        gain += len(bad.compress(block)) - len(good.compress(block))
    return gain / n if n else 0.0


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> dict:
    """The calibration of differences ``x`` with labels ``y``.

    The isotonic fit (neighbours that fall are pooled) gives the shares, joined by straight lines; a logistic curve, by
    Newton's method with a weak pull towards 0, keeps what lies on a flat piece in order.
    """
    scale = float(np.std(x)) or 1.0
    z, w, pull = np.stack([np.ones_like(x), x / scale], 1), np.zeros(2), np.array([1e-3, 1e-2])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    pools: list[list[float]] = []  # sum of x, positives, size
    for value, good in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        pools.append([value, good, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    shares = np.maximum.accumulate([(good + 0.5) / (n + 1) for _, good, n in pools])
    return {"at": [total / n for total, _, n in pools], "shares": shares.tolist(), "offset": float(w[0]), "slope": float(w[1] / scale)}


def calibrated(x: np.ndarray, curve: dict) -> np.ndarray:
    p = 1 / (1 + np.exp(-np.clip(curve["offset"] + curve["slope"] * x, -700, 700)))
    return (1 - ORDERING) * np.interp(x, curve["at"], curve["shares"]) + ORDERING * p


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", folds: int = 3, held: int = 1) -> dict:
    """The model, from labelled rows whose crc32(id) modulo ``folds`` isn't ``held``. It is two dictionaries and two numbers."""
    said = labels.where(F.col(label).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held))
    said = said.groupBy(id_col).agg(F.min(label).alias("__y"), F.max(label).alias("__z")).where("__y = __z").select(F.col(id_col).alias("__id"), F.col("__y").cast("int"))
    counts = {r[0]: r[1] for r in said.groupBy("__y").count().collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    none = {"good": b"", "bad": b"", "curve": {"at": [0.0], "shares": [share], "offset": 0.0, "slope": 0.0}}
    if len(counts) < 2:
        return none
    text = F.col("text").cast("string")
    short = documents.where(text.isNotNull() & F.octet_length(text).between(1, TRAIN_BYTES)).select(F.col(id_col).alias("__id"), text.alias("__text"))

    def first(rows: DataFrame, *order: str) -> DataFrame:
        """The first TRAIN_ROWS of each label; Spark keeps as many of each task and merges them."""
        return rows.where("__y = 0").orderBy(*order).limit(TRAIN_ROWS).unionByName(rows.where("__y = 1").orderBy(*order).limit(TRAIN_ROWS))

    # Ids are drawn before texts are fetched, so no text is shuffled but the sample's; an id may stand for many rows.
    drawn = settled(first(said.join(short.select("__id").distinct(), "__id").withColumn("__h", F.xxhash64("__id")), "__h", "__id"))
    sample = first(short.join(F.broadcast(drawn), "__id"), "__h", "__id", "__text")  # at most 2 x TRAIN_ROWS ids

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__h", "__id", "__text"], kind="stable")
        teach = rows["__text"][(rows["__h"] % CURVE_SHARE != 0).to_numpy()].drop_duplicates()
        return pd.DataFrame({"__y": [key[0]], "raw": [dictionary([t.encode() for t in teach])]})

    sample = settled(sample)
    raw = {r[0]: bytes(r[1]) for r in sample.groupBy("__y").applyInPandas(learn, "__y int, raw binary").collect()}
    if len(raw) < 2 or not all(raw.values()):
        return none
    model = none | {"good": raw[1], "bad": raw[0]}
    curve = sample.where(F.col("__h") % CURVE_SHARE == 0).select("__y", F.col("__text").alias("text"))
    points = np.array([tuple(r) for r in score(curve, model, ["__y"]).select("__y", "difference").collect()], float).reshape(-1, 2)  # at most 2 x TRAIN_ROWS numbers
    if len(set(points[:, 0])) < 2:
        return none
    return model | {"curve": fit_curve(points[:, 1], points[:, 0])}


def score(documents: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` with difference and score, from the text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES
    schema = ts.widened(documents.select(*keep), "difference double, score double")
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        good, bad = compressor(m["good"]), compressor(m["bad"])
        for b in batches:
            x = np.zeros(b.num_rows)
            for lo, hi, buf, offs in ts.text_slices(b.column(k)):
                raw = memoryview(buf)
                for d in range(hi - lo):
                    x[lo + d] = difference(raw[offs[d] : offs[d + 1]], good, bad)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), pa.array(x), pa.array(calibrated(x, m["curve"]))], [*keep, "difference", "score"])

    return documents.select(*keep, F.col("text").cast("string").alias("__text")).transform(ts.in_batches, run, schema)
