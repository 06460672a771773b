"""Digests of ordered sequences.

A digest of a sequence is itself sequential. Rows are sorted by range and become text side by side, where their ranges
are; one task then reads these pieces in order and only hashes their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.session import settled

_PIECE = pa.schema([("place", pa.int32()), ("piece", pa.int64()), ("rows", pa.int64()), ("n", pa.list_(pa.int64())), ("text", pa.list_(pa.binary()))])


def pieces(ordered: DataFrame, texts: Callable[[pa.RecordBatch], list[list[str]]]) -> DataFrame:
    """(place, piece, rows, n, text) of a table in order: what each digest reads of a batch, and of how many rows.

    ``texts`` gives a list of texts for every digest; each is joined by commas. The pieces are settled: the one task that
    hashes them then has nothing to sort or to format.
    """

    def run(batches):
        piece = 0
        for b in batches:
            if b.num_rows:
                said = texts(b.select(b.schema.names[:-1]))
                yield pa.RecordBatch.from_pydict({"place": [b.column(b.num_columns - 1)[0].as_py()], "piece": [piece], "rows": [b.num_rows], "n": [[len(x) for x in said]], "text": [[",".join(x).encode() for x in said]]}, _PIECE)
                piece += 1

    return settled(ordered.withColumn("__place", F.spark_partition_id()).mapInArrow(run, "place int, piece long, rows long, n array<long>, text array<binary>"))


def hashed(found: DataFrame, starts: list[bytes], finish: Callable, schema: str) -> DataFrame:
    """What ``finish(states, counts, rows)`` makes of the hash states, begun with ``starts``, after all pieces in order.

    Pieces out of their order raise. A table without rows gives no row.
    """

    def run(batches):
        states, counts, rows, last = [hashlib.sha256(x) for x in starts], [0] * len(starts), 0, (-1, -1)
        for b in batches:
            for r in b.to_pylist():
                if (r["place"], r["piece"]) <= last:
                    raise ValueError("pieces of a sequence came out of order")
                last = (r["place"], r["piece"])
                for i, (n, text) in enumerate(zip(r["n"], r["text"], strict=True)):
                    if n:
                        states[i].update(b"," + text if counts[i] else text)
                        counts[i] += n
                rows += r["rows"]
        if rows:
            yield finish(states, counts, rows)

    return found.coalesce(1).mapInArrow(run, schema)
