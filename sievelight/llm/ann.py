"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Each half of a vector is quantised by its own codebook, so a cell is a pair of centroids. A query walks the cells in
order of the summed inner products of its halves with the two centroids (a heap over the sorted halves, as in the
multi-sequence algorithm) until the cells hold ``probe`` entries. Cells with neighbouring numbers lie on one page of
about ``BLOCK`` entries, and all entries of a page that a query meets are ranked by their exact products.

``probe`` is fitted to the table: the exact neighbours of at most ``FIT_QUERIES`` queries, chosen by a hash, are found
in one pass over all entries, and ``probe`` is what walks must hold for ``RECALL`` of these neighbours to be met. Where
vectors have no structure that is a large share of the table, and time grows as queries times vectors.

The codebooks are fitted on at most ``TRAIN_ROWS`` vectors, chosen by a hash of the id; every vector is indexed. The
number of cells follows the number of vectors up to ``MAX_CENTROIDS`` squared; their sizes (at most that many
integers) are what the driver gathers and broadcasts.

Equal vectors are one entry with their ``top + 1`` smallest ids (more can't reach any result), found with a salted
pre-aggregation, and equal queries are asked once. Large cells are dealt out in blocks; a task holds the entries of
one block, while the queries stream past.

Edge cases: null, zero, non-finite vectors and those of another than the most frequent length take no part; repeated
ids are separate rows, and a query skips every row of its own id; an empty table gives an empty result; with fewer than ``top`` candidates all are returned.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts

TRAIN_ROWS = 20_000
MAX_CENTROIDS = 2048
CELL_ENTRIES = 48
#: Entries that a query ranks at least (fewer only where there are fewer), however few the fit asks for.
PROBE = 4_000
#: Queries whose exact neighbours are found for the fit, and the share of these neighbours that walks must meet.
FIT_QUERIES = 256
RECALL = 0.95
BLOCK = 4_096
_SALTS = 64


def _rows(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors (float64) of the rows that take part."""
    col = col.cast(pa.large_list(pa.float64()))
    size = np.diff(np.asarray(col.offsets))
    ok = np.flatnonzero((size == dim) & np.asarray(col.is_valid()))
    if not len(ok):
        return ok, np.zeros((0, dim))
    flat = col.take(pa.array(ok)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(len(ok), dim) + 0.0
    good = np.isfinite(x).all(1) & x.any(1)
    return ok[good], x[good]


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, vkey, v as float64 bytes) of the rows that take part, and their length."""
    most = vectors.where(F.col(col).isNotNull() & F.col(id_col).isNotNull() & (F.size(col) > 0)).groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most[0] if most else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _rows(b.column(1), dim)
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "vkey", "v"])

    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(col).cast("array<double>"))
    return rows.transform(ts.in_batches, run, "vec_id long, vkey binary, v binary"), dim


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's centroids from a fixed seed; empty ones move to the worst served vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        best, far = nearest(x, c)
        n = np.bincount(best, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, best, x)
        c = np.where(n[:, None] > 0, new / np.maximum(1, n)[:, None], c)
        lost = np.flatnonzero(n == 0)
        if len(lost):
            c[lost] = x[np.argsort(-far)[: len(lost)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, far = np.empty(len(x), np.int64), np.empty(len(x))
    for a in range(0, len(x), 2048):
        d = (c * c).sum(1) - 2 * x[a : a + 2048] @ c.T
        best[a : a + 2048] = d.argmin(1)
        far[a : a + 2048] = d.min(1) + (x[a : a + 2048] ** 2).sum(1)
    return best, far


def walk(left: np.ndarray, right: np.ndarray, size: np.ndarray, probe: int) -> list[int]:
    """Cells (i * K + j) by falling left[i] + right[j], until they hold ``probe`` entries; empty ones aren't named."""
    k = len(right)
    p, q = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    a, b = left[p], right[q]
    heap, cells, held = [(-(a[0] + b[0]), 0, 0)], [], 0
    while heap and held < probe:
        _, i, j = heapq.heappop(heap)
        cell = int(p[i]) * k + int(q[j])
        if size[cell]:
            cells.append(cell)
            held += int(size[cell])
        if j + 1 < k:
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return cells


def _matrix(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(len(col), dim)


def best_hits(scores: np.ndarray, ids: list[list[int]], top: int) -> list[tuple[float, int, int]]:
    """(-score, id, entry) of the ``top`` best ids by falling score, then id; every entry has ids."""
    at = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) > top else np.arange(len(scores))
    return sorted((-float(scores[i]), d, int(i)) for i in at for d in ids[i])[:top]


def fitted_probe(placed: DataFrame, questions: DataFrame, dim: int, top: int, books: tuple[np.ndarray, np.ndarray], size: np.ndarray) -> int:
    """The entries that walks must hold to meet ``RECALL`` of the exact neighbours of the fit's queries; at least ``PROBE``."""
    asked = questions.orderBy(F.xxhash64("vkey"), "vkey").limit(FIT_QUERIES).collect()
    if not asked:
        return PROBE
    q = placed.sparkSession.sparkContext.broadcast(_matrix([bytes(r["v"]) for r in asked], dim))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in range(len(q.value))]
        for b in batches:
            if not b.num_rows:
                continue
            ids, cell, x = b.column(0).to_pylist(), b.column(2).to_numpy(), _matrix(b.column(1).to_pylist(), dim)
            for lo in range(0, len(x), 4096):
                for i, own in enumerate(q.value @ x[lo : lo + 4096].T):
                    best[i] = sorted(best[i] + [(f, d, int(cell[lo + e])) for f, d, e in best_hits(own, ids[lo : lo + 4096], top + 1)])[: top + 1]
        out = [[{"far": f, "id": d, "cell": c} for f, d, c in hits] for hits in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out, pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64()), ("cell", pa.int64())])))], ["q", "hits"])

    found = placed.select("ids", "v", "cell").transform(ts.in_batches, exact, "q int, hits array<struct<far:double,id:long,cell:long>>")
    found = found.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, top + 1).alias("hits")).collect()  # at most FIT_QUERIES rows
    half, need = books[0].shape[1], []
    for i, hits in found:
        v = q.value[i]
        order = np.argsort(-((books[0] @ v[:half])[:, None] + books[1] @ v[half:]).ravel(), kind="stable")
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(size[order]) - size[order]
        need += [int(before[h["cell"]]) + 1 for h in [h for h in hits if h["id"] != asked[i]["own"]][:top]]
    return max(PROBE, sorted(need)[-(-len(need) * int(RECALL * 100) // 100) - 1]) if need else PROBE


def search(vectors: DataFrame, is_query, top: int = 20, probe: int | None = None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each row where ``is_query`` (a condition on vec_id) holds.

    ``probe`` is fitted to the table where it isn't given.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, col)
    half = max(1, dim // 2)
    firsts = Window.partitionBy("vkey", F.pmod("vec_id", F.lit(_SALTS))).orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(firsts)).where(f"n <= {top + 1}")
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("vkey").orderBy("vec_id"))).where(f"n <= {top + 1}")
    entries = few.groupBy("vkey").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")).checkpoint()
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, 1.5 * TRAIN_ROWS / n)
    sample = entries.where(F.pmod(F.xxhash64("vkey"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").limit(TRAIN_ROWS).collect()
    x = _matrix([bytes(r[0]) for r in sample], dim) if sample else _matrix([bytes(r[0]) for r in entries.select("v").limit(1).collect()], dim)
    k = int(min(MAX_CENTROIDS, max(2, round((n / CELL_ENTRIES) ** 0.5)), len(x)))
    books = spark.sparkContext.broadcast((kmeans(x[:, :half], k), kmeans(x[:, half:], k) if dim > half else np.zeros((1, 0))))
    k1, k2 = len(books.value[0]), len(books.value[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1, c2 = books.value
        for b in batches:
            v = _matrix(b.column(2).to_pylist(), dim)
            cell = nearest(v[:, :half], c1)[0] * k2 + nearest(v[:, half:], c2)[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64())], ["vkey", "ids", "v", "cell"])

    placed = entries.select("vkey", "ids", "v").transform(ts.in_batches, assign, "vkey binary, ids array<long>, v binary, cell long").checkpoint()
    size = np.zeros(k1 * k2, np.int64)
    for cell, count in placed.groupBy("cell").count().collect():  # at most MAX_CENTROIDS squared
        size[cell] = count
    page = (np.cumsum(size) - size) // BLOCK
    held = np.bincount(page, weights=size).astype(np.int64)
    layout = spark.sparkContext.broadcast((size, page, np.maximum(1, -(-held // (2 * BLOCK)))))  # the last: blocks of each page

    asked = rows.where(is_query).select("vec_id", "vkey", "v").distinct()
    questions = asked.groupBy("vkey").agg(F.first("v").alias("v"), F.min("vec_id").alias("own"))
    reach = fitted_probe(placed, questions, dim, top, books.value, size) if probe is None else probe
    schema = "page long, eb int, asks boolean, key binary, v binary, ids array<long>"
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    names = ["page", "eb", "asks", "key", "v", "ids"]

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to all blocks of the pages that their walks meet."""
        c1, c2 = books.value
        sizes, pages, blocks = layout.value
        for b in batches:
            keys, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            v = _matrix(raw, dim)
            left, right = v[:, :half] @ c1.T, v[:, half:] @ c2.T
            for lo in range(0, len(keys), 64):
                out = []
                for i in range(lo, min(lo + 64, len(keys))):
                    for p in np.unique(pages[walk(left[i], right[i], sizes, reach)]).tolist():
                        out += [(p, eb, True, keys[i], raw[i], None) for eb in range(int(blocks[p]))]
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries to a block of their page."""
        _, pages, blocks = layout.value
        for b in batches:
            p = pages[b.column(3).to_numpy()]
            eb = np.array([int.from_bytes(x[4:8], "little") for x in b.column(0).to_pylist()], np.int64) % blocks[p]
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(eb.astype(np.int32)), pa.array(np.zeros(len(p), bool)), b.column(0), b.column(2), b.column(1)], names)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks in order, each with its entries before its queries."""
        at, parts, ids, of, x = None, [], [], [], None
        hit = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64()), ("same", pa.bool_())]))
        for b in batches:
            pages, ebs, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((np.diff(pages) != 0) | (np.diff(ebs) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                if at != (pages[lo], ebs[lo]):
                    at, parts, ids, of, x = (pages[lo], ebs[lo]), [], [], [], None
                v = _matrix(b.column(4).slice(lo, hi - lo).to_pylist(), dim)
                if not asks[lo]:
                    parts.append(v)
                    ids += b.column(5).slice(lo, hi - lo).to_pylist()
                    of += b.column(3).slice(lo, hi - lo).to_pylist()
                    continue
                if not parts:
                    continue  # a block that the hash left empty
                x = np.concatenate(parts) if x is None else x
                keys = b.column(3).slice(lo, hi - lo)
                for a in range(0, len(v), 256):
                    some = keys.slice(a, 256)
                    out = [[{"far": f, "id": d, "same": of[i] == q} for f, d, i in best_hits(own, ids, top + 1)] for q, own in zip(some.to_pylist(), v[a : a + 256] @ x.T, strict=True)]
                    yield pa.RecordBatch.from_arrays([some, pa.array(out, hit)], ["qkey", "hits"])

    probes = questions.select("vkey", "v").transform(ts.in_batches, traverse, schema)
    dealt = placed.select("vkey", "ids", "v", "cell").transform(ts.in_batches, deal, schema)
    met = dealt.unionByName(probes).repartition("page", "eb").sortWithinPartitions("page", "eb", "asks")
    ranked = met.transform(ts.in_batches, rank, "qkey binary, hits array<struct<far:double,id:long,same:boolean>>")
    merged = ranked.groupBy("qkey").agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, top + 1).alias("hits"))
    own = asked.select("vec_id", "vkey").distinct().join(merged, F.col("vkey") == F.col("qkey"))
    # One hit is the query's own row: its id on its own vector. Other rows of that id are candidates like any.
    self_at = F.array_position(F.transform("hits", lambda h: h["same"] & (h["id"] == F.col("vec_id"))), True).cast("int")
    others = F.when(self_at > 0, F.concat(F.slice("hits", 1, self_at - 1), F.slice("hits", self_at + 1, top + 1))).otherwise(F.col("hits"))
    best = F.slice(others, 1, top)
    return own.select(F.col("vec_id").alias("query_id"), F.posexplode(best).alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
