"""Nearest neighbours by largest inner product: a block matrix join in int8.

Vectors are packed into blocks, with an int8 code, its scale and the size of what the code leaves
out. Every query block meets every candidate block once, as an equi join on the candidate block's
number. In such a tile one product of codes bounds all inner products from both sides: by the
Cauchy-Schwarz inequality they differ from the decoded product by at most
|query| * |rest of candidate| + |rest of query| * |decoded candidate|. Pairs whose upper bound lies
below the k-th best lower bound can't be among the k nearest; the others are computed from the
original vectors in double precision, and the k best are merged with heaps. Nothing is lost: the
result is that of brute force.

Scale: work is queries x candidates by contract, in tiles of bounded size whatever the table's; each
tile ships one block of either side. A task keeps k entries a query and hands them on when there are
too many. Copies of one vector cost recomputations within a tile, no more rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

CANDIDATES = 8_192  # in a block, about
QUERIES = 1_024
MOST_HELD = 1_000_000
SLACK = 1e-9  # for rounding in the bounds themselves

_BLOCK = "block bigint, dim int, ids binary, vectors binary, codes binary, scales binary, rests binary"


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of what the codes leave out."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(vectors - codes * scale[:, None], axis=1)
    return codes, scale, rest


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, vector), sorted by block -> one row per block."""
    def pack(block: int, ids: list, vectors: list) -> pa.RecordBatch:
        dim = max(map(len, vectors))
        x = np.zeros((len(ids), dim))
        for row, v in zip(x, vectors):
            row[:len(v)] = v
        codes, scale, rest = quantised(x)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([dim], pa.int32()),
             *(pa.array([a.tobytes()], pa.binary()) for a in (np.array(ids, np.int64), x, codes, scale, rest))],
            ["block", "dim", "ids", "vectors", "codes", "scales", "rests"])

    current, ids, vectors = None, [], []
    for batch in batches:
        for block, i, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if block != current and ids:
                yield pack(current, ids, vectors)
                ids, vectors = [], []
            current = block
            ids.append(i)
            vectors.append(v)
    if ids:
        yield pack(current, ids, vectors)


def _blocks(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // size))
    placed = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), "id", "vector")
    return placed.repartition("block").sortWithinPartitions("block", "id").transform(map_arrow, _packed, _BLOCK), n


class _Side:
    def __init__(self, row: dict, prefix: str, dim: int):
        self.ids = np.frombuffer(row[prefix + "ids"], np.int64)
        n, own = len(self.ids), row[prefix + "dim"]
        widen = lambda a: np.pad(a, ((0, 0), (0, dim - own))) if own < dim else a
        self.vectors = widen(np.frombuffer(row[prefix + "vectors"]).reshape(n, own))
        self.codes = widen(np.frombuffer(row[prefix + "codes"], np.int8).reshape(n, own))
        self.scale = np.frombuffer(row[prefix + "scales"])
        self.rest = np.frombuffer(row[prefix + "rests"])


def tile(queries: _Side, candidates: _Side, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k best of the candidates as (-score, id), best first."""
    # sums of products of codes are integers; up to 2^24 float32 holds them exactly
    exact = np.float32 if queries.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    c_codes, c_norm = candidates.codes.astype(exact), np.linalg.norm(candidates.codes * candidates.scale[:, None], axis=1)
    for at in range(0, len(queries.ids), 128):
        part = slice(at, at + 128)
        product = (queries.codes[part].astype(exact) @ c_codes.T).astype(np.float64)
        product *= queries.scale[part, None] * candidates.scale[None]
        q_norm = np.linalg.norm(queries.vectors[part], axis=1)
        off = q_norm[:, None] * candidates.rest[None] + queries.rest[part, None] * c_norm[None]
        off += SLACK * (q_norm[:, None] * (c_norm + candidates.rest)[None])
        own = queries.ids[part, None] == candidates.ids[None]
        low = np.where(own, -np.inf, product - off)
        high = np.where(own, -np.inf, product + off)
        if low.shape[1] > k:
            least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        else:
            least = np.full(len(low), -np.inf)
        for q in range(len(low)):
            left = np.flatnonzero((high[q] >= least[q]) & ~own[q])
            # products of two float32 are exact in double, and each row is summed on its own
            score = (queries.vectors[at + q][None] * candidates.vectors[left]).sum(axis=1)
            best = np.lexsort((candidates.ids[left], -score))[:k]
            yield int(queries.ids[at + q]), [(-float(score[b]), int(candidates.ids[left[b]])) for b in best]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[float, int]]] = {}

        def out():
            rows = [(q, i, -s) for q, best in held.items() for s, i in best]
            held.clear()
            for at in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at:at + 100_000])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                dim = max(row["q_dim"], row["dim"])
                for query, best in tile(_Side(row, "q_", dim), _Side(row, "", dim), k):
                    held[query] = list(islice(heapq.merge(held[query], best), k)) if query in held else best
                if len(held) * k > MOST_HELD:
                    yield from out()
        yield from out()
    return run


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            candidates_per_block: int = CANDIDATES, queries_per_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows, ties to the smaller id.

    `is_query` is a condition on the id column. Rows without an id, and vectors that are null, empty,
    zero or hold null or non-finite components take no part. Of rows that repeat an id the smallest
    vector counts. A shorter vector counts as padded with zeros. Other columns aren't read.
    """
    x = F.col("vector")
    usable = (F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0))
    vectors = (df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), is_query.alias("asks"),
                                                           F.col(vector_col).cast("array<double>").alias("vector"))
               .filter(usable).groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")))
    blocks, n = _blocks(vectors.select("id", "vector"), candidates_per_block)
    asking, _ = _blocks(vectors.filter("asks").select("id", "vector"), queries_per_block)
    asking = (asking.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
              .select("tile", *(F.col(c).alias(f"q_{c}") for c in ("dim", "ids", "vectors", "codes", "scales", "rests"))))
    tiles = asking.join(blocks, asking["tile"] == blocks["block"]).drop("tile", "block")
    found = tiles.transform(map_arrow, _search(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
