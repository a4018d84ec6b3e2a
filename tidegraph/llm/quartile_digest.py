"""Document fingerprints: quartile bucket digests, compared with a bounded difference score.

Every window of four bytes gives three byte triplets, each hashed into one of BUCKETS counters. The
digest says of every counter in which quartile of all counters it lies (two bits each), and before
that the length on a logarithmic scale and the ratios of the quartiles. An edit moves the counters
of the triplets it touches only, so digests of similar texts differ in few codes. The difference of
two digests is a weighted sum over codes and header, cut at BOUND, about where unrelated random
texts lie; likeness is 1 - difference / BOUND.

Scale: a digest needs its own text only, in pieces of bounded size. Comparing each document with the
next one in the order of ids is one range shuffle of the texts: a task streams its sorted rows and
holds two at a time; the pairs across partition borders, one a partition, are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import freeze
from .common import map_arrow, sliced

BUCKETS = 256
PIECE = 1 << 20          # bytes of a text that are counted at a time
LENGTH_BASE = 1.1        # one step of the length code is a tenth more bytes
CODE_WEIGHTS = (0, 1, 2, 6)
LENGTH_WEIGHT, RATIO_WEIGHT, HEADER_BOUND = 2, 4, 48
BOUND = 416

# Which three bytes of a window of four, and the odd multipliers that hash them.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many hashed byte triplets fall into each bucket; texts of less than four bytes have
    the zero byte behind them."""
    if not data:
        return np.zeros(BUCKETS, np.int64)
    data = data.ljust(4, b"\0")
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data) - 3, PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE + 3, len(data) - at), at).astype(np.uint32)
        n = len(b) - 3
        for salt, places in enumerate(TRIPLETS):
            h = np.full(n, salt + 1, np.uint32)
            for place, m in zip(places, MULTIPLIERS):
                h ^= b[place:place + n]
                h *= np.uint32(m)
                h ^= h >> np.uint32(15)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(text: str | None) -> str:
    """The fingerprint as 132 hex digits: length, quartile ratios, two bits per bucket.

    Null counts as empty. Equal texts have equal fingerprints.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, int(np.log1p(len(data)) / np.log(LENGTH_BASE)))
    ratios = 16 * min(15, 15 * q1 // max(q3, 1)) + min(15, 15 * q2 // max(q3, 1))
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1])
    return bytes([length, ratios, *packed.tolist()]).hex()


@cache
def _byte_differences() -> np.ndarray:
    """Of two bytes of four codes each: the weights of the codes' differences, summed."""
    codes = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3
    return np.array(CODE_WEIGHTS, np.int32)[np.abs(codes[:, None] - codes[None])].sum(2)


def difference(a: str, b: str) -> int:
    """From 0, for equal digests, to BOUND."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    head = LENGTH_WEIGHT * abs(int(x[0]) - int(y[0])) \
        + RATIO_WEIGHT * (abs(int(x[1] >> 4) - int(y[1] >> 4)) + abs(int(x[1] & 15) - int(y[1] & 15)))
    return min(BOUND, min(HEADER_BOUND, head) + int(_byte_differences()[x[2:], y[2:]].sum()))


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / BOUND


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; rows may repeat, null texts count as empty, an empty table
    gives an empty one. Other columns aren't read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest, batch.column(1).to_pylist()), pa.string())],
                                             ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(map_arrow, run, f"id {kind}, fingerprint string")


def edited(text: str, other: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the other's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def _compared(doc_id, text: str, mark: str, other: str, other_mark: str) -> tuple:
    new = edited(text, other)
    new_mark = mark if new == text else digest(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, mark, new_mark, likeness(mark, new_mark), likeness(mark, other_mark)


_COMPARED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                       ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_PLACED = pa.schema([*_COMPARED, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
COMPARED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")
AT_ONCE = 200            # result rows of a record batch


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, text) of one partition: each compared with the next one, and the first
    and the last row themselves."""
    part, held, out = TaskContext.get().partitionId(), None, []
    for batch in sliced(batches, AT_ONCE):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            mark = digest(text)
            if held is None:
                yield _batch([(doc_id, *[None] * 6, part, "first", text)], _PLACED)
            else:
                out.append((*_compared(*held, text, mark), part, None, None))
            held = doc_id, text, mark
        if out:
            yield _batch(out, _PLACED)
            out = []
    if held is not None:
        yield _batch([(held[0], *[None] * 6, part, "last", held[1])], _PLACED)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, next text)."""
    for batch in batches:
        for doc_id, text, other in zip(*(c.to_pylist() for c in batch.columns)):
            yield _batch([_compared(doc_id, text, digest(text), other, digest(other))], _COMPARED)


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text (see `edited`), and its likeness to the
    edited text's and to the next document's fingerprint.

    The next document is that of the next id in ascending order, the first one after the last; a
    single document is its own next one. Null ids come first, rows of one id are ordered by the hash
    of their texts. Null texts count as empty, an empty table gives an empty one. Other columns
    aren't read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    placed = freeze(ordered.transform(map_arrow, _neighbours, f"{COMPARED}, part int, edge string, text string"), "neighbours")
    names = _COMPARED.names
    inner = placed.filter("edge IS NULL").select(*names)
    parts = sorted(r.part for r in placed.filter("edge = 'first'").select("part").collect())
    if not parts:
        return inner
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    last = placed.filter("edge = 'last'").select("part", "doc_id", "text").join(following, "part")
    first = placed.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("other"))
    border = last.join(first, "next_part").select("doc_id", "text", "other").transform(map_arrow, _across, COMPARED)
    return inner.union(border)
