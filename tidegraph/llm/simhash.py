"""Near-duplicate groups by SimHash, found through deletion variants.

A fingerprint is cut into segments. With `max_bits` differing bits and more than max_bits / 2
segments, at least one segment differs in at most one bit. So every segment is indexed exactly and
under each of its one-wildcard variants (one bit left out); two fingerprints that differ in at most
one bit of a segment meet under an equal key, and the whole fingerprints are then compared. Pairs
that differ in the bit left out meet once per segment, equal segments meet under the exact key.

Scale: equal fingerprints are one entry, so groups of exact copies cost one entry however large.
The index is one shuffle of 16-byte rows. A key held by very many different fingerprints is cut
into blocks which are compared block by block in different tasks; only a spanning forest of each
comparison is returned, never all pairs.

With fewer segments than max_bits / 2 + 1 nothing is guaranteed any more and the search is
probabilistic: `recall` gives the chance that a pair at a given share of differing bits is met.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import freeze
from .common import map_arrow, texts_of
from .components import connected_components

SEED = 42
SHINGLES_AT_ONCE = 255 * 256
GROUP_IN_MEMORY = 4_096    # rows of one key that the reader of the index holds back; more are cut into blocks
BLOCK = 2_048              # different fingerprints on either side of one comparison
NO_ID = 1 << 62            # stand-ins for fingerprints whose rows have no id start here


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """More bits from a 64-bit hash; lane 0 is the hash itself."""
    if lane == 0:
        return hashes
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * lane) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set. Sums of up to 255 rows fit a byte."""
    n = len(hashes)
    rows = np.zeros((-(-n // 255) * 255, 8), np.uint8)
    rows[:n] = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(-1, 255, 64)
    return bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: str, words: int = 3, lanes: int = 1) -> bytes:
    """SimHash of the word shingles, 64 bits per lane, most significant bit first.

    A-Z are lower-cased, words are runs without ASCII white space, a shingle is `words` of them
    joined by spaces (all of them if there are fewer), repeats count. A bit is set when more than
    half the shingles' XXH64 have it. No words: zero.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return bytes(8 * lanes)
    if len(found) < words:
        shingles = iter([b" ".join(found)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
        total = len(found) - words + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((lanes, 64), np.int64)
    for _ in range(0, total, SHINGLES_AT_ONCE):
        hashes = np.array([digest(s, SEED) for s in islice(shingles, SHINGLES_AT_ONCE)], np.uint64)
        for lane in range(lanes):
            ones[lane] += _ones(_lane(hashes, lane))
    set_bits = (2 * ones > total)[:, ::-1]
    return np.packbits(set_bits.reshape(-1)).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                 lanes: int = 1) -> DataFrame:
    """(id, fp binary) for every row; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, words, lanes) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["id", "fp"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.transform(map_arrow, run, "id bigint, fp binary")


def _segments(fps: np.ndarray, segments: int, width: int) -> np.ndarray:
    """(rows, bytes) -> (rows, segments): the leading bits in segments, as integers."""
    bits = np.unpackbits(fps, axis=1)[:, :segments * width].reshape(len(fps), segments, width)
    weights = (1 << np.arange(bits.shape[2], dtype=np.int64))[::-1]
    return bits.astype(np.int64) @ weights


def _index(segments: int, width: int):
    """Emit the exact key and the one-wildcard keys of every segment. The lowest bit of a key is
    the bit left out, so the two sides of a group lie next to each other when sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(width, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
                value = _segments(fps, segments, width)[:, :, None]
                side = (value >> place) & 1
                code = (np.arange(segments, dtype=np.int64)[:, None] * (width + 1) + place)[None]
                one_out = (code << (width + 1)) | ((value & ~(1 << place)) << 1) | side
                exact = ((np.arange(segments, dtype=np.int64) * (width + 1) + width)[None, :, None] << (width + 1)) | (value << 1)
                keys = np.concatenate([one_out, exact], axis=2).reshape(len(ids), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "id"])
    return run


def _shared(width: int):
    """From rows sorted by key, keep groups in which two fingerprints can meet.

    A group larger than GROUP_IN_MEMORY is passed on unchecked and marked, to be cut into blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, ids, hot):
            return pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(ids), pa.array(np.broadcast_to(hot, len(key)))], ["key", "id", "hot"])

        held_key, held_id, passing = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            ids = np.concatenate([held_id, batch.column(1).to_numpy()])
            group = key >> 1
            if passing is not None:
                n = int(np.searchsorted(group, passing, "right"))
                if n:
                    yield out(key[:n], ids[:n], True)
                key, ids, group = key[n:], ids[n:], group[n:]
                held_key, held_id = key[:0], ids[:0]
                if not len(key):
                    continue
                passing = None
            last = int(np.searchsorted(group, group[-1], "left"))
            if last:
                keep, hot = _meets(key[:last], group[:last], width)
                if keep.any():
                    yield out(key[:last][keep], ids[:last][keep], hot[keep])
            held_key, held_id = key[last:], ids[last:]
            if len(held_key) > GROUP_IN_MEMORY:
                passing = group[-1]
                yield out(held_key, held_id, True)
                held_key, held_id = held_key[:0], held_id[:0]
        if len(held_key):
            keep, hot = _meets(held_key, held_key >> 1, width)
            if keep.any():
                yield out(held_key[keep], held_id[keep], hot[keep])
    return run


def _meets(key: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of groups with two rows (exact keys) or with both sides (one bit left out), and whether
    the group is too large for one comparison."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    ones = np.add.reduceat(key & 1, start)
    exact = (group[start] >> width) % (width + 1) == width
    return np.repeat(np.where(exact, size > 1, (ones > 0) & (ones < size)), size), np.repeat(size > GROUP_IN_MEMORY, size)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left = np.ones(len(near), bool)
    edges = []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            found = np.flatnonzero(near[at] & left)
            left[found] = False
            edges.extend((at, int(f)) for f in found)
            todo.extend(found.tolist())
    return edges


def _compare(width: int, max_bits: int):
    """From rows sorted by (group, block), the links that the full comparison confirms."""
    small = 16

    def links(block_keys, key, ids, fps):
        """All complete blocks at once: small ones by shifted comparison, large ones one by one."""
        start = np.flatnonzero(np.r_[True, (block_keys[1:] != block_keys[:-1]).any(axis=1)])
        size = np.diff(np.r_[start, len(key)])
        nth = np.repeat(np.arange(len(start)), size)
        exact = ((key >> (width + 1)) % (width + 1)) == width
        few = (size <= small)[nth]
        for d in range(1, small):
            if len(key) <= d:
                break
            i = np.flatnonzero((nth[:-d] == nth[d:]) & few[:-d])
            if not len(i):
                break
            i = i[exact[i] | ((key[i] & 1) != (key[i + d] & 1))]
            bits = np.bitwise_count(fps[i] ^ fps[i + d]).sum(axis=1)
            ok = i[bits <= max_bits]
            yield ids[ok], ids[ok + d]
        for s, n in zip(start[size > small], size[size > small]):
            f, side = fps[s:s + n], key[s:s + n] & 1
            near = np.zeros((n, n), bool)
            for at in range(0, n, 128):
                near[at:at + 128] = np.bitwise_count(f[at:at + 128, None] ^ f[None]).sum(axis=2) <= max_bits
            if not exact[s]:
                near &= side[:, None] != side[None]
            np.fill_diagonal(near, False)
            edges = np.array(_forest(near), np.int64).reshape(-1, 2)
            yield ids[s:s + n][edges[:, 0]], ids[s:s + n][edges[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        seen: set[tuple[int, int]] = set()

        def emit(parts):
            for a, b in parts:
                if len(a):
                    pairs = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) - seen
                    if len(seen) < 1_000_000:
                        seen.update(pairs)
                    if pairs:
                        left, right = zip(*pairs)
                        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, bi, bj, ids = (batch.column(i).to_numpy() for i in range(4))
            fps = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(len(key), -1)
            rows = [np.stack([key >> 1, bi, bj], axis=1), key, ids, fps]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            same = (rows[0] == rows[0][-1]).all(axis=1)
            last = len(same) if not same.any() else len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from emit(links(*(r[:last] for r in rows)))
            held = [r[last:] for r in rows]
        if held is not None and len(held[1]):
            yield from emit(links(*held))
    return run


def near_links(fps: DataFrame, segments: int = 2, max_bits: int = 2, width: int | None = None) -> DataFrame:
    """(id, fp) with different ids and fingerprints -> (a, b) links, enough to connect every group.

    The fingerprint is cut into `segments` equal segments of at most 32 bits. With `width` only its
    leading bits are indexed, in segments of that width; all bits are compared.
    """
    first = fps.select(F.max(F.length("fp"))).first()[0]
    if first is None:
        return fps.sparkSession.createDataFrame([], "a bigint, b bigint")
    given, width = width, width or first * 8 // segments
    if width * segments > first * 8 or width > 32 or not given and width * segments != first * 8:
        raise ValueError(f"{first * 8} bits can't be cut into {segments} equal segments of at most 32 bits")
    index = fps.select("id", "fp").transform(map_arrow, _index(segments, width), "key bigint, id bigint")
    sorted_keys = (index.withColumn("g", F.shiftright("key", 1)).repartition("g")
                   .sortWithinPartitions("key", "id").select("key", "id"))
    shared = freeze(sorted_keys.transform(map_arrow, _shared(width), "key bigint, id bigint, hot boolean"), "variants")
    plain = shared.filter("not hot").select("key", "id", F.lit(0).cast("bigint").alias("bi"), F.lit(0).cast("bigint").alias("bj"))
    hot = shared.filter("hot").withColumn("g", F.shiftright("key", 1))
    blocks = hot.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("bigint").alias("n"))
    placed = (hot.join(blocks, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")))
              .withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
              .select("key", "id", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj")))
    # every fingerprint is joined once, with the list of its keys (bounded by segments and blocks)
    listed = plain.union(placed).groupBy("id").agg(F.collect_list(F.struct("key", "bi", "bj")).alias("at"))
    members = (listed.join(fps.select("id", "fp"), "id").select("id", "fp", F.explode("at").alias("p"))
               .select("id", "fp", "p.key", "p.bi", "p.bj").withColumn("g", F.shiftright("key", 1)))
    return (members.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj", "key", "id")
            .select("key", "bi", "bj", "id", "fp")
            .transform(map_arrow, _compare(width, max_bits), "a bigint, b bigint"))


def recall(share: float, width: int, segments: int) -> float:
    """Chance that a pair with this share of differing bits meets in some segment."""
    one = (1 - share) ** width + width * share * (1 - share) ** (width - 1)
    return 1 - (1 - one) ** segments


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    lanes: int = 1, segments: int = 2, max_bits: int = 2, width: int | None = None) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id reachable over links of fingerprints
    that differ in at most `max_bits` bits.

    Null and blank texts share the zero fingerprint and so are linked. Rows that repeat an id stay
    rows of their own. Rows without an id take part; a group of only such rows has a null
    component. An empty table gives an empty result. Other columns aren't read.
    """
    marked = freeze(fingerprints(df, id_col, text_col, words, lanes), "fingerprints")
    # one entry for each fingerprint, named by its smallest id
    entries = freeze(marked.groupBy("fp").agg(F.min("id").alias("least"))
                     .withColumn("node", F.coalesce("least", F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(NO_ID)))), "entries")
    # an id on rows of different texts names several entries: these get names of their own
    named = entries.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = (entries.join(named, "node", "left")
               .withColumn("id", F.when(F.col("n").isNull(), F.col("node"))
                           .otherwise(F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(NO_ID)))))
    roots = connected_components(near_links(entries.select("id", "fp"), segments, max_bits, width))
    grouped = (entries.select("id", "fp", "least")
               .join(roots.withColumnRenamed("node", "id"), "id", "left")
               .withColumn("root", F.coalesce("root", "id")))
    # the smallest real id of a component; its root is one unless ids are missing or repeated
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return (marked.join(grouped.join(smallest, "root").select("fp", "component_id"), "fp")
            .select("id", "fp", "component_id"))
