"""Near-duplicate groups by SimHash, confirmed and completed by the Jaccard similarity of word-shingle sets.

SimHash comes first: every distinct set's text has a 64-bit fingerprint, fingerprints that differ in at
most `bits` bits and share a half up to one bit are linked (simhash.near_links), and a link stands if
the whole sets are similar enough. Close copies are linked so. At a share of 80 hundredths some 15 % of
the bits differ, and many such pairs have no half in common; an exact search of what is still apart
follows, and nothing is missed.

Two sets of which `similar` hundredths are shared have at least that share of the larger one in
common. So with the shingles in any one order, they share one among the first n - ceil(share * n) + 1
of either: every pair that is looked for meets under such a key, none is left to chance. An order
decides how many pairs meet, never which are found; each pair is confirmed on the whole sets.

First most sets are ruled out. Of every PART-th shingle by hash it is counted, over all sets, whether
another set has it. An order that puts those of one set first leaves nothing to meet under for a set
with enough of them, however many passages or lines it shares with others. The rest goes through two
orders, one after the other:

1. By hash, shingles that are frequent in a sample last. Of each key held by several sets, the set
   with most such keys, which is the most typical of its copies, is compared with the others that
   SimHash has not linked to it, under two keys of each set.
2. Sets that still share a key with a set of another component are looked at again, as components:
   first by the counted part, then, if that leaves them, in an order of all their shingles: those
   that only one component has come first, then the rarer ones. A set of which less than `similar`
   hundredths occur in other components can't be similar to anything left, and goes without any
   comparison. What is left is compared, across components only, in blocks: first the likeliest pairs
   that would connect the sets of a block, fewer than it has sets, then all that these left apart.

Scale: equal sets are one entry. No pass holds a key's sets in memory but the last, a block at a
time. All that is written on the way is deleted when the result is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import freeze, new_path, scratch, write_to
from .common import map_arrow, sliced, texts_of
from .components import connected_components
from .simhash import fingerprints, near_links

SEED = 42
BLOCK = 1_024          # sets on either side of one comparison
SKETCH = 4_096         # classes of hashes, a multiple of 64
BITS = 16              # of 64 that may differ in a SimHash link
PART = 3               # one shingle in so many is counted over all sets
SAMPLE = 16            # one set in so many is counted for the order
OFTEN = 8              # a shingle in so many sampled sets is frequent
MOST_FREQUENT = 100_000

INDEX = "key bigint, node bigint, n int, at int"


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct XXH64 hashes of the word shingles in ascending order.

    A-Z are lower-cased, words are runs without ASCII white space, a shingle is `words` of them
    joined by spaces (all of them if there are fewer). No words: none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(found) < words:
        return np.array([digest(join(found), SEED)], np.uint64)
    shingles = map(join, zip(*(found[i:] for i in range(words))))
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(found) - words + 1))


def _digests(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1_000):
            sets = [shingle_set(t, words) for t in texts_of(batch, "text")]
            digests = [xxhash.xxh3_128_digest(found.tobytes()) for found in sets]
            n, counted = ([len(found) for found in sets], [len(_counted(found)) for found in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(map(_sketch, sets), pa.binary()),
                                              pa.array(n, pa.int32()), pa.array(counted, pa.int32())], ["row", "digest", "sketch", "n", "counted"])
    return run


def _counted(found: np.ndarray) -> np.ndarray:
    return found[found % np.uint64(PART) == 0]


def _hashes(words: int, part=np.asarray):
    """(row, text) -> one row (key, node) for each shingle of each set, or of that part of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            sets = [part(shingle_set(t, words)) for t in texts_of(batch, "text")]
            sizes = [len(found) for found in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], ["key", "node"])
    return run


def _index(words: int, similar: int, frequent: np.ndarray):
    """(row, text, single) -> the first n - ceil(share * n) + 1 shingles of every set, without the
    `single` counted ones that come before all others: key, node, the set's size, position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            parts = []
            for node, text, single in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), batch.column(2).to_pylist()):
                found = shingle_set(text, words)
                n = len(found)
                if not n:
                    continue
                is_counted = found % np.uint64(PART) == 0
                often = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found \
                    if len(frequent) else np.zeros(n, bool)
                # counted ones that others have too come last
                ordered = np.concatenate([found[~often & ~is_counted], found[often & ~is_counted], found[is_counted]])
                first = ordered[:n + (-similar * n) // 100 + 1 - single]
                parts.append((first.view(np.int64), np.full(len(first), node), np.full(len(first), n, np.int32),
                              np.arange(single, single + len(first), dtype=np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["key", "node", "n", "at"])
    return run


def _can_be_similar(n, at, m, to, similar: int):
    """Whether sets of n and m shingles with a shared one at these positions can be similar enough."""
    most = np.minimum(at, to) + 1 + np.minimum(n - at, m - to) - 1
    return most * (100 + similar) >= similar * (n + m)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by their first `keys` columns, cut only between groups."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        end = [c[-1] for c in rows[:keys]]
        same = np.logical_and.reduce([c == e for c, e in zip(rows[:keys], end)])
        start = int(np.argmax(same))
        if start or last is not None and end != last:
            whole = [np.concatenate(c) for c in zip(*held, [c[:start] for c in rows])]
            if len(whole[0]):
                yield whole
            held = []
        held.append([c[start:] for c in rows])
        last = end
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


class _Pairs:
    """Passes on pairs, those it remembers only once."""

    def __init__(self):
        self.seen: set[tuple[int, int]] = set()

    def new(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        pairs = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) - self.seen
        if len(self.seen) < 100_000:
            self.seen |= pairs
        return list(pairs)


def _of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, those that share it with another row."""
    last, repeats = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        key = batch.column(0).to_numpy()
        same = key[1:] == key[:-1]
        before = np.r_[repeats, same]
        keep = before | np.r_[same, False]
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        last, repeats = batch.slice(batch.num_rows - 1), bool(before[-1])
    if repeats:
        yield last


def _with_most_typical(similar: int):
    """Rows (key, node, n, at, chosen), those of a key in the order of typicality -> pairs (a, b) of the
    key's first node and each node that has chosen this key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = columns if first is None else [np.r_[f, c] for f, c in zip(first, columns)]
            key, node, n, at, chosen = rows
            begin = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
            ok = chosen & (begin < np.arange(len(key))) & _can_be_similar(n[begin], at[begin], n, at, similar)
            if first is not None:
                ok[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(node[begin][ok]), pa.array(node[ok])], ["a", "b"])
            first = [c[begin[-1]:begin[-1] + 1] for c in rows]
    return run


def _most_shared(n: int, m: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """The most shingles that a set of n can share with sets of m by their sketches' classes."""
    return np.minimum(n - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), m - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))


def _likeliest(node, n, at, root, classes, similar: int) -> tuple[list[int], list[int]]:
    """Of the possible pairs of different components, a spanning forest of the most similar by sketch."""
    size = len(node)
    left, best, near = np.ones(size, bool), np.full(size, -1.0), np.full(size, -1)
    a, b = [], []
    for _ in range(size):
        k = int(np.argmax(np.where(left, best, -2.0)))
        if near[k] >= 0:
            a.append(node[near[k]])
            b.append(node[k])
        left[k] = False
        j = np.flatnonzero(left)
        linked = j[root[j] == root[k]]
        best[linked], near[linked] = 2.0, -1
        j = j[(root[j] != root[k]) & _can_be_similar(n[k], at[k], n[j], at[j], similar)]
        most = _most_shared(n[k], n[j], classes[k], classes[j])
        share = most / np.maximum(n[k] + n[j] - most, 1)
        closer = (100 * most >= similar * (n[k] + n[j] - most)) & (share > best[j])
        best[j[closer]], near[j[closer]] = share[closer], k
    return a, b


def _left_apart(similar: int, likeliest: bool):
    """From rows sorted by (key, block, block): the pairs of different components that positions and
    sketches leave possible, or of these a forest that is at most as large as the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()
        for key, bi, bj, node, n, at, root, made in _groups(batches, 3):
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            for s, e in zip(start, np.r_[start[1:], len(key)]):
                classes = np.stack([np.frombuffer(m, np.uint64, offset=8) for m in made[s:e]])
                found = []
                if likeliest:
                    found = pairs.new(*(np.array(c, np.int64) for c in _likeliest(node[s:e], n[s:e], at[s:e], root[s:e], classes, similar)))
                for k in range(s, e) if not likeliest else ():
                    # either way round once
                    j = k + 1 + np.flatnonzero((root[k] != root[k + 1:e]) & _can_be_similar(n[k], at[k], n[k + 1:e], at[k + 1:e], similar))
                    most = _most_shared(n[k], n[j], classes[k - s], classes[j - s])
                    j = j[100 * most >= similar * (n[k] + n[j] - most)]
                    found += pairs.new(np.full(len(j), node[k]), node[j])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b"])
    return run


def _similar_sets(a: bytes, b: bytes, similar: int) -> bool:
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= similar * (len(a) + len(b) - shared)


def _sketch(found: np.ndarray) -> bytes:
    """The set's size, and which of SKETCH classes of hashes it has."""
    has = np.zeros(SKETCH, bool)
    has[found % np.uint64(SKETCH)] = True
    return len(found).to_bytes(8, "little") + np.packbits(has).tobytes()


def _similar_sketches(a: bytes, b: bytes, similar: int) -> bool:
    """False only if the sets can't be similar: a class that one of them lacks has at least one
    shingle of the other that isn't shared."""
    n, m = int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
    a, b = np.frombuffer(a, np.uint64, offset=8), np.frombuffer(b, np.uint64, offset=8)
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return 100 * most >= similar * (n + m - most)


def _passing(pairs: DataFrame, made: DataFrame, test, similar: int) -> DataFrame:
    """The pairs (a, b) of nodes for which test(made of a, made of b) holds; made: node, made."""
    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([test(x, y, similar) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    sides = [made.select(F.col("node").alias(c), F.col("made").alias(f"made_{c}")) for c in "ba"]
    both = pairs.join(sides[0], "b").join(sides[1], "a").select("a", "b", "made_a", "made_b")
    return freeze(both.transform(map_arrow, tested, "a bigint, b bigint"), "passing")


def _links(possible: DataFrame, texts: DataFrame, words: int, similar: int) -> DataFrame:
    """Of the written pairs (a, b), those that are similar enough by their whole sets. Most others have
    fallen by their sketches before, so that few whole sets are made and moved."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            sets = [shingle_set(t, words).tobytes() for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "made"])

    spark = texts.sparkSession
    needed = possible.select(F.col("a").alias("row")).union(possible.select("b")).distinct()
    sets = texts.join(needed, "row", "left_semi").select("row", "text").transform(map_arrow, whole, "node bigint, made binary")
    path = new_path(spark, "links")
    with scratch(spark):
        return write_to(_passing(possible, freeze(sets, "whole-sets"), _similar_sets, similar), path)


def _alike(texts: DataFrame, words: int, bits: int) -> DataFrame:
    """(a, b), written: rows of (row, text) that SimHash links, enough to connect every group of fingerprints."""
    spark = texts.sparkSession
    path = new_path(spark, "alike")
    with scratch(spark):
        marked = freeze(fingerprints(texts, "row", "text", words), "fingerprints")
        entries = freeze(marked.groupBy("fp").agg(F.min("id").alias("id")), "entries")
        equal = marked.join(entries.withColumnRenamed("id", "b"), "fp").filter("id <> b").select(F.col("id").alias("a"), "b")
        return write_to(near_links(entries.select("id", "fp"), max_bits=bits).union(equal).distinct(), path)


def _of_two_components(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are of different components."""
    for side in ("a", "b"):
        pairs = _rooted(pairs.withColumnRenamed(side, "node"), roots).withColumnsRenamed({"node": side, "root": f"root_{side}"})
    return pairs.filter("root_a <> root_b").select("a", "b")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with a node, and the root of its component."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(rows: DataFrame) -> DataFrame:
    """(key, size) of keys whose nodes are of several components. rows: key, root."""
    return (rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
            .filter("low < high").select("key", "size"))


def _still_possible(sets: DataFrame, shared: DataFrame, similar: int) -> DataFrame:
    """Of sets (node, n, counted), those with too few counted shingles of their own to be ruled out,
    with their number `single`. shared: (key, node) for each counted shingle that others have too."""
    have = shared.groupBy("node").agg(F.count(F.lit(1)).alias("others"))
    single = F.col("counted") - F.coalesce("others", F.lit(0))
    return (sets.join(have, "node", "left").withColumn("single", single.cast("int"))
            .filter(F.col("single") < F.col("n") - F.ceil(similar * F.col("n") / 100) + 1).drop("others"))


def _second_keys(shingles: DataFrame, similar: int) -> DataFrame:
    """Of written rows (key, node, n, root) for all shingles of some sets, the ones under which sets
    of different components must meet: key, node, n, at, root, size."""
    several = shingles.join(_apart(shingles), "key")
    several = freeze(several, "keys-of-several")
    # all other shingles of a set come before these in the order
    held = several.groupBy("node").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("of")).filter(100 * F.col("held") >= similar * F.col("of"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("size", "key"))
    placed = several.join(held.select("node", "held"), "node").withColumn("nth", nth)
    needed = F.col("held") - F.ceil(similar * F.col("n") / 100) + 1
    at = F.col("n") - F.col("held") + F.col("nth") - 1
    return placed.filter(F.col("nth") <= needed).select("key", "node", "n", at.cast("int").alias("at"), "root")


def _blocked(keyed: DataFrame, sketches: DataFrame, similar: int, likeliest: bool) -> DataFrame:
    """The possible pairs of different components that share a key, or the likeliest of each block.
    keyed: key, node, n, at, root, written."""
    blocks = _apart(keyed).select("key", F.ceil(F.col("size") / BLOCK).cast("bigint").alias("blocks"))
    placed = (keyed.join(blocks, "key").join(sketches, "node").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
              .withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
              .select("key", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "node", "n", "at", "root", "made"))
    return (placed.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "node")
            .transform(map_arrow, _left_apart(similar, likeliest), "a bigint, b bigint"))


def similar_rows(texts: DataFrame, words: int, similar: int, bits: int = BITS) -> DataFrame:
    """(row bigint, text) with different rows, written -> (row, root): the smallest row that is
    reachable over pairs of which `similar` hundredths or more of all shingles are shared. `bits`
    decides how many of them SimHash links, never which are found.

    Null and blank texts have no shingles; they are equal to each other. Other columns aren't read.
    """
    spark = texts.sparkSession
    path = new_path(spark, "near-duplicates")
    with scratch(spark):
        return write_to(_similar_rows(texts.select("row", "text"), words, similar, bits), path)


def _similar_rows(texts: DataFrame, words: int, similar: int, bits: int) -> DataFrame:
    digests = freeze(texts.transform(map_arrow, _digests(words), "row bigint, digest binary, sketch binary, n int, counted int"), "digests")
    equal = freeze(digests.groupBy("digest").agg(F.min("row").alias("node")), "equal-sets")
    sets = freeze(digests.join(equal.select(F.col("node").alias("row")), "row", "left_semi")
                  .select(F.col("row").alias("node"), F.col("sketch").alias("made"), "n", "counted"), "sets")
    sketches = sets.select("node", "made")
    once = texts.join(sets.select(F.col("node").alias("row")), "row", "left_semi").select("row", "text")

    alike = _passing(_alike(once, words, bits), sketches, _similar_sketches, similar)
    near = _links(alike, texts, words, similar)
    close = connected_components(near)

    hashed = once.transform(map_arrow, _hashes(words, _counted), "key bigint, node bigint")
    counted = freeze(hashed.repartition("key").sortWithinPartitions("key").transform(map_arrow, _of_several, "key bigint, node bigint"), "counted")
    possible = freeze(_still_possible(sets.select("node", "n", "counted"), counted, similar), "possible")

    sample = once.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    times = sample.transform(map_arrow, _hashes(words), "key bigint, node bigint").groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    often = times.filter(F.col("c") >= OFTEN).orderBy(F.desc("c"), "key").limit(MOST_FREQUENT).collect()
    frequent = np.sort(np.array([r.key for r in often], np.int64).view(np.uint64))
    named = texts.join(possible.select(F.col("node").alias("row"), "single"), "row").select("row", "text", "single")
    index = named.transform(map_arrow, _index(words, similar, frequent), INDEX)
    shared = freeze(index.repartition("key").sortWithinPartitions("key").transform(map_arrow, _of_several, INDEX), "shared-keys")

    # each set meets the most typical one of its lowest and of its highest shared key
    typical = freeze(shared.groupBy("node").agg(F.count(F.lit(1)).alias("keys"), F.min("key").alias("low"), F.max("key").alias("high")), "typical")
    chosen = (F.col("key") == F.col("low")) | (F.col("key") == F.col("high"))
    ordered = (shared.join(typical, "node").select("key", "node", "n", "at", chosen.alias("chosen"), F.col("keys").alias("keys"))
               .repartition("key").sortWithinPartitions("key", F.desc("keys"), "node").drop("keys"))
    pairs = ordered.transform(map_arrow, _with_most_typical(similar), "a bigint, b bigint").distinct()
    first = freeze(_of_two_components(pairs, close), "first-pairs")
    links = near.union(_links(_passing(first, sketches, _similar_sketches, similar), texts, words, similar))
    roots = connected_components(links)

    # sets that share a key with another component are looked at again, unless the counted part rules them out
    rooted = _rooted(shared.select("key", "node"), roots)
    apart = rooted.join(_apart(rooted), "key", "left_semi").select("node").distinct()
    others = _rooted(counted, roots)
    others = others.join(_apart(others), "key", "left_semi").select("key", "node")
    again = freeze(_still_possible(possible.select("node", "n", "counted").join(apart, "node", "left_semi"), others, similar)
                   .select(F.col("node").alias("row"), "n"), "again")
    shingles = (texts.join(again.select("row"), "row", "left_semi").select("row", "text")
                .transform(map_arrow, _hashes(words), "key bigint, node bigint").join(again.select(F.col("row").alias("node"), "n"), "node"))
    keyed = freeze(_second_keys(freeze(_rooted(shingles, roots).select("key", "node", "n", "root"), "all-shingles"), similar), "second-keys")
    tried = freeze(_blocked(keyed, sketches, similar, True).distinct(), "likeliest")
    if not tried.isEmpty():
        links = links.union(_links(tried, texts, words, similar))
        roots = connected_components(links)
        keyed = _rooted(keyed.drop("root"), roots).select(*keyed.columns)
        rest = freeze(_blocked(freeze(keyed, "keys-again"), sketches, similar, False).distinct().join(tried, ["a", "b"], "left_anti"), "left-apart")
        if not rest.isEmpty():
            roots = connected_components(links.union(_links(rest, texts, words, similar)))
    grouped = equal.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return digests.select("row", "digest").join(grouped, "digest").select("row", "root")
