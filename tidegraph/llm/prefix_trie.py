"""The trie of conversation prefixes, with totals of every subtree.

A node is a sequence of first turns; its key is the sum of hashes of (depth, turn), 122 bits, which a
running sum per conversation gives for all depths at once, however long a conversation is.

Totals go from children to parents by time-forward processing. Nodes whose subtree has at most
`limit` rows make up shards: whole subtrees, dealt by their root, sorted by Spark in reverse level
order and streamed; a node takes the messages addressed to it from a priority queue, adds its own
and sends the total on. The queue writes sorted runs to Spark's scratch folder when it is large.
Then the shard roots' totals are added up at their parents, the nodes above. Those fall into paths,
each along the member that stays longest above the shards, at most as many as there are limits in
all rows; the same streaming pass over paths passes totals across, and a running sum distributes
each path's total over its nodes, which may be as many as the longest conversation has turns.

How many rows a subtree has at most, the lengths of its members from there on, is a sum over
members; so shards are known before any total is. Nothing is drawn or capped: `limit` decides which
way a node goes, never its result.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import running_sum
from ..plans.storage import freeze
from .common import map_arrow, sliced

HEADS = 4                  # a conversation takes up to HEADS - 1 turns of another one
GROUP = 20                 # which is the first of so many ids
WORD = r"[^\x20\x09-\x0D]+"
MODULUS = (1 << 61) - 1
MOST_ROWS, LEAST_ROWS = 2_000_000, 1_000     # of a shard
MOST_BROADCAST = 200_000
HELD = 200_000             # messages of a queue in memory
KEY = ["depth", "ka", "kb"]


class MessageQueue:
    """Messages (level, a, b, values...) of 64-bit integers, smallest key first, in bounded memory.

    Beyond `held` messages those in memory are written as a sorted run to an unnamed file of this
    task; equal keys are added up before that.
    """

    def __init__(self, values: int, held: int = HELD):
        self.values, self.held, self.heap, self.runs = values, held, [], []
        self.record = struct.Struct(f"<{3 + values}q")

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        for message in self._added_up(sorted(self.heap)):
            file.write(self.record.pack(*message))
        file.seek(0)
        run = self._read(file)
        self.heap = []
        self._advance(run)

    def _added_up(self, messages: list[tuple]) -> Iterator[tuple]:
        last, sums = None, []
        for key, values in ((m[:3], m[3:]) for m in messages):
            if key == last:
                sums = [a + b for a, b in zip(sums, values)]
                continue
            if last:
                yield (*last, *sums)
            last, sums = key, values
        if last:
            yield (*last, *sums)

    def _read(self, file) -> Iterator[tuple]:
        while block := file.read(self.record.size * 4_096):
            yield from self.record.iter_unpack(block)
        file.close()

    def _advance(self, run: Iterator[tuple]) -> None:
        head = next(run, None)
        if head:
            heapq.heappush(self.runs, (head, id(run), run))

    def take(self, key: tuple[int, int, int]) -> list[int]:
        """The sums of all messages with this key; smaller keys have been taken before."""
        sums = [0] * self.values
        while self.heap and self.heap[0][:3] == key:
            sums = [a + b for a, b in zip(sums, heapq.heappop(self.heap)[3:])]
        while self.runs and self.runs[0][0][:3] == key:
            head, _, run = heapq.heappop(self.runs)
            sums = [a + b for a, b in zip(sums, head[3:])]
            self._advance(run)
        return sums

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


def _totals(held: int):
    """Rows (level, a, b, parent level, parent a, parent b, leaves, saved, childless), sorted by
    (level descending, a, b) -> (level, a, b, children, leaves, saved) with totals of subtrees.

    A null parent level: the row's total isn't passed on here. `leaves` and `saved` are what a row
    adds itself; if `childless`, it is a leaf unless a message comes.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("level", "a", "b", "children", "leaves", "saved")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = MessageQueue(3, held)
        for batch in sliced(batches, 10_000):
            out = []
            for level, a, b, up, pa_, pb_, leaves, saved, childless in zip(*(c.to_pylist() for c in batch.columns)):
                children, below, words = queue.take((-level, a, b))
                leaves, saved = leaves + below + (childless and not children), saved + words
                if up is not None:
                    queue.push((-up, pa_, pb_, 1, leaves, saved))
                out.append((level, a, b, children, leaves, saved))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
        assert not len(queue), "a message without a receiver"
    return run


TOTALS = "level bigint, a bigint, b bigint, children bigint, leaves bigint, saved bigint"


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, size, depth, ha, hb, words): conversations of which each begins with up to three
    turns of the first of its twenty.

    Conversation c takes the first h turns of c - c % GROUP (all if fewer, none if absent) and then
    its own after the first h; h is crc32(decimal c) mod HEADS, c % GROUP has the sign of c. Turns are ordered by number, null
    first; of equal numbers by role, first 256 characters and hash of the text. A null role or text
    counts as empty, rows without a conversation id take no part. `size` is the number of turns of
    the rebuilt conversation, (ha, hb) a 128-bit hash of role and text, `words` the text's words.
    A conversation without any turn left has one row with depth 0.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    own = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.left(text, F.lit(256)).alias("head"),
        F.xxhash64(role, text).alias("ha"), F.xxhash64(text, F.lit(1), role).alias("hb"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    own = freeze(running_sum(own, ["conv_id"], ["turn", "role", "head", "ha"], {"at": F.lit(1)})
                 .select("conv_id", "at", "ha", "hb", "words"), "turns")
    lengths = own.groupBy("conv_id").agg(F.max("at").alias("length"))
    convs = lengths.select("conv_id", "length", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
                           (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    first = lengths.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("length").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0).cast("bigint")))
    convs = (convs.join(first, "base", "left").withColumn("taken", taken)
             .withColumn("size", F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0).cast("bigint"))))
    convs = freeze(convs.select("conv_id", "base", "h", "taken", "size"), "conversations")
    heads = own.filter((F.col("conv_id") % GROUP == 0) & (F.col("at") < HEADS)).withColumnRenamed("conv_id", "base")
    given = (convs.filter("taken > 0").join(heads, "base").filter("at <= taken")
             .select("conv_id", "size", F.col("at").alias("depth"), "ha", "hb", "words"))
    kept = (own.join(convs, "conv_id").filter("at > h")
            .select("conv_id", "size", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "ha", "hb", "words"))
    none = F.lit(0).cast("bigint")
    empty = convs.filter("size = 0").select("conv_id", "size", none.alias("depth"), none.alias("ha"), none.alias("hb"), none.alias("words"))
    return given.unionByName(kept).unionByName(empty)


def _prefixes(turns: DataFrame) -> DataFrame:
    """Each turn's prefix by key, and the parent's key; the root has keys 0."""
    turns = freeze(turns, "rebuilt").filter("depth > 0")
    big, m = "decimal(38,0)", F.lit(MODULUS).cast("decimal(38,0)")
    own = {"oa": F.xxhash64("depth", "ha", "hb"), "ob": F.xxhash64(F.lit(1), "hb", "ha", "depth")}
    summed = running_sum(turns.withColumns(own), ["conv_id"], ["depth"], {"pa": F.col("oa"), "pb": F.col("ob")}, big=True)

    def key(total, minus=None):
        rest = F.col(total) if minus is None else F.col(total) - F.col(minus).cast("decimal(20,0)")
        return F.pmod(rest.cast(big), m).cast("bigint")

    first = F.col("depth") == 1
    return freeze(summed.select("conv_id", "size", "depth", key("pa").alias("ka"), key("pb").alias("kb"),
                                F.when(first, 0).otherwise(key("pa", "oa")).alias("ua"), F.when(first, 0).otherwise(key("pb", "ob")).alias("ub"), "words"), "prefixes")


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _up(df: DataFrame) -> DataFrame:
    """With parent columns `ud`, `ua`, `ub` named as keys."""
    return df.withColumnsRenamed({"ud": "depth", "ua": "ka", "ub": "kb"})


def _streamed(df: DataFrame, held: int) -> DataFrame:
    """Totals of rows that are dealt to their tasks: see _totals."""
    return (df.sortWithinPartitions(F.desc("level"), "a", "b").select("level", "a", "b", "up", "xa", "xb", "leaves", "saved", "childless")
            .transform(map_arrow, _totals(held), TOTALS))


def _within_shards(light: DataFrame, held: int) -> DataFrame:
    """Totals of the nodes of whole subtrees; `top` marks subtrees' roots, (sa, sb) names them."""
    up = F.when(~F.col("top"), F.col("ud"))
    rows = light.select(F.col("depth").alias("level"), F.col("ka").alias("a"), F.col("kb").alias("b"), up.alias("up"), F.col("ua").alias("xa"), F.col("ub").alias("xb"),
                        F.lit(0).cast("bigint").alias("leaves"), "saved", F.lit(True).alias("childless"), "sa", "sb")
    done = _streamed(rows.repartition("sa", "sb"), held)
    return done.select(F.col("level").alias("depth"), F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("children").alias("n_children"),
                       F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def _above_shards(heavy: DataFrame, held: int) -> DataFrame:
    """Totals of the nodes above the shards. heavy: key, parent key, rep, n_children, leaves, saved."""
    level = F.when(F.col("depth") > 0, F.col("ud")).alias("ud")
    paths = heavy.groupBy("rep").agg(F.min("depth").alias("level"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
                                     F.min_by(F.struct(level, "ua", "ub"), "depth").alias("p"))
    paths = freeze(paths.select("rep", "level", "leaves", "saved", "p.*"), "paths")
    tops = paths.select("rep", F.col("level").alias("up"))
    above = heavy.select(F.col("depth").alias("ud"), F.col("ka").alias("ua"), F.col("kb").alias("ub"), "rep").join(_small(tops), "rep").withColumnRenamed("rep", "xa")
    zero = F.lit(0).cast("bigint")
    # as many rows as the table has limits at most: one task
    linked = paths.join(above, ["ud", "ua", "ub"], "left").select(
        "level", F.col("rep").alias("a"), zero.alias("b"), "up", "xa", zero.alias("xb"), "leaves", "saved", F.lit(False).alias("childless"))
    totals = freeze(_streamed(linked.repartition(1), held), "path-totals")
    joined = paths.select("rep", "ud", "ua", "ub").join(totals.select(F.col("a").alias("rep"), "leaves", "saved"), "rep").filter("ud IS NOT NULL")
    sent = _up(joined.groupBy("ud", "ua", "ub").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    own = heavy.join(sent, KEY, "left").withColumns({
        "leaves": F.col("leaves") + F.coalesce("more_leaves", zero), "saved": F.col("saved") + F.coalesce("more_saved", zero), "from_end": -F.col("depth")})
    summed = running_sum(own.select(*KEY, "rep", "n_children", "leaves", "saved", "from_end"), ["rep"], ["from_end"], {"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")})
    return summed.select(*KEY, "n_children", "n_leaves", "saved_tokens")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, ka, kb, conv_id) in order -> pieces of the joined ids, each with its first id."""
    names = [*KEY, "first", "ids"]
    for batch in sliced(batches, 8_192):
        out: list[list] = []
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if out and out[-1][:3] == key:
                out[-1][4].append(str(conv))
            else:
                out.append([*key, conv, [str(conv)]])
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array([",".join(i) for i in columns[4]])], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (depth, ka, kb, ids), in order -> one digest per node."""
    last, sha = None, None
    for batch in sliced(batches, 1_000):
        done = []
        for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last:
                if sha:
                    done.append((*last, sha.hexdigest()))
                last, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield _digest_batch(done)
    if sha:
        yield _digest_batch([(*last, sha.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    *keys, shas = zip(*rows)
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(shas)], [*KEY, "ends_sha256"])


def _ends(prefixes: DataFrame, turnless: DataFrame) -> DataFrame:
    """The digest of the ids that end at a node. A hash can't be split, so a node's ids pass through
    one task, but as pieces of thousands of ids, made where the sorted ids lie."""
    zero = F.lit(0).cast("bigint")
    ends = (prefixes.filter("depth = size").select(*KEY, "conv_id")
            .union(turnless.select(zero, zero, zero, "conv_id")))
    ordered = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = ordered.transform(map_arrow, _chunks, "depth bigint, ka bigint, kb bigint, first bigint, ids string")
    return (pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids")
            .transform(map_arrow, _digests, "depth bigint, ka bigint, kb bigint, ends_sha256 string"))


def trie_nodes(turns: DataFrame, limit: int | None = None, held: int = HELD) -> DataFrame:
    """(conv_id, size, depth, ha, hb, words) as of `rebuilt` -> one row per node of the trie.

    conv_id, depth: the smallest member and the number of turns, which name the node; parent_conv_id
    (root: null), n_convs, n_children, n_leaves and saved_tokens of the subtree, ends_sha256 of the
    ids that end here. No conversations: no nodes.
    """
    spark = turns.sparkSession
    turns = freeze(turns, "conversation-turns")
    turnless = turns.filter("size = 0").select("conv_id")
    prefixes = _prefixes(turns)
    # (depth 1 of a conversation, or its row of depth 0, stands for it at the root)
    root = turns.filter("depth <= 1").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("size") + 1).alias("rows")).first()
    if not root.n_convs:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
                                         "n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    if limit is None:
        tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        limit = min(MOST_ROWS, max(LEAST_ROWS, root.rows // tasks))
    nodes = prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("ua").alias("ua"), F.max("ub").alias("ub"),
        F.max("words").alias("words"), F.sum(F.col("size") - F.col("depth") + 1).alias("rows"))
    top = spark.createDataFrame([(0, 0, 0, root.conv_id, root.n_convs, 0, 0, 0, root.rows)],
                                "depth bigint, ka bigint, kb bigint, conv_id bigint, n_convs bigint, ua bigint, ub bigint, words bigint, rows bigint")
    nodes = nodes.unionByName(top).withColumns({"ud": F.col("depth") - 1, "saved": (F.col("n_convs") - 1) * F.col("words")}).drop("words")
    nodes = freeze(nodes, "nodes")

    heavy = freeze(nodes.filter(F.col("rows") > limit), "heavy-nodes")
    light = nodes.filter(F.col("rows") <= limit)
    zero = F.lit(0).cast("bigint")
    if root.rows <= limit:
        light = light.withColumns({"sa": zero, "sb": zero, "top": F.col("depth") == 0})
        done = freeze(_within_shards(light, held), "totals")
    else:
        keys = _small(heavy.select(*KEY))
        ups = _small(heavy.select(F.col("depth").alias("ud"), F.col("ka").alias("ua"), F.col("kb").alias("ub")))
        # where each member leaves the heavy nodes: the first light node on its way names the shard
        left = prefixes.withColumn("ud", F.col("depth") - 1).join(ups, ["ud", "ua", "ub"], "left_semi").join(keys, KEY, "left_anti")
        shards = left.select("conv_id", F.col("ka").alias("sa"), F.col("kb").alias("sb"))
        light = light.join(shards, "conv_id").withColumn("top", (F.col("ka") == F.col("sa")) & (F.col("kb") == F.col("sb")))
        within = freeze(_within_shards(light, held), "shard-totals")

        # the member that stays among heavy nodes longest names the path of each of them
        members = freeze(prefixes.join(keys, KEY, "left_semi").select("conv_id", *KEY), "heavy-members")
        deep = members.groupBy("conv_id").agg(F.max("depth").alias("deep"))
        longest = F.max(F.struct("deep", -F.col("conv_id"))).alias("m")
        reps = members.join(deep, "conv_id").groupBy(*KEY).agg(longest).union(
            deep.agg(longest).filter("m IS NOT NULL").select(zero, zero, zero, "m"))
        reps = reps.toDF(*KEY, "m").select(*KEY, (-F.col("m").getField("col2")).alias("rep"))

        from_shards = within.join(nodes.filter(F.col("rows") <= limit).select(*KEY, "ud", "ua", "ub"), KEY).join(ups, ["ud", "ua", "ub"], "left_semi")
        messages = _up(from_shards.groupBy("ud", "ua", "ub").agg(F.count(F.lit(1)).alias("c1"), F.sum("n_leaves").alias("l1"), F.sum("saved_tokens").alias("s1")))
        inner = _up(heavy.filter("depth > 0").groupBy("ud", "ua", "ub").agg(F.count(F.lit(1)).alias("c2")))
        joined = heavy.join(messages, KEY, "left").join(inner, KEY, "left").join(reps, KEY, "left")
        children = F.coalesce("c1", zero) + F.coalesce("c2", zero)
        above = freeze(joined.select(
            *KEY, "ud", "ua", "ub", F.coalesce("rep", F.lit(root.conv_id)).alias("rep"), children.alias("n_children"),
            (F.coalesce("l1", zero) + F.when(children == 0, 1).otherwise(0)).alias("leaves"), (F.col("saved") + F.coalesce("s1", zero)).alias("saved")), "above")
        done = freeze(within.unionByName(_above_shards(above, held)), "totals")

    all_nodes = freeze(nodes.select(*KEY, "ud", "ua", "ub", "conv_id", "n_convs").join(done, KEY)
                       .join(_ends(prefixes, turnless), KEY, "left"), "trie")
    # parents with very many children are few; the others' children fit a task
    parents = all_nodes.select(F.col("depth").alias("ud"), F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    wide = freeze(parents.filter(F.col("n_children") > limit).drop("n_children"), "wide-parents")
    narrow = parents.filter(F.col("n_children") <= limit).drop("n_children")
    up = ["ud", "ua", "ub"]
    below = all_nodes.join(_small(wide), up, "left_semi").join(_small(wide), up)
    rest = all_nodes.join(_small(wide), up, "left_anti").join(narrow, up, "left")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nothing = hashlib.sha256(b"").hexdigest()
    return below.unionByName(rest).select(*result, F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
