"""BPE encoding and decoding of whole texts.

Short texts are encoded where they lie. A long text is halved until its parts are short; the parts
are spread over the cluster, encoded in parallel and put together as a tree: at every join a window
around it is encoded anew, and grown until the window's cuts agree with both sides. The result is
that of encoding the whole text.

Why that is exact. Pre-tokens: a cut at least three characters before the end of a part doesn't
depend on what follows, and from a cut that a part and the window share, everything to the right is
the same. Inside one very long pre-token: a sequence of tokens is the encoding of its bytes if every
two neighbours are the encoding of theirs, so the window has to fit its neighbours on both sides.

Scale: no shuffle for short texts. Parts of long texts are shuffled twice, and the task that puts a
text together holds that text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import freeze
from .common import by_size, column, free_name, map_arrow, schema_with, sliced, texts_of, with_columns
from .tokens import Codec, codec, vocabulary

PART_CHARS = 65_536
LONG_WORD = 1_024
LOOKAHEAD = 3


def halves(text: str, most: int) -> list[str]:
    """The text halved until no part is longer than `most`; their number is a power of two."""
    n = 1
    while len(text) > most * n:
        n *= 2
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


@dataclass
class Part:
    """An encoded text: where its pre-tokens end in the text and in the ids (both from 0 on)."""
    text: str
    ends: np.ndarray
    id_ends: np.ndarray
    ids: np.ndarray

    @property
    def words(self) -> int:
        return len(self.ends) - 1

    def word(self, i: int) -> tuple[str, np.ndarray]:
        i %= self.words
        return self.text[self.ends[i]:self.ends[i + 1]], self.ids[self.id_ends[i]:self.id_ends[i + 1]]


def _ends(sizes: list[int]) -> np.ndarray:
    return np.cumsum([0, *sizes], dtype=np.int64)


class Joiner:
    """Encodes parts and puts them together."""

    def __init__(self, c: Codec):
        self.codec = c

    def part(self, text: str) -> Part:
        words = self.codec.words(text)
        ids = list(map(self.codec.known(words), words))
        return Part(text, _ends([len(w) for w in words]), _ends([len(i) // 4 for i in ids]), np.frombuffer(b"".join(ids), "<i4"))

    def join_ids(self, left: list[int], right: list[int], window: int = 4) -> list[int]:
        """Encoding of the two sides' bytes as one pre-token."""
        table, bpe = self.codec.token_bytes, self.codec.bpe
        fits = lambda a, b: bpe(table[a] + table[b]) == [a, b]
        while True:
            a, b = left[:-window] if window < len(left) else [], right[window:]
            middle = bpe(b"".join(table[i] for i in [*left[len(a):], *right[:window]]))
            if (not a or fits(a[-1], middle[0])) and (not b or fits(middle[-1], b[0])):
                return [*a, *middle, *b]
            window *= 2

    def join(self, left: Part, right: Part, window: int = 8) -> Part:
        """Encoding of the two parts' text."""
        if not left.words or not right.words:
            return left if left.words else right
        while True:
            i, j = max(0, left.words - window), min(window, right.words)
            tail, head = left.text[left.ends[i]:], right.text[:right.ends[j]]
            if i == 0 or len(tail) >= LOOKAHEAD:
                cuts = {len(tail) + end: k for k, end in enumerate(right.ends[:j + 1].tolist())}
                words, at = self.codec.words(tail + head), 0
                for k, word in enumerate(words, 1):
                    at += len(word)
                    if at in cuts and (at + LOOKAHEAD <= len(tail) + len(head) or j == right.words):
                        return self.put_together(left, i, words[:k], right, cuts[at])
            window *= 2

    def put_together(self, left: Part, i: int, words: list[str], right: Part, j: int) -> Part:
        """The first i pre-tokens of left, the new ones, and right from its j-th on."""
        made = [self.ids(w, left, right) for w in words]
        n, at = len(left.text), int(left.id_ends[i])
        ids = np.concatenate([left.ids[:at], *(np.asarray(m, "<i4") for m in made), right.ids[right.id_ends[j]:]])
        shift = at + sum(map(len, made)) - int(right.id_ends[j])
        return Part(left.text + right.text,
                    np.concatenate([left.ends[:i], left.ends[i] + _ends([len(w) for w in words]), right.ends[j + 1:] + n]),
                    np.concatenate([left.id_ends[:i], at + _ends([len(m) for m in made]), right.id_ends[j + 1:] + shift]), ids)

    def ids(self, word: str, left: Part, right: Part) -> list[int]:
        if len(word) > LONG_WORD:
            (a, a_ids), (b, b_ids) = left.word(-1), right.word(0)
            if word == a + b:
                return self.join_ids(a_ids.tolist(), b_ids.tolist())
        return self.codec.bpe(word.encode())

    def concatenate(self, parts: list[Part]) -> np.ndarray:
        """Ids of the parts' text: neighbours are joined two by two until one is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0].ids if parts else np.empty(0, "<i4")


def _id_arrays(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


Batches = Iterator[pa.RecordBatch]


def _whole(json: str, out: str, names: list[str], then, text_col: str):
    def run(batches: Batches) -> Batches:
        c = codec(json)
        for batch in by_size(batches, text_col):
            encoded = _id_arrays([c.encode(t) for t in texts_of(batch, text_col)])
            yield from then(iter([with_columns(batch, **{out: encoded}).select([*names, out])]))
    return run


def _cut(json: str, most: int):
    """Rows of one long text each -> its parts: (row, segment, part, special id, text).

    Special strings are tokens of their own; what lies between them is cut into halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(json)
        for batch in sliced(batches, 1):
            row, text = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            for segment, s in enumerate(c.segments(text)):
                parts = [s] if segment % 2 else halves(s, most)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([segment] * n, pa.int32()), pa.array(range(n), pa.int32()),
                     pa.array([c.special[s] if segment % 2 else None] * n, pa.int32()), pa.array(parts, pa.string())],
                    ["row", "segment", "part", "special", "text"])
    return run


_PART = "row bigint, segment int, part int, special int, text string"


def _encode_parts(json: str):
    """Adds where the pre-tokens end in the text and in the ids, and the ids."""
    def run(batches: Batches) -> Batches:
        joiner = Joiner(codec(json))
        for batch in by_size(batches, "text"):
            parts = [joiner.part(text) if special is None else joiner.part("")
                     for special, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield with_columns(batch, ends=pa.array([p.ends.astype("<i4").tobytes() for p in parts], pa.binary()),
                               id_ends=pa.array([p.id_ends.astype("<i4").tobytes() for p in parts], pa.binary()),
                               ids=pa.array([p.ids.tobytes() for p in parts], pa.binary()))
    return run


def _assemble(json: str):
    """Rows sorted by (row, segment, part) -> (row, ids), one text at a time."""
    def run(batches: Batches) -> Batches:
        joiner = Joiner(codec(json))
        row, segment, parts, done = None, None, [], []

        def close():
            if parts:
                done.append(joiner.concatenate(parts))
                parts.clear()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), _id_arrays([b"".join(d.tobytes() for d in done)])], ["row", "ids"])

        for batch in sliced(batches, 16):
            for r in batch.to_pylist():
                if r["row"] != row:
                    close()
                    if row is not None:
                        yield out()
                    row, segment, done = r["row"], None, []
                if r["segment"] != segment:
                    close()
                    segment = r["segment"]
                if r["special"] is not None:
                    done.append(np.array([r["special"]], "<i4"))
                    continue
                ends, id_ends, ids = (np.frombuffer(r[n], "<i4") for n in ("ends", "id_ends", "ids"))
                parts.append(Part(r["text"], ends.astype(np.int64), id_ends.astype(np.int64), ids))
        close()
        if row is not None:
            yield out()
    return run


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", vocabulary_json: str | None = None,
           part_chars: int = PART_CHARS, then=iter, then_schema: str | None = None) -> DataFrame:
    """df with the ids (array<int>) of the text, as the library gives them without added tokens.

    Special strings inside a text become their token, the library's default. A null text counts as
    empty. All columns are kept; one named like `out` is replaced. Rows that repeat an id are rows of
    their own, an empty table gives an empty one.

    `then`, if given, turns the encoded record batches into others (of `then_schema`) before they
    leave their task, as decode_batches does.
    """
    json = vocabulary_json or vocabulary()
    names = [c for c in df.columns if c != out]
    quoted = [column(c) for c in names]
    text, row, ids = (free_name(df, c) for c in ("encoded_text", "row", "found_ids"))
    source = df.select(*quoted, F.coalesce(column(text_col), F.lit("")).alias(text))
    short = source.filter(F.length(text) <= part_chars)
    schema = schema_with(df.select(*quoted), **{out: "array<int>"})
    encoded = short.transform(map_arrow, _whole(json, out, names, then, text), then_schema or schema)
    # written once, so that its row numbers hold for both uses
    long = freeze(source.filter(F.length(text) > part_chars).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    parts = (long.select(row, text).transform(map_arrow, _cut(json, part_chars), _PART).repartition("row", "segment", "part")
             .transform(map_arrow, _encode_parts(json), _PART + ", ends binary, id_ends binary, ids binary"))
    whole = (parts.repartition("row").sortWithinPartitions("row", "segment", "part")
             .transform(map_arrow, _assemble(json), "row bigint, ids array<int>").select(F.col("row").alias(row), F.col("ids").alias(ids)))
    joined = long.join(whole, row).select(*quoted, F.col(ids).alias(out))
    if then_schema:
        joined = joined.transform(map_arrow, then, then_schema)
    return encoded.union(joined)


def _decoded(json: str, batch: pa.RecordBatch, ids_col: str = "ids") -> list[str | None]:
    token = codec(json).token_bytes.__getitem__
    ids = batch.column(batch.schema.names.index(ids_col))
    return [None if i is None else b"".join(map(token, i)).decode("utf-8", "replace") for i in _lists(ids)]


def decode_batches(json: str, ids_col: str = "ids", out: str = "decoded"):
    """A function that adds to record batches the text of their ids."""
    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, 250):
            yield with_columns(batch, **{out: pa.array(_decoded(json, batch, ids_col), pa.string())})
    return run


def _lists(ids: pa.ListArray) -> Iterator[list[int] | None]:
    for i in range(len(ids)):
        value = ids[i].values
        yield None if value is None else value.to_numpy(zero_copy_only=False).tolist()


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", vocabulary_json: str | None = None) -> DataFrame:
    """df with the text of the ids, special tokens kept; bytes that aren't UTF-8 become U+FFFD.

    Null ids give a null text. A column named like `out` is replaced.
    """
    return df.transform(map_arrow, decode_batches(vocabulary_json or vocabulary(), ids_col, out), schema_with(df, **{out: "string"}))


def check_batches(json: str, text_col: str = "text"):
    """A function that adds to record batches with `ids` their number, n_tokens, and round_trip:
    whether decoding them gives the text (null as empty) back."""
    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, 250):
            same = [(a or "") == b for a, b in zip(_decoded(json, batch), texts_of(batch, text_col))]
            ids = batch.column(batch.schema.names.index("ids"))
            yield with_columns(batch, n_tokens=pc.list_value_length(ids).cast(pa.int64()), round_trip=pa.array(same, pa.bool_()))
    return run


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digest_batches(json: str, keep: list[str]):
    """A function from record batches with `ids` to the columns `keep` and DIGESTS: the number of
    ids, the digest of the decimal ids joined by commas, and that of the decoded text."""
    def run(batches: Batches) -> Batches:
        decimal = [str(i).encode() for i in range(len(codec(json).token_bytes))].__getitem__
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in sliced(batches, 250):
            ids = list(_lists(batch.column(batch.schema.names.index("ids"))))
            texts = [t or "" for t in _decoded(json, batch)]
            yield with_columns(batch, n_tokens=pa.array([len(i) for i in ids], pa.int64()),
                               ids_sha256=pa.array([sha(b",".join(map(decimal, i))) for i in ids], pa.string()),
                               decoded_sha256=pa.array([sha(t.encode()) for t in texts], pa.string())
                               ).select([*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
    return run
