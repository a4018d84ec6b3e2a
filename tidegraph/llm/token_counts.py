"""Token counts of texts without encoding them.

A text's tokens are the pieces of its pre-tokens, and a pre-token has the same pieces wherever it
stands. So each document is reduced to its pre-token frequencies, every distinct pre-token is
counted once, and the two are joined and summed; no ids are made for any text.

Scale: the frequencies are written once, one row per document. Most occurrences belong to few
pre-tokens: the `head`, the most frequent ones of a small sample of the documents, is counted
beforehand and travels with the tasks (its size is fixed), so only the rest is shuffled. The head
decides what is shuffled and never a result. The rest is an equi join on the pre-token, whose
skew AQE splits; the sums are combined before their shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import freeze
from .common import by_size, map_arrow, sliced, texts_of
from .tokens import codec, vocabulary

HEAD = 200_000
HEAD_CHARS = 32
HEAD_SAMPLE = 0.02


def _frequencies(parts: list[str], words_of) -> tuple[Counter, int]:
    """Pre-token frequencies and the number of special strings."""
    found: Counter = Counter()
    for segment in parts[::2]:
        found.update(words_of(segment))
    return found, len(parts) // 2


def _head(texts: DataFrame, json: str, size: int, share: float) -> dict[str, int]:
    """Piece counts of the most frequent pre-tokens of a sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(json)
        for batch in by_size(batches, "text"):
            total: Counter = Counter()
            for text in texts_of(batch, "text"):
                total.update(w for w in _frequencies(c.segments(text), c.words)[0] if len(w) <= HEAD_CHARS)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    top = (texts.sample(share, seed=1).transform(map_arrow, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(size).select("word"))
    words = [r[0] for r in top.collect()]
    return {w: len(ids) // 4 for w, ids in codec(json).encode_words(words).items()}


def _documents(json: str, head: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(json)
        for batch in by_size(batches, "text"):
            n_bytes, counted, words, times, ends = [], [], [], [], [0]
            for text in texts_of(batch, "text"):
                found, known = _frequencies(c.segments(text), c.words)
                for word, n in found.items():
                    pieces = head.get(word)
                    if pieces is None:
                        words.append(word)
                        times.append(n)
                    else:
                        known += pieces * n
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                counted.append(known)
                ends.append(len(words))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(counted, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(words, pa.string())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                ["row", "id", "n_bytes", "counted", "words", "times"])
    return run


def _pieces(json: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(json)
        for batch in sliced(batches, 5_000):
            found = c.encode_words(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([len(i) // 4 for i in found.values()], pa.int64())],
                                             ["word", "pieces"])
    return run


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_json: str | None = None,
                 head: int = HEAD, head_sample: float = HEAD_SAMPLE) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row, counted as the library would without added tokens.

    Special strings inside a text are one token each, the library's default. A null text counts as
    empty. Rows that repeat an id or have none stay rows of their own. Other columns aren't read.
    """
    json = vocabulary_json or vocabulary()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = _head(rows.select("text"), json, head, head_sample) if head else {}
    id_type = rows.schema["id"].dataType.simpleString()
    docs = freeze(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text").transform(map_arrow, 
        _documents(json, known), f"row bigint, id {id_type}, n_bytes bigint, counted bigint, words array<string>, times array<int>"),
        "frequencies")
    rest = (docs.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
            .select("row", F.col("w.words").alias("word"), F.col("w.times").alias("n")))
    pieces = rest.select("word").distinct().transform(map_arrow, _pieces(json), "word string, pieces bigint")
    sums = rest.join(pieces, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    return (docs.select("row", "id", "n_bytes", "counted").join(sums, "row", "left")
            .select("id", "n_bytes", (F.col("counted") + F.coalesce("rest", F.lit(0))).alias("n_tokens")))
