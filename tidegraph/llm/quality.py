"""Document quality from compressed sizes.

Two zstandard dictionaries are made of text labelled good and bad. A document is compressed in
blocks, each on its own so that every block of a long text is judged by the dictionaries and not by
what came before it: once primed with good text, once with bad, once unprimed. The normalised
difference of the two primed sizes says which side the text resembles; with the sizes themselves
and the length it is calibrated to a probability by logistic regression, on labelled rows that are
not in the dictionaries.

Fitting uses a bounded sample: at most `rows_per_class` labelled rows of either class, those with
the smallest hashes of their ids; half of them (by another hash) may go into the dictionaries, of
`dictionary_bytes` each, the others calibrate. Scoring is one pass over all rows, without a shuffle;
a task holds the dictionaries and one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import freeze
from .common import map_arrow, schema_with, sliced, texts_of, with_columns

BLOCK_BYTES = 512
DICTIONARY_BYTES = 256 << 10
ROWS_PER_CLASS = 5_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def blocks(data: bytes, size: int = BLOCK_BYTES) -> list[bytes]:
    return [data[at:at + size] for at in range(0, len(data), size)]


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration. Without both classes, `constant` is every text's score."""
    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float | None = None

    def sizes(self, texts: list[str]) -> np.ndarray:
        """(rows, 4): bytes compressed with the good dictionary, the bad one, with none, and plain."""
        def primed(content: bytes) -> zstandard.ZstdCompressor:
            found = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            return zstandard.ZstdCompressor(level=3, dict_data=found, write_content_size=False)

        compress = [primed(c).compress for c in (self.good, self.bad, b"")]
        out = np.zeros((len(texts), 4))
        for row, text in zip(out, texts):
            data = text.encode("utf-8", "surrogatepass")
            cut = blocks(data)
            row[:3] = [sum(len(c(b)) for b in cut) for c in compress]
            row[3] = len(data)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = standardised(features(self.sizes(texts)), self.mean, self.scale)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights), -30, 30)))


def features(sizes: np.ndarray) -> np.ndarray:
    good, bad, plain, n = sizes.T
    n = np.maximum(n, 1)
    return np.stack([(bad - good) / n, good / n, plain / n, np.log(n)], axis=1)


def standardised(x: np.ndarray, mean, scale) -> np.ndarray:
    """Within four deviations, with squares and a constant."""
    z = np.clip((x - np.array(mean)) / np.array(scale), -4, 4)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: mean, scale and weights."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = standardised(x, mean, scale)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(w)), z.T @ (p - y) + ridge * len(y) * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        rows_per_class: int = ROWS_PER_CLASS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Learn from labelled rows that aren't held out. An id with both labels counts for both."""
    usable = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .filter("id IS NOT NULL AND label IN (0, 1)").filter(~held_out(F.col("id"))).distinct())
    order = [F.xxhash64("id"), "id"]
    taken = usable.filter("label = 1").orderBy(*order).limit(rows_per_class).union(
        usable.filter("label = 0").orderBy(*order).limit(rows_per_class))
    # rows of equal text belong to the same half
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most 2 * rows_per_class rows of two numbers, so this side may be broadcast
    sample = freeze(texts.join(F.broadcast(taken), "id").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))), "labelled")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            found = [(label, b) for label, t in zip(batch.column(0).to_pylist(), texts_of(batch, "text")) for b in blocks(t.encode("utf-8", "surrogatepass"))]
            if found:
                label, block = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(block, pa.binary())], ["label", "block"])

    pieces = sample.filter("half = 0").select("label", "text").transform(map_arrow, cut, "label int, block binary")
    content = []
    for label in (1, 0):
        rows = (pieces.filter(F.col("label") == label).orderBy(F.xxhash64("block"), "block").limit(dictionary_bytes // BLOCK_BYTES)
                .select("block").collect())
        content.append(b"".join(bytes(r[0]) for r in rows))
    draft = Model(*content)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            sizes = draft.sizes(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in sizes.T)], ["label", "good", "bad", "plain", "n"])

    rows = (sample.filter("half = 1").select("label", "text")
            .transform(map_arrow, measure, "label int, good double, bad double, plain double, n double").collect())
    y = np.array([r[0] for r in rows], float)
    # the sample holds the classes in other shares than the labels do; the constant term makes up for it
    share = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    if not all(content) or len(set(y.tolist())) < 2:
        n = sum(share.values())
        return Model(constant=(share.get(1, 0) + 1) / (n + 2))
    mean, scale, w = calibrate(features(np.array([tuple(r)[1:] for r in rows])), y)
    drawn = {c: min(share.get(c, 0), rows_per_class) for c in (0, 1)}
    w[0] += np.log(share[1] / share[0]) - np.log(drawn[1] / drawn[0])
    return Model(*content, tuple(mean), tuple(scale), tuple(w))


def with_scores(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """df with the probability (0 to 1) that a text is good; null texts count as empty, rows that repeat
    are scored each, an empty table gives an empty one.

    All columns are kept; one named like `out` is replaced.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            yield with_columns(batch, **{out: pa.array(model.scores(texts_of(batch, text_col)))})

    return df.transform(map_arrow, run, schema_with(df, **{out: "double"}))
