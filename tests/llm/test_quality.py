import zlib

import numpy as np
from llm_data import AWKWARD, docs_of, prose
from pyspark.sql import functions as F

from tidegraph.llm import quality
from tidegraph.llm.queries import QUERIES


def labelled(spark, n=200):
    good = [prose(60, i) for i in range(n)]
    bad = ["### *** %%% " + " ".join([f"{i * 7919 % 1000:03d}!!"] * 40) for i in range(n)]
    docs = docs_of(spark, [t for pair in zip(good, bad) for t in pair])
    return docs, docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))


def test_held_out_fold(spark):
    ids = [0, 1, 7, 10, 12345678901, -3, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()
    assert {r.doc_id: r.h for r in rows} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_learns_and_keeps_to_the_fold(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.with_scores(docs, model).collect()}
    assert np.mean([(s >= 0.5) == (i % 2 == 0) for i, s in scores.items()]) > 0.97
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, flipped) == model


def test_awkward_rows(spark):
    docs, labels = labelled(spark, 60)
    model = quality.fit(docs, labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None), (999, 1)], "doc_id long, quality int")))
    odd = docs_of(spark, AWKWARD).withColumn("score", F.lit("clash"))
    got = quality.with_scores(odd, model)
    assert got.columns == odd.columns
    rows = {r.doc_id: r.score for r in got.collect()}
    assert len(rows) == len(AWKWARD) and all(0 <= s <= 1 for s in rows.values())
    assert rows[0] == rows[1]  # null as empty


def test_without_labels_of_both_classes(spark):
    docs, labels = labelled(spark, 5)
    assert quality.fit(docs, labels.filter("quality = 2")).constant == 0.5
    model = quality.fit(docs, labels.filter("quality = 1"))
    assert model.constant > 0.5
    assert quality.with_scores(docs.limit(0), model).count() == 0


def test_query_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def plain_score(text, model):
    """The score of one text from its compressed blocks, step by step."""
    import math

    import zstandard
    data = (text or "").encode()

    def size(dictionary):
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        total = 0
        for at in range(0, len(data), 512):
            total += len(zstandard.ZstdCompressor(level=3, dict_data=content, write_content_size=False).compress(data[at:at + 512]))
        return total

    n = max(1, len(data))
    good, bad, none = size(model.good), size(model.bad), size(b"")
    x = [(bad - good) / n, good / n, none / n, math.log(n)]
    z = [min(4, max(-4, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale)]
    total = sum(w * v for w, v in zip(model.weights, [1, *z, *(v * v for v in z)]))
    return 1 / (1 + math.exp(-total))


def test_scores_are_the_plain_ones(spark, sf):
    """Every score of the query, recomputed text by text from the fitted model."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.score, r.predicted) for r in QUERIES["op5_quality"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, (score, predicted) in got.items():
        want = plain_score(texts[i], model)
        assert abs(score - want) < 1e-9 and predicted == (want >= 0.3)
