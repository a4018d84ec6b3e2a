"""Columns that are named like the operators' own helpers come through unchanged."""
import pytest
from llm_data import docs_of, prose
from pyspark.sql import functions as F

import corpus_pipeline
from tidegraph.llm import bpe, decontaminate, quality, quartile_digest, secret_scan, token_counts

SF = "/root/testdata/sf0.001"
NAMES = ["_row", "_score", "_encoded", "_scanned", "row", "ROW_", "key", "node", "score", "_decoded", "encoded_text", "scanned_text", "found_ids", "root",
         "seed", "start", "at", "words"]


@pytest.fixture(scope="module")
def docs(spark):
    """Two short texts, a long one and a null one."""
    made = docs_of(spark, [prose(80, 1), prose(60, 2) + " password = hunter2hunter2", "y " * 30_000, None])
    return made.withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in NAMES})


def unchanged(df, names=NAMES, id_col="doc_id"):
    """(ids, whether all helper columns that are left are as they were)."""
    got = df.collect()
    return {r[id_col] for r in got}, all(r[n] == f"{n} {r[id_col]}" for r in got for n in names)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    ids, same = unchanged(stage(spark, docs, SF))
    assert same and (name == "quality_classifier" or ids == {0, 1, 2, 3})


@pytest.mark.parametrize("part_chars", [bpe.PART_CHARS, 1_000])
def test_bpe(spark, docs, part_chars):
    encoded = bpe.encode(docs, out="made", part_chars=part_chars)
    assert unchanged(encoded) == ({0, 1, 2, 3}, True)
    assert unchanged(bpe.decode(encoded, "made", "text_again")) == ({0, 1, 2, 3}, True)


def test_scans_and_scores(spark, docs):
    assert unchanged(secret_scan.secret_spans(docs)) == ({0, 1, 2, 3}, True)
    assert unchanged(secret_scan.redact(docs)) == ({0, 1, 2, 3}, True)
    assert unchanged(quality.with_scores(docs, quality.Model(constant=0.5), out="made")) == ({0, 1, 2, 3}, True)
    items = spark.createDataFrame([(1, prose(80, 1))], "item_id long, text string").withColumns({"seed": F.lit(1), "words": F.lit("x"), "doc_id": F.lit(3)})
    assert unchanged(decontaminate.decontaminated(docs, items)) == ({1, 2, 3}, True)
    assert {r.doc_id for r in decontaminate.overlaps(docs, items).collect()} == {0}


def test_counts_and_digests(spark, docs):
    assert {r.id for r in token_counts.count_tokens(docs).collect()} == {0, 1, 2, 3}
    assert {r.doc_id for r in quartile_digest.compare_neighbours(docs).collect()} == {0, 1, 2, 3}
