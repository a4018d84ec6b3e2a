"""From raw documents to tokens: each stage works on all that the one before kept.

All stages but the last return the columns of documents. Null texts count as empty throughout, rows are
told apart whether their ids are repeated or missing, an empty table gives an empty one, and columns
besides those of documents come through whatever their names; only the last stage replaces columns
named ids, n_tokens and round_trip by its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import bpe, decontaminate, quality, secret_scan, shingle_pairs
from tidegraph.llm.common import column, free_name, schema_with
from tidegraph.llm.tokens import vocabulary
from tidegraph.plans.storage import freeze, new_path, scratch

GOOD = 0.3

# Near-duplicates share 80 hundredths or more of their distinct five-word shingles. SimHash links those
# whose fingerprints differ in up to 16 bits of 64; what it doesn't meet is searched for exactly.
NEAR = {"words": 5, "similar": 80, "bits": 16}


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "score")
    return quality.with_scores(docs, model, out=score).filter(F.col(score) >= GOOD).drop(score)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest id. Groups are linked by
    SimHash, confirmed and completed by the shared shingles. Rows are told apart by number, whether their ids are repeated or missing."""
    row = free_name(docs, "row")
    rows = freeze(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = shingle_pairs.similar_rows(rows.select(F.col(row).alias("row"), "text"), **NEAR)
    ids = rows.select(F.col(row).alias("row"), "doc_id")
    by_id = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = groups.join(ids, "row").groupBy("root").agg(F.min(by_id).alias("first")).select(F.col("first.row").alias(row))
    return rows.join(first, row, "left_semi").select(*map(column, docs.columns))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return secret_scan.redact(docs, "text", "n_chars", secret_scan.learn_identifiers(docs))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids, their number, and whether decoding them gives the text back."""
    json = vocabulary()
    schema = schema_with(docs, ids="array<int>", n_tokens="bigint", round_trip="boolean")
    return bpe.encode(docs, vocabulary_json=json, then=bpe.check_batches(json), then_schema=schema)


STAGES = [("quality_classifier", good_quality), ("simhash_near_dedup", deduplicated),
          ("benchmark_decontamination", clean_of_benchmark), ("secret_scans", without_secrets),
          ("bpe_encoding", tokenised)]

# None: trained scores, XXH64 fingerprints and compression have no equal in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read again by the next. What a
    stage writes on the way is deleted when its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
