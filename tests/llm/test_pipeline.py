"""The stages of corpus_pipeline against plain versions of themselves, each on its own input."""
import re

import pytest
from llm_data import AWKWARD, docs_of
from oracle_check import connect, difference
from test_tokens import ids_of

import corpus_pipeline
from tidegraph.llm import quality, secret_scan
from tidegraph.llm.queries import QUERIES, SQL
from tidegraph.plans.storage import freeze

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output rows) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = freeze(stage(spark, docs, SF), name)
        out.append((name, {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}))
        docs = after
    return out


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_columns(stages):
    for name, before, after in stages:
        columns = list(next(iter(before.values())).asDict())
        assert list(next(iter(after.values())).asDict())[:len(columns)] == columns


def test_quality_stage(spark, stages):
    _, before, after = stages[0]
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = list(before)
    assert set(after) == {i for i, s in zip(ids, model.scores([before[i].text for i in ids])) if s >= corpus_pipeline.GOOD}


def test_near_duplicate_stage(stages):
    """What goes is similar to something that was there, and nothing that stays is similar to another."""
    _, before, after = stages[1]
    sets = {i: shingles(r.text) for i, r in before.items()}
    similar = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    for i in set(before) - set(after):
        assert any(similar(i, j) for j in before if j != i)
    kept = sorted(after)
    for n, i in enumerate(kept):
        assert not any(similar(i, j) for j in kept[:n])


def test_benchmark_stage(spark, stages):
    _, before, after = stages[2]
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holding = {i for i, r in before.items() if any(f" {item} " in f" {norm(r.text)} " for item in items)}
    assert holding.isdisjoint(after) and len(before) - len(after) <= 2 * len(holding)


def test_secret_stage(spark, stages):
    _, before, after = stages[3]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    scanner = secret_scan.Scanner(secret_scan.learn_identifiers(spark.createDataFrame(list(before.values()), schema)))
    assert set(before) == set(after)
    for i, r in before.items():
        assert after[i].text == secret_scan.redacted(r.text, scanner.spans(r.text)) and after[i].n_chars == len(after[i].text)


def test_token_stage(stages):
    _, before, after = stages[4]
    assert set(before) == set(after)
    assert all(r.round_trip and r.ids == ids_of(r.text) and r.n_tokens == len(r.ids) for r in after.values())


def test_awkward_documents(spark):
    docs = docs_of(spark, AWKWARD + [AWKWARD[-1]], [*range(len(AWKWARD)), 0]).union(docs_of(spark, ["no id"], [None]))
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, SF).count() <= len(AWKWARD) + 2


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: r.n_tokens for i, r in stages[-1][2].items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), connect(SF).sql(SQL[name]).df()) is None
