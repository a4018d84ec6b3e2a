import random

import pytest
from llm_data import AWKWARD, docs_of, prose

import corpus_pipeline
from tidegraph.llm import shingle_pairs

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_roots(texts):
    """The smallest row reachable over pairs of Jaccard 0.8 or more, by comparing all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def changed(text, n, draw):
    words = text.split()
    for at in draw.sample(range(len(words)), n):
        words[at] = f"changed{draw.randrange(10**6)}"
    return " ".join(words)


def roots_of(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    found = {r.row: r.root for r in shingle_pairs.similar_rows(rows, 5, 80, **options).collect()}
    return [found[i] for i in range(len(texts))]


def kept(spark, texts, ids=None):
    return sorted(r.text for r in corpus_pipeline.deduplicated(spark, docs_of(spark, texts, ids), SF).collect())


def test_repeats_do_not_decide(spark):
    """A shared line that is repeated links nothing; a repeated ending separates nothing."""
    line = prose(10, 77)
    apart = [" ".join([line] * 20 + [prose(100, 300 + i)]) for i in range(3)]
    text = prose(300, 310)
    copy = " ".join([text] + [" ".join(text.split()[-10:])] * 15)
    assert kept(spark, apart + [text, copy]) == sorted(apart + [text])


@pytest.mark.parametrize("block", [shingle_pairs.BLOCK, 4])
def test_every_pair_at_eight_tenths(spark, monkeypatch, block):
    """Pairs with 0.76 to 0.87 of their shingles in common, groups of many copies, a common line."""
    monkeypatch.setattr(shingle_pairs, "BLOCK", block)
    draw = random.Random(3)
    texts = list(AWKWARD)
    for i in range(50):
        text = prose(300, 400 + i)
        texts += [text, changed(text, 4 + i % 5, draw)]
    many = prose(200, 500)
    texts += [changed(many, draw.randint(0, 6), draw) for _ in range(60)]
    line = prose(12, 501)
    texts += [f"{line} {prose(draw.randint(3, 40), 600 + i)}" for i in range(60)]
    draw.shuffle(texts)
    assert roots_of(spark, texts) == plain_roots(texts)


def test_stage_against_brute_force(spark):
    """Over the whole table, what stays is what comparing all pairs at 0.8 leaves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    want = {rows[i].doc_id for i, root in enumerate(plain_roots([r.text for r in rows])) if i == root}
    assert {r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, SF).collect()} == want


def test_rows_of_equal_and_missing_ids(spark):
    """Near copies go whatever their ids, other texts stay."""
    a, b, c = prose(40, 1), prose(40, 2), prose(40, 3)
    assert kept(spark, [a, b, b, c, c, a], [7, 7, 8, None, None, None]) == sorted([a, b, c])


def test_simhash_links_first(spark, monkeypatch):
    """Close copies are linked by fingerprints alone; with no exact pass after it, they are one group."""
    text = prose(300, 700)
    draw = random.Random(5)
    texts = [text] + [changed(text, 1, draw) for _ in range(10)] + [prose(300, 701)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    pairs = shingle_pairs._alike(rows, 5, corpus_pipeline.NEAR["bits"]).collect()
    met = {frozenset((p.a, p.b)) for p in pairs}
    assert len({i for p in met for i in p if i < 11}) > 8 and all(len(p) == 2 for p in met)
    asked = []
    links = shingle_pairs.near_links
    monkeypatch.setattr(shingle_pairs, "near_links", lambda *a, **o: asked.append(o) or links(*a, **o))
    assert kept(spark, texts) == sorted([texts[0], texts[11]]) and asked == [{"max_bits": corpus_pipeline.NEAR["bits"]}]


def test_rows_made_grow_with_the_group():
    """Loosely alike sets under one key: the likeliest pairs are fewer than the sets, and connect them."""
    import numpy as np
    import pyarrow as pa
    draw = np.random.default_rng(1)

    def made(m, likeliest):
        base = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
        sets = [np.unique(np.r_[base[20 + i % 20:], draw.integers(0, 1 << 63, 20, dtype=np.uint64)]) for i in range(m)]
        nodes = np.arange(m)
        one = np.zeros(m, np.int64)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(one), pa.array(one), pa.array(one), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array(one.astype(np.int32)),
             pa.array(nodes), pa.array([shingle_pairs._sketch(s) for s in sets], pa.binary())], ["key", "bi", "bj", "node", "n", "at", "root", "made"])
        return [(a, b) for out in shingle_pairs._left_apart(80, likeliest)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns))]

    for m in (10, 40, 160):
        forest = made(m, True)
        assert len(forest) == m - 1 and {i for p in forest for i in p} == set(range(m))
        assert len(made(m, False)) == m * (m - 1) // 2
