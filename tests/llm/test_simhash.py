import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import AWKWARD, docs_of, prose

from tidegraph.llm import simhash
from tidegraph.llm.components import connected_components
from tidegraph.llm.queries import QUERIES


def plain_fingerprint(text, words=3):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, max_bits=2):
    """{key: fingerprint} -> {key: smallest key reachable}, by comparing all pairs."""
    root = {k: k for k in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    keys = sorted(values)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (values[a] ^ values[b]).bit_count() <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    text = text.encode("utf-8", "replace").decode()
    assert int.from_bytes(simhash.fingerprint(text)) == plain_fingerprint(text)


def test_fingerprint_of_long_text():
    text = prose(2_000)
    assert int.from_bytes(simhash.fingerprint(text)) == plain_fingerprint(text)
    long = " ".join([text] * 40)  # more shingles than are hashed at once
    assert int.from_bytes(simhash.fingerprint(long)) == plain_fingerprint(long)


def test_fingerprint_of_very_long_text_without_repeats():
    for seed in (19, 20, 21):
        text = prose(150_000, seed)
        assert int.from_bytes(simhash.fingerprint(text)) == plain_fingerprint(text)


def test_awkward_rows(spark):
    docs = docs_of(spark, AWKWARD).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id")
    got = {r.id: (int.from_bytes(r.fp), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    values = {i: plain_fingerprint(t) for i, t in enumerate(AWKWARD)}
    want = plain_components(values)
    assert got == {i: (values[i], want[i]) for i in values}
    assert [got[i][1] for i in (0, 1, 2, 3)] == [0, 0, 0, 0]  # no words: zero, linked


def test_missing_and_repeated_ids(spark):
    a, b = prose(40, 1), prose(40, 2)
    docs = docs_of(spark, [a, a, a, b, b], [7, 7, None, None, None])
    got = sorted(str((r.id, r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted(map(str, [(7, 7), (7, 7), (None, 7), (None, None), (None, None)]))


def test_id_on_two_texts(spark):
    docs = docs_of(spark, [prose(40, 1), prose(40, 2)], [7, 7])
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [7, 7]


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 8, "GROUP_IN_MEMORY": 20}])
def test_dense_groups(spark, monkeypatch, limits):
    """Fingerprints close together: long chains, hot keys, blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(simhash, name, value)
    draw = random.Random(5)
    values = {}
    for centre in range(3):
        base = draw.getrandbits(64)
        for _ in range(60):
            value = base
            for _ in range(draw.randint(0, 4)):
                value ^= 1 << draw.randrange(64)
            values[len(values)] = value
    values = {k: v for k, v in values.items() if v not in list(values.values())[:k]}
    fps = spark.createDataFrame([(k, v.to_bytes(8)) for k, v in values.items()], "id long, fp binary")
    roots = {r.node: r.root for r in connected_components(simhash.near_links(fps)).collect()}
    assert {k: roots.get(k, k) for k in values} == plain_components(values)


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)] + [(3, 3), (6, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(6, 60)}


def test_recall_at_eight_tenths(spark):
    """Texts that share most of their five-word shingles meet; unrelated ones don't."""
    draw = random.Random(3)
    texts = []
    for n in range(40):
        words = prose(300, n).split()
        other = list(words)
        for at in draw.sample(range(300), 4):  # about 0.88 of the shingles stay
            other[at] = "changed"
        texts += [" ".join(words), " ".join(other)]
    found = simhash.near_duplicates(docs_of(spark, texts), words=5, lanes=7, segments=17, width=26, max_bits=70).collect()
    component = {r.id: r.component_id for r in found}
    assert sum(component[i] == component[i + 1] for i in range(0, 80, 2)) >= 36
    assert len(set(component.values())) >= 40


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    values = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    want = plain_components(values)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, sf).collect()}
    assert got == {k: (f"{v:016x}", want[k]) for k, v in values.items()}
