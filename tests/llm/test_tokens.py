import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import AWKWARD, docs_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegraph.llm import bpe, token_counts
from tidegraph.llm.queries import QUERIES
from tidegraph.llm.tokens import codec, vocabulary

JSON = vocabulary()
LIBRARY = Tokenizer.from_str(JSON)
TEXTS = AWKWARD + ["<|endoftext|>", "a <|endoftext|>  <|endoftext|>b \n", "don't we'll 've  x", "1234 ١٢٣ ½", "՘ᲀ \U0001f1e6" * 30,
                   "a\x1cb\x85c\xa0d\u2028e", " " * 3_000 + "x" + "\n" * 500, "<|endoftext" + "|>" * 3]
WORDS = st.lists(st.sampled_from(["a", "b", "ab", "the", " ", "  ", "\n", "'", "s", "ll", "re", "1", "12", "é", "日", ".", "!?", "␛", "\t"]), max_size=120).map("".join)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.one_of(st.text(max_size=80), WORDS))
@settings(max_examples=300, deadline=None)
def test_codec(text):
    text = text.encode("utf-8", "replace").decode()
    c = codec(JSON)
    ids = ids_of(text)
    assert c.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert b"".join(c.token_bytes[i] for i in ids).decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


@given(st.lists(st.integers(0, 50_256), max_size=30))
@settings(max_examples=200, deadline=None)
def test_decoding_of_any_ids(ids):
    c = codec(JSON)
    assert b"".join(c.token_bytes[i] for i in ids).decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("long_word", [bpe.LONG_WORD, 1])
def test_joins(monkeypatch, long_word):
    monkeypatch.setattr(bpe, "LONG_WORD", long_word)
    joiner, draw = bpe.Joiner(codec(JSON)), random.Random(1)
    alphabets = ["ab", ["aab", "a "], ["the", " "], ["a", "'s", "l", "l "], ["é", "日", "a", "b "], "  \n\tx", ["1", "2", "ab "], ["'re", "'ve"], ["!?", ".", ",a"],
                 ["abc", "deth", "theion", "r"]]
    for _ in range(1_500):
        alphabet = draw.choice(alphabets)
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 200)))
        parts = [joiner.part(p) for p in bpe.halves(text, draw.randint(1, 40))]
        assert joiner.concatenate(parts).tolist() == ids_of(text), repr(text)


@given(st.text(max_size=300), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_halves(text, most):
    parts = bpe.halves(text, most)
    assert "".join(parts) == text and max(map(len, parts)) <= most and len(parts) & (len(parts) - 1) == 0


@pytest.mark.parametrize("part_chars", [bpe.PART_CHARS, 100])
def test_encode_and_decode(spark, part_chars):
    docs = docs_of(spark, TEXTS + TEXTS).withColumnRenamed("lang", "ids").withColumnRenamed("source", "row").withColumnRenamed("n_chars", "_row")
    encoded = bpe.encode(docs, part_chars=part_chars)
    assert encoded.columns == ["doc_id", "text", "row", "_row", "ids"]
    rows = bpe.decode(encoded).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: ids_of(t) for i, t in enumerate(TEXTS + TEXTS)}
    assert {r.doc_id: r.decoded for r in rows} == {i: t or "" for i, t in enumerate(TEXTS + TEXTS)}


def test_repeated_and_missing_ids(spark):
    docs = docs_of(spark, ["ab " * 100, "ab " * 100, "cd " * 100], [1, 1, None])
    got = sorted((str(r.doc_id), r.ids) for r in bpe.encode(docs, part_chars=50).collect())
    assert got == sorted((str(i), ids_of(t)) for i, t in [(1, "ab " * 100), (1, "ab " * 100), (None, "cd " * 100)])
    got = sorted((str(r.id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, head_sample=1.0).collect())
    assert got == sorted((str(i), 300, len(ids_of(t))) for i, t in [(1, "ab " * 100), (1, "ab " * 100), (None, "cd " * 100)])


@pytest.mark.parametrize("head", [0, 20, 200_000])
def test_counts(spark, head):
    docs = docs_of(spark, TEXTS).withColumnRenamed("lang", "row").withColumnRenamed("source", "words")
    got = {r.id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, head=head, head_sample=1.0).collect()}
    assert got == {i: (len((t or "").encode()), len(ids_of(t))) for i, t in enumerate(TEXTS)}


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    assert token_counts.count_tokens(empty).count() == 0
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_null_ids(spark):
    rows = bpe.decode(docs_of(spark, ["a"]).withColumn("ids", F.lit(None).cast("array<int>"))).collect()
    assert [r.decoded for r in rows] == [None]


def test_queries(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: ids_of(t) for d, t in docs.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op9_token_counts"](spark, sf).collect()}
    assert got == {d: (len(t.encode()), len(ids[d]), len(ids[d]) > 512) for d, t in docs.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_bpe"](spark, sf).collect()}
    assert got == {d: (len(ids[d]), sha(",".join(map(str, ids[d]))), sha(LIBRARY.decode(ids[d], skip_special_tokens=False))) for d in docs}
