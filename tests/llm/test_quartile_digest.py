import hashlib
import random

from pyspark.sql import functions as F

from llm_data import AWKWARD, docs_of, prose
from tidegraph.llm import quartile_digest as q
from tidegraph.llm.queries import QUERIES


def plain_digest(text):
    """The digest byte by byte."""
    data = (text or "").encode()
    counts = [0] * q.BUCKETS
    if data:
        data = data.ljust(4, b"\0")
        for i in range(len(data) - 3):
            for salt, places in enumerate(q.TRIPLETS):
                h = salt + 1
                for place, m in zip(places, q.MULTIPLIERS):
                    h = ((h ^ data[i + place]) * m) & 0xFFFFFFFF
                    h ^= h >> 15
                counts[h >> 24] += 1
    s = sorted(counts)
    quartiles = [s[63], s[127], s[191]]
    codes = [sum(c > x for x in quartiles) for c in counts]
    return codes, quartiles


def codes_of(mark):
    return [(b >> shift) & 3 for b in bytes.fromhex(mark)[2:] for shift in (6, 4, 2, 0)]


def plain_neighbours(rows):
    """[(doc_id, text)] in order -> doc_id, edited text, next text."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        out.append((doc_id, text, text[:len(text) - half] + other[:half], other))
    return out


def checked(spark, texts, ids=None, parts=4):
    got = q.compare_neighbours(docs_of(spark, texts, ids).withColumn("part", F.lit("clash")).withColumn("edge", F.lit(1))).collect()
    order = list(zip(range(len(texts)) if ids is None else ids, [t or "" for t in texts]))
    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), q.digest(t), q.digest(e), q.likeness(q.digest(t), q.digest(e)),
             q.likeness(q.digest(t), q.digest(o))) for i, t, e, o in plain_neighbours(order)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    return got


def test_digest_is_the_plain_one():
    for text in ["", "a", "abc", "abcd", prose(40), "é日本\U0001f600" * 30, "x" * 5_000]:
        codes, (q1, q2, q3) = plain_digest(text)
        mark = q.digest(text)
        assert codes_of(mark) == codes and len(mark) == 2 * (2 + q.BUCKETS // 4)
        assert bytes.fromhex(mark)[1] == 16 * (15 * q1 // max(q3, 1)) + 15 * q2 // max(q3, 1)


def test_pieces_of_long_texts_add_up(monkeypatch):
    text = prose(2_000, 3)
    whole = q.digest(text)
    monkeypatch.setattr(q, "PIECE", 1_000)
    assert q.digest(text) == whole


def test_difference_is_bounded_and_symmetric():
    marks = [q.digest(t) for t in ["", "a", "zz", prose(50, 1), prose(5_000, 2), "q" * 100_000]]
    for a in marks:
        assert q.difference(a, a) == 0 and q.likeness(a, a) == 1
        for b in marks:
            assert 0 <= q.difference(a, b) == q.difference(b, a) <= q.BOUND
            plain = sum(q.CODE_WEIGHTS[abs(x - y)] for x, y in zip(codes_of(a), codes_of(b)))
            assert min(q.BOUND, plain) <= q.difference(a, b) <= plain + q.HEADER_BOUND


def test_smaller_edits_are_nearer():
    draw = random.Random(5)
    falling = 0
    for seed in range(20):
        words = prose(300, seed).split()
        marks = []
        for share in (0.0, 0.05, 0.2, 0.5, 1.0):
            other = [("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=len(w))) if draw.random() < share else w) for w in words]
            marks.append(q.likeness(q.digest(" ".join(words)), q.digest(" ".join(other))))
        assert marks[0] == 1
        falling += marks == sorted(marks, reverse=True)
    assert falling >= 19


def test_neighbours_against_brute_force(spark):
    checked(spark, AWKWARD)
    checked(spark, [prose(1 + i * 7 % 60, i) for i in range(300)], [(i * 37) % 300 for i in range(300)][:0] or list(range(0, 900, 3)))


def test_few_rows(spark):
    checked(spark, [prose(20)])
    checked(spark, ["ab", "xyz"])
    checked(spark, [None])
    assert checked(spark, []) == []


def test_repeated_and_missing_ids(spark):
    """Rows of one id and text may change places; a row of every kind is there."""
    texts, ids = ["same text here"] * 5 + ["other text of this one"], [3, 3, 3, 3, None, 7]
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0] or 0))
    got = q.compare_neighbours(docs_of(spark, texts, ids)).collect()
    want = sorted((i or -1, hashlib.sha256(e.encode()).hexdigest()) for i, _, e, _ in plain_neighbours(order))
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == want


def test_query(spark, sf):
    got = QUERIES["op13_fingerprints"](spark, sf).collect()
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    want = {i: (len(t), hashlib.sha256(e.encode()).hexdigest(), q.digest(t), q.digest(e)) for i, t, e, _ in plain_neighbours(docs)}
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got} == want and len(got) == len(docs)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_fingerprints(spark):
    got = q.fingerprints(docs_of(spark, AWKWARD).withColumn("id", F.lit(5)).withColumn("fingerprint", F.lit(5))).collect()
    assert {r.id: r.fingerprint for r in got} == {i: q.digest(t) for i, t in enumerate(AWKWARD)}
