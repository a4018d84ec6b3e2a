import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_data import prose
from tidegraph.llm import prefix_trie as t
from tidegraph.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends, parent = defaultdict(set), defaultdict(list), {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[c] for c in children[p])
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("clash"), "size": F.lit(1), "ka": F.lit(2)})
    return sorted(map(tuple, t.trie_nodes(t.rebuilt(df), **how).collect()))


def conversations(n=120, seed=1, shared=0.5):
    """Some conversations repeat turns of earlier ones, some grow very alike."""
    draw, rows, made = random.Random(seed), [], []
    for c in range(n):
        turns = [(draw.choice(["user", "assistant"]), prose(draw.randint(0, 9), draw.randint(0, 400))) for _ in range(draw.randint(1, 7))]
        if made and draw.random() < shared:
            turns = made[draw.randrange(len(made))][:draw.randint(1, 7)] + turns[:draw.randint(0, 3)]
        made.append(turns)
        rows += [(c, i, r, x) for i, (r, x) in enumerate(turns)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [None, 3, 20, 100])
def test_against_brute_force(spark, limit):
    rows = conversations()
    assert found(spark, rows, limit=limit) == brute(rows)


def test_awkward_rows(spark):
    rows = [(0, None, None, None), (0, None, "user", None), (0, 3, None, "a b"), (0, 3, "user", "a b c"), (None, 1, "user", "lost"), (1, 0, "user", ""),
            (1, 0, "user", ""), (7, -5, "x", "y" * 40_000 + " z"), (7, -5, "x", "y" * 40_000 + " a"), (41, 0, "user", "alone"), (26, 2, "r", "t"), (20, 0, "q", "é \U0001f600")]
    rows += [(c, 0, "user", "the same") for c in range(60, 80)]
    for limit in (None, 2):
        assert found(spark, rows, limit=limit) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "lost")]) == []


def test_long_conversations_and_hot_nodes(spark):
    """Chains of heavy nodes with branches, a node with very many children, and one with many ends."""
    chain = [("user", f"turn {i}") for i in range(150)]
    rows = [(c, i, *turn) for c, upto in enumerate(range(0, 150, 3)) for i, turn in enumerate(chain[:upto] + [("user", f"leaf of {c}")])]
    rows += [(c, i, r, x) for c in range(100, 300) for i, (r, x) in enumerate([("system", "s"), ("user", f"own {c}"), ("user", f"more {c}"), ("user", "end"), ("user", f"{c}")])]
    rows += [(c, i, r, x) for c in range(300, 400) for i, (r, x) in enumerate([("system", "s"), ("user", "same"), ("user", "same"), ("user", "same"), ("user", "same")])]
    want = brute(rows)
    for limit in (5, 60):
        assert found(spark, rows, limit=limit) == want
    spark.conf.set("spark.tidegraph.maxGroupRows", "20")
    try:
        assert found(spark, rows, limit=40, held=3) == want
    finally:
        spark.conf.unset("spark.tidegraph.maxGroupRows")


def test_queue_spills():
    draw = random.Random(3)
    queue, want = t.MessageQueue(2, held=16), defaultdict(lambda: [0, 0])
    for _ in range(1_000):
        key, values = (draw.randint(-3, 0), draw.randint(0, 20), draw.randint(-2, 2)), (draw.randint(0, 9), 1)
        queue.push((*key, *values))
        want[key] = [a + b for a, b in zip(want[key], values)]
    assert queue.runs and len(queue.heap) <= 17
    for key in sorted(want):
        assert queue.take(key) == want[key]
    assert not len(queue) and queue.take((1, 1, 1)) == [0, 0]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_prefix_trie"](spark, sf).collect())) == brute(rows)


def test_query_equals_its_sql(spark):
    from oracle_check import connect, difference
    sf = "/root/testdata/sf0.01"
    assert difference(QUERIES["op11_prefix_trie"](spark, sf).toPandas(), connect(sf).sql(SQL["op11_prefix_trie"]).df()) is None
