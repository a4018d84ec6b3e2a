import random

import pytest
from frames import rows

from tidegraph.operators import sampling as S
from tidegraph.sources import ranked

EDGES = "src long, dst long, ts long, eid long, seq long"


def batches(seed=2, n=200, parts=5):
    """Rows in the order of time, but for some that come batches later."""
    draw, out = random.Random(seed), [[] for _ in range(parts)]
    for i in range(n):
        at = i * parts // n
        if draw.random() < 0.06:
            at = min(parts - 1, at + draw.randint(1, 3))
        out[at].append((draw.choice([0, 0, 0, 1, 2, 3, 50 + i]), draw.randrange(9), i // 4, i, i))
    return out


def frame(spark, rows_):
    return spark.createDataFrame(rows_, EDGES)


@pytest.mark.parametrize("strategy", ["auto", "ranged"])
def test_equals_ranking_everything(spark, tmp_path, strategy):
    path, seen = str(tmp_path), []
    for version, batch in enumerate(batches(), 1):
        assert ranked.append_ranked(frame(spark, batch), path, version, strategy)
        seen += batch
        got = sorted(rows(ranked.read_ranked(spark, path), *ranked.EDGE, "rk"))
        want = sorted(rows(S.rank_edges(frame(spark, seen), static=True), *ranked.EDGE, "rk"))
        assert got == want
    sizes = {r.src: (r.n, r.last_ts, r.last_seq) for r in ranked.source_sizes(spark, path).collect()}
    assert sizes == {s: (sum(e[0] == s for e in seen), *max((e[2], e[4]) for e in seen if e[0] == s)) for s in {e[0] for e in seen}}
    # earlier versions stay as they were
    early = sorted(rows(ranked.read_ranked(spark, path, 2), *ranked.EDGE, "rk"))
    want = sorted(rows(S.rank_edges(frame(spark, sum(batches()[:2], [])), static=True), *ranked.EDGE, "rk"))
    assert early == want


def test_an_append_in_order_reads_no_old_edges(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    ranked.append_ranked(frame(spark, [(1, 2, 10, 0, 0), (2, 2, 10, 1, 1)]), path, 1)
    monkeypatch.setattr(ranked, "read_ranked", lambda *a, **k: pytest.fail("old edges were read"))
    ranked.append_ranked(frame(spark, [(1, 3, 11, 2, 2), (1, 3, 10, 3, 3), (9, 9, 0, 4, 4)]), path, 2)
    monkeypatch.undo()
    assert sorted(rows(ranked.read_ranked(spark, path), "src", "eid", "rk")) == [(1, 0, 1), (1, 2, 3), (1, 3, 2), (2, 1, 1), (9, 4, 1)]
    # and their plan has neither a sort nor a shuffle
    plan = ranked.read_ranked(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Join" not in plan


def test_late_rows_rank_their_source_only(spark, tmp_path):
    path = str(tmp_path)
    ranked.append_ranked(frame(spark, [(s, 2, t, 10 * s + t, 10 * s + t) for s in (1, 2) for t in range(3)]), path, 1)
    ranked.append_ranked(frame(spark, [(1, 7, 1, 99, 99), (2, 7, 9, 98, 98)]), path, 2)
    written = spark.read.parquet(f"{path}/edges/version=2")
    assert sorted(rows(written, "src", "eid", "rk")) == [(1, 10, 1), (1, 11, 2), (1, 12, 4), (1, 99, 3), (2, 98, 4)]
    assert ranked.read_ranked(spark, path).count() == 8


def test_repeated_versions_and_bad_rows(spark, tmp_path):
    path = str(tmp_path)
    ranked.append_ranked(frame(spark, [(1, 2, 10, 0, 0)]), path, 3)
    assert not ranked.append_ranked(frame(spark, [(1, 2, 11, 1, 1)]), path, 3)
    with pytest.raises(ValueError):
        ranked.append_ranked(frame(spark, [(1, 2, 11, 1, 1)]), path, 2)
    with pytest.raises(Exception, match="before 0"):
        ranked.append_ranked(frame(spark, [(1, 2, -1, 1, 1)]), path, 4)
    assert ranked.read_ranked(spark, path).count() == 1
    with pytest.raises(ValueError):
        ranked.read_ranked(spark, path, 1)


def test_sampling_from_stored_ranks(spark, tmp_path):
    path, all_rows = str(tmp_path), sum(batches(), [])
    for version, batch in enumerate(batches(), 1):
        ranked.append_ranked(frame(spark, batch), path, version)
    roots = spark.createDataFrame([(i, i % 4, i) for i in range(50)], "rid long, node long, ts long")
    stored, edges = ranked.read_ranked(spark, path), frame(spark, all_rows)
    columns = ("rid", "slot", "eid", "dt")
    assert sorted(rows(S.sample_uniform(stored, roots, 4, seed=3), *columns)) == sorted(rows(S.sample_uniform(S.rank_edges(edges), roots, 4, seed=3), *columns))
    assert sorted(rows(S.sample_recent(stored, roots, 40), *columns)) == sorted(rows(S.sample_recent(edges, roots, 40), *columns))
