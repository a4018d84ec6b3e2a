"""Versioned tables, and node state kept in them by a stream."""
import random

import pytest
from tidegraph.operators import state as M
from tidegraph.sources import commits, versioned
from tidegraph.streaming import ingest, memory

FEATS = "id long, feat array<float>"


def frame(spark, rows, schema=FEATS):
    return spark.createDataFrame(rows, schema)


def as_dict(df):
    return {r.id: list(r.feat) for r in df.collect()}


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.create(frame(spark, [(i, [float(i)]) for i in range(100)]), path)
    versioned.append(frame(spark, [(5, [50.0], 1), (5, [51.0], 2), (200, [7.0], 1)], f"{FEATS}, at int"), path, 1, order="at")
    versioned.append(frame(spark, [(5, [52.0]), (7, [70.0])]), path, 4)
    return path


WANT = {0: {i: [float(i)] for i in range(100)}}
WANT[1] = WANT[0] | {5: [51.0], 200: [7.0]}
WANT[4] = WANT[1] | {5: [52.0], 7: [70.0]}


def test_reads_at_versions_before_and_after_compaction(spark, table):
    def check():
        for version, want in ((0, WANT[0]), (1, WANT[1]), (3, WANT[1]), (4, WANT[4]), (None, WANT[4])):
            assert as_dict(versioned.read(spark, table, version)) == want
    check()
    assert versioned.compact(spark, table, 1) == 1
    check()
    assert versioned.compact(spark, table) == 4
    check()
    versioned.append(frame(spark, [(0, [-1.0])]), table, 9)
    assert as_dict(versioned.read(spark, table)) == WANT[4] | {0: [-1.0]}
    versioned.drop_versions(spark, table, 4)
    assert as_dict(versioned.read(spark, table, 4)) == WANT[4] and versioned.versions(spark, table) == [4, 9]
    with pytest.raises(ValueError):
        versioned.read(spark, table, 1)


def test_update_writes_its_own_rows(spark, table):
    assert spark.read.parquet(f"{table}/delta/version=1").count() == 2
    assert spark.read.parquet(f"{table}/delta/version=4").count() == 2


def test_repeated_and_older_versions(spark, table):
    assert not versioned.append(frame(spark, [(1, [9.0])]), table, 4)
    assert as_dict(versioned.read(spark, table)) == WANT[4]
    with pytest.raises(ValueError):
        versioned.append(frame(spark, [(1, [9.0])]), table, 3)


def test_unfinished_versions_are_not_seen(spark, table):
    frame(spark, [(1, [9.0])]).write.parquet(f"{table}/delta/version=6")
    assert as_dict(versioned.read(spark, table)) == WANT[4]
    assert versioned.append(frame(spark, [(1, [8.0])]), table, 6)
    assert as_dict(versioned.read(spark, table)) == WANT[4] | {1: [8.0]}


def test_lookup_prunes_deltas(spark, table):
    asked = frame(spark, [(0, 7), (1, 999), (2, 7), (3, 5), (4, 200)], "req long, id long")
    for version in (0, 1, 4):
        got = {r.req: r.feat and list(r.feat) for r in versioned.lookup(spark, table, asked, version).collect()}
        assert got == {q: WANT[version].get(i) for q, i in enumerate([7, 999, 7, 5, 200])}
    # version 4 has keys 5 to 7 only: its files aren't opened
    files = versioned.read(spark, table, wanted=frame(spark, [(90,), (95,)], "id long")).inputFiles()
    assert not any("version=4" in f for f in files)
    assert versioned.read(spark, table, wanted=frame(spark, [], "id long")).count() == 0


def test_commit_names(spark, tmp_path):
    path = str(tmp_path)
    assert commits.commits(spark, path) == []
    commits.commit(spark, path, "delta", 3, None, -5)
    commits.commit(spark, path, "delta", 3, None, -5)
    commits.commit(spark, path, "base", 0, 1, 2)
    assert commits.commits(spark, path) == [("base", (0, 1, 2)), ("delta", (3, None, -5))]


# --- node state by a stream ---------------------------------------------------------------------

MEM, EDGE = 3, 2
MAIL = 2 * MEM + EDGE
EDGES = "src long, dst long, ts long, eid long, feat array<float>"


def random_edges(n, seed, nodes=12):
    draw = random.Random(seed)
    return [(draw.randrange(nodes), draw.randrange(nodes), i * 10, i, [draw.randint(0, 9) / 2, float(i)]) for i in range(n)]


def plain(batches, start, updater):
    """State after all batches, one edge at a time."""
    state = dict(start)
    zero = ([0.0] * MEM, 0, [0.0] * MAIL, 0)
    for batch in batches:
        fresh_mem, fresh_mail, new = {}, {}, {}
        for role in (0, 1):
            for e in sorted(batch, key=lambda e: e[3]):
                mem, mem_ts, mail, _ = state.get(e[role], zero)
                new[e[3], role] = updater(mem, mail, e[2] - mem_ts)
                fresh_mem[e[role]] = (new[e[3], role], e[2])
        for e in sorted(batch, key=lambda e: e[3]):
            for role in (0, 1):
                fresh_mail[e[role]] = (new[e[3], role] + new[e[3], 1 - role] + list(e[4]), e[2])
        for node in fresh_mem:
            state[node] = (*fresh_mem[node], *fresh_mail[node])
    return state


def stored(df):
    return {r.node: (list(r.mem), r.mem_ts, list(r.mail), r.mail_ts) for r in df.collect()}


def start_rows():
    return [(i, [1.0 * i, 2.0, -1.0], 0, [0.5 * i] * MAIL, 0) for i in range(0, 12, 2)]


def test_stream_equals_batches_applied_one_by_one(spark, tmp_path):
    """With a batch that is repeated, a restart in between, and compaction."""
    rows = random_edges(60, 3)
    batches = [rows[:20], rows[20:21], rows[21:40], rows[40:]]
    path, check = str(tmp_path / "state"), str(tmp_path / "c")
    schema = memory.empty_state(spark).schema
    versioned.create(spark.createDataFrame(start_rows(), schema), path, "node")
    stream = lambda: ingest.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], EDGES).schema, files_per_trigger=1)

    def arrive(batch):
        spark.createDataFrame(batch, EDGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    run = lambda: memory.node_memory_stream(stream(), path, check, MEM, EDGE, memory.towards_mail(0.25), compact_every=3).awaitTermination()
    arrive(batches[0])
    arrive(batches[1])
    run()
    # the second batch comes again, as after a failure before its offset was stored
    assert not memory.apply_batch(spark.createDataFrame(batches[1], EDGES), path, 2, MEM, EDGE)
    arrive(batches[2])
    arrive(batches[3])
    run()
    begin = {n: (m, t, x, u) for n, m, t, x, u in start_rows()}
    move = lambda mem, mail, dt: [a * 0.75 + b * 0.25 for a, b in zip(mem, mail)]
    for k in range(5):
        want = plain(batches[:k], begin, move)
        got = stored(versioned.read(spark, path, k, "node"))
        assert got.keys() == want.keys()
        for node, (mem, mem_ts, mail, mail_ts) in want.items():
            assert got[node][1::2] == (mem_ts, mail_ts) and got[node][0] == pytest.approx(mem) and got[node][2] == pytest.approx(mail)
    assert [c.values[0] for c in commits.commits(spark, path, "base")] == [0, 3]


def test_stream_step_equals_batch_operators(spark):
    """update_memory and update_mailbox of the batch, with the same new memories."""
    rows = random_edges(30, 5)
    edges = spark.createDataFrame(rows, EDGES)
    state = spark.createDataFrame(start_rows(), memory.empty_state(spark).schema)
    got = stored(memory.batch_update(edges, state, MEM, EDGE))
    known = {n: m for n, m, *_ in start_rows()}
    zero = [0.0] * MEM
    marks = [(0, e[3] + 30 * role, ("src", "dst")[role], e[role], e[2], known.get(e[role], zero)) for e in rows for role in (0, 1)]
    batch = spark.createDataFrame(marks, "batch_id long, pos long, role string, node long, ts long, mem array<double>")
    talks = spark.createDataFrame([(0, e[3], e[0], e[1], e[2], known.get(e[0], zero), known.get(e[1], zero), e[4]) for e in rows],
                                  "batch_id long, i long, src long, dst long, ts long, mem_src array<double>, mem_dst array<double>, feat array<float>")
    after = M.update_mailbox(M.update_memory(state, batch, MEM, MAIL), talks, MEM, MAIL)
    touched = {n for e in rows for n in e[:2]}
    assert got == {n: v for n, v in stored(after).items() if n in touched}


def test_empty_micro_batch(spark, tmp_path):
    path = str(tmp_path / "s")
    versioned.create(memory.empty_state(spark), path, "node")
    assert memory.apply_batch(spark.createDataFrame([], EDGES), path, 1, MEM, EDGE)
    assert versioned.versions(spark, path) == [0, 1] and versioned.read(spark, path, key="node").count() == 0
