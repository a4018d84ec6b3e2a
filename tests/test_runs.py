import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from tidegraph.operators import continuous as C
from tidegraph.plans.storage import freeze
from tidegraph.streaming import runs

STEPS = 4


@pytest.fixture(scope="module")
def stepped(spark):
    draw = random.Random(9)
    edges = spark.createDataFrame([(draw.randrange(8), 100 + draw.randrange(12), 10 * i, i, i) for i in range(120)],
                                  "src long, dst long, ts long, eid long, seq long")
    return freeze(C.increments(edges, 40, STEPS), "stepped")


OPTIONS = dict(window=300, replay=0.25, val=0.2, seed=5)


def everything(spark, path):
    return {what: sorted(map(tuple, runs.results(spark, path, what).select(*sorted(runs.results(spark, path, what).columns)).collect()))
            for what in ("metrics", "retrain", "pool")}


def test_resumed_run_equals_an_unbroken_one(spark, stepped, tmp_path):
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    runs.continuous_run(stepped, whole, **OPTIONS)
    asked = []

    def scorer(known, questions):
        asked.append(1)
        if len(asked) == 4:
            raise RuntimeError("lost")
        return runs.popularity(known, questions)

    with pytest.raises(RuntimeError):
        runs.continuous_run(stepped, broken, scorer, **OPTIONS)
    assert [s for s, _ in runs.finished_steps(spark, broken)] == [0, 1, 2]
    before = everything(spark, broken)
    runs.continuous_run(stepped, broken, scorer, **OPTIONS)
    assert len(asked) == 5  # no complete step was scored again
    after = everything(spark, broken)
    assert all(set(before[k]) <= set(after[k]) for k in before)
    assert after == everything(spark, whole) and len(after["metrics"]) == STEPS
    runs.continuous_run(stepped, broken, scorer, **OPTIONS)
    assert len(asked) == 5


def test_steps_by_hand(spark, stepped, tmp_path):
    path, seen = str(tmp_path), {}

    def scorer(known, questions):
        step = len(seen)
        seen[step] = set(rows(known, "eid"))
        return runs.popularity(known, questions)

    runs.continuous_run(stepped, path, scorer, **OPTIONS)
    everyone = stepped.collect()
    before = None
    for step in range(STEPS):
        assert seen[step] == {(r.eid,) for r in everyone if r.step < step and (before is None or r.ts >= before)}
        before = min((r.ord, r.ts) for r in everyone if r.step == step)[1] - 300
    retrain = runs.results(spark, path, "retrain").collect()
    for step in range(STEPS):
        mine = [r for r in retrain if r.step == step]
        start = 40 + 20 * step
        old = [r for r in mine if r.replay >= 0]
        low = min(r.ord for r in everyone if r.ts >= 10 * start - 300)
        assert len(old) == int(0.25 * start) and all(low <= r.ord < start for r in old)
        assert sorted(r.ord for r in mine if r.replay < 0) == list(range(start, start + 20))
        assert sum(r.part == "train" for r in mine) == int(len(mine) * 0.8) + 1
    assert runs.results(spark, path, "pool").filter(F.col("step") == STEPS - 1).count() == len({r.dst for r in everyone})


def test_without_window_and_replay(spark, stepped, tmp_path):
    runs.continuous_run(stepped, str(tmp_path), stop_after=1)
    assert runs.finished_steps(spark, str(tmp_path)) == [(0, None), (1, None)]
    assert runs.results(spark, str(tmp_path), "retrain").count() == 40
