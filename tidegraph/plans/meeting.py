"""Positions of questions among the sorted edges of their node.

Edges and questions are shuffled once, by node, and sorted there: a node's edges by time, then its
questions. A task holds the edges of one node at a time; its questions stream past, numpy finds where
their bounds fall, and the chosen edges leave with their question. No answer is shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Workers get the functions by value, so this package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT = ["snapshot", "rid", "slot", "node", "ts", "src_node", "eid", "edge_ts"]

# (lowest positions, positions after the last, draws or None) -> (question, slot, position) of each chosen edge
Chosen = tuple[np.ndarray, np.ndarray, np.ndarray]


def newest(k: int) -> Callable[[np.ndarray, np.ndarray, list[np.ndarray]], Chosen]:
    """The k last positions of each range, the last one first."""
    def choose(low: np.ndarray, high: np.ndarray, draws: list[np.ndarray]) -> Chosen:
        n = np.minimum(high - low, k)
        asked = np.repeat(np.arange(len(n)), n)
        slot = np.arange(len(asked)) - np.repeat(np.cumsum(n) - n, n)
        return asked, slot, high[asked] - 1 - slot
    return choose


def drawn(low: np.ndarray, high: np.ndarray, draws: list[np.ndarray]) -> Chosen:
    """One position of each range for every draw, counted back from its end."""
    some = np.flatnonzero(high > low)
    back = np.stack([d[some] % (high - low)[some] for d in draws], axis=1)
    asked = np.repeat(some, len(draws))
    return asked, np.tile(np.arange(len(draws)), len(some)), high[asked] - 1 - back.ravel()


def answers(choose, draws: int, whole: bool, once: bool):
    """Rows (node, salt, asks, at, start, end, ts, rid, snapshot, dst, eid, draw_0, ...), those of a
    (node, salt) together, its edges (asks = 0) by time before its questions -> OUT.

    `whole`: a range begins with the first edge. `once`: of equal questions that follow each other
    one is answered.
    """
    def placed(edges_at: np.ndarray, rows: dict, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        high = np.searchsorted(edges_at, rows["end"][s:e])
        low = np.zeros_like(high) if whole else np.searchsorted(edges_at, rows["start"][s:e])
        return low, np.maximum(high, low)

    def rows_of(batch: pa.RecordBatch, questions: np.ndarray, edges: pa.RecordBatch, chosen: list[Chosen]) -> pa.RecordBatch:
        asked, slot, at = (np.concatenate(c) for c in zip(*chosen))
        asked, at = pa.array(questions[asked]), pa.array(at)
        mine = [batch.column(c).take(asked) for c in ("snapshot", "rid", "node", "ts")]
        theirs = [edges.column(c).take(at) for c in ("dst", "eid", "at")]
        return pa.RecordBatch.from_arrays([*mine[:2], pa.array(slot.astype(np.int32)), *mine[2:], *theirs], OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_at, group, last = [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False)
                    for c in ("node", "salt", "asks", "at", "start", "end", *(f"draw_{i}" for i in range(draws)))}
            node, salt, asks = rows["node"], rows["salt"], rows["asks"]
            starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (salt[1:] != salt[:-1])])
            ends = np.r_[starts[1:], len(node)]
            keep = asks == 1
            if once:
                same = [batch.column(c) for c in ("rid", "snapshot", "ts")]
                now = batch.select(["node", "rid", "snapshot", "ts", "asks"])
                equal = np.ones(len(node) - 1, bool)
                for column in same:
                    a, b = column.slice(0, len(column) - 1), column.slice(1)
                    both_null = np.asarray(a.is_null()) & np.asarray(b.is_null())
                    equal &= both_null | np.asarray(pc.fill_null(pc.equal(a, b), False))
                equal &= keep[1:] & keep[:-1] & (node[1:] == node[:-1])
                first = last is not None and now.slice(0, 1).to_pylist() == last
                keep &= ~np.r_[first, equal]
                last = now.slice(len(node) - 1).to_pylist()
            questions, chosen, base = np.flatnonzero(keep), [], 0
            for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                m = s + int(np.searchsorted(asks[s:e], 1))
                mine = questions[np.searchsorted(questions, m):np.searchsorted(questions, e)] if m < e else questions[:0]
                goes_on = i == 0 and group == (node[0], salt[0])
                if goes_on:
                    if m > s:
                        held.append(batch.slice(s, m - s))
                        held_at = None
                    if len(mine) and held:
                        if held_at is None:
                            held = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]]
                            held_at = held[0].column("at").to_numpy()
                        low, high = placed(held_at, {c: rows[c][mine] for c in ("start", "end")}, 0, len(mine))
                        found = choose(low, high, [rows[f"draw_{d}"][mine] for d in range(draws)])
                        if len(found[0]):
                            yield rows_of(batch, mine, held[0], [found])
                elif len(mine) and m > s:
                    low, high = placed(rows["at"][s:m], {c: rows[c][mine] for c in ("start", "end")}, 0, len(mine))
                    asked, slot, at = choose(low, high, [rows[f"draw_{d}"][mine] for d in range(draws)])
                    chosen.append((mine[asked], slot, at + s))
                if i == len(starts) - 1 and not goes_on:
                    held, held_at = ([batch.slice(s, m - s)] if m > s else []), None
            group = (node[-1], salt[-1])
            if any(len(c[0]) for c in chosen):
                yield rows_of(batch, np.arange(len(node)), batch, chosen)
    return run
