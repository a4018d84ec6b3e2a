import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidegraph.session import local_session
    session = local_session(4, shuffle_partitions=4, memory="6g", name="tests", extra={
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def edges_of(spark):
    """Edges from literal columns; eid and seq are the position."""
    def make(src, dst, ts, eids=None):
        n = len(src)
        frame = pd.DataFrame({"src": list(src), "dst": list(dst), "ts": [float(t) for t in ts],
                              "eid": eids or list(range(n)), "seq": list(range(n))})
        return spark.createDataFrame(frame, "src long, dst long, ts double, eid long, seq long")
    return make


@pytest.fixture()
def roots_of(spark):
    def make(nodes, ts):
        times = ts if isinstance(ts, list) else [ts] * len(nodes)
        frame = pd.DataFrame({"rid": range(len(nodes)), "node": nodes, "ts": [float(t) for t in times]})
        return spark.createDataFrame(frame.astype({"rid": "int64", "node": "int64", "ts": "float64"}),
                                     "rid long, node long, ts double")
    return make


@pytest.fixture()
def small(edges_of):
    """Three sources with three edges each at times 0, 1, 2: fixed values."""
    return edges_of([0, 0, 0, 1, 1, 1, 2, 2, 2], [1, 2, 3, 1, 2, 3, 1, 2, 3], [0, 1, 2, 0, 1, 2, 0, 1, 2])
