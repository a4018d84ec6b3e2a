"""Canonical schemas and named sampling presets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_LONG = T.LongType()

EDGE_FILE = T.StructType([
    T.StructField("Unnamed: 0", _LONG),
    T.StructField("src", _LONG),
    T.StructField("dst", _LONG),
    T.StructField("time", T.DoubleType()),
    T.StructField("ext_roll", T.IntegerType()),
])

EDGES = T.StructType([
    T.StructField("src", _LONG),
    T.StructField("dst", _LONG),
    T.StructField("ts", _LONG),
    T.StructField("eid", _LONG),
    T.StructField("seq", _LONG),
])

FEATURES = T.StructType([
    T.StructField("id", _LONG),
    T.StructField("feat", T.ArrayType(T.FloatType())),
])

PARTITION_TABLE = T.StructType([
    T.StructField("node", _LONG),
    T.StructField("pid", T.IntegerType()),
])

NODE_STATE = T.StructType([
    T.StructField("node", _LONG),
    T.StructField("mem", T.ArrayType(T.DoubleType())),
    T.StructField("mem_ts", _LONG),
    T.StructField("mail", T.ArrayType(T.DoubleType())),
    T.StructField("mail_ts", _LONG),
])


@dataclass(frozen=True)
class SamplingPreset:
    fanouts: tuple[int, ...]
    strategy: str
    snapshots: int = 1
    window: float = 0
    prop_time: bool = False
    static: bool = False
    batch_size: int = 600


# The default settings of the five standard model families.
PRESETS = {
    "recent_one_hop": SamplingPreset((10,), "recent", batch_size=4000),
    "uniform_two_hop": SamplingPreset((10, 10), "uniform"),
    "snapshots_two_hop": SamplingPreset((10, 10), "uniform", snapshots=3, window=10000, prop_time=True),
    "static_mean": SamplingPreset((15, 10), "uniform", static=True, batch_size=1200),
    "static_attention": SamplingPreset((10, 10), "uniform", static=True),
}
