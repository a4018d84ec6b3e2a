"""Vectors as text, made by Arrow's kernels a batch at a time."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Workers get the functions by value, so this package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def millionths(vectors: pa.Array) -> pa.Array:
    """Each list's numbers in millionths, rounded half away from zero and joined by commas. Null
    numbers are left out, a null list stays null; what no bigint holds is an error."""
    numbers = vectors.flatten()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    if numbers.null_count:
        there = numbers.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        sizes, numbers = np.bincount(row[there], minlength=len(sizes)), numbers.drop_null()
    y = numbers.cast(pa.float64()).to_numpy(zero_copy_only=False) * 1e6
    down = np.trunc(y)
    with np.errstate(invalid="ignore"):
        texts = pa.array(down + np.trunc((y - down) * 2)).cast(pa.int64()).cast(pa.string())
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, texts), ",")
    return pc.if_else(vectors.is_valid(), joined, pa.scalar(None, pa.string())) if vectors.null_count else joined


def in_millionths(column) -> Column:
    return F.arrow_udf(millionths, "string")(column)
