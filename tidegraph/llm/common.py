"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# What a Python worker and the JVM beside it hold of a table at a time, several times over.
BATCH_BYTES = 8 << 20
_BATCH_OPTION = "spark.sql.execution.arrow.maxBytesPerBatch"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix=f"{root.name}-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with record batches of bounded size; the session's own limit holds if lower."""
    spark = df.sparkSession
    ship(spark)
    limit = (spark.conf.get(_BATCH_OPTION, None) or "").lower().rstrip("b")
    if not limit.isdigit() or not 0 < int(limit) <= BATCH_BYTES:
        spark.conf.set(_BATCH_OPTION, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one, that no column of df has, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_columns(batch: pa.RecordBatch, **arrays: pa.Array) -> pa.RecordBatch:
    """The batch with columns added; a column of the same name is replaced."""
    names = [n for n in batch.schema.names if n not in arrays]
    columns = [batch.column(batch.schema.names.index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*columns, *arrays.values()], [*names, *arrays])


def schema_with(df: DataFrame, **types: str) -> str:
    """DDL of df's columns plus new ones; a column of the same name is replaced."""
    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name not in types]
    return ", ".join([*kept, *(f"`{name}` {kind}" for name, kind in types.items())])


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The strings of a column, null as empty."""
    return [t or "" for t in batch.column(batch.schema.names.index(name)).to_pylist()]


def by_size(batches: Iterator[pa.RecordBatch], name: str, most: int = 1 << 20, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `most` bytes in the column `name`."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(batch.schema.names.index(name))).to_pylist()):
            if i > start and (size + (n or 0) > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
