"""Small helpers around Arrow batches, shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from agendry.runtime import checkpoint_dir, share_code


#: Rows of an Arrow batch: texts can be long, and a worker holds a batch several times over.
ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's rows of an Arrow batch to ROWS; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = share_code(df).sparkSession.conf
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, ROWS)
    return df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow for a function of one batch that gives arrays, one for each column of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(fn(b), names)

    return small_batches(df).mapInArrow(run, schema)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each string; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(at, at[1:]):
        yield bytes(view[a:b])


def dropped(spark: SparkSession, uri: str) -> None:
    """Delete a file or folder of the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own in the shared one, as a URI, that is there until the block ends."""
    root = checkpoint_dir(spark)
    uri = f"{root if ':/' in root else 'file://' + os.path.abspath(root)}/{name}-{uuid.uuid4().hex}"
    try:
        yield uri
    finally:
        dropped(spark, uri)
