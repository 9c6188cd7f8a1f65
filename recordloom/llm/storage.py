"""Tables between steps: written once to the shared checkpoint folder, then read back.

A written table cuts lineage, survives the loss of executors and lets the planner see a measured size,
so that small sides are broadcast by Spark itself and large ones are not.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a new temporary folder is set, on a local master only, as in tests."""
    own = spark.sparkContext.getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or own
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="recordloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Where the tables of materialize() are.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the checkpoint folder and read it back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[written] = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


#: Rows in one Arrow batch of texts: a task's Python and JVM hold a few of them at a time.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches; the session's batch size is lowered to BATCH_ROWS where it is larger, and a task frees its memory at its end."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(freed, schema)


def release_memory() -> None:
    """Give free memory back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
