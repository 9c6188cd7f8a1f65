"""Tables between steps: written once to the shared checkpoint folder, then read back.

A written table cuts lineage, survives the loss of executors and lets the planner see a measured size,
so that small sides are broadcast by Spark itself and large ones are not.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


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


class Steps:
    """Tables of one computation: keep(df) writes one, and at the end all of them are deleted.

    What is returned from inside must be a table of its own, as materialize() makes it.
    """

    def __init__(self, name: str) -> None:
        self.name, self.tables = name, []

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(materialize(df, self.name))
        return self.tables[-1]

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        release(*self.tables)
