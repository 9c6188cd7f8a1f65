"""Linking names as they arrive: each micro-batch against a fixed catalog.

The work is stateless by row, so it needs no watermark; a batch that is replayed writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators.match import link_prepared, prepared
from recordloom.stored import Steps, materialize
from recordloom.vocab import Vocabulary


def link_stream(sources: DataFrame, targets: DataFrame, out: str, checkpoint: str, vocab: Vocabulary | None = None, threshold: float = 0.7, once: bool = False) -> StreamingQuery:
    """Start linking a stream of (q, name) to targets (idx, code, name); batch n is written to out/batch=n.

    The catalog is taken apart once and written down; a batch's own table goes when its result is written.
    """
    catalog = materialize(prepared(targets, vocab), "catalog")

    def each(batch: DataFrame, n: int) -> None:
        with Steps("batch") as steps:
            link_prepared(steps.keep(prepared(batch, vocab)), catalog, vocab, threshold).write.mode("overwrite").parquet(f"{out}/batch={n}")

    writer = sources.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
