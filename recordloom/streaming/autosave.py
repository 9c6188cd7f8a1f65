"""Autosave: of a stream of edits the last state of each session, written after a moment of quiet.

Each session's latest edit is Spark's own keyed state with a timer.  An edit starts the timer anew, whether it is the
latest or comes late; when it runs out, the latest edit is handed on and the state is dropped.  The state is part of
the query's checkpoint, so a restarted query goes on with the timers it had.  A batch that is replayed writes the same
sessions with the same content again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET_MS = 1200
EDIT = "session_id string, edit_seq long, state string"


def settled(edits: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(session_id, edit_seq, state) of a stream of edits (the same columns): each session's latest after quiet_ms without any.

    The latest is the one with the highest edit_seq; of repeated ones the greatest state.  Edits without session_id are
    left out.  A session that goes on after it was saved is saved again, with what came since.
    """

    def latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seq, value = state.get
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "edit_seq": [seq], "state": [value]})
            return
        best = state.get if state.exists else None
        for batch in batches:
            for seq, value in zip(batch["edit_seq"], batch["state"], strict=True):
                found = (int(seq), "" if value is None else value)
                best = found if best is None else max(tuple(best), found)
        state.update(tuple(best))
        state.setTimeoutDuration(quiet_ms)

    wanted = edits.filter("session_id IS NOT NULL AND edit_seq IS NOT NULL").select("session_id", F.col("edit_seq").cast("long").alias("edit_seq"), "state")
    return wanted.groupBy("session_id").applyInPandasWithState(latest, EDIT, "edit_seq long, state string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def autosave(edits: DataFrame, path: str, checkpoint: str, quiet_ms: int = QUIET_MS) -> StreamingQuery:
    """Start saving: each settled session replaces its own partition under path, others stay."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)

    return settled(edits, quiet_ms).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).start()
