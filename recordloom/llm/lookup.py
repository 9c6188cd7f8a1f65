"""A left join with a table of one row a key, whose keys may be asked for by very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.storage import materialize, release

#: A key is hot if more than the HOT-th part of all rows ask for it, so there are at most so many hot keys.
HOT = 10_000


def look_up(rows: DataFrame, found: DataFrame, on: list[str], asked: str, name: str) -> DataFrame:
    """rows with the columns of found, null where it has no such key; a table of materialize().

    found: one row a key, and in the column asked, which is dropped, by how many of rows it is asked for.  Hot
    keys, at most HOT, are looked up in a broadcast table, so no task gets all rows of one key; a key of the
    rest has at most the HOT-th part of the rows.
    """
    hot = F.col(asked) > rows.count() // HOT
    told = F.lit(True).alias("__told")
    known = materialize(rows.join(F.broadcast(found.filter(hot).drop(asked).select("*", told)), on, "left"), f"{name}-hot")
    more = [c for c in found.columns if c not in (*on, asked)]
    rest = known.filter("__told IS NULL").drop("__told", *more).join(found.filter(~hot).drop(asked), on, "left")
    out = materialize(known.filter("__told").drop("__told").unionByName(rest), name)
    release(known)
    return out
