"""Order-dependent columns of a catalog: running ordinals and chapters filled forward.

A window over all rows would run in one task.  Instead rows are dealt to blocks of about BLOCK rows by ranges of
their order column, however sparse its numbers are, and written down with their block; each block is summed up in one
row, and rows are completed within their block.  The blocks' running state is taken in two levels as well: over the sums
of GROUP blocks, then within those; so neither the rows nor the blocks of any table are one task's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.stored import materialize

BLOCK, GROUP = 10_000, 1000


def _blocked(rows: DataFrame, order: str, block: int) -> DataFrame:
    """rows with __block: the range of the order column that they are in, from 0."""
    n = -(-rows.count() // block)
    if n <= 1:
        return rows.withColumn("__block", F.lit(0))
    # ranges are sampled anew each time a plan runs, so they are written down
    return materialize(rows.repartitionByRange(n, order).withColumn("__block", F.spark_partition_id()), "blocks")


def _carried(state: DataFrame, columns: list[str], running: Callable[[Column], Column], total: Callable[[Column], Column], joined: Callable[[Column, Column], Column], group: int) -> DataFrame:
    """(__block, __c of each column c): what the blocks before it come to.

    running: an aggregate to take over a window; total: the same of a group of blocks; joined: of an earlier part and a later one.
    """
    grouped = state.withColumn("__group", F.floor(F.col("__block") / group))
    totals = grouped.groupBy("__group").agg(*(total(F.col(c)).alias(c) for c in columns))
    back = W.orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("__group", *(running(F.col(c)).over(back).alias(f"__before_{c}") for c in columns))
    near = W.partitionBy("__group").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    within = grouped.select("__group", "__block", *(running(F.col(c)).over(near).alias(f"__{c}") for c in columns))
    return within.join(before, "__group").select("__block", *(joined(F.col(f"__before_{c}"), F.col(f"__{c}")).alias(f"__{c}") for c in columns))


def running_count(rows: DataFrame, flag: Column, order: str = "row_no", out: str = "ordinal", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """rows with the number of flagged rows up to each."""
    marked = _blocked(rows, order, block).withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("long"))
    sums = marked.groupBy("__block").agg(F.sum("__flag").alias("sum"))
    before = _carried(sums, ["sum"], F.sum, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), group)
    within = F.sum("__flag").over(W.partitionBy("__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return marked.join(before, "__block").withColumn(out, F.col("__sum") + within).drop("__block", "__flag", "__sum")


def ordinals(rows: DataFrame, flag: Column, order: str = "row_no", out: str = "ordinal") -> DataFrame:
    """The running count as text on flagged rows, empty on the others."""
    return running_count(rows, flag, order, "__n").withColumn(out, F.when(flag, F.col("__n").cast("string")).otherwise("")).drop("__n")


def fill_chapters(rows: DataFrame, major: Column, minor: Column, order: str = "row_no", out: str = "chapter", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """rows with their chapter: `major > minor`, or whichever there is; a new major clears the minor.

    major and minor are null but on the rows that open one.
    """
    base = _blocked(rows, order, block).withColumns({"__major": major, "__minor": F.when(major.isNull(), minor)})
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))
    at = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col(order)))
    state = base.groupBy("__block").agg(last("__major").alias("m"), at("__major").alias("m_at"), last("__minor").alias("n"), at("__minor").alias("n_at"))
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("__block")))
    carried = _carried(state, ["m", "m_at", "n", "n_at"], lambda c: F.last(c, ignorenulls=True), latest, lambda a, b: F.coalesce(b, a), group)
    own = W.partitionBy("__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    seen = base.join(carried, "__block").withColumns({
        "__M": F.coalesce(F.last("__major", ignorenulls=True).over(own), "__m"),
        "__Mat": F.coalesce(F.last(F.when(F.col("__major").isNotNull(), F.col(order)), ignorenulls=True).over(own), "__m_at"),
        "__N": F.coalesce(F.last("__minor", ignorenulls=True).over(own), "__n"),
        "__Nat": F.coalesce(F.last(F.when(F.col("__minor").isNotNull(), F.col(order)), ignorenulls=True).over(own), "__n_at"),
    })
    live = F.when(F.col("__Mat").isNull() | (F.col("__Nat") > F.col("__Mat")), F.col("__N"))
    return seen.withColumn(out, F.concat_ws(" > ", "__M", live)).drop("__block", "__major", "__minor", "__m", "__m_at", "__n", "__n_at", "__M", "__Mat", "__N", "__Nat")
