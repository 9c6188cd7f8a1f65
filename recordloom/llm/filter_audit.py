"""Operator 11, filter interaction audit: what every filter removes in every order of the filters.

The orders form a trie; two prefixes with the same filters leave the same rows, so the trie has one state for
each set of filters.  The states are walked depth first: a state's survivors are persisted as a narrow table
(no texts), what each remaining filter removes from them is counted, the next filter is applied to them, and a
state that was reached before is not applied again.  A state's table is deleted when the walk leaves it, so
there is at most one a filter at a time.  The orders are put together from the counted edges only.

A filter is a flag of the row, taken once from the whole text; `same` compares with all rows of the table.

Cases.  Null text: empty.  Null or empty part: the part "".  Identical texts are told by SHA-256; a row without
doc_id is neither smaller than another nor has it a smaller one, and rows with the same id don't fail for each
other.  Repeated rows count each.  Several labels of one doc_id: it is good (toxic) if any of them says so; null
labels say nothing.  A part whose rows are all removed has zeros.  An empty table gives an empty result.  Other
columns of both tables are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recordloom.llm import wordhash as wh
from recordloom.llm.lookup import look_up
from recordloom.llm.storage import documents, map_arrow, materialize, release

#: The contract's filters and what they fail for.
FILTERS = "ABCDE"
UPPER, MARKS = np.zeros(256, bool), np.zeros(256, bool)
UPPER[0x41:0x5B] = True
MARKS[list(b"#$%&*|")] = True


def _flags(part: wh.Slice) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    found = wh.words(part, fold=wh.KEEP_CASE)
    n = found.counts
    _, owner, _ = wh.distinct(found.hashes, found.texts)
    different = np.bincount(owner, minlength=len(n))
    points = wh.per_text((part.data & 0xC0) != 0x80, part.offsets)
    fails = (n < 50, 100 * different < 65 * n, 100 * wh.per_text(UPPER[part.data], part.offsets) > 5 * points, wh.per_text(MARKS[part.data], part.offsets) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def text_flags(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, digest of the text, fails: bits of A to D), without the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), whole.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails = [_flags(p) for p in wh.slices(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(fails) if fails else np.zeros(0, np.int32))], names=["doc_id", "part", "digest", "fails"])

    return map_arrow(source, run, "doc_id long, part string, digest binary, fails int")


def with_copies(rows: DataFrame, bit: int) -> tuple[DataFrame, DataFrame]:
    """rows without the digest, with the bit in fails where a smaller doc_id has the same text; and the table to release after it."""
    firsts = materialize(rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "audit-firsts")
    found = look_up(rows, firsts, ["digest"], "n", "audit-copies")
    release(firsts)
    return found.select("doc_id", "part", (F.col("fails") + F.when(F.col("doc_id") > F.col("first"), bit).otherwise(0)).alias("fails")), found


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(said.filter("doc_id IS NOT NULL"), "doc_id", "left").fillna(0, ["good", "toxic"])


def failing(k: int) -> Column:
    return F.col("fails").bitwiseAND(1 << k) != 0


def edges(root: DataFrame, n: int) -> DataFrame:
    """(part, state, left, removed_k, good_k, toxic_k of each filter k): per part and set of applied filters, bits of state, the
    rows left and what each filter would remove of them.

    root: (part, fails, good, toxic) and whatever names the rows.
    """
    counted: dict[int, DataFrame] = {}

    def count(state: int, survivors: DataFrame) -> DataFrame:
        hit = [F.when(failing(k), 1).otherwise(0) for k in range(n)]
        sums = [F.sum(h * w).cast("long").alias(f"{name}_{k}") for k, h in enumerate(hit) for name, w in (("removed", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
        return survivors.groupBy("part").agg(F.lit(state).alias("state"), F.count("*").alias("left"), *sums)

    def visit(state: int, survivors: DataFrame) -> None:
        counted[state] = materialize(count(state, survivors), f"audit-count-{state}")
        for k in range(n):
            below = state | 1 << k
            if below == state or below in counted or below == (1 << n) - 1:
                continue
            kept = survivors.filter(~failing(k))
            if below.bit_count() < n - 1:
                table = materialize(kept, f"audit-left-{below}")
                visit(below, table)
                release(table)
            else:  # one filter remains: one reading
                visit(below, kept)

    visit(0, root)
    merged = None
    for table in counted.values():
        merged = table if merged is None else merged.unionByName(table)
    out = materialize(merged, "audit-edges")
    release(*counted.values())
    return out


def interactions(found: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Every order and step of every part, from the counts of edges()."""
    n = len(filters)
    everything = (1 << n) - 1
    ways = [factorial(i) * factorial(n - 1 - i) for i in range(n)]  # orders that meet an edge from a state of i filters
    steps = []
    for order in permutations(range(n)):
        state = 0
        for i, k in enumerate(order, 1):
            steps.append((state, k, i, "".join(filters[j] for j in order)))
            state |= 1 << k
    each = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{name}_{k}").alias(name) for name in ("removed", "good", "toxic"))) for k in range(n)))
    counted = found.select("part", "state", "left", F.explode(each).alias("e")).select("part", "state", "left", "e.*")
    # a part without survivors at a state has no row there; all parts have one at the first state
    states = F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.lit(k).alias("k")) for s in range(everything) for k in range(n) if not s >> k & 1)))
    whole = found.filter("state = 0").select("part", states.alias("e")).select("part", "e.*").join(counted, ["part", "state", "k"], "left").fillna(0)
    of_filter = W.partitionBy("part", "k")
    told = whole.withColumns({
        "fails": F.max(F.when(F.col("state") == 0, F.col("removed"))).over(of_filter),
        "unique_fails": F.max(F.when(F.bit_count("state") == n - 1, F.col("removed"))).over(of_filter),
        "shapley": F.sum(F.col("removed") * F.get(F.array(*map(F.lit, ways)), F.bit_count("state"))).over(of_filter),
    })
    walked = found.sparkSession.createDataFrame(steps, "state int, k int, step int, filter_order string")
    return told.join(F.broadcast(walked), ["state", "k"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("left") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The filters A to E over docs: per part, order and step what is kept, removed, redundant and lost."""
    flags = materialize(text_flags(docs, doc_id, text, part), "audit-flags")
    copies, table = with_copies(flags, 1 << FILTERS.index("E"))
    root = materialize(with_labels(copies, labels), "audit-left-0")
    release(flags, table)
    found = edges(root, len(FILTERS))
    release(root)
    return interactions(found, FILTERS)


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
said AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
marked AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, FALSE)::INT AS fails
  FROM docs LEFT JOIN firsts USING (text) LEFT JOIN said USING (doc_id)),
few AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits FROM letter v, letter w, letter x, letter y, letter z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND v.b | w.b | x.b | y.b | z.b = 31),
steps AS (SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
walked AS (SELECT part, filter_order, step, b, sum(n) FILTER (fails & (before | b) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND fails & b <> 0) AS removed, sum(n) FILTER (fails & before <> 0 AND fails & b <> 0) AS redundant,
  sum(n) FILTER (fails = b) AS unique_fails, sum(good) FILTER (fails & before = 0 AND fails & b <> 0) AS good_lost, sum(toxic) FILTER (fails & before = 0 AND fails & b <> 0) AS toxic_lost
  FROM few, steps GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, b), 0)::BIGINT AS shapley
FROM walked
"""
