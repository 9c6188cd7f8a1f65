"""Operator 3, quality rules: thresholds per language and source from mergeable quantile sketches.

Per text one Arrow pass takes counts of words, symbols, repeated lines and repeated word windows.  The
sketch of a metric is a histogram with exponentially growing buckets of BITS significant bits (relative
error 1/128): a table of (group, metric, bucket, count), so merging is a sum and Spark combines it map-side.
Sketches are kept per (lang, source), merged per lang and merged over all.  There are no fixed cutoffs: a
metric's threshold lies some spreads beyond the quantiles of its own group, where a spread is the distance of
its two quantiles, or a part of how far its tail reaches.  A group's quantiles are weighed by its rows against WEIGHT rows with those of its language,
which are weighed in the same way against those of all rows, so small groups lean on larger ones.

Cases.  Null and empty text: no words, base_failed.  Null lang or source: a group of its own.  Rows that
failed the base rules aren't in the sketches.  A quantile is the lower bound of the bucket that holds it, so
ties don't matter; a value at its threshold passes.  Repeated rows: each is counted and returned.  An empty table gives an empty result.  Other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recordloom.llm import wordhash as wh
from recordloom.llm.storage import documents, map_arrow, materialize

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Rows that a group's parent counts for.
WEIGHT = 50
BITS = 7
#: Groups whose thresholds are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 100_000


class Metric(NamedTuple):
    low: int  #: percentages of the two quantiles
    high: int
    times: int  #: spreads beyond them that still pass
    least: int  #: the least spread, in thousandths: differences below it are noise
    far: int  #: percentage of the quantile that tells how far the tail reaches
    part: int  #: and the part of it that a spread is at least, where a metric is 0 in most rows
    both: bool  #: whether values can also be too small


#: Per metric, a ratio in whole thousandths.  Quartiles where outliers may be many, the far tail where most rows are 0.
METRICS = {
    "symbols_per_word": Metric(25, 75, 1, 10, 99, 16, False),
    "chars_per_word": Metric(25, 75, 5, 64, 75, 1 << 20, True),
    "dup_lines": Metric(50, 99, 1, 50, 99, 1 << 20, False),
    "repeat_words": Metric(50, 99, 1, 50, 99, 1 << 20, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _counts(part: wh.Slice) -> dict[str, np.ndarray]:
    found = wh.words(part, fold=wh.KEEP_CASE)
    spaces = wh.SPACES[part.data]
    lead = (part.data & 0xC0) != 0x80
    n = len(part.offsets) - 1
    windows, owner = wh.shingles(found, 3, short=False)
    order = np.lexsort((windows, owner))
    same = (windows[order[1:]] == windows[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    # the windows of one text begin at its first words, so a window's first word is its rank plus two words for each text before it
    first = np.flatnonzero(_opens(found, 3))[twice] if len(windows) else np.zeros(0, np.int64)
    hit = np.zeros(len(found.hashes), bool)
    for k in range(3):
        hit[first + k] = True
    lines = wh.words(part, separators=wh.NEWLINES, fold=wh.KEEP_CASE)
    worded = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum(~spaces, out=worded[1:])
    full = worded[lines.ends] > worded[lines.starts]
    line_text = lines.texts[full]
    _, distinct_owner, _ = wh.distinct(lines.hashes[full], line_text)
    n_lines = np.bincount(line_text, minlength=n)
    return {
        "n_words": found.counts,
        "word_chars": wh.per_text(lead & ~spaces, part.offsets),
        "n_symbols": wh.per_text(SYMBOLS[part.data], part.offsets),
        "n_dup_lines": n_lines - np.bincount(distinct_owner, minlength=n),
        "n_repeat_words": wh.per_text(hit, found.offsets),
        "n_lines": n_lines,
    }


def _opens(found: wh.Words, n: int) -> np.ndarray:
    """Whether a window of n words begins at each word."""
    text = found.texts
    opens = np.zeros(len(text), bool)
    opens[: max(0, len(text) - n + 1)] = text[: max(0, len(text) - n + 1)] == text[n - 1 :]
    return opens


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of docs and the six counts of its text."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_counts(p) for p in wh.slices(batch.column(len(keep)))]
            cols = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c) for c in cols)], names=[*keep, *COUNTS])

    return map_arrow(source, run, schema)


def with_metrics(counts: DataFrame) -> DataFrame:
    """base_failed and the metrics in whole thousandths."""
    per = lambda a, b: F.when(F.col(b) > 0, F.expr(f"({a} * 1000) div {b}")).otherwise(F.lit(0))
    return counts.withColumns({
        "base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "chars_per_word": per("word_chars", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeat_words": per("n_repeat_words", "n_words"),
    })


def bucket(value: Column) -> Column:
    """The lower bound of a value's bucket: its BITS leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, metric, bucket, n): the quantile sketch of each metric in each group."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS))).alias("p")
    return rows.select(*group, pairs).groupBy(*group, "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, group: list[str]) -> DataFrame:
    return sketches.groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"))


def _of_metric(field: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for m, v in METRICS.items() for x in (m, getattr(v, field)))), F.col("metric"))


def quantiles(sketches: DataFrame, group: list[str], tag: str) -> DataFrame:
    """(group, metric, and under the tag: n, low, high, far): the rows of each sketch and its metric's quantiles."""
    by = W.partitionBy(*group, "metric")
    ranked = sketches.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "total": F.sum("n").over(by)})
    at = lambda field: F.min(F.when(F.col("upto") * 100 >= F.col("total") * _of_metric(field), F.col("bucket")))
    return ranked.groupBy(*group, "metric").agg(F.max("total").alias(f"{tag}_n"), *(at(q).alias(f"{tag}_{q}") for q in ("low", "high", "far")))


def _blend(tag: str, parent: str, field: str, n: str) -> str:
    return f"(({tag}_{n} * {tag}_{field} + {WEIGHT} * {parent}) div ({tag}_{n} + {WEIGHT}))"


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang_key, source_key, low_ and high_ of each metric) for every group with a row that passed the base rules."""
    fine = materialize(sketch(rows.filter(~F.col("base_failed")), ["lang_key", "source_key"]), "quality-sketch")
    found = quantiles(fine, ["lang_key", "source_key"], "g").join(quantiles(merge(fine, ["lang_key"]), ["lang_key"], "l"), ["lang_key", "metric"]).join(quantiles(merge(fine, []), [], "a"), "metric")
    for side in ("low", "high", "far"):
        found = found.withColumn(side, F.expr(_blend("g", _blend("l", f"a_{side}", side, "n"), side, "n")))
    reach = _of_metric("times") * F.greatest(F.col("high") - F.col("low"), _of_metric("least"), F.floor(F.col("far") / _of_metric("part")))
    of = lambda m, v: F.max(F.when(F.col("metric") == m, v))
    wide = [of(m, v).alias(f"{side}_{m}") for m in METRICS for side, v in (("low", F.col("low") - reach), ("high", F.col("high") + reach))]
    return found.groupBy("lang_key", "source_key").agg(*wide)


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The kept columns, the counts, base_failed, the thresholds that hold for the row, and kept."""
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, F.concat(F.lit("="), lang).alias("lang_key"), F.concat(F.lit("="), source).alias("source_key"), F.col(text).alias("__t")).fillna("", ["lang_key", "source_key"])
    counts = materialize(with_metrics(text_counts(rows, [*keep, "lang_key", "source_key"], "__t")), "quality-counts")
    limits = materialize(thresholds(counts), "quality-thresholds")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    judged = counts.join(limits, ["lang_key", "source_key"], "left")
    fine = ~F.col("base_failed")
    for m, v in METRICS.items():
        fine &= F.col(m) <= F.col(f"high_{m}")
        if v.both:
            fine &= F.col(m) >= F.col(f"low_{m}")
    return judged.withColumn("kept", F.coalesce(fine, F.lit(False)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _per_metric(field: str) -> str:
    return "CASE metric " + " ".join(f"WHEN '{m}' THEN {getattr(v, field)}" for m, v in METRICS.items()) + " END"


def _quantiles_sql(tag: str, keys: str) -> str:
    by = f"{keys}, metric" if keys else "metric"
    return f"""{tag} AS (SELECT {by}, max(total) AS {tag}_n, {", ".join(f"min(bucket) FILTER (upto * 100 >= total * {_per_metric(q)}) AS {tag}_{q}" for q in ("low", "high", "far"))}
      FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bucket, sum(n) AS n FROM fine GROUP BY {by}, bucket)) GROUP BY {by})"""


def _blend_sql(side: str) -> str:
    return f"(g_n * g_{side} + {WEIGHT} * ((l_n * l_{side} + {WEIGHT} * a_{side}) // (l_n + {WEIGHT}))) // (g_n + {WEIGHT}) AS {side}"


ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS lang_key, coalesce('=' || source, '') AS source_key, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM docs),
win AS (SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g, unnest(range(1, len(ws) - 1)) AS i FROM split WHERE len(ws) >= 3),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY r),
counts AS (SELECT s.r, doc_id, lang_key, source_key, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM split s LEFT JOIN rep ON rep.r = s.r),
met AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols_per_word,
  CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS chars_per_word, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_words FROM counts),
vals AS ({" UNION ALL ".join(f"SELECT lang_key, source_key, '{m}' AS metric, {m} AS v FROM met WHERE NOT base_failed" for m in METRICS)}),
fine AS (SELECT lang_key, source_key, metric, (v >> greatest(length(bin(v)) - {BITS}, 0)) << greatest(length(bin(v)) - {BITS}, 0) AS bucket, count(*) AS n FROM vals GROUP BY ALL),
{_quantiles_sql("g", "lang_key, source_key")},
{_quantiles_sql("l", "lang_key")},
{_quantiles_sql("a", "")},
b AS (SELECT g.lang_key, g.source_key, metric, {_blend_sql("low")}, {_blend_sql("high")}, {_blend_sql("far")} FROM g JOIN l USING (lang_key, metric) JOIN a USING (metric)),
t AS (SELECT lang_key, source_key, metric, low - {_per_metric("times")} * greatest(high - low, {_per_metric("least")}, far // {_per_metric("part")}) AS low, high + {_per_metric("times")} * greatest(high - low, {_per_metric("least")}, far // {_per_metric("part")}) AS high FROM b),
w AS (SELECT lang_key, source_key, {", ".join(f"max({side}) FILTER (metric = '{m}') AS {side}_{m}" for m in METRICS for side in ("low", "high"))} FROM t GROUP BY lang_key, source_key)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {" AND ".join(f"{m} <= high_{m}" + f" AND {m} >= low_{m}" * v.both for m, v in METRICS.items())}, FALSE) AS kept
FROM met LEFT JOIN w ON w.lang_key = met.lang_key AND w.source_key = met.source_key
"""
