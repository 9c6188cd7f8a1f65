"""Candidates by shared weight, met only where they can still be among the first: exact, without opening frequent tokens.

A source's tokens are ordered from rare to frequent.  Whoever shares weight with it shares a first token in that
order, a second, and so on; what follows bounds what can still come.  A key is a beginning of that list: one token, and
where a token is frequent two tokens, and where a pair is frequent three.  Key statistics say how many target rows
have all tokens of a key, so the best key that enough rows have gives each source a bar before any target is met.  Then a key
is opened if it is short, or if its own weight reaches the bar; is passed over if with all that can follow it stays below
the bar; and else is left to longer keys.  So a frequent token is opened only for sources that it alone can decide.

Lists are cut into blocks of BLOCK targets, and source and block meet, so no task gets a whole frequent list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.stored import Steps, materialize

#: Targets of a list that is opened without asking; tokens of the longest keys; targets in a block of a list.
SHORT, LEVELS, BLOCK = 10, 3, 4096
#: Frequent tokens of a name whose pairs and triples are listed; names with more are met by single tokens.
LONG = 20
Stored = Callable[[DataFrame], DataFrame]
_AND, _LONG = "\x02", "\x03"


def _statistics(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("key").agg(F.count("*").alias("names"), F.sum("n").alias("rows"))


def _longer(rows: DataFrame, *carried: Column) -> DataFrame:
    """Each key of rows (key, last, toks, level) with each of its later tokens: key, last, level, added; toks and what is carried stay."""
    after = F.transform(F.slice("toks", F.col("last") + 2, F.size("toks")), lambda t, i: F.struct((F.col("last") + 1 + i).alias("last"), t.alias("t")))
    return rows.select(*carried, "toks", "key", "level", F.explode(after).alias("e")).select(
        *carried, "toks", F.concat("key", F.lit(_AND), "e.t.token").alias("key"), "e.last", (F.col("level") + 1).alias("level"), F.col("e.t").alias("added")
    )


def lists(index: DataFrame, sizes: DataFrame, stored: Stored) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of postings (idx, token) and sizes (idx, n: rows that a target stands for): the targets' tokens from rare to frequent, the keys'
    lists (key, idx, names), and the keys' statistics (key, names, rows).  stored(df): df computed once."""
    single = _statistics(index.join(sizes, "idx").withColumnRenamed("token", "key"))
    told = index.join(single.select(F.col("key").alias("token"), "names"), "token").groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("names", "token"))).alias("toks"))
    targets = stored(told.join(sizes, "idx"))
    frequent = targets.withColumn("toks", F.filter("toks", lambda t: t["names"] > SHORT)).withColumn("long", F.size("toks") > LONG)
    begin = targets.select("idx", "n", F.explode("toks").alias("t")).select(F.col("t.token").alias("key"), "idx", F.col("t.names").alias("names"))
    far = frequent.filter("long").select("idx", "n", F.explode("toks.token").alias("t")).select(F.concat("t", F.lit(_LONG)).alias("key"), "idx", "n")
    far_counts = _statistics(far)
    found, counts = [begin, far.drop("n").join(far_counts.select("key", "names"), "key").select("key", "idx", "names")], [single, far_counts]
    at = frequent.filter("NOT long").select("idx", "n", "toks", F.posexplode("toks").alias("last", "t")).select("idx", "n", "toks", "last", F.col("t.token").alias("key"), F.lit(1).alias("level"))
    for _ in range(1, LEVELS):
        at = _longer(at, F.col("idx"), F.col("n")).drop("added")
        # rows that carry all tokens of their name are never broadcast: the planner takes them for what the names take on disk
        at = stored(at.hint("merge").join(_statistics(at).select("key", "names"), "key"))
        found.append(at.select("key", "idx", "names"))
        counts.append(_statistics(at.drop("names")))
        at = at.filter(F.col("names") > SHORT).drop("names")
    return targets.select("idx", F.col("toks.token").alias("tokens")), reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, counts)


def keys(probes: DataFrame, counts: DataFrame, top: int, stored: Stored) -> tuple[DataFrame, DataFrame]:
    """Of probes (q, token, w, pos): the sources' tokens (q, toks), and the keys that each opens (q, key, names)."""
    known = counts.filter(~F.contains("key", F.lit(_AND)) & ~F.endswith("key", F.lit(_LONG)))
    told = probes.join(known.withColumnRenamed("key", "token"), "token").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("names", "token", "rows", "w", "pos"))).alias("toks"))
    asked = stored(told)
    tail = lambda k, f, start: F.aggregate(F.slice("toks", k + 2, F.size("toks")), start, f)
    first = asked.select("q", "toks", F.posexplode("toks").alias("last", "t")).select("q", "toks", "last", F.col("t.token").alias("key"), F.lit(1).alias("level"), F.col("t.w").cast("long").alias("w"), F.col("t.pos").alias("pos"), F.col("t.names").alias("names"), F.col("t.rows").alias("rows"), F.lit(None).cast("struct<w:bigint,before:int>").alias("parent"))
    first = first.withColumn("alone", F.size(F.filter("toks", lambda t: t["names"] > SHORT)) > LONG)
    value = F.struct(F.col("w"), (-F.col("pos")).alias("before"))
    levels = [first]
    for _ in range(1, LEVELS):
        grown = _longer(levels[-1].filter((F.col("names") > SHORT) & ~F.col("alone")), F.col("q"), F.col("w"), F.col("pos"), F.col("alone"))
        grown = grown.select("q", "toks", "last", "key", "level", (F.col("w") + F.col("added.w")).alias("w"), F.least("pos", "added.pos").alias("pos"), value.alias("parent"), "alone")
        levels.append(grown.hint("merge").join(counts, "key").select(*first.columns))
    every = reduce(DataFrame.unionByName, levels)
    most = F.struct((F.col("w") + tail(F.col("last"), lambda s, t: s + t["w"], F.lit(0).cast("long"))).alias("w"), (-F.least("pos", tail(F.col("last"), lambda s, t: F.least(s, t["pos"]), F.lit(1 << 30)))).alias("before"))
    every = stored(every.select("q", "key", "level", "names", "rows", "parent", "alone", value.alias("own"), most.alias("most")))
    bars = every.filter(F.col("rows") >= top).groupBy("q").agg(F.max("own").alias("bar"))
    none = F.struct(F.lit(0).cast("long").alias("w"), F.lit(-(1 << 30)).alias("before"))
    judged = every.join(bars, "q", "left").withColumn("bar", F.coalesce("bar", none)).filter((F.col("most") >= F.col("bar")) & (F.col("parent").isNull() | (F.col("parent") < F.col("bar"))))
    decides = (F.col("names") <= SHORT) | (F.col("own") >= F.col("bar")) | (F.col("level") == LEVELS) | F.col("alone")
    long = counts.filter(F.endswith("key", F.lit(_LONG))).select("key", "names")
    left_over = judged.filter(~decides & (F.col("level") == 1)).select("q", F.concat("key", F.lit(_LONG)).alias("key")).join(long, "key").select("q", "key", "names")
    return asked, judged.filter(decides).select("q", "key", "names").unionByName(left_over)


def meet(probes: DataFrame, index: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """(q, idx, weight, pos) of all targets that can be among the first `top` rows of a source by weight, then pos; and of others.

    probes (q, token, w, pos), index (idx, token), each once; sizes (idx, n): the rows that a target stands for.
    """
    with Steps("bounded") as steps:
        targets, lists_, counts = lists(steps.keep(index), steps.keep(sizes), steps.keep)
        asked, opened = keys(probes, counts, top, steps.keep)
        both = met(opened, lists_).distinct().join(asked, "q").join(targets, "idx")
        shared = F.filter("toks", lambda t: F.array_contains("tokens", t["token"]))
        told = both.select("q", "idx", shared.alias("shared"))
        return materialize(told.select("q", "idx", F.aggregate("shared", F.lit(0).cast("long"), lambda s, t: s + t["w"]).alias("weight"), F.array_min("shared.pos").alias("pos")), "candidates")


def met(opened: DataFrame, lists_: DataFrame) -> DataFrame:
    """(q, idx): opened keys and the lists' targets, block by block."""
    blocks = F.ceil(F.col("names") / BLOCK).cast("int")
    ask = opened.select("q", "key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    dealt = lists_.select("key", F.pmod(F.xxhash64("idx"), blocks).cast("int").alias("block"), "idx")
    return ask.join(dealt, ["key", "block"]).select("q", "idx")
