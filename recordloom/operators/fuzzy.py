"""Pairs of strings that can have a sequence ratio: a count filter over numbered characters, without losing any.

Matching blocks don't overlap and keep their order, so a ratio r of two strings of n and m characters needs r (n + m) / 2
characters in common, each counted as often as it stands in both.  The third `a` of a string is the character (a, 3);
so strings are sets, and a pair needs an intersection of a known size T(n, m).  Two sets with T members in
common share one of the first n - T + 1 of the one and of the first m - T + 1 of the other, in any order of all members:
they are ordered from rare to frequent, and met by these beginnings only, for each length of the other string.
Then the members in common are counted, and an edit distance that no such pair can have ends the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.stored import Steps, materialize


def needed(n: Column, m: Column, ratio: float) -> Column:
    """Characters that strings of n and m characters must have in common for the ratio."""
    # a hair less than the bound, so that no rounding of the ratio loses a pair
    return F.ceil((n + m) * (ratio / 2) - 1e-9)


def numbered(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, c, k): the characters of each text, and which one of its kind each is."""
    letters = rows.select(key, F.explode(F.array_remove(F.split(text, ""), "")).alias("c")).groupBy(key, "c").agg(F.count("*").cast("int").alias("n"))
    return letters.select(key, "c", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))


def _ordered(tokens: DataFrame, key: str, rarity: DataFrame) -> DataFrame:
    """(key, toks): the numbered characters of each text from rare to frequent."""
    return tokens.join(rarity, ["c", "k"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "c", "k"))).alias("toks"))


def overlapping(asked: DataFrame, items: DataFrame, ratio: float, most: float | None = None) -> DataFrame:
    """(q, idx, common) of asked (q, wanted) and items (idx, text) that have enough characters in common for the ratio (above 0).

    With most, items of more than so many times the wanted text's length are left out.  Empty texts are met by nothing.
    """
    with Steps("fuzzy") as steps:
        tokens = steps.keep(numbered(items, "idx", "text"))
        rarity = steps.keep(tokens.groupBy("c", "k").agg(F.count("*").alias("df")))
        there = steps.keep(_ordered(tokens, "idx", rarity).withColumn("m", F.size("toks")))
        here = steps.keep(_ordered(numbered(asked, "q", "wanted"), "q", rarity).withColumn("n", F.size("toks")))
        lengths = F.broadcast(there.groupBy().agg(F.sort_array(F.collect_set("m")).alias("lengths")))  # the lengths of names
        n, m = F.col("n"), F.col("m")
        can = lambda m: (needed(n, m, ratio) <= F.least(n, m)) & (F.lit(True) if most is None else m <= most * n)
        wide = here.join(lengths).select("q", "n", "toks", F.explode(F.filter("lengths", can)).alias("m"))
        head = lambda toks, size, t: F.explode(F.slice(toks, 1, F.greatest(size - t + 1, F.lit(0)).cast("int")))
        ask = wide.select("q", "n", "m", head(F.col("toks"), n, needed(n, m, ratio)).alias("t")).select("q", "n", "m", "t.c", "t.k")
        listed = there.select("idx", "m", F.posexplode("toks").alias("at", "t")).select("idx", "m", "at", "t.c", "t.k")
        met = ask.join(listed, ["m", "c", "k"]).filter(F.col("at") <= m - needed(n, m, ratio)).select("q", "idx").distinct()
        sets = lambda df, key, name: df.select(key, F.transform("toks", lambda t: F.struct(t["c"].alias("c"), t["k"].alias("k"))).alias(name))
        both = met.join(sets(here, "q", "a"), "q").join(sets(there, "idx", "b"), "idx").select("q", "idx", F.size(F.array_intersect("a", "b")).alias("common"), F.size("a").alias("n"), F.size("b").alias("m"))
        return materialize(both.filter(F.col("common") >= needed(n, m, ratio)).select("q", "idx", "common"), "fuzzy-pairs")


def distance_allows(a: Column, b: Column, ratio: float) -> Column:
    """Whether the edit distance leaves room for the ratio: what isn't matched can be deleted and inserted."""
    return F.levenshtein(a, b) <= (F.length(a) + F.length(b)) * (1 - ratio) + 1e-9
