"""Ranked search of a catalog: tiers of code, equality, prefix, substring, words, then fuzzy matches.

Whatever can score has a part of the query in it: the first word, where queries of several words are gated by
it; else one of the words; or the query in its code.  So items are met by equality on grams of up to GRAM characters: of each
part its first gram.  Fuzzy matches of queries that aren't gated are met by the characters that they must have in common.
A query of nothing but punctuation begins every name alike, so only the first items in the order of ranking count.

Queries are composed (NFC) before they are compared, as catalogs are when they are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.functions.decompose import decompose
from recordloom.functions.similarity import sequence_ratio
from recordloom.functions.text import clean_lite, grams, nfc, normalize, unaccent
from recordloom.operators.fuzzy import distance_allows, overlapping
from recordloom.operators.review import labels
from recordloom.stored import Steps, materialize
from recordloom.vocab import Vocabulary

TOP = 15
GRAM = 3
#: The least sequence ratio of a fuzzy match, and by how many times its item may be longer.
FUZZY, LONGEST = 0.6, 2.2


def _index(rows: DataFrame, text: str, vocab: Vocabulary | None) -> DataFrame:
    c = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    clean = normalize(F.col(text), vocab) if vocab else clean_lite(F.col(text))
    return rows.withColumn("low", c).withColumn("clean", clean).withColumns({"bare": unaccent(F.col("clean")), "toks": F.array_remove(F.split("clean", " "), "")}).withColumn("bare_toks", F.transform("toks", unaccent))


def _place(tokens: Column, bare: Column, t: Column, b: Column) -> Column:
    """The first place of a token that equals or begins with t (or, unaccented, with b); -1 without one."""
    flags = F.zip_with(tokens, bare, lambda x, y: F.startswith(x, t) | F.startswith(y, b))
    return F.array_position(flags, True) - 1


def search(queries: DataFrame, items: DataFrame, top: int = TOP, vocab: Vocabulary | None = None, fuzzy: bool = True) -> DataFrame:
    """(query_id, rank, idx, code, name, score, match_type) for queries (query_id, query) over items (idx, code, name)."""
    with Steps("search") as steps:
        return materialize(_search(queries, items, top, vocab, fuzzy, steps.keep), "search-found")


def _search(queries: DataFrame, items: DataFrame, top: int, vocab: Vocabulary | None, fuzzy: bool, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    c = F.col
    q = _index(queries.withColumn("query", nfc("query")), "query", vocab).select("query_id", *(F.col(x).alias(f"q_{x}") for x in ("low", "clean", "bare", "toks", "bare_toks")))
    q = stored(q)
    i = stored(_index(items, "name", vocab).withColumn("low_code", F.lower(F.coalesce("code", F.lit("")))))
    first = F.substring_index(c("q_low"), " ", 1)
    gated = (F.length(first) >= 3) & (F.size("q_toks") >= 2)
    blank = c("q_low") == ""
    asked, browsing = q.filter(~blank), q.filter(blank)
    met = _met(asked.withColumns({"first": first, "gated": gated}), i)
    first_of = lambda rows: rows.select("idx", F.length("name").alias("n")).orderBy("n", "idx").limit(top).select("idx")
    shortest = first_of(i).unionByName(first_of(i.filter(c("clean") == "")))
    met = met.unionByName(asked.filter(c("q_clean") == "").select("query_id").join(F.broadcast(shortest)).select("query_id", "idx"))
    if fuzzy:
        loose = asked.filter(~gated & (F.length("q_clean") >= 4)).select(c("query_id").alias("q"), c("q_clean").alias("wanted"))
        named = i.groupBy("clean").agg(F.min("idx").alias("head"))
        near = overlapping(loose, named.select(c("head").alias("idx"), c("clean").alias("text")), FUZZY, LONGEST)
        met = met.unionByName(near.join(named.withColumnRenamed("head", "idx"), "idx").drop("idx").join(i.select("clean", "idx"), "clean").select(c("q").alias("query_id"), "idx"))
    met = stored(met.distinct())
    pairs = met.join(i, "idx").join(asked, "query_id")
    passes = ~gated | F.contains("low", first) | F.contains(unaccent(c("low")), unaccent(first)) | F.contains("low_code", c("q_low"))
    pairs = pairs.filter(passes)
    share = F.least(F.length("q_clean") / F.greatest(F.length("clean"), F.lit(1)), F.lit(1.0))
    code = F.when(c("low_code") == c("q_low"), 100.0).when((c("low_code") != "") & F.startswith("low_code", c("q_low")), 98.0).when((c("low_code") != "") & F.contains("low_code", c("q_low")), 92.0).otherwise(0.0)
    places = F.transform(F.arrays_zip(c("q_toks").alias("t"), c("q_bare_toks").alias("b")), lambda z: _place(c("toks"), c("bare_toks"), z["t"], z["b"]))
    pairs = pairs.withColumns({"s0": code, "r": share, "places": places})
    hit = F.size(F.filter("places", lambda p: p >= 0))
    n = F.size("q_toks")
    ordered = F.aggregate("places", F.struct(F.lit(True).alias("ok"), F.lit(-1).cast("long").alias("last")), lambda a, p: F.struct((a["ok"] & (p >= a["last"])).alias("ok"), p.cast("long").alias("last")))["ok"]
    equal = (c("low") == c("q_low")) | (c("clean") == c("q_clean"))
    prefix = F.when(F.startswith("clean", c("q_clean")), 95 + 4 * c("r")).when(F.startswith("bare", c("q_bare")), 93 + 4 * c("r"))
    inside = F.when(F.contains("clean", c("q_clean")), 90 + 5 * c("r")).when(F.contains("bare", c("q_bare")), 86 + 5 * c("r"))
    words = F.when((n >= 2) & (hit == n), 84 + F.when(ordered, 4.0).otherwise(0.0) + 4 * c("r"))
    some = F.when((n >= 2) & (hit < n) & (hit * 2 >= n), 35.0 * hit / n)
    single = F.when((n == 1) & (hit == 1), 80 + 8 * c("r"))
    # the first tier that applies names the match; an earlier, higher score stays
    tier = F.coalesce(
        F.when(equal, F.struct(F.lit(100.0).alias("s"), F.lit("EXACT").alias("m"))),
        F.when(c("bare") == c("q_bare"), F.struct(F.lit(99.0).alias("s"), F.lit("EXACT").alias("m"))),
        F.when(prefix.isNotNull(), F.struct(prefix.alias("s"), F.lit("PREFIX").alias("m"))),
        F.when(inside.isNotNull(), F.struct(inside.alias("s"), F.lit("SUBSTRING").alias("m"))),
        F.when(words.isNotNull(), F.struct(words.alias("s"), F.lit("ALL_WORDS").alias("m"))),
        F.when(some.isNotNull(), F.struct(some.alias("s"), F.lit("FUZZY").alias("m"))),
        F.when(single.isNotNull(), F.struct(single.alias("s"), F.lit("SUBSTRING").alias("m"))),
    )
    pairs = pairs.withColumn("tier", F.when(c("s0") < 99, tier))
    pairs = pairs.withColumns({"s": F.greatest(c("s0"), F.coalesce("tier.s", F.lit(0.0))), "m": F.coalesce("tier.m", F.when(c("s0") > 0, "CODE"), F.lit("FUZZY"))})
    if fuzzy:
        slow = (c("s") < 40) & (F.length("q_clean") >= 4) & (F.length("clean") <= LONGEST * F.length("q_clean")) & distance_allows(c("q_clean"), c("clean"), FUZZY)
        far = pairs.filter(slow).withColumn("f", sequence_ratio(c("q_clean"), c("clean")))
        far = far.withColumns({"s": F.when(c("f") >= FUZZY, F.greatest("s", c("f") * 50)).otherwise(c("s")), "m": F.when(c("f") >= FUZZY, "FUZZY").otherwise(c("m"))}).drop("f")
        pairs = pairs.filter(~slow).unionByName(far)
    kept = pairs.filter((c("s") >= 25) | (c("m") == "CODE")).withColumn("score", F.floor(c("s") * 10 + 0.5) / 10)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.length("name"), "idx")
    found = kept.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= top).select("query_id", "rank", "idx", "code", "name", "score", c("m").alias("match_type"))
    # a blank query shows the catalog's beginning
    start = items.select("idx", "code", "name").orderBy("idx").limit(top).withColumn("rank", F.row_number().over(W.orderBy("idx")))
    shown = browsing.select("query_id").join(F.broadcast(start)).select("query_id", "rank", "idx", "code", "name", F.lit(100.0).alias("score"), F.lit("EXACT").alias("match_type"))
    return found.unionByName(shown)


def labelled(found: DataFrame, vocab: Vocabulary) -> DataFrame:
    """What search() found with the labels of its names: specialty_label and anatomy_label.  Only the found names are taken apart."""
    names = found.select("name").distinct().withColumn("clean", normalize(F.col("name"), vocab)).withColumn("chapter", F.lit(None).cast("string"))
    told = labels(decompose(names, "clean", vocab), vocab).select("name", "specialty_label", "anatomy_label")
    return found.join(told, found["name"].eqNullSafe(told["name"]), "left").drop(told["name"])


def _met(asked: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, idx): items with the first gram of one of a query's parts, in the name or the code."""
    head = lambda t: F.substring(t, 1, GRAM)
    in_name = F.when(F.col("gated"), F.array(head(unaccent(F.col("first"))))).otherwise(F.concat(F.transform("q_bare_toks", head), F.transform("q_toks", lambda t: head(unaccent(t))), F.array(head("q_bare"))))
    wanted = asked.select("query_id", F.explode(F.array_distinct(F.concat(F.transform(in_name, lambda g: F.struct(F.lit("name").alias("part"), g.alias("gram"))), F.array(F.struct(F.lit("code").alias("part"), head("q_low").alias("gram")))))).alias("g")).select("query_id", "g.part", "g.gram").filter("gram <> ''")
    # grams that no query has aren't listed
    listed = wanted.select("part", "gram").distinct()
    said = items.select("idx", F.explode(grams(unaccent(F.concat_ws("\n", "low", "bare")))).alias("gram"), F.lit("name").alias("part"))
    coded = items.select("idx", F.explode(grams(F.col("low_code"))).alias("gram"), F.lit("code").alias("part"))
    posted = said.unionByName(coded).join(listed, ["part", "gram"], "left_semi")
    return wanted.join(posted, ["part", "gram"]).select("query_id", "idx").distinct()
