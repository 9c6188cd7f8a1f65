"""Operator 10, benchmark decontamination: a prefix-filtered join of item windows with documents, in SQL functions only.

A window is the WINDOW consecutive words of a benchmark item (all words of a shorter one).  The words of a
window are ordered by rarity in the documents; a document can only contain the window where it contains
the rarest of them, so that word alone is joined (the prefix for full containment).  The word's place in
the window gives the place of the window in the document; a candidate passes if the window fits there (the
positional and length bound) and all its words agree.

Up to BROADCAST_WINDOWS windows are broadcast and held against each document's words where they are.  More are
joined by shuffle: only (document, place, token) is dealt out by token, tokens with at least 1 in HOT words of
all documents (of which there are HOT at most) under SALTS salts; the candidates go back to their documents,
where the words are cut out, and their hash, then they themselves, are held against the window's.

Cases.  Null and empty texts have no words, so no hits; items without words have no window.  Equal items,
and windows that occur in several items, count for each item id.  Rows that repeat a doc_id are judged by
their own text.  A null doc_id or item_id is kept as null (null items are listed as none).  Empty tables
give empty results or no hits; other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.storage import documents, materialize

WINDOW = 10
BROADCAST_WINDOWS = 200_000
HOT, SALTS = 10_000, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lower-cased; runs of 0-9, a-z and of all characters beyond ASCII."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, words): the distinct windows of each item."""
    found = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return found.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).distinct()


def distinct_windows(found: DataFrame) -> DataFrame:
    """(words, item_ids, window) of windows (item_id, words)."""
    return materialize(found.groupBy("words").agg(F.array_compact(F.array_sort(F.collect_set("item_id"))).alias("item_ids")).withColumn("window", F.xxhash64("words")), "decontaminate-windows")


def prefixes(merged: DataFrame, docs_words: DataFrame, few: bool) -> DataFrame:
    """(token, n, place, window, words, item_ids) for each window that documents may hold: its rarest word in them, that word's count and place."""
    small = F.broadcast if few else lambda df: df
    tokens = merged.select("window", F.posexplode("words").alias("place", "token"))
    vocabulary = materialize(tokens.select("token").distinct(), "decontaminate-vocabulary")
    seen = materialize(docs_words.select(F.explode("w").alias("token")).join(small(vocabulary), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")), "decontaminate-counts")
    # a window with a word that no document has can't occur
    rarest = F.min(F.struct("n", "token", "place"))
    chosen = tokens.join(small(seen), "token", "left").groupBy("window").agg(rarest.alias("r"), F.count_if(F.col("n").isNull()).alias("absent")).filter("absent = 0")
    return materialize(merged.join(chosen.select("window", "r.token", "r.n", "r.place"), "window").select("token", "n", "place", "window", "words", "item_ids"), "decontaminate-prefixes")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, text_key (of its text), n_words, n_hit, n_items, items_sha256, contaminated."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), words(F.col(text)).alias("w"))
    merged = distinct_windows(windows(items, text=text, window=window))
    few = merged.count() <= BROADCAST_WINDOWS
    if not few:
        base = materialize(base, "decontaminate-words")  # read in several places
    rare = prefixes(merged, base, few)
    hits = materialize(_hits(base, rare) if few else _dealt_hits(base, rare), "decontaminate-hits")
    key = ["doc_id", "text_key"]
    spots = hits.select(*key, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("spot")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    item = hits.select(*key, F.explode("item_ids").alias("item")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("listed"))
    found = spots.join(item, [spots.doc_id.eqNullSafe(item.doc_id), spots.text_key == item.text_key], "left").select(spots.doc_id.alias("__doc"), spots.text_key.alias("__key"), "n_hit", "listed")
    rows = base.select(*key, F.size("w").cast("long").alias("n_words"))
    listed = F.coalesce("listed", F.array().cast("array<string>"))
    return rows.join(found, [rows.doc_id.eqNullSafe(F.col("__doc")), rows.text_key == F.col("__key")], "left").select(
        *key,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def _hits(base: DataFrame, rare: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, n, item_ids): the occurrences of windows, start counted from 1."""
    tokens = base.select("doc_id", "text_key", "w", F.posexplode("w").alias("at", "token"))
    pairs = tokens.join(F.broadcast(rare.withColumnRenamed("words", "wanted")), "token")
    start = F.col("at") - F.col("place") + 1
    return pairs.filter((start >= 1) & (start + F.size("wanted") - 1 <= F.size("w"))).filter(F.slice("w", start, F.size("wanted")) == F.col("wanted")).select("doc_id", "text_key", start.alias("start"), F.size("wanted").alias("n"), "item_ids")


def _dealt_hits(base: DataFrame, rare: DataFrame) -> DataFrame:
    """The same rows by shuffled joins: no array is dealt out by token."""
    total = base.agg(F.sum(F.size("w"))).first()[0] or 0
    hot = materialize(rare.filter(F.col("n") * HOT >= total).select("token", F.lit(True).alias("hot")).distinct(), "decontaminate-hot")
    wanted = rare.join(F.broadcast(hot), "token", "left").select("token", "place", "window", F.size("words").alias("n"), F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    tokens = base.select("doc_id", "text_key", F.size("w").alias("size"), F.posexplode("w").alias("at", "token")).join(F.broadcast(hot), "token", "left")
    tokens = tokens.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "text_key", "at"), F.lit(SALTS))).otherwise(0).cast("int"))
    start = F.col("at") - F.col("place") + 1
    met = tokens.join(wanted, ["token", "salt"]).filter((start >= 1) & (start + F.col("n") - 1 <= F.col("size")))
    candidates = met.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), start.alias("start"), "n", "window")
    cut = base.join(candidates, [base.doc_id.eqNullSafe(F.col("__doc")), base.text_key == F.col("__key")]).select("doc_id", "text_key", "start", "n", "window", F.slice("w", F.col("start"), F.col("n")).alias("said"))
    return cut.filter(F.xxhash64("said") == F.col("window")).join(rare.select("window", "words", "item_ids"), "window").filter("said = words").select("doc_id", "text_key", "start", "n", "item_ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without any benchmark window, with their own columns."""
    bad = materialize(contamination(docs, items, doc_id, text).filter("contaminated").select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct(), "decontaminate-bad")
    return docs.join(bad, [docs[doc_id].eqNullSafe(bad["__doc"]), F.xxhash64(docs[text]) == bad["__key"]], "left_anti")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")


ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[i:i + {WINDOW - 1}] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
dwin AS (SELECT r, n, i, w[i:i + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, dwin.n, item_id FROM dwin JOIN wins ON wins.win = dwin.win),
spots AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0, FALSE) AS contaminated
FROM docs LEFT JOIN spots ON spots.r = docs.r LEFT JOIN listed ON listed.r = docs.r
"""
