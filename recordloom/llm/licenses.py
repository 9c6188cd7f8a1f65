"""Operator 4, license scans: lines and windows against licence templates by Dice coefficient over word bigrams, in SQL functions only.

Texts are normalised (lower case; words are runs of a-z, 0-9 and of characters beyond ASCII).  Two kinds of unit
are held against a template, each by its distinct word bigrams: every line, and windows of as many words as the
template over the whole text, whatever its line breaks.  A template can only reach the least coefficient D with
a unit of between D / (2 - D) and (2 - D) / D times as many bigrams, so it is dropped for lines beyond these
bounds.  Within them a unit must have at least D / (2 - D) of the template's bigrams, and so one of its anchors,
which are so many of its bigrams that no fewer could be left out, those with the longest words first.  Only where
an anchor stands is a line compared; and there a window is cut so that the anchor stands at its place in the template.

One pass over all texts keeps those with an anchor; the units are made of these only.  Up to FEW anchors are looked for
where the words are, first their longer words alone; of a longer list only (unit, place, bigram) is dealt out.

Cases.  Null and empty texts and lines of fewer than two words have no bigrams and match nothing.  Of equal
coefficients the first licence by name wins.  Windows that begin before the text begin with it; they may end with
it.  Repeated rows of one doc_id are told apart by their text and each returned.  Templates of fewer than two
words match nothing.  An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.license_texts import TEMPLATES
from recordloom.llm.storage import documents, materialize

#: Anchors that are literals and broadcast.
FEW = 5_000
#: Words of a text in which anchors are looked for at a time; each part also has the words before and after it that a window may need.
PART = 4096
#: Lines of so many times the longest template's words, and more, are compared as sets of bigrams.
LINE = 2
#: The least Dice coefficient, as a percentage.
PERCENT = 80
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def bigrams(w: Column) -> Column:
    """Distinct bigrams of an array of words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))


def size_bounds(least: int, most: int, percent: int = PERCENT) -> tuple[int, int]:
    """The sizes of sets that can reach the coefficient with a set of least to most."""
    ratio = Fraction(percent, 200 - percent)
    return -int(-least * ratio // 1), int(most / ratio)


def anchors(spark: SparkSession, templates: dict[str, list[str]], percent: int = PERCENT) -> DataFrame:
    """(license, template, n_words, bigrams, first, second, place, word, other, step): the anchors of each template.

    place counts from 0; word is the longer one of first and second, and the other stands a step from it.
    """
    listed = [(name, f"{name}/{i}", text) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    made = spark.createDataFrame(listed, "license string, template string, text string").withColumn("w", words(F.col("text"))).withColumn("bigrams", bigrams(F.col("w"))).filter(F.size("bigrams") > 0)
    longest = lambda b: F.greatest(F.length(F.substring_index(b, " ", 1)), F.length(F.substring_index(b, " ", -1)))
    ranked = F.array_sort(F.transform("bigrams", lambda b: F.struct((-longest(b)).alias("minus"), b.alias("bigram"))))
    needed = F.size("bigrams") - F.ceil(F.size("bigrams") * percent / (200 - percent)) + 1
    each = made.select("license", "template", F.size("w").alias("n_words"), "bigrams", "w", F.explode(F.slice(ranked, 1, needed.cast("int"))["bigram"]).alias("bigram"))
    second = F.substring_index("bigram", " ", -1)
    found = each.withColumns({"first": F.substring_index("bigram", " ", 1), "second": second})
    # an anchor that stands twice in its template is met at its first place
    places = F.sequence(F.lit(0), F.size("w") - 2)
    place = F.filter(places, lambda i: (F.get("w", i) == F.col("first")) & (F.get("w", i + 1) == F.col("second")))[0]
    ahead = F.length("first") >= F.length("second")
    met = {"word": F.when(ahead, F.col("first")).otherwise(F.col("second")), "other": F.when(ahead, F.col("second")).otherwise(F.col("first")), "step": F.when(ahead, 1).otherwise(-1)}
    return found.withColumn("place", place).withColumns(met).select("license", "template", "n_words", "bigrams", "first", "second", "place", "word", "other", "step")


def _at(w: str, i: Column) -> Column:
    """The word at a place counted from 0; null outside."""
    return F.when(i >= 0, F.get(w, i))


def _pairs() -> Column:
    n = F.greatest(F.size("w") - 1, F.lit(0))
    return F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.struct(a.alias("first"), b.alias("second")))


def anchored(texts: DataFrame, key: list[str], wanted: DataFrame, few: bool) -> DataFrame:
    """The texts (key, said) that have an anchor."""
    split = texts.withColumn("w", words(F.col("said")))
    if few:
        listed = wanted.select("word", F.concat_ws(" ", "first", "second").alias("bigram")).collect()
        literals = lambda values: F.array(*map(F.lit, sorted(values))).cast("array<string>")
        near = split.filter(F.arrays_overlap("w", literals({r.word for r in listed})))
        return near.filter(F.arrays_overlap(bigrams(F.col("w")), literals({r.bigram for r in listed}))).select(*key, "said")
    each = split.select(*(F.col(k).alias(f"__{k}") for k in key), F.explode(_pairs()).alias("b")).select(*(f"__{k}" for k in key), "b.first", "b.second")
    some = each.join(wanted.select("first", "second").distinct(), ["first", "second"], "left_semi").drop("first", "second").distinct()
    return texts.join(some, [texts[k].eqNullSafe(some[f"__{k}"]) for k in key], "left_semi").select(*key, "said")


def _met(units: DataFrame, key: list[str], wanted: DataFrame, few: bool) -> DataFrame:
    """(key, w, at, license, template, n_words, bigrams, place) where an anchor stands in a unit (key, w), at counted from 0."""
    kept = ["license", "template", "n_words", "bigrams", "place"]
    if few:
        pairs = units.select(*key, "w", F.posexplode("w").alias("at", "word")).join(F.broadcast(wanted), "word")
        begin = F.least(F.col("at"), F.col("at") + F.col("step"))
        return pairs.filter(_at("w", F.col("at") + F.col("step")) == F.col("other")).withColumn("at", begin).select(*key, "w", "at", *kept)
    every = units.select(*key, F.posexplode(_pairs()).alias("at", "b"))
    slim = every.select(*(F.col(k).alias(f"__{k}") for k in key), "at", "b.first", "b.second").join(wanted.select("first", "second", "template", "place"), ["first", "second"]).drop("first", "second")
    same = [units[k].eqNullSafe(slim[f"__{k}"]) for k in key]
    whole = wanted.select("license", "template", "n_words", "bigrams").dropDuplicates(["template"])
    return units.join(slim, same).select(*key, "w", "at", "template", "place").join(whole, "template").select(*key, "w", "at", *kept)


def _long_lines(lines: DataFrame, reach: int, low: int, high: int, wanted: DataFrame, few: bool) -> DataFrame:
    """(doc_id, text_key, line, license, bigrams, b) of lines of more than LINE * reach words that an anchor of a template is in.

    Such a line is like a template only if it repeats itself so much that its distinct bigrams are few; those are met as a set.
    """
    long = lines.filter(F.length("said") >= 2 * LINE * reach).select("doc_id", "text_key", "line", words(F.col("said")).alias("w")).filter(F.size("w") > LINE * reach)
    sets = long.select("doc_id", "text_key", "line", bigrams(F.col("w")).alias("b")).filter(F.size("b").between(low, high))
    templates = wanted.select("license", "template", "bigrams", F.concat_ws(" ", "first", "second").alias("g"))
    met = sets.select("doc_id", "text_key", "line", "b", F.explode("b").alias("g")).join(F.broadcast(templates) if few else templates, "g")
    return met.dropDuplicates(["doc_id", "text_key", "line", "template"]).select("doc_id", "text_key", "line", "license", "bigrams", "b")


def _matching(compared: DataFrame, percent: int) -> DataFrame:
    """compared (b, bigrams, ..) with dice, where it reaches the least coefficient."""
    sized = compared.filter((percent * F.size("b") <= (200 - percent) * F.size("bigrams")) & (percent * F.size("bigrams") <= (200 - percent) * F.size("b")))
    common = sized.withColumn("common", F.size(F.array_intersect("b", "bigrams")))
    return common.filter(200 * F.col("common") >= percent * (F.size("b") + F.size("bigrams"))).withColumn("dice", 2 * F.col("common") / (F.size("b") + F.size("bigrams")))


def license_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, kind, at, license, dice): per line (kind line, at: its number from 0) the best licence, and of windows (at: first word) every licence's best."""
    wanted = materialize(anchors(docs.sparkSession, TEMPLATES if templates is None else templates, percent), "license-anchors")
    counted = wanted.agg(F.count("*").alias("n"), F.min(F.size("bigrams")).alias("least"), F.max(F.size("bigrams")).alias("most"), F.max("n_words").alias("longest")).first()
    few, (low, high) = counted.n <= FEW, size_bounds(counted.least or 0, counted.most or 0, percent)
    every = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("said"))
    texts = materialize(anchored(every, ["doc_id", "text_key"], wanted, few), "license-texts")
    lines = texts.select("doc_id", "text_key", F.posexplode(F.split("said", "\n")).alias("line", "said"))
    reach = counted.longest or 1
    # a line of so many bigrams has one word more, each of a character and a separator but for the last
    cut = lines.filter(F.length("said") > 2 * max(low, 1)).select("doc_id", "text_key", "line", words(F.col("said")).alias("w")).filter(F.size("w").between(max(low, 1) + 1, LINE * reach))
    by_line = _met(cut, ["doc_id", "text_key", "line"], wanted, few).filter((F.size("w") - 1) * (200 - percent) >= percent * F.size("bigrams")).withColumn("b", bigrams(F.col("w"))).select("doc_id", "text_key", "line", "license", "bigrams", "b")
    by_line = by_line.unionByName(_long_lines(lines, reach, low, high, wanted, few))
    best = lambda of: F.min(F.struct((-F.col("dice")).alias("minus"), of)).alias("best")
    of_lines = _matching(by_line, percent).groupBy("doc_id", "text_key", "line").agg(best("license")).select("doc_id", "text_key", F.lit("line").alias("kind"), F.col("line").alias("at"), "best.license", (-F.col("best.minus")).alias("dice"))
    whole = texts.filter(F.length("said") > 2 * max(low, 1)).select("doc_id", "text_key", words(F.col("said")).alias("w"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(PART)), lambda c: F.struct(c.alias("begin"), F.slice("w", F.greatest(c - reach, F.lit(0)) + 1, F.lit(PART + 2 * reach)).alias("w")))
    part = whole.select("doc_id", "text_key", F.explode(parts).alias("p")).select("doc_id", "text_key", "p.begin", "p.w")
    before = F.least(F.col("begin"), F.lit(reach))
    met = _met(part, ["doc_id", "text_key", "begin"], wanted, few).filter((F.col("at") >= before) & (F.col("at") < before + PART))
    first = F.greatest(F.col("at") - F.col("place"), F.lit(0))
    windows = met.select("doc_id", "text_key", "license", "bigrams", (first + F.col("begin") - before).alias("start"), F.slice("w", first + 1, F.col("n_words")).alias("window")).withColumn("b", bigrams(F.col("window")))
    of_windows = _matching(windows, percent).groupBy("doc_id", "text_key", "license").agg(best("start")).select("doc_id", "text_key", F.lit("window").alias("kind"), F.col("best.start").alias("at"), "license", (-F.col("best.minus")).alias("dice"))
    return of_lines.unionByName(of_windows)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, text_key, n_license_lines, licenses (names in order, comma-joined), best_license and best_dice (null without any)."""
    matches = materialize(license_matches(docs, doc_id, text, templates, percent), "license-matches")
    found = matches.groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).agg(
        F.count_if(F.col("kind") == "line").alias("n"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.min(F.struct((-F.col("dice")).alias("minus"), F.col("license").alias("license"))).alias("best"),
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"))
    return rows.join(found, [rows.doc_id.eqNullSafe(F.col("__doc")), rows.text_key == F.col("__key")], "left").select(
        "doc_id",
        "text_key",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.col("best.license").alias("best_license"),
        (-F.col("best.minus")).alias("best_dice"),
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("text_key")


_WORDS = r"list_filter(string_split_regex(translate({0}, '" + _UPPER + "', '" + _LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_BIGRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_LISTED = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in sorted(TEMPLATES.items()) for text in texts)
_SCORED = f"""200 * len(list_intersect(b, t)) >= {PERCENT} * (len(b) + len(t)) AND len(list_intersect(b, t)) > 0"""
#: Lines are held against every template; windows are cut at anchors.
ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, i, {_BIGRAMS.format("w")} AS b FROM (SELECT r, i, {_WORDS.format("line")} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs))),
templates AS (SELECT row_number() OVER () AS template, license, tw, {_BIGRAMS.format("tw")} AS t FROM (SELECT license, {_WORDS.format("text")} AS tw FROM (VALUES {_LISTED}) v(license, text))),
pairs AS (SELECT r, i, license, b, t FROM lines JOIN templates ON {PERCENT} * len(b) <= {200 - PERCENT} * len(t) AND {PERCENT} * len(t) <= {200 - PERCENT} * len(b)),
on_lines AS (SELECT r, 'line' AS kind, license, len(list_intersect(b, t)) * 2 / (len(b) + len(t)) AS dice FROM pairs WHERE {_SCORED} QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY len(list_intersect(b, t)) * 2 / (len(b) + len(t)) DESC, license) = 1),
ranked AS (SELECT template, license, tw, t, g, row_number() OVER (PARTITION BY template ORDER BY greatest(length(string_split(g, ' ')[1]), length(string_split(g, ' ')[2])) DESC, g) AS k FROM (SELECT *, unnest(t) AS g FROM templates)),
anchors AS (SELECT template, license, len(tw) AS m, t, g, list_position(list_transform(range(1, len(tw)), lambda i: tw[i] || ' ' || tw[i + 1]), g) AS place FROM ranked WHERE k <= len(t) - ceil(len(t) * {PERCENT} / {200 - PERCENT}) + 1),
texts AS (SELECT r, {_WORDS.format("text")} AS w FROM docs),
spots AS (SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g, unnest(range(1, len(w))) AS spot FROM texts WHERE len(w) > 1),
starts AS (SELECT DISTINCT r, template, license, m, t, greatest(spot - place, 0) + 1 AS start FROM spots JOIN anchors USING (g)),
windows AS (SELECT r, license, t, {_BIGRAMS.format("x")} AS b FROM (SELECT r, license, t, w[start:start + m - 1] AS x FROM starts JOIN texts USING (r))),
matches AS (SELECT r, kind, license, dice FROM on_lines UNION ALL SELECT r, 'window', license, len(list_intersect(b, t)) * 2 / (len(b) + len(t)) FROM windows WHERE {_SCORED}),
found AS (SELECT r, count(*) FILTER (kind = 'line') AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best_dice, arg_min(license, (-dice, license)) AS best_license FROM matches GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_license_lines, coalesce(licenses, '') AS licenses, best_license, best_dice FROM docs LEFT JOIN found ON found.r = docs.r
"""
