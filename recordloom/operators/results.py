"""Work on linked results: filters, facets, paging, edits, locks, sessions and export columns.

Result rows have row_id, code, name, code_1, name_1, score_1, code_2, name_2, score_2, specialty, anatomy and
an audit struct, as far as an operator needs them.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.functions.text import grams, last_segment, roman_value
from recordloom.stored import Steps, materialize

#: Characters by which labels meet the names of entries.
GRAM = 3
#: Entries whose names make an automaton; more are joined.
ENTRIES = 10_000
STATUS = {
    "all": lambda: F.lit(True),
    "warning_only": lambda: F.coalesce(F.col("warning"), F.lit(False)),
    "locked_only": lambda: F.coalesce(F.col("is_locked"), F.lit(False)),
    "both": lambda: (F.col("name_1") != "") & (F.col("name_2") != ""),
    "pl1_only": lambda: (F.col("name_1") != "") & (F.col("name_2") == ""),
    "pl2_only": lambda: (F.col("name_1") == "") & (F.col("name_2") != ""),
    "unmatched": lambda: (F.col("name_1") == "") & (F.col("name_2") == ""),
}


def by_status(rows: DataFrame, status: str) -> DataFrame:
    return rows.filter(STATUS[status]())


def auditable(rows: DataFrame) -> DataFrame:
    return rows.filter((F.coalesce("name_1", F.lit("")) != "") | (F.coalesce("name_2", F.lit("")) != ""))


def by_keyword(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query, in either case, within one of the columns."""
    found = F.lit(False)
    for c in columns:
        found |= F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(query.strip().lower()))
    return rows.filter(found)


def plain_label(c: Column) -> Column:
    """Lower case; hyphens, slashes and commas are spaces; accents stay.  Null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[-/,]", " "), r"(?U)\s+", " "))


def specialty_matches(specialty: Column, anatomy: Column, wanted: Column, ontology: bool) -> Column:
    """Whether a row belongs to a specialty; a row with neither specialty nor anatomy belongs to none.

    ontology: the specialty equal to, within or around the wanted name, the anatomy around it, or at least min(2, n) of
    the name's n words of three letters or more within either.  An empty specialty is within every name.
    Else: the specialty or one of its parts (split at > and -) equal, mutual containment without leading numerals, or the anatomy around it.
    """
    s, a = F.coalesce(specialty, F.lit("")), F.coalesce(anatomy, F.lit(""))
    given = (s != "") | (a != "")
    if ontology:
        return given & _ontology_matches(plain_label(s), plain_label(a), plain_label(wanted))
    w = F.lower(F.trim(wanted))
    bare = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?i)^([IVXLCDM0-9]+)[.:\-\s]+", "")))
    parts = F.transform(F.split(s, "[>-]"), lambda p: F.lower(F.trim(p)))
    mutual = (bare(s) != "") & (bare(F.trim(wanted)) != "") & (F.contains(bare(s), bare(F.trim(wanted))) | F.contains(bare(F.trim(wanted)), bare(s)))
    named = (s != "") & ((F.lower(F.trim(s)) == w) | F.array_contains(parts, w) | mutual)
    return given & (named | ((a != "") & F.contains(F.lower(a), w)))


def _ontology_matches(s: Column, a: Column, w: Column) -> Column:
    """The same for plain labels."""
    words = F.filter(F.split(w, " "), lambda x: F.length(x) >= 3)
    shared = F.size(F.filter(words, lambda x: F.contains(s, x) | F.contains(a, x)))
    return F.contains(s, w) | F.contains(w, s) | F.contains(a, w) | ((F.size(words) > 0) & (shared >= F.least(F.lit(2), F.size(words))))


def facet_ontology(rows: DataFrame, entries: DataFrame, specialty: str = "specialty", anatomy: str = "anatomy", entry: str = "entry", most: int = ENTRIES) -> DataFrame:
    """(entry, n): how many rows belong to each entry (distinct names) by specialty_matches(ontology=True); those without rows are left out.

    At most `most` entries, which are counted, make one automaton of their names and words: each label is read once, where it
    is, and only counts are dealt out.  More entries are met by equality of grams.  Rows whose label is empty belong to
    every entry and are counted once for all.
    """
    s, a, w = plain_label(F.col(specialty)), plain_label(F.col(anatomy)), plain_label(F.col(entry))
    given = rows.filter((F.coalesce(specialty, F.lit("")) != "") | (F.coalesce(anatomy, F.lit("")) != ""))
    with Steps("facets") as steps:
        names = steps.keep(entries.select(F.col(entry).alias("entry"), w.alias("w")).distinct())
        listed = names.filter("w <> ''").select("w").distinct().limit(most + 1).collect()
        if len(listed) <= most:
            found = _read_once(given.select(s.alias("s"), a.alias("a")), names, [r.w for r in listed])
        else:
            found = _met_by_grams(given.select(s.alias("s"), a.alias("a")), names, steps)
        return materialize(found.filter("n > 0"), "facet-counts")


def _read_once(labels: DataFrame, names: DataFrame, listed: list[str]) -> DataFrame:
    """(entry, n) of plain labels (s, a) and names (entry, w), whose distinct w are listed."""

    @F.pandas_udf("array<int>")
    def belongs(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        entries = Entries(listed)
        for specialties, anatomies in parts:
            yield pd.Series([entries.of(x, y) for x, y in zip(specialties, anatomies, strict=True)], dtype=object)

    none, every = -1, -2  # rows whose label is empty; all rows
    told = F.when(F.col("s") == "", F.array(F.lit(none), F.lit(every))).otherwise(F.array_append("of", F.lit(every)))
    counts = labels.withColumn("of", belongs(F.when(F.col("s") != "", F.col("s")), F.when(F.col("s") != "", F.col("a")))).select(F.explode(told).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    n = {r.k: r.n for r in counts.collect()}  # a row an entry at most
    spark = names.sparkSession
    by_name = spark.createDataFrame([(w, n.get(k, 0) + n.get(none, 0)) for k, w in enumerate(listed)] + [("", n.get(every, 0))], "w string, n long")
    return names.join(by_name, "w").select("entry", "n")


class Entries:
    """Plain names (distinct, not empty) found in labels: all names and their words by one automaton."""

    def __init__(self, names: list[str]) -> None:
        import ahocorasick

        self.names, self.near = names, {}
        self.whole = {w: k for k, w in enumerate(names)}
        self.words: dict[str, list[tuple[int, int]]] = {}  # (name, how often it has the word)
        self.least: list[int] = []
        for k, w in enumerate(names):
            counted = Counter(x for x in w.split(" ") if len(x) >= 3)
            self.least.append(min(2, counted.total()))
            for x, times in counted.items():
                self.words.setdefault(x, []).append((k, times))
        self.found = ahocorasick.Automaton()
        for x in {*self.whole, *self.words}:
            self.found.add_word(x, x)
        self.found.make_automaton()

    def of(self, s: str | None, a: str | None) -> list[int]:
        """The names that a label belongs to; of none if it is empty."""
        if not s or not self.names:
            return []
        if s not in self.near:
            if len(self.near) > 10_000:
                self.near.clear()
            self.near[s] = ({x for _, x in self.found.iter(s)}, [k for k, w in enumerate(self.names) if s in w])
        said, within = self.near[s]
        said = said | {x for _, x in self.found.iter(a or "")}
        out, shared = set(within), Counter()
        for x in said:
            if x in self.whole:
                out.add(self.whole[x])
            for k, times in self.words.get(x, ()):
                shared[k] += times
        out.update(k for k, times in shared.items() if times >= self.least[k])
        return sorted(out)


def _met_by_grams(labels: DataFrame, names: DataFrame, steps: Steps) -> DataFrame:
    """The same for any number of names.

    Whatever matches has the beginning of the name or of one of its words within the row's label, or the label's beginning
    within the name: three characters or, of shorter ones, all.  So labels, counted before, and names meet by equality of
    such grams, under their ids; only the names that a label has met are compared with it.
    """
    every = labels.groupBy("s", "a").agg(F.count("*").alias("n"))
    known = steps.keep(every.filter("s <> ''").withColumn("id", F.expr("uuid()")))
    head = lambda c: F.substring(c, 1, GRAM)
    heads = F.array_distinct(F.concat(F.array(head("w")), F.transform(F.filter(F.split("w", " "), lambda x: F.length(x) >= 3), head)))
    by_entry = names.select("entry", F.explode(heads).alias("gram")).join(known.select("id", F.explode(F.array_union(grams(F.col("s")), grams(F.col("a")))).alias("gram")), "gram")
    by_label = known.select("id", head("s").alias("gram")).join(names.select("entry", F.explode(grams(F.col("w"))).alias("gram")), "gram")
    met = by_entry.unionByName(by_label).select("entry", "id").distinct().join(names, "entry").groupBy("id").agg(F.collect_list(F.struct("entry", "w")).alias("met"))
    compared = known.join(met, "id").select("n", F.explode(F.filter("met", lambda x: _ontology_matches(F.col("s"), F.col("a"), x["w"]))).alias("x"))
    counted = compared.groupBy("x.entry").agg(F.sum("n").alias("n"))
    # one row: rows that belong to every entry; and a name without letters is within every label
    all_rows = labels.agg(F.count_if(F.col("s") == "").alias("unnamed"), F.count("*").alias("every"))
    joined = names.join(counted, "entry", "left").join(F.broadcast(all_rows))
    return joined.select("entry", F.when(F.col("w") == "", F.col("every")).otherwise(F.coalesce("n", F.lit(0)) + F.col("unnamed")).alias("n"))


def page(rows: DataFrame, number: int, size: int = 25, order: str = "row_id") -> DataFrame:
    """The page of that number, from 1; past the end the last one."""
    last = max(1, -(-rows.count() // size))
    return rows.orderBy(order).offset((min(max(number, 1), last) - 1) * size).limit(size)


def page_after(rows: DataFrame, after: int | None, size: int = 25, order: str = "row_id") -> DataFrame:
    """The rows that follow the last one of a page, by its key: each task keeps a page at most, and nothing is counted."""
    left = rows if after is None else rows.filter(F.col(order) > after)
    return left.orderBy(order).limit(size)


def facet_specialties(rows: DataFrame, column: str = "specialty") -> DataFrame:
    """(facet, n): rows by their specialty and, where it differs, by its last segment."""
    whole = F.trim(F.coalesce(F.col(column), F.lit("")))
    each = F.array_distinct(F.array(whole, last_segment(whole)))
    return rows.select(F.explode(each).alias("facet")).filter("facet <> ''").groupBy("facet").agg(F.count("*").alias("n"))


def order_facets(facets: DataFrame) -> DataFrame:
    """Facets that begin with a roman numeral first, by its value; the others in Vietnamese order."""
    numeral = F.regexp_extract("facet", r"^([IVXLCDM]+)[.\s]", 1)
    return facets.withColumn("roman", F.when(numeral != "", roman_value(numeral))).orderBy(F.col("roman").asc_nulls_last(), F.expr("facet COLLATE vi"))


def facet_members(rows: DataFrame, dimension: DataFrame, key: str, members: str) -> DataFrame:
    """(key, n) over a dimension whose rows name several members: a row counts for each key that has it; a key without rows is dropped."""
    exploded = dimension.select(key, F.explode(members).alias("__m")).distinct()
    return rows.select(F.col(rows.columns[0]).alias("__id"), F.col("member").alias("__m")).join(exploded, "__m").groupBy(key).agg(F.count_distinct("__id").alias("n"))


def warning_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if("warning").alias("warnings"), F.count_if("is_locked").alias("locked"))


def passthrough(rows: DataFrame, specs: list[tuple[str, str, int]]) -> DataFrame:
    """rows with extra columns (name, array column, index): the trimmed cell, or empty."""
    return rows.withColumns({name: F.coalesce(F.trim(F.get(cells, F.lit(i))), F.lit("")) for name, cells, i in specs})


def export_status(locked: Column, note: Column, warning: Column, severity: Column, reason: Column, advice: Column, matched: Column) -> Column:
    noted = F.coalesce(F.trim(note), F.lit(""))
    base = (
        F.when(locked, F.when(noted != "", F.concat(F.lit("Locked ("), noted, F.lit(")"))).otherwise("Locked"))
        .when(warning, F.when(severity == "HIGH", "Serious conflict").otherwise("To be checked"))
        .when(matched, "Matched")
        .otherwise("Unmatched")
    )
    return F.concat(base, F.when(warning, F.concat(F.lit(" ("), reason, F.lit(" -> "), advice, F.lit(")"))).otherwise(""))


def project(rows: DataFrame, layout: list[dict]) -> DataFrame:
    """The selected columns of a layout (see recordloom.plans.layout), in its order, under their titles."""
    return rows.select(*(F.col(c["id"]).alias(c["title"]) for c in sorted((c for c in layout if c["selected"]), key=lambda c: c["order"])))


def report_text(rows: DataFrame, lines: list[tuple[str, Column]]) -> Column:
    """Labelled lines, those without a value left out."""
    return F.concat_ws("\n", *(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), v)) for label, v in lines))


def resolve_edits(rows: DataFrame, edits: DataFrame, columns: list[str], key: str = "row_id", seq: str = "edit_seq", ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with the last edit of each applied: a null in an edit leaves the value, others replace it.  Of edits with equal seq the first by ties counts; without ties seq must tell them apart."""
    last = edits.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq), *ties))).filter("__n = 1").select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return rows.join(last, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def clear_match(rows: DataFrame, cleared: DataFrame, key: str = "row_id") -> DataFrame:
    """rows with the matches blanked that cleared (row_id, side: PL1, PL2 or BOTH) names."""
    sides = cleared.groupBy(key).agg(F.bool_or(F.col("side").isin("PL1", "BOTH")).alias("__1"), F.bool_or(F.col("side").isin("PL2", "BOTH")).alias("__2"))
    joined = rows.join(sides, key, "left")
    blank = {"code": F.lit(""), "name": F.lit(""), "score": F.lit(0.0)}
    return joined.select(*(F.when(F.col(f"__{c[-1]}"), blank[c[:-2]]).otherwise(F.col(c)).alias(c) if c[-2:] in ("_1", "_2") and c[:-2] in blank else F.col(c) for c in rows.columns))


def dismiss_warning(rows: DataFrame, dismissed: DataFrame, key: str = "row_id") -> DataFrame:
    """rows whose warning is taken back by a reviewer: no warning, SAFE, audited by the user."""
    hit = rows.join(dismissed.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    new = {"warning": F.lit(False), "severity": F.lit("SAFE"), "audited_by": F.lit("user_reviewed")}
    return hit.select(*(F.when(F.col("__hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns))


def picker(rows: DataFrame, query: str) -> DataFrame:
    """Up to 50 items (30 for a blank query) whose code or name has the query, in order."""
    wanted = query.strip().lower()
    return by_keyword(rows, wanted, ["code", "name"]).orderBy("idx").limit(50 if wanted else 30)


def replace_rows(rows: DataFrame, changed: DataFrame, key: str = "row_id") -> DataFrame:
    """rows with those of changed in the place of the ones with their key."""
    return rows.join(changed.select(key), key, "left_anti").unionByName(changed)


def toggle_lock(rows: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """Locking marks an override and its time; unlocking clears the time."""
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    joined = rows.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    now = F.when(hit, ~F.col("is_locked")).otherwise(F.col("is_locked"))
    return joined.select(*(now.alias(c) if c == "is_locked" else F.when(hit & ~F.col("is_locked"), F.lit(True)).otherwise(F.col(c)).alias(c) if c == "is_manual_override" else F.when(hit & ~F.col("is_locked"), F.current_timestamp()).when(hit, None).otherwise(F.col(c)).alias(c) if c == "locked_at" else F.col(c) for c in rows.columns))


def save_session(rows: DataFrame, path: str, session_id: str) -> None:
    """Write one session's rows, replacing those it had; other sessions stay."""
    rows.withColumn("session_id", F.lit(session_id)).withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def load_session(spark, path: str, session_id: str) -> DataFrame:  # noqa: ANN001
    return spark.read.parquet(path).filter(F.col("session_id") == session_id).drop("session_id", "saved_at")


def snapshot(rows: DataFrame, path: str) -> str:
    """Write the rows as a session of their own; its id."""
    session_id = f"snapshot_{uuid.uuid4().hex}"
    save_session(rows, path, session_id)
    return session_id


def restored(current: dict, saved: dict) -> dict:
    """The settings after a session is restored: its threshold if it has one other than 0, its other settings if they are given."""
    given = {k: v for k, v in saved.items() if v is not None}
    return current | {k: v for k, v in given.items() if k != "threshold" or v}


def export_json(rows: DataFrame, path: str, settings: dict | None = None) -> None:
    """Write a session as JSON that load_json reads: results, one a line, and settings; refused without results."""
    if rows.isEmpty():
        raise ValueError("there are no results")
    rows.write.mode("overwrite").json(f"{path}/results")
    if settings is not None:
        rows.sparkSession.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_json(spark, path: str, schema: str) -> DataFrame:  # noqa: ANN001
    """Results of an exported session: a folder of export_json, or one document with a list of results; others are refused."""
    row = spark.createDataFrame([], f"r {schema}").schema["r"].dataType
    try:
        return spark.read.schema(row).json(f"{path}/results")
    except AnalysisException:
        found = spark.read.option("multiLine", True).schema(f"results array<{schema}>").json(path)
    if not found.filter("results IS NOT NULL").limit(1).count():
        raise ValueError("the document has no results")
    return found.select(F.inline("results"))


def list_sessions(rows: DataFrame) -> DataFrame:
    """(session_id, saved_at, n_results, n_locked), the latest first."""
    return rows.groupBy("session_id").agg(F.max("saved_at").alias("saved_at"), F.count("*").alias("n_results"), F.count_if("is_locked").alias("n_locked")).orderBy(F.desc("saved_at"), "session_id")


def session_json(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON document."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
