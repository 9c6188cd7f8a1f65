"""What a reviewer does to linked rows: pick, clear and override matches, with the audit of changed rows made anew.

Rows have row_id, name, and per side code_1, name_1, score_1, anatomy_1 (and _2), is_locked, is_manual_override,
manual_note, locked_at and the audit struct of audit_rows(), as far as an operator needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import decompose as D
from recordloom.functions.text import normalize
from recordloom.operators.audit import audit_pair, audit_row, findings, judged, no_findings, skipped
from recordloom.operators.results import auditable, clear_match, report_text
from recordloom.stored import Steps, materialize
from recordloom.vocab import Vocabulary

SIDES = {"PL1": "1", "PL2": "2"}


#: Pairs of names that a task audits with a vocabulary.
PAIRS = 5000


def audit_rows(rows: DataFrame, vocab: Vocabulary | None = None, boundary: str = "ascii") -> DataFrame:
    """rows with audit: both matches held against the name, the finding combined; with a vocabulary, kinds of procedure and organs as well.

    With a vocabulary each distinct name is taken apart once, and each distinct pair of names held against each other once.
    """
    plain = rows.select(*(c for c in rows.columns if c != "audit"))
    if vocab:
        plain = materialize(plain, "audited")  # read for its pairs and for its rows
    work = plain.select(F.struct(*plain.columns).alias("__row"), "name", "name_1", "name_2", "score_1", "score_2")
    if vocab:
        pairs = _pair_findings(plain, vocab, boundary)
        named = lambda c: F.coalesce(c, F.lit(""))
        for n in SIDES.values():
            found = pairs.select("g", "t", F.col("details").alias(f"__details_{n}"))
            work = work.join(found, (named("name") == found["g"]) & (named(f"name_{n}") == found["t"]), "left").drop("g", "t")
            work = judged(work.withColumn(f"__details_{n}", F.coalesce(f"__details_{n}", no_findings())), "name", f"name_{n}", f"score_{n}", f"__details_{n}", f"__audit_{n}")
    else:
        for n in SIDES.values():
            work = audit_pair(work, "name", f"name_{n}", f"score_{n}", f"__audit_{n}", boundary)
    return audit_row(work, "__audit_1", "__audit_2").select("__row.*", "audit")


def _pair_findings(rows: DataFrame, vocab: Vocabulary, boundary: str) -> DataFrame:
    """(g, t, details) of the pairs of names and matches of either side that a rule finds something between."""
    sides = [rows.select(F.coalesce("name", F.lit("")).alias("g"), F.coalesce(f"name_{n}", F.lit("")).alias("t")) for n in SIDES.values()]
    with Steps("audit") as steps:
        pairs = steps.keep(sides[0].unionByName(sides[1]).filter(~skipped(F.col("g"), F.col("t"))).distinct())
        names = pairs.select(F.col("g").alias("name")).union(pairs.select("t")).distinct()
        parts = steps.keep(D.decompose(names.withColumn("clean", normalize(F.col("name"), vocab)), "clean", vocab).select("name", "anatomy", "category", "modality"))
        side = lambda n, on: parts.select(F.col("name").alias(on), *(F.col(p).alias(f"{p}_{n}") for p in ("anatomy", "category", "modality")))
        own = lambda p: (F.col(f"{p}_0"), F.col(f"{p}_1"))
        dealt = pairs.repartition(-(-pairs.count() // PAIRS) or 1, "g", "t")
        both = dealt.join(side(0, "g"), "g").join(side(1, "t"), "t")
        status = (D.modality_status(*own("modality"), vocab), D.anatomy_status(*own("anatomy"), *own("category")))
        return materialize(both.select("g", "t", findings(F.col("g"), F.col("t"), boundary, status).alias("details")).filter(F.size("details") > 0), "audit-findings")


def _changed(rows: DataFrame, ids: DataFrame, key: str, change, vocab: Vocabulary | None) -> DataFrame:  # noqa: ANN001
    """rows, those with one of the ids changed and audited anew."""
    touched = rows.join(ids.select(key).distinct(), key, "left_semi")
    done = audit_rows(change(touched), vocab)
    return rows.join(ids.select(key).distinct(), key, "left_anti").unionByName(done.select(*rows.columns))


def clear_and_audit(rows: DataFrame, cleared: DataFrame, vocab: Vocabulary | None = None, key: str = "row_id") -> DataFrame:
    """rows with the matches and their anatomy blanked that cleared (row_id, side: PL1, PL2 or BOTH) names."""

    def change(touched: DataFrame) -> DataFrame:
        blank = clear_match(touched, cleared, key)
        gone = {f"anatomy_{n}": F.when((F.col(f"name_{n}") == "") & (F.col(f"code_{n}") == ""), None).otherwise(F.col(f"anatomy_{n}")) for n in SIDES.values() if f"anatomy_{n}" in touched.columns}
        return blank.withColumns(gone) if gone else blank

    return _changed(rows, cleared, key, change, vocab)


def pick_inline(rows: DataFrame, picks: DataFrame, vocab: Vocabulary | None = None, key: str = "row_id") -> DataFrame:
    """rows with the last pick of each side applied: picks (row_id, seq, side, code, name, score, anatomy); without a code and name the match is taken away.

    Locks the row as an override and notes the last pick; the time of locking stays as it is.
    """
    last = picks.groupBy(key, "side").agg(F.max_by(F.struct(F.coalesce("code", F.lit("")).alias("code"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("score", F.lit(0.0)).alias("score"), "anatomy", "seq"), "seq").alias("p"))
    last = last.withColumn("note", F.concat(F.when((F.col("p.code") == "") & (F.col("p.name") == ""), "Match taken away by hand [").otherwise("Match picked by hand ["), F.col("side"), F.lit("]")))
    of = lambda side: F.max_by("p", F.when(F.col("side") == side, F.col("p.seq"))).alias(f"__{SIDES[side]}")
    wide = last.groupBy(key).agg(of("PL1"), of("PL2"), F.max_by("note", "p.seq").alias("__note"))

    def change(touched: DataFrame) -> DataFrame:
        new = {"is_locked": F.lit(True), "is_manual_override": F.lit(True), "manual_note": F.col("__note")}
        for n in SIDES.values():
            new |= {f"{c}_{n}": F.when(F.col(f"__{n}").isNotNull(), F.col(f"__{n}")[c]).otherwise(F.col(f"{c}_{n}")) for c in ("code", "name", "score", "anatomy")}
        return touched.join(wide, key).select(*((new[c].alias(c) if c in new else F.col(c)) for c in touched.columns))

    return _changed(rows, picks, key, change, vocab)


def save_override(rows: DataFrame, edits: DataFrame, vocab: Vocabulary | None = None, key: str = "row_id", now: Column | None = None) -> DataFrame:
    """rows with edits (row_id, code_1, name_1, code_2, name_2, is_locked, manual_note), one a row, in their place.

    A match that was changed scores 100, one that was taken away 0.  The row is an override if it was one, is locked
    or differs from before; a blank note is none; a lock keeps its time, a new one gets now, none has none.
    """
    fields = ["code_1", "name_1", "code_2", "name_2", "is_locked", "manual_note"]
    wanted = edits.select(key, *(F.col(c).alias(f"__{c}") for c in fields))
    given = lambda c: F.coalesce(f"__{c}", F.lit(False) if c == "is_locked" else F.lit(""))
    had = lambda c: F.coalesce(c, F.lit(False) if c == "is_locked" else F.lit(""))

    def change(touched: DataFrame) -> DataFrame:
        modified = F.lit(False)
        for c in fields:
            modified |= given(c) != had(c)
        new = {c: given(c) for c in fields}
        for n in SIDES.values():
            same = (given(f"code_{n}") == had(f"code_{n}")) & (given(f"name_{n}") == had(f"name_{n}"))
            new[f"score_{n}"] = F.when(same, F.col(f"score_{n}")).when((given(f"code_{n}") == "") & (given(f"name_{n}") == ""), 0.0).otherwise(100.0)
        note = F.trim(given("manual_note"))
        new |= {"manual_note": F.when(note != "", note), "is_manual_override": modified | F.coalesce("is_manual_override", F.lit(False)) | given("is_locked")}
        new["locked_at"] = F.when(given("is_locked"), F.coalesce("locked_at", F.current_timestamp() if now is None else now))
        return touched.join(wanted, key).select(*((new[c].alias(c) if c in new else F.col(c)) for c in touched.columns))

    return _changed(rows, edits, key, change, vocab)


def audit_summary(rows: DataFrame) -> DataFrame:
    """One row: the rows that an audit looks at (those with a match), the warnings, and the others of them."""
    audited = auditable(rows).agg(F.count("*").alias("audited"))
    warned = rows.agg(F.count_if(F.coalesce("audit.warning", F.lit(False))).alias("warnings"))
    return audited.join(F.broadcast(warned)).select("audited", "warnings", (F.col("audited") - F.col("warnings")).alias("safe"))


def labels(rows: DataFrame, vocab: Vocabulary, default: str = "Unclassified", chapter: str = "chapter") -> DataFrame:
    """rows (decomposed) with specialty_label, the chapter, else the category's display name, else the default, and anatomy_label, the terms, null without any."""
    names = F.create_map(*(F.lit(x) for c, (shown, _) in vocab.ontology.items() for x in (c, shown))) if vocab.ontology else F.create_map().cast("map<string,string>")
    own = F.when(F.trim(F.coalesce(F.col(chapter), F.lit(""))) != "", F.col(chapter))
    return rows.withColumns({"specialty_label": F.coalesce(own, F.element_at(names, F.col("category")), F.lit(default)), "anatomy_label": F.when(F.size("anatomy") > 0, F.array_join("anatomy", ", "))})


def extras(rows: DataFrame, specs: list[tuple[str, str, int]]) -> DataFrame:
    """rows (cells, cells_1, cells_2, ..) with extra columns (name, side: source, PL1 or PL2, index): the trimmed cell or empty.

    Cells of a catalog count only where the row is matched in it, and on locked rows none do.
    """
    found = {}
    for name, side, i in specs:
        n = SIDES.get(side)
        cell = F.coalesce(F.trim(F.get(F.col(f"cells_{n}" if n else "cells"), F.lit(i))), F.lit(""))
        found[name] = F.when((F.coalesce(f"name_{n}", F.lit("")) != "") & ~F.coalesce("is_locked", F.lit(False)), cell).otherwise("") if n else cell
    return rows.withColumns(found)


def audit_report(rows: DataFrame) -> DataFrame:
    """(row_id, report): the audit of each row as labelled lines, then its findings, numbered."""
    a = lambda f: F.col(f"audit.{f}")
    blank = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(other)
    match = lambda n: F.concat(F.lit("["), blank(f"code_{n}", "none"), F.lit("] "), blank(f"name_{n}", "none"), F.lit(" ("), F.col(f"score_{n}").cast("string"), F.lit(" %)"))
    verdict = F.when(a("warning") & (a("severity") == "HIGH"), "serious conflict").when(a("warning"), "to be checked").otherwise("suitable")
    found = F.transform(a("details"), lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d["type"], F.lit(" ("), d["severity"], F.lit("): "), d["reason"]))
    head = report_text(rows, [("Code", blank("code", "(none)")), ("Name", F.col("name")), ("First catalog", match("1")), ("Second catalog", match("2")), ("Verdict", verdict), ("Reason", F.when(a("reason") != "", a("reason")).otherwise("no rule applies"))])
    return rows.select("row_id", F.concat(head, F.when(F.size(a("details")) > 0, F.concat(F.lit("\nFindings:\n"), F.array_join(found, "\n"))).otherwise("")).alias("report"))
