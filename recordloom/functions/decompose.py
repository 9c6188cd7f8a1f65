"""Decomposition of procedure names and the barriers between two of them.

All terms of a vocabulary are looked for in one pass over a name, so neither the plan nor the time grows with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.terms import hits, of_kind
from recordloom.vocab import Vocabulary, spellings


def _phrases(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def terms_of(vocab: Vocabulary) -> list[tuple[str, str]]:
    """The vocabulary's terms by kind, in order of precedence: categories and modalities as listed, longer terms and actions first."""
    out = [(f"anatomy {c}", t) for c in vocab.ontology for t in vocab.terms(c)]
    out += [("action", a) for a in sorted(spellings(vocab.actions), key=lambda a: -len(a))]
    for name, patterns in vocab.modalities.items():
        barred = [p for p, _ in vocab.excluded.get(name, [])]
        out += [(f"modality {name}", s) for s in spellings([p for p in patterns if p not in barred])]
        out += [(f"barred {name} {p}", s) for p in barred for s in spellings([p])]
    return out + [("modifier", m) for m in spellings(vocab.modifiers)]


def _removed(text: Column, phrases: Column) -> Column:
    """The text without the phrases, one after another; of adjacent equal ones the second stays."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.trim(F.regexp_replace(F.aggregate(phrases, padded, lambda s, p: F.replace(s, F.concat(F.lit(" "), p, F.lit(" ")), F.lit(" "))), r"\s+", " "))


def decompose(df: DataFrame, text: str, vocab: Vocabulary) -> DataFrame:
    """df with modifiers, anatomy, category, actions, modalities, modality, rest (the text without anatomy) and core.

    Arrays are in order of detection.  Empty text gives empty arrays and nulls.
    """
    t, found = F.col(text), F.col("__found")
    df = df.withColumn("__found", hits(t, terms_of(vocab)))
    organs = F.filter(found, lambda h: F.startswith(h["kind"], F.lit("anatomy ")))
    anatomy = F.array_distinct(F.transform(organs, lambda h: h["phrase"]))
    category = F.substring(F.get(F.transform(organs, lambda h: h["kind"]), F.lit(0)), len("anatomy ") + 1, 1 << 20)
    # an action within one that is kept already isn't one of its own
    actions = F.aggregate(of_kind(found, "action"), _phrases([]), lambda kept, a: F.when(F.exists(kept, lambda k: F.contains(k, a)), kept).otherwise(F.array_append(kept, a)))
    forced = F.lit(False)
    if vocab.forced:
        forced = F.exists(_phrases(spellings(vocab.forced[1])), lambda p: F.contains(t, p))
    shown = []
    has = lambda kind: F.exists(found, lambda h: h["kind"] == kind)
    for name in vocab.modalities:
        here = has(f"modality {name}")
        for p, words in vocab.excluded.get(name, []):
            here |= has(f"barred {name} {p}") & ~F.exists(_phrases(spellings(words)), lambda w: F.contains(t, w))
        if vocab.forced and name == vocab.forced[0]:
            here |= forced
        shown.append(F.when(here, F.lit(name)))
    modalities = F.array_compact(F.array(*shown)) if shown else _phrases([])
    implied = F.lit(None).cast("string")
    for c, m in vocab.implied.items():
        implied = F.when(F.col("category") == c, F.lit(m)).otherwise(implied)
    primary = F.coalesce(F.when(forced, F.lit(vocab.forced[0] if vocab.forced else None)), F.get("modalities", F.lit(0)), implied)
    out = df.withColumns({"modifiers": of_kind(found, "modifier"), "anatomy": anatomy, "category": category, "actions": actions, "modalities": modalities})
    out = out.withColumn("modality", primary).withColumn("rest", _removed(t, F.col("anatomy")))
    fillers = "|".join(vocab.fillers) or "(?!)"
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), f" (?:{fillers}) ", " "), r"\s+", " "))
    return out.withColumn("core", _removed(_removed(bare, F.col("modifiers")), F.col("actions"))).drop("__found")


def anatomy_status(a: Column, b: Column, category_a: Column, category_b: Column) -> Column:
    """GENERIC (a side without terms), EXACT_MATCH (a term equal to or within another), SAME_ORGAN_SYSTEM, SEVERE_CONFLICT."""
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    close = F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))
    return F.when(none_a | none_b, "GENERIC").when(close, "EXACT_MATCH").when(category_a == category_b, "SAME_ORGAN_SYSTEM").otherwise("SEVERE_CONFLICT")


def anatomy_factor(a: Column, b: Column) -> Column:
    """The penalty of a generic pair: one side only has terms."""
    return F.when((F.size(a) == 0) == (F.size(b) == 0), 1.0).otherwise(0.9)


def modality_status(a: Column, b: Column, vocab: Vocabulary) -> Column:
    """UNKNOWN, MATCH, CONFLICT or COMPATIBLE."""
    clash = F.lit(False)
    for x, y in vocab.conflicts:
        clash |= ((a == x) & (b == y)) | ((a == y) & (b == x))
    return F.when(a.isNull() | b.isNull(), "UNKNOWN").when(a == b, "MATCH").when(clash, "CONFLICT").otherwise("COMPATIBLE")
