"""From raw sheets (row_no, cells) to catalogs: header row, columns, chapters and ordinals.

What is inferred looks at the first rows only, on the driver, as a person would; all rows are then read by
DataFrame operations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import NOISE_LITE, chapter_header, clean_lite, is_ordinal, keyword, nfc, parse_ordinal
from recordloom.operators.chapters import fill_chapters, ordinals, running_count
from recordloom.vocab import Vocabulary, bare

PROBE = 30


@dataclass(frozen=True)
class Inspection:
    header_row: int
    headers: list[str]
    samples: list[list[str]]
    name_col: int
    code_col: int
    ordinal_col: int
    specialty_col: int = -1


@dataclass(frozen=True)
class Kind:
    """What tells a kind of sheet: words of its header, the header's row and the columns of name, code and ordinal without them; whether it is a target."""

    words: tuple[str, ...]
    header: int
    columns: tuple[int, int, int]
    target: bool = False


#: The three kinds of catalogs.
SOURCE = Kind(("danh muc ky thuat", "ten ky thuat", "ten danh muc"), 1, (2, 1, 0))
FIRST = Kind(("ten ky thuat", "ten ky thuat cot 4", "ma ky thuat"), 3, (3, 1, 0), True)
SECOND = Kind(("ten ky thuat", "ma lien ket", "ten ky thuat cot 5", "ma tuong duong"), 1, (4, 3, 0), True)


def _key(cell: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in bare((cell or "").lower())).split())


def header_by_ordinal(rows: list[list[str]], is_key) -> int:  # noqa: ANN001
    """The first row of two or more filled cells with an ordinal header; else one that names a catalog; else the first."""
    for i, row in enumerate(rows[:PROBE]):
        if sum(bool(c.strip()) for c in row) >= 2 and any(is_key(_key(c)) for c in row):
            return i
    for i, row in enumerate(rows[:PROBE]):
        if any(w in f" {_key(c)} " for c in row for w in (" danh muc ", " ky thuat ", " ten ")):
            return i
    return 0


#: Numbers of decrees, and the shapes of ordinal headers: whole, at the beginning, at the end, within.
DECREES = ("43", "21", "23", "32")
ORDINAL_HEADERS = ("stt", "tt", "so tt", "so thu tu", "thu tu")
ORDINAL_STARTS, ORDINAL_ENDS, ORDINAL_PARTS = ("stt ", "tt ", "so tt "), (" stt", " tt"), ("stt cot", "tt cot", "so tt cot")


def is_ordinal_header(header: str) -> bool:
    """Whether a header names an ordinal column and not the code of a decree."""
    k = _key(header)
    if not k or any(n in k for n in DECREES):
        return False
    return k in ORDINAL_HEADERS or k.startswith(ORDINAL_STARTS) or k.endswith(ORDINAL_ENDS) or any(w in k for w in ORDINAL_PARTS)


def ordinal_column(headers: list[str], rows: list[list[str]], name_col: int, code_col: int) -> int:
    """Of several ordinal columns before the name, the one that numbers the catalog itself: named so, or with gaps or numbers above 10."""
    keys = [_key(h) for h in headers]
    near = [i for i in range(max(0, name_col)) if is_ordinal_header(headers[i]) or keys[i].startswith("stt") or "so tt" in keys[i]]
    if len(near) > 1:
        for i in near:
            if any(w in keys[i] for w in ("qd", "43", "21", "23", "kt", "stt 2")):
                return i
        probe = [(r[near[1]] if near[1] < len(r) else "").strip() for r in rows[:24]]
        high = any(not v or (v.replace(".", "", 1).isdigit() and float(v) > 10) for v in probe)
        return near[1] if high else near[0]
    if near:
        return near[0]
    exact = next((i for i, k in enumerate(keys) if is_ordinal_header(headers[i])), -1)
    return exact if exact >= 0 else 0 if name_col and code_col else -1


#: Headers of a column with a row's specialty.
SPECIALTY_HEADERS = ("chuyen khoa", "khoa phong", "khoa", "khoa thuc hien", "nhom ky thuat", "phan loai", "chuyen nganh", "he co quan", "chuong")


def specialty_column(headers: list[str]) -> int:
    keys = [_key(h) for h in headers]
    exact = next((i for i, k in enumerate(keys) if k in SPECIALTY_HEADERS), -1)
    return exact if exact >= 0 else next((i for i, k in enumerate(keys) if k.startswith(("chuyen khoa", "khoa ", "nhom ")) and not any(w in k for w in ("ten", "ma", "stt"))), -1)


def header_by_keyword(rows: list[list[str]], words: list[str], fallback: int = 0) -> int:
    """The first of 15 rows with a keyword; else the fullest of the first six, from the fallback on."""
    for i, row in enumerate(rows[:15]):
        if any(_key(w) in _key(c) for c in row if c.strip() for w in words):
            return i
    filled = lambda i: sum(bool(c.strip()) for c in rows[i]) if i < len(rows) else -1
    best = fallback
    for i in range(min(6, len(rows))):
        if filled(i) > filled(best):
            best = i
    return max(0, min(best, len(rows) - 1))


def header_by_clean_text(rows: list[list[str]], words: list[str], fallback: int = 1) -> int:
    """The first of 20 rows with a keyword in a cell, both cleaned of punctuation; else the fallback."""
    clean = lambda c: " ".join(re.sub(NOISE_LITE, " ", (c or "").lower()).split())
    wanted = [clean(w) for w in words]
    return next((i for i, row in enumerate(rows[:20]) if any(w in clean(c) for c in row if c for w in wanted)), fallback)


def resolve_column(headers: list[str], words: list[str], fallback: int = -1) -> int:
    """The column of the first keyword that a header contains; else of the first whose words a header has; else the fallback."""
    keys = [_key(h) for h in headers]
    for test in (lambda w, k: w in k, lambda w, k: all(x in k.split() for x in w.split() if len(x) >= 2) and any(len(x) >= 2 for x in w.split())):
        for w in map(_key, words):
            for i, k in enumerate(keys):
                if k and test(w, k):
                    return i
    return fallback if 0 <= fallback < len(headers) else -1


#: Words that tell a catalog's columns.
NAME_WORDS, CODE_WORDS = ["tên kỹ thuật", "danh mục kỹ thuật", "tên dịch vụ", "tên"], ["mã tương đương", "mã kỹ thuật", "mã tt", "mã"]


def inspect(sheet: DataFrame, kind: Kind | None = None) -> Inspection:
    """Header and columns of a sheet: of a kind by its words, else by an ordinal header, as for a preview."""
    rows = [list(r.cells) for r in sheet.orderBy("row_no").limit(PROBE).collect()]
    if len(rows) < 2:
        raise ValueError("a catalog needs a header and a row")
    fallback = (kind or SOURCE).columns
    head = header_by_keyword(rows, list(kind.words), kind.header) if kind else header_by_ordinal(rows, is_ordinal_header)
    headers = [c.strip() or f"Column {i + 1}" for i, c in enumerate(rows[head])]
    samples = [r for r in rows[head + 1 :] if any(c.strip() for c in r)][:5]
    name, code = resolve_column(headers, NAME_WORDS, fallback[0]), resolve_column(headers, CODE_WORDS, fallback[1])
    return Inspection(head, headers, samples, name, code, ordinal_column(headers, rows[head + 1 :], name, code), specialty_column(headers))


def catalog(sheet: DataFrame, spec: Inspection, vocab: Vocabulary, target: bool = False) -> DataFrame:
    """(idx, id, code, name, clean, ordinal_text, ordinal, chapter, cells): the rows below the header that are no chapters and have a name.

    idx is the row in the sheet, id counts the rows kept.  A target's ordinals don't tell its chapters.  Refused without rows.
    """
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))) if i >= 0 else F.lit("")
    body = sheet.filter(F.col("row_no") > spec.header_row).withColumns({"name": nfc(cell(spec.name_col)), "code": cell(spec.code_col), "ordinal_text": cell(spec.ordinal_col)})
    after = F.size(F.filter(F.slice("cells", spec.name_col + 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: F.trim(c) != "")) == 0
    head = chapter_header(F.col("name"), F.lit("") if target else F.col("ordinal_text"), F.col("code"), after, vocab.specialties)
    marked = body.withColumn("head", head)
    major = F.col("head").rlike(r"(?i)^([IVXLCDM]+[.:]|chương|chuong|phần|phan)")
    filled = fill_chapters(marked, F.when(major, F.col("head")), F.when(~major, F.col("head")))
    kept = filled.filter(F.col("head").isNull() & (F.col("name") != ""))
    if kept.isEmpty():
        raise ValueError("the catalog has no rows")
    counted = running_count(ordinals(kept, is_ordinal(F.col("ordinal_text"))), F.lit(True), out="id")
    own = cell(spec.specialty_col)
    return counted.select(F.col("row_no").alias("idx"), "id", "code", "name", clean_lite(F.col("name")).alias("clean"), parse_ordinal(F.col("ordinal_text")).alias("ordinal_text"), "ordinal", F.when(own != "", own).otherwise(F.col("chapter")).alias("chapter"), "cells")


def keyword_column(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, keyword(F.col(column)))
