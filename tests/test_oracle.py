"""Every registered query with SQL gives the same rows as its SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    """Sorted rows by columns' names; a column with nulls is compared value by value, as pandas may hold its integers as floats."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].isna().any():
            df[c] = [None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) else v for v in df[c]]
            df[c] = df[c].astype(object).where(df[c].notna(), None)
    return sorted(map(repr, df.itertuples(index=False, name=None)))


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_text_queries_read_whole_texts(spark, tmp_path):
    long = "word " * 40
    rows = [(1, long + "One"), (2, long + "one!"), (3, long + "two"), (4, long + "three")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: [tuple(r) for r in entry.queries()[n](spark, str(tmp_path)).collect()] for n in ("text_clean_lite", "text_keyword", "text_tokens", "text_dedupe", "text_exact_link", "text_postings")}
    assert dict(got["text_clean_lite"]) == dict(got["text_keyword"]) == {i: t.lower().strip("!") for i, t in rows}
    assert all(len(t.split("|")) == 41 for _, t in got["text_tokens"])
    assert sorted(i for i, _ in got["text_dedupe"]) == [1, 3, 4] and sorted(got["text_exact_link"]) == [(2, 1), (4, -1)]
    assert set(got["text_postings"]) == {(i, t) for i, w in enumerate(("one", "one", "two", "three"), 1) for t in ("word", w)}
