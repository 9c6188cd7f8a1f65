"""Terms of a dictionary found in one pass over a text, however many there are.

Terms are phrases of whole words.  They make a trie of words with failure links: at each word of a text the
state is the longest ending that begins a term, so all terms that end there are known without going back.  What is
found is listed by the dictionary's own order (kinds, and the terms of a kind), not by places in the text, so
precedence (categories first to last, longer terms before shorter ones) is the order of the table.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<kind: string, phrase: string>>"
#: Terms of a table that are made into a trie; a longer table is joined by the texts' own phrases.
MOST = 200_000


class Trie(NamedTuple):
    terms: list[tuple[str, str]]  #: (kind, phrase) in order of precedence
    after: list[dict[str, int]]
    fail: list[int]
    ends: list[tuple[int, ...]]  #: the terms that end at a state, shorter ones by failure links included

    def found(self, text: str | None) -> list[int]:
        """The terms in a text of words with single spaces between them, each once, by precedence."""
        out: set[int] = set()
        state = 0
        for word in (text or "").split(" "):
            while state and word not in self.after[state]:
                state = self.fail[state]
            state = self.after[state].get(word, 0)
            out.update(self.ends[state])
        return sorted(out)


def trie(terms: Iterable[tuple[str, str]]) -> Trie:
    """Of (kind, phrase) in order of precedence; a phrase may have several kinds."""
    listed = list(dict.fromkeys((k, p) for k, p in terms if p.strip()))
    after: list[dict[str, int]] = [{}]
    own: list[list[int]] = [[]]
    for n, (_, phrase) in enumerate(listed):
        state = 0
        for word in phrase.split(" "):
            if word not in after[state]:
                after[state][word] = len(after)
                after.append({})
                own.append([])
            state = after[state][word]
        own[state].append(n)
    fail, todo = [0] * len(after), list(after[0].values())
    for state in todo:  # breadth first: a failure link leads to a shorter phrase
        own[state] += own[fail[state]]
        for word, below in after[state].items():
            back = fail[state]
            while back and word not in after[back]:
                back = fail[back]
            fail[below] = after[back].get(word, 0)
            todo.append(below)
    return Trie(listed, after, fail, [tuple(sorted(e)) for e in own])


def hits(text: Column, terms: Iterable[tuple[str, str]]) -> Column:
    """(kind, phrase) of the terms in the text, each once, by precedence."""
    made = trie(terms)

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series, _: pd.Series) -> pd.Series:
        named = [{"kind": k, "phrase": p} for k, p in made.terms]
        return pd.Series([[named[n] for n in made.found(t)] for t in texts], dtype=object)

    # named twice, the text is a column of its own to the planner, which can't take an expression with lambdas for an argument
    return find(text, text)


def of_kind(found: Column, kind: str) -> Column:
    """The phrases of one kind among what hits() found."""
    return F.transform(F.filter(found, lambda h: h["kind"] == kind), lambda h: h["phrase"])


def hits_of_table(rows: DataFrame, terms: DataFrame, key: str, text: str, most: int = MOST) -> DataFrame:
    """(key, found) of rows with terms from a table (rank, kind, phrase): found as of hits(), by rank.  The key is unique.

    A table of at most `most` terms, which is counted, is made into a trie; a longer one is joined by equality with the
    texts' own phrases of as many words as its terms have.
    """
    few = terms.select("rank", "kind", "phrase").orderBy("rank", "kind", "phrase").limit(most + 1).collect()
    if len(few) <= most:
        return rows.select(key, hits(F.col(text), [(r.kind, r.phrase) for r in few]).alias("found"))
    lengths = sorted(r[0] for r in terms.select(F.size(F.split("phrase", " "))).distinct().collect())
    words = F.split(F.coalesce(F.col(text), F.lit("")), " ")

    def of_length(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))

    said = [of_length(n) for n in lengths]
    phrases = rows.select(key, words.alias("w")).select(key, F.explode(F.array_distinct(F.concat(*said))).alias("phrase"))
    ranked = terms.groupBy("kind", "phrase").agg(F.min("rank").alias("rank"))
    met = phrases.join(ranked, "phrase").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind", "phrase"))), lambda h: F.struct(h["kind"].alias("kind"), h["phrase"].alias("phrase"))).alias("found"))
    return rows.select(key).join(met, key, "left").select(key, F.coalesce("found", F.array().cast(FOUND)).alias("found"))
