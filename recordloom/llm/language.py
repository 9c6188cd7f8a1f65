"""Operator 5, language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of lower-cased letters, with each run of other characters as one mark,
hashed to BUCKETS.  Document frequencies are counted over all labelled training rows.  The weights are
fitted by follow-the-regularised-leader with elastic-net penalties, a fifth of the sample is kept apart and sets
the temperature.  The sample is bounded by SAMPLE texts a language and SAMPLE_OF_ALL in all: of each language's
distinct texts those with the lowest hashes, so it doesn't depend on ids, their type or their repetition.  The
model keeps only the buckets that have a weight, and at most LANGUAGES languages, which bounds what is broadcast:
of more labels the most frequent ones are learned (of equally frequent ones the first by name), and the model says
how many it left out.

Cases.  Null text, or text without a letter: `und` with score 0.  Empty and very long texts: as any other,
whole.  Null labels aren't learned from; neither are rows that the caller holds out.  Without any labelled
row every text is `und`.  Of equal scores the first language by name wins.  Ids may be null, repeated or of any
type: rows are learned from by their text, so repeated rows count once in the sample and each in the document
frequencies.  Repeated rows are each returned; an empty table gives an empty result.  identify() keeps all
columns of its input, and replaces any named as its results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recordloom.llm.storage import documents, map_arrow

BUCKETS = 1 << 15
SAMPLE, SAMPLE_OF_ALL = 1000, 16_000
LANGUAGES = 500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.01
_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    row: np.ndarray  #: bucket -> row of weights; 0 for buckets without a weight
    weights: np.ndarray  #: row x language; the first row is 0
    temperature: float
    left_out: int = 0  #: labels that weren't learned, beyond the most frequent ones

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[self.row[at]]


def sparse(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Model.row and Model.weights of a table of bucket x language."""
    kept = np.flatnonzero(weights.any(1))
    row = np.zeros(len(weights), np.int32)
    row[kept] = np.arange(1, len(kept) + 1)
    return row, np.concatenate([np.zeros((1, weights.shape[1])), weights[kept]])


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a text's n-grams; None if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    marked = np.zeros(len(code) + 2, np.uint64)
    marked[1:-1] = code * letter
    keep = np.ones(len(marked), bool)
    keep[1:] = (marked[1:] != 0) | (marked[:-1] != 0)
    c = marked[keep]
    h = [c[c != 0] * _KEYS[0]]
    h.append(c[:-1] * _KEYS[0] + (c[1:] + np.uint64(1)) * _KEYS[1])
    h.append(h[1][:-1] + (c[2:] + np.uint64(1)) * _KEYS[2])
    h = np.concatenate(h)
    h = ((h ^ (h >> np.uint64(29))) * _KEYS[0]) >> np.uint64(64 - 15)
    n = np.bincount(h.astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def weigh(terms: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(terms[1])) * idf[terms[0]]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 11) -> np.ndarray:
    """Weights fitted to rows of (buckets, values, class)."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def solved(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = solved(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return solved(slice(None))


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search; targets are smoothed by one row a class, so that it stays above 0."""
    if not len(y):
        return 1.0
    target = np.full(logits.shape, 1 / (len(y) + logits.shape[1]))
    target[np.arange(len(y)), y] += len(y) / (len(y) + logits.shape[1])
    loss = lambda u: -(target * np.log(np.maximum(softmax(logits / np.exp(u)), 1e-300))).sum(1).mean()
    a, b, r = -5.0, 5.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """In how many rows each bucket occurs; what comes to the driver is one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if terms := term_counts(t.as_py()):
                    df[terms[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "df"])

    df = np.zeros(BUCKETS, np.int64)
    for bucket, n in map_arrow(docs.select(text), run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[bucket] = n
    return df


def sampled(rows: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """(lang, draw, text): of rows (text, lang) the texts of each language with the lowest hashes, each once; sizes: distinct texts, about."""
    draw = F.shiftrightunsigned(F.xxhash64("text"), 1)
    # about four times as many as wanted leave their tasks; the hashes of any of them come before those of all others
    most = F.element_at(F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, (2**63 - 1) * min(n, 4 * sample + 50) // n))), F.col("lang"))
    near = rows.withColumn("draw", draw).filter(F.col("draw") <= most).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    return near.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("draw"))).filter(F.col("n") <= sample).drop("n")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """A model of the rows with one of the most frequent labels; null labels and texts are left out."""
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("text", 0.02).alias("texts"))
    found = counted.orderBy(F.desc("n"), "lang").limit(languages + 1).collect()
    langs, left_out = sorted(r.lang for r in found[:languages]), 0
    if len(found) > languages:
        found, left_out = found[:languages], counted.count() - languages
        rows = rows.filter(F.col("lang").isin(langs))
    if not langs:
        return Model([], np.zeros(BUCKETS), np.zeros(BUCKETS, np.int32), np.zeros((1, 0)), 1.0)
    df = document_frequencies(rows, "text")
    idf = np.log((1 + sum(r.n for r in found)) / (1 + df)) + 1
    picked = sampled(rows.filter("text IS NOT NULL"), {r.lang: max(r.texts, 1) for r in found}, min(sample, max(SAMPLE_OF_ALL // len(langs), 1)))
    picked = picked.select("lang", "draw", (F.pmod(F.xxhash64("draw"), F.lit(5)) == 0).alias("apart"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [term_counts(t.as_py()) for t in batch.column(3)]
            at = pa.array([None if t is None else t[0].astype(np.int32) for t in terms], pa.list_(pa.int32()))
            n = pa.array([None if t is None else t[1].astype(np.int32) for t in terms], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], at, n], names=["lang", "draw", "apart", "at", "n"])

    got = map_arrow(picked, run, "lang string, draw long, apart boolean, at array<int>, n array<int>").toArrow().sort_by([("lang", "ascending"), ("draw", "ascending")])
    # counts stay in Arrow's buffers: 4 bytes a bucket of a text
    class_of = {v: i for i, v in enumerate(langs)}
    made = []
    for batch in got.to_batches():
        name, apart = batch.column("lang").to_pylist(), batch.column("apart").to_pylist()
        for i in range(batch.num_rows):
            a, n = (batch.column(c)[i].values for c in ("at", "n"))
            if a is not None and len(a):
                a = a.to_numpy()
                made.append((a, weigh((a, n.to_numpy()), idf).astype(np.float32), class_of[name[i]], apart[i]))
    model = Model(langs, idf, *sparse(ftrl([m[:3] for m in made if not m[3]], len(langs))), 1.0)
    apart = [m for m in made if m[3]]
    logits = np.array([model.logits(at, x) for at, x, _, _ in apart]).reshape(len(apart), len(langs))
    return model._replace(temperature=calibrate(logits, np.array([y for *_, y, _ in apart], np.int64)), left_out=left_out)


def predict(model: Model, text: str | None) -> tuple[str, float]:
    terms = term_counts(text) if model.langs else None
    if terms is None:
        return "und", 0.0
    p = softmax(model.logits(terms[0], weigh(terms, model.idf)) / model.temperature)
    best = int(p.argmax())
    return model.langs[best], float(p[best])


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score under the given names.  The model's size is bounded by BUCKETS and LANGUAGES, so it is broadcast."""
    kept = docs.drop(*(c for c in names if c != text))
    at = kept.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{names[0]}` string, `{names[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(shared.value, t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names, *names])

    return map_arrow(kept, run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def corpus_model(docs: DataFrame) -> Model:
    return train(docs.filter(~held_out()))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), corpus_model(docs)).select("doc_id", "held_out", "lang_pred", "score")
