"""A corpus pipeline of five stages: (spark, docs, sf_dir) -> DataFrame each, written and reread in between.

Language ID drops documents whose language can't be told; the Jaccard join keeps one document of each group
of near duplicates; decontamination drops documents with a benchmark window; the secret scan replaces
secrets in the texts; the last stage encodes the texts as SentencePiece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontaminate, jaccard, language, pieces, secrets
from recordloom.llm.storage import documents, materialize, release

#: A document is rejected if the best language's calibrated probability is not this share of the way from 1 / languages to 1.
LEAST_MARGIN = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.corpus_model(docs)
    n = len(model.langs)
    # columns of the documents' own may have any name
    lang, score = (f"{c}{'_' * (1 + max(map(len, docs.columns)))}" for c in ("lang", "score"))
    told = F.col(score) * n - 1 >= LEAST_MARGIN * (n - 1)
    return language.identify(docs, model, names=(lang, score)).filter((F.col(lang) != "und") & told).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.redact(docs)
    return found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding", encoding),
]
#: A trained model's verdicts and BPE ids are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        read, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i + 1}")
            release(read)  # a table of the stage before, never the documents
    return docs
