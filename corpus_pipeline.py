"""A corpus pipeline in five stages, each over all documents that the one before it kept.

What each stage decides: language ID drops a document that it can't place
(`und`, or a posterior below SURE); near-dedup keeps the first document of each
group of documents with ALIKE percent of their shingles in common or more; decontamination drops documents that hold a passage of the benchmark;
the secret scan puts a mark in place of each span; the last stage encodes each
text into token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspark.llm import decontaminate, language_id, minhash_dedup, secret_scan, sentencepiece_lattice
from cellspark.llm.queries import MODEL
from cellspark.llm.shared import kept

#: Least posterior probability of a language.
SURE = 0.5
#: Least similarity of near copies, in percent.
ALIKE = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is sure enough."""
    found = language_id.predict(docs, language_id.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of linked ones."""
    return minhash_dedup.without_near_duplicates(docs, ALIKE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark and n_chars counted anew where one was."""
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    text = secret_scan.redact(F.col("text"), F.col("spans"))
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).withColumn("text", text).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document."""
    return sentencepiece_lattice.encode(docs, MODEL, keep=["doc_id", "lang", "source"]).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_tokens),
]

#: SQL can't express the fitted models and the tokenizer's fold; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
