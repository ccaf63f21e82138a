"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Each stage works on all that the one before it kept. A document is known by its doc_id: one that is rejected in one of its rows goes in all
of them. A row without doc_id is a document of its own, known by a number from its content, and is kept or rejected as others are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.common import small, stage, table
from gazeloom.llm.decontamination import decontaminate
from gazeloom.llm.near_duplicates import near_duplicates
from gazeloom.llm.quality import classify_quality
from gazeloom.llm.sentencepiece_codec import digest_documents
from gazeloom.llm.toxicity import score_toxicity
from gazeloom.staging import delete, scope

#: Numbers of documents without doc_id begin here; every doc_id in use is smaller, so that of a group one with doc_id stays.
NAMELESS = 1 << 62


def number(docs: DataFrame) -> Column:
    """doc_id, or for a row without it a number from its content, the same for equal rows."""
    own = F.xxhash64(*[c for c in ("text", "lang", "source") if c in docs.columns]).bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))
    return F.coalesce(F.col("doc_id").cast("long"), own)


def unused(docs: DataFrame, name: str = "_id_") -> str:
    """A column name that docs doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def without(docs: DataFrame, rejected: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of docs, with their number in column unused(docs), but for the documents whose numbers `rejected` gives as doc_id when it is asked with numbers for ids."""
    name = unused(docs)
    ids = rejected(docs.withColumn("doc_id", number(docs)))
    gone = stage(ids.select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.withColumn(name, number(docs)).join(small(gone), name, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trusted-text model accepts."""
    return without(docs, lambda d: classify_quality(d, table(spark, sf_dir, "labels")).where(~F.col("accepted"))).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic."""
    return without(docs, lambda d: score_toxicity(d, table(spark, sf_dir, "labels")).where("predicted = 1")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest doc_id. Of rows that repeat a document, the first by text stays."""
    kept, name = without(docs, lambda d: near_duplicates(d).where(~F.col("kept"))), unused(docs)
    repeated = stage(docs.select(number(docs).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(name), "repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    first = kept.join(small(repeated), name, "left_semi").groupBy(name).agg(F.min(F.struct(F.col("text").alias("text"), F.struct(*docs.columns).alias("row"))).alias("first"))
    return kept.join(small(repeated), name, "left_anti").select(docs.columns).unionByName(first.select("first.row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a small part of benchmark text."""
    return without(docs, lambda d: decontaminate(d, table(spark, sf_dir, "benchmark")).where("contaminated")).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids, and of the text decoded from them."""
    return digest_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL cannot express the trained models and the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Every table but the result is deleted when the last stage is written, or where one fails."""
    docs, made = table(spark, sf_dir, "documents"), []
    try:
        with scope(made):
            for name, function in STAGES:
                docs = stage(function(spark, docs, sf_dir), "pipeline-" + "-".join(name.split()).lower())
        made.remove(docs._staged_at)
    finally:
        delete(spark, made)
    return docs
