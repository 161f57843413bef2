"""Corpus pipeline: the stages that turn ``documents`` into training data.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; ``run`` writes each result as Parquet and reads it back as the next
stage's input.  All stages but the last return the columns of ``docs``.

1. quality classifier: documents that nearest-neighbour voting scores below 0.5 go;
2. SimHash near-dedup: of each group of linked fingerprints the smallest doc_id stays;
3. suffix-array dedup: bytes of strings that occur elsewhere go, and with them documents
   of which nothing is left; ``n_chars`` follows the text;
4. benchmark decontamination: documents that overlap with a benchmark item go;
5. BPE: what is left is encoded, decoded and counted.

Rows with null or empty text are scored, grouped (as fingerprint zero) and encoded (to
no ids) like any other; extra columns pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohlcflow.llm import bpe, decontaminate, quality_knn, simhash, suffix_dedup
from ohlcflow.llm.common import Workspace, table
from ohlcflow.llm.queries import quality_model, word_bpe


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality_knn.score(docs, quality_model(spark, docs, sf_dir))
    return scored.filter(F.col("quality_score") >= 0.5).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.rewrite(docs.withColumn("text", F.coalesce("text", F.lit("")))).filter("text IS NOT NULL")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, word_bpe())


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("bpe encoding and decoding", bpe_encoding),
]

#: SQL cannot state the classifier, the fingerprints or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    work = Workspace(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
