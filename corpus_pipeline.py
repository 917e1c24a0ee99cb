"""A corpus pipeline of five stages; each stage's result is written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import crf_quality, decontaminate, lsh_forest, packing, personal_data
from cadenza.llm.common import stage


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage may have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    return crf_quality.keep_good(docs, crf_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return lsh_forest.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark goes."""
    return _counted(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal_information(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind."""
    return _counted(personal_data.mask(docs))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents as packed sequences, a row for each piece."""
    import public_tokenizers

    return packing.digest(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_information", personal_information),
    ("sequence_packing", sequence_packing),
]

#: Fitted models decide in the stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
