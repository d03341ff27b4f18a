"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what its successor reads. A document that scores as toxic
goes; of near duplicates one stays; documents that hold benchmark items go; sources are mixed to their target
weights; what is left is written as token files, and the last result is what reads back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swaylark.llm import decontaminate, mixing, simhash, tokens, toxicity
from swaylark.llm.common import Scope, remove, scratch
from swaylark.llm.queries import held_out

#: Words of a shingle, bits of 64 in which candidates differ at most, and the Jaccard similarity of near duplicates.
NEAR_WORDS, NEAR_BITS, NEAR_SIMILARITY = 5, 11, 0.8


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a classifier trained on labelled ones; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_civil(docs, toxicity.train(docs.where(~held_out(3, 1)), labels))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the least id."""
    return simhash.near_dedup(docs, words=NEAR_WORDS, distance=NEAR_BITS, least=NEAR_SIMILARITY)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, up to its share of errors."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document by its Poisson draw, towards weights of the square root of the sources' sizes; null is a source."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, as they read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_files(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("source_mixing", mixed),
    ("token_files", token_ids),
]

#: SQL has neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again. What a stage has staged goes once its result is written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        with Scope(spark) as scope:
            docs = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                scope.keep_all()
                break
            path = scratch(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            scope.keep(path)
        if read:
            remove(spark, [read])
        docs, read = spark.read.parquet(path), path
    return docs
