"""A training corpus from documents: quality, near-duplicates, contamination, mixing, sharding.

Every stage takes the documents that the one before kept and, but for the last, returns the columns of documents; other columns, whatever their names, are left out. Rows are judged by their texts, so
nulls in lang, source and n_chars change nothing but the source that a document is mixed as. Empty tables of documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm import decontaminate, jaccard, mixing, quality, sharding
from lumigraph.llm._common import Scratch
from lumigraph.llm.language import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null, empty and very long texts are scored like any other, row by row; equal texts share their score; a null doc_id is kept or not by its text. Without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0))
    return quality.keep_good(docs.select(*COLUMNS), labels, train_on=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at a similarity of 0.8 or more. Texts without words (null, empty, blank) are linked with nothing and stay; of rows of one doc_id all stay or none; rows with a null doc_id stay."""
    return jaccard.keep_first(docs.select(*COLUMNS), words_n=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, each row by its own text; null and empty texts hold none. An empty benchmark, or one without words, drops nothing."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, shuffled globally. Null is a source; repeated rows of a doc_id draw the same count; sources of empty texts only get nothing."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard in sixteen shards of near equal bytes; copies of a text stay together, those without a text too; a null doc_id is kept."""
    return sharding.shard_documents(docs.select("doc_id", "text"))


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontaminate", drop_contaminated), ("mix", mix_sources), ("shard", shard)]

#: Trained models and connected components are beyond SQL; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
