"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing and packing, one operator a stage.

Each stage works on all that its predecessor kept, and its decisions take effect. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import line_dedup, mixing, near_dedup, packing, toxicity
from waymark.llm.common import Scratch, text_or_empty, word_count


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't mark."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(docs, labels, carry=docs.columns)
    return scored.where("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs. A document all of whose words go is dropped."""
    out = line_dedup.drop_repeated_lines(docs, report=True)
    return out.where((F.col("_deleted") == 0) | (word_count(text_or_empty("text")) > 0)).select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus mixed to the target weights: a row for each take of a document."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(docs, packing.tokenizer_path(), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near), ("mixing", mix), ("packing", pack)]

#: The stages learn, sketch and tokenise: SQL can't express them, so tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again, and goes once the next one's is written."""
    scratch = Scratch(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
