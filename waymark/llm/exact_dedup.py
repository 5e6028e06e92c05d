"""Exact duplicates by progressive refinement: length, then a hash of the first characters, then a full hash.

Full content is hashed only for rows whose (length, prefix hash) occurs more than once. A null text counts as empty;
empty texts are equal to each other. Of equal texts the row with the largest id stays; a null id is smaller than any
other, and a group of null ids only keeps one. Rows that repeat both id and text count in ``group_size`` and are marked
alike; ``drop_duplicates`` leaves one of them. An empty table gives an empty result. Other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, drop_rows, text_or_empty


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, prefix_chars: int = 128, broadcast_keys: int = 200_000
) -> DataFrame:
    """Rows of texts that occur more than once: doc_id, text_hash (binary SHA-256), keep_id, group_size.

    ``normalise`` maps the text Column to the one that is compared (default: no change). Up to ``broadcast_keys``
    surviving (length, prefix hash) keys, 16 bytes each, are broadcast; above that they are joined by shuffling.
    """
    scratch = Scratch(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (normalise(text) if normalise else text).alias("text"))
    rows = rows.withColumn("size", F.octet_length("text").cast("long"))
    shared = scratch.save(rows.groupBy("size").count().where("count > 1").select("size"), "lengths")
    prefixed = rows.withColumn("prefix", F.xxhash64(F.substring("text", 1, prefix_chars)))
    same_length = prefixed.select("size", "prefix").join(shared, "size", "left_semi")
    keys = scratch.save(same_length.groupBy("size", "prefix").count().where("count > 1").select("size", "prefix"), "prefixes")
    small = F.broadcast(keys) if keys.count() <= broadcast_keys else keys
    survivors = prefixed.join(small, ["size", "prefix"], "left_semi")
    hashed = scratch.save(survivors.select("doc_id", "size", full_hash(F.col("text")).alias("text_hash")), "hashed")
    groups = hashed.groupBy("size", "text_hash").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = scratch.save(groups.where("group_size > 1"), "groups")
    return hashed.join(groups, ["size", "text_hash"]).select("doc_id", "text_hash", "keep_id", "group_size")


def full_hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex)."""
    normalise = options.get("normalise") or (lambda c: c)
    members = exact_groups(docs, id_col, text_col, **options).dropDuplicates(["doc_id", "text_hash"])
    rows = docs.select(F.col(id_col).alias("doc_id"), full_hash(normalise(text_or_empty(text_col))).alias("text_hash"))
    m = members.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "keep_id", "group_size")
    joined = rows.join(m, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_hash == F.col("_hash")), "left")
    keep = F.when(F.col("_hash").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("text_hash")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without later copies: one row of each text, all columns kept."""
    normalise = options.get("normalise") or (lambda c: c)
    members = exact_groups(docs, id_col, text_col, **options).withColumn("_first", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = members.where("_first").groupBy("doc_id", "text_hash").count().where("count > 1")
    keys = {"doc_id": F.col(id_col), "text_hash": full_hash(normalise(text_or_empty(text_col)))}
    return drop_rows(Scratch(docs.sparkSession), docs, keys, members.where("NOT _first"), again)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def query(spark, sf_dir: str) -> DataFrame:
    return mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
