"""Training-order materialisation: fixed-stride binary shards in the order of a keyed permutation.

Texts become token ids with an end id and are cut into sequences of ``length`` ids; the last of a document is padded with
zeros. Texts are dealt over range partitions by (id, hash) and cut in that order, so that the sequences are numbered by
(id, start) over the whole table as they are written, without a shuffle of their own. A keyed Feistel network permutes
those numbers: its domain is the next power of four, and numbers outside the range walk on until they are inside
(cycle-walking). The result is the sequence's slot. Shard n holds the slots from n * shard_sequences on, in order, one
record of ``stride`` bytes each: little-endian unsigned ids (16 bits where the vocabulary allows) and a closing line
feed. So the record of any slot is at a known place, readers go through shards in sequence, and a run resumes from a slot
alone.

Shards are ranges of slots of one size, so each is a task's partition by its number, without sampling for bounds. They
are written by Spark's text writer, byte for byte, to any file system that Spark writes to, and only appear when
their task is committed. The index (id, start, length, slot) is a Parquet table beside them.

A null text counts as empty and still has its end id. Rows that repeat id and text have equal sequences, numbered one
after the other. An empty table gives no shards and an empty index. A long text is tokenised whole, in one task, and handed
on in sequences. Other columns are not read, whatever their names. ``docs`` is read three times (sizes, bounds, texts), so
it is best a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, global_rank, shuffles_cleared, text_or_empty
from .packing import END_ID, HELD_IDS, tokenizer_path
from .tokens import encode_in_parts, id_bytes

LENGTH, SHARD_SEQUENCES, KEY, ROUNDS, PASSES = 512, 16_384, 20_240_601, 8, 2
#: Bytes of text that one task orders and tokenises at most, on average.
TASK_BYTES = 64 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def permuted(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slot in [0, n) of each number in [0, n): a bijection, chosen by ``key``."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for r in range(rounds):
            h = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))
            h = (h ^ (h >> np.uint64(30))) * _M1
            h = (h ^ (h >> np.uint64(27))) * _M2
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask)
        return left << bits | right

    out = once(numbers.astype("uint64"))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype("int64")


def slot_column(number: Column, n: int, key: int = KEY) -> Column:
    @F.pandas_udf("long")
    def slot(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n, key))

    return slot(number)


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length and ids (not padded), in the width of ``id_bytes``."""
    width = id_bytes(path)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids"]).astype({"doc_id": "Int64"})

    def cut(batches):
        for b in batches:
            rows, held = [], 0
            for doc, ids in zip(b["doc_id"], encode_in_parts(path, b["text"].tolist()), strict=True):
                ids = np.append(ids, end_id).astype(f"<u{width}")
                rows += [(doc, start, len(ids[start : start + length]), ids[start : start + length].tobytes()) for start in range(0, len(ids), length)]
                held += len(ids)
                if held > HELD_IDS:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(cut, "doc_id long, start long, length long, ids binary")


@dataclass(frozen=True)
class Shards:
    """What is needed to read the shards: the folder, the layout and the index table."""

    folder: str
    sequences: int
    shard_sequences: int
    length: int
    id_bytes: int
    index: DataFrame

    @property
    def stride(self) -> int:
        return self.length * self.id_bytes + 1


def materialise(
    docs: DataFrame, path: str, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
) -> Shards:
    """Write the shards and the index to ``folder`` (default: the shared folder, until the application ends)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    width = id_bytes(path)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Rows that are alike in id and text may come in any order, so their row numbers spread a large group over partitions.
    order = ["doc_id", F.xxhash64("text"), "_row"]
    numbered = texts.withColumn("_row", F.monotonically_increasing_id())
    ranked = global_rank(scratch, numbered, order, "sequences", -(-size // TASK_BYTES), lambda d: sequences(d, path, length, end_id))
    n = ranked.count()
    placed = ranked.withColumn("slot", slot_column(F.col("rank"), n, key)).drop("rank")
    index = placed.select("doc_id", "start", "length", "slot")
    if folder is None:
        index = scratch.save(index, "index")
    else:
        index.write.parquet(f"{folder}/index")
        index = spark.read.parquet(f"{folder}/index")
    record = F.rpad(F.col("ids"), F.lit(length * width), F.lit(b"\x00")).cast("string")
    rows = placed.select((F.col("slot") / shard_sequences).cast("long").alias("shard"), "slot", record.alias("record"))
    tasks = max(1, -(-n // shard_sequences))
    target = f"{folder}/shards" if folder is not None else scratch.place("shards")
    for k in range(PASSES if n else 0):  # a pass shuffles every PASSES-th shard, so that less lies on disk at once
        part = rows.where(F.col("shard") % PASSES == k).repartitionById(-(-tasks // PASSES), (F.col("shard") / PASSES).cast("int")).sortWithinPartitions("shard", "slot")
        with shuffles_cleared(spark):
            part.select("shard", "record").write.mode("append").partitionBy("shard").option("compression", "none").text(target)
    scratch.drop("sequences")
    return Shards(target, n, shard_sequences, length, width, index)


def read_sequences(spark: SparkSession, shards: Shards, first_slot: int = 0) -> DataFrame:
    """(slot, ids): the records from ``first_slot`` on; shards before it are not opened. ``ids`` is padded to the stride."""
    if not shards.sequences:
        return spark.createDataFrame([], "slot long, ids binary")
    files = spark.read.format("binaryFile").load(shards.folder).where(F.col("shard") >= first_slot // shards.shard_sequences)
    records = (F.col("length") / shards.stride).cast("int")
    at = F.col("at")
    cut = files.select("shard", "content", F.explode(F.sequence(F.lit(0), records - 1)).alias("at"))
    ids = F.substring("content", at * shards.stride + 1, F.lit(shards.stride - 1))
    slot = F.col("shard").cast("long") * shards.shard_sequences + at
    return cut.select(slot.alias("slot"), ids.alias("ids")).where(F.col("slot") >= first_slot)


def query(spark, sf_dir: str) -> DataFrame:
    shards = materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
    back = read_sequences(spark, shards).join(shards.index, "slot")
    used = (F.col("length") * shards.id_bytes).cast("int")
    shard = (F.col("slot") / shards.shard_sequences).cast("long")
    return back.select(
        "doc_id", "start", "length", "slot", shard.alias("shard"), (F.col("slot") % shards.shard_sequences * shards.stride).alias("byte"),
        F.crc32(F.substring("ids", F.lit(1), used)).alias("ids_crc32"),
    )
