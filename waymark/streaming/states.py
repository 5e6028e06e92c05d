"""Streams whose state outlives a batch: keys that fall silent, by event-time timers, and the newest result of each key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from waymark.sources.writers import _fs

_SILENT = "unit long, seen_us long, stale_us long"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Silence(StatefulProcessor):
    """The latest time of a key and whether its silence was told; a timer stands at the end of the time that is waited."""

    def __init__(self, after_us: int) -> None:
        self.after_us = after_us

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "seen_us long, told boolean")

    def _wait(self, seen_us: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.latest.update((seen_us, False))
        self.handle.registerTimer(seen_us // 1000 + self.after_us // 1000)

    def _row(self, key: tuple, seen: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"unit": np.full(len(seen), key[0]), "seen_us": seen, "stale_us": seen + self.after_us})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._wait(int(initialState["seen_us"].max()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, told = self.latest.get() if self.latest.exists() else (None, False)
        seen = np.unique(np.concatenate([r["seen_us"].to_numpy() for r in rows]))
        seen = seen if before is None else np.concatenate([[before], seen[seen > before]]).astype(np.int64)
        silent = np.diff(seen) > self.after_us
        if told and len(silent):
            silent[0] = False
        if before is None or len(seen) > 1:
            self._wait(int(seen[-1]))
        yield self._row(key, seen[:-1][silent])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, _ = self.latest.get()
        self.latest.update((seen, True))
        yield self._row(key, np.array([seen]))


def silent_keys(stream: DataFrame, after_s: float, late: str, snapshot: DataFrame) -> DataFrame:
    """(unit, seen_us, stale_us): a row for each time that a unit's latest observation has become older than ``after_s``.

    stream: unit, ts; snapshot: unit, seen_us, the latest observations of an earlier run. A silence is told once, when
    the watermark, ``late`` behind, passes its end or a later row of the unit shows it. Rows older than the unit's latest
    one change nothing. A micro-batch holds the times of a unit's rows, eight bytes each, in one task. Needs the state
    store of ``timed``.
    """
    s = stream.select("unit", "ts", F.unix_micros("ts").alias("seen_us")).withWatermark("ts", late).where("unit IS NOT NULL AND ts IS NOT NULL")
    start = snapshot.where("unit IS NOT NULL AND seen_us IS NOT NULL").select("unit", "seen_us").groupBy("unit")
    return s.groupBy("unit").transformWithStateInPandas(_Silence(int(after_s * 1_000_000)), _SILENT, "Append", "EventTime", initialState=start)


@contextmanager
def timed(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in the store that timers need."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def keep_newest(stream: DataFrame, path: str, key: str, generation: str, checkpoint: str):
    """Start a sink that keeps the rows of the newest generation of each key; ``newest`` reads it.

    A batch is reduced to one row a key and written to a folder of its number, so a batch that is repeated replaces what
    it wrote before, and one that was merged already is never read again. Stale rows lose whenever they come.
    """

    def write(batch: DataFrame, number: int) -> None:
        _best(batch.withColumn("batch", F.lit(number).cast("long")), key, generation).drop("batch").write.mode("overwrite").parquet(f"{path}/log/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _best(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """One row a key: the highest generation, of equals the earliest batch, then the greatest row."""
    rest = [c for c in rows.columns if c not in (key, generation, "batch")]
    best = rows.where(F.col(generation).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(generation), (-F.col("batch")).alias("batch"), F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest"))).alias("b"))
    return best.select(key, f"b.{generation}", (-F.col("b.batch")).alias("batch"), *[f"b.rest.{c}" for c in rest])


def _merged(spark: SparkSession, path: str) -> int:
    """Number of the last batch that a merge took in; -1 if there was none."""
    root, fs = _fs(spark, f"{path}/merged")
    if not fs.exists(root):
        return -1
    names = [s.getPath() for s in fs.listStatus(root)]
    whole = [int(p.getName().partition("=")[2]) for p in names if fs.exists(_fs(spark, f"{p}/_SUCCESS")[0])]
    return max(whole, default=-1)


def _all(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    last, typed = _merged(spark, path), StructType([*schema.fields]).add("batch", "long")
    out = spark.createDataFrame([], typed)
    if last >= 0:
        out = out.unionByName(spark.read.schema(typed).parquet(f"{path}/merged/upto={last}"))
    root, fs = _fs(spark, f"{path}/log")
    if fs.exists(root):
        out = out.unionByName(spark.read.schema(typed).parquet(f"{path}/log").where(F.col("batch") > last))
    return out


def newest(spark: SparkSession, path: str, schema: StructType, key: str, generation: str) -> DataFrame:
    """The newest row of each key that the sink has kept, in the columns of ``schema``."""
    return _best(_all(spark, path, schema), key, generation).select(*schema.names)


def merge_newest(spark: SparkSession, path: str, schema: StructType, key: str, generation: str) -> int:
    """Merge the finished batches into one table, so that reads don't grow with their number; returns the last one merged.

    Call it while no batch is being written. Batches' own folders stay until a later merge has been read by all.
    """
    root, fs = _fs(spark, f"{path}/log")
    batches = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")] if fs.exists(root) else []
    last = max([_merged(spark, path), *batches])
    if last > _merged(spark, path):
        _best(_all(spark, path, schema), key, generation).write.mode("overwrite").parquet(f"{path}/merged/upto={last}")
    return last
