"""Structured Streaming over observations: windows with a watermark, late rows by key, and an offence state per unit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def stream_of(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """The Parquet table ``name`` in a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def windowed(stream: DataFrame, ts: str, value: str, width: str, late: str) -> DataFrame:
    """(start, n, avg, max) per tumbling window; a window closes when the watermark, ``late`` behind, has passed it."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"))
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max")).select(F.col("w.start").alias("start"), "n", "avg", "max")


def accepted(stream: DataFrame) -> DataFrame:
    """(event_id, unit, t) of rows that are not older than the latest accepted one of their unit.

    Late is what is late for its own key, not for a watermark over all keys, so each key keeps its latest time as state.
    Rows of a micro-batch count in the order of ``event_id``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values("event_id")
        best = rows["t"].cummax().clip(lower=latest)
        state.update((max(latest, float(best.iloc[-1])),))
        kept = rows[rows["t"] >= best]
        yield kept.assign(unit=key[0])[["event_id", "unit", "t"]]

    out = "event_id long, unit long, t double"
    return stream.select("event_id", "unit", "t").groupBy("unit").applyInPandasWithState(run, out, "latest double", "append", GroupStateTimeout.NoTimeout)


def offences(stream: DataFrame, handoff_s: float = 6.0) -> DataFrame:
    """(event_id, unit, state) after each row: patrol, observe, stop attempt, pursuit. The state survives micro-batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since = state.get if state.exists else ("patrol", 0.0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["t", "event_id"]).itertuples():
            if now == "stop":
                now = "observe" if r.complied else "pursuit" if r.t - since >= handoff_s else now
            if not r.current:
                now = "patrol" if now == "observe" else now
            else:
                now = "observe" if now == "patrol" else now
                if r.offence:
                    now, since = "stop", r.t
            out.append((r.event_id, key[0], now))
        state.update((now, float(since)))
        yield pd.DataFrame(out, columns=["event_id", "unit", "state"])

    columns = stream.select("event_id", "unit", "t", "current", "offence", "complied")
    return columns.groupBy("unit").applyInPandasWithState(run, "event_id long, unit long, state string", "state string, since double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and return its Parquet output; ``folder`` is new, and holds the checkpoint too."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").format("parquet").start(f"{folder}/out")
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def log_samples(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream's rows to CSV files, one micro-batch at a time; a batch that is repeated replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
