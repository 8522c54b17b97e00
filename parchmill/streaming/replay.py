"""Replay of ordered events: high-water marks in batch by windows, and the same as a stateful stream.

The stream keeps one number for each family; increments are what an event adds over the highest value before it, so they
add up to the highest value however the events are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUT = "family STRING, sequence LONG, value LONG, increment LONG"


def increments(events: DataFrame) -> DataFrame:
    """(family, sequence, value, increment) of events (family, sequence, value): max(0, value - highest before)."""
    before = Window.partitionBy("family").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    return events.select("family", "sequence", "value", F.greatest(F.lit(0).cast("long"), F.col("value") - F.coalesce(F.max("value").over(before), F.lit(0).cast("long"))).alias("increment"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    high = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values("sequence")
    best = rows["value"].cummax().clip(lower=high)
    rows["increment"] = best - best.shift(fill_value=high)
    state.update((int(best.iloc[-1]),))
    yield rows[["family", "sequence", "value", "increment"]]


def stream_increments(events: DataFrame) -> DataFrame:
    """``increments`` over a stream; within a micro-batch events are taken by sequence, batches in the order they come."""
    return events.groupBy("family").applyInPandasWithState(_advance, OUT, "high LONG", "append", "NoTimeout")


def stream_windows(events: DataFrame, late: str = "1 hour", size: str = "6 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows; events later than ``late`` are dropped."""
    windows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a table of the shared folder, and return the table."""
    import uuid

    from parchmill.session import _written, scratch_dir

    spark = stream.sparkSession
    path = f"{scratch_dir(spark)}/parchmill-{uuid.uuid4().hex}"
    _written.append((spark, path))
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}")
