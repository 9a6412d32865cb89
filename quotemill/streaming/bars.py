"""Structured Streaming forms: bars of a tick stream, sealed availability groups and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.bars import PRICES


def bars_of_stream(ticks: DataFrame, delay: str = "10 minutes", period: str = "1 hour") -> DataFrame:
    """Bars of a stream with columns instrument, ts (timestamp), source_row, bid, ask; append mode, sealed by the watermark.

    Ticks are counted once by (instrument, ts, source_row), copies within the delay dropped. The state is one row per instrument
    and open period.
    """
    at = F.struct("ts", "source_row")
    sides = [f(s).alias(f"{s}_{p}") for s in ("bid", "ask") for p, f in zip(PRICES, (lambda c: F.min_by(c, at), F.max, F.min, lambda c: F.max_by(c, at)))]
    once = ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["instrument", "ts", "source_row"])
    return once.groupBy("instrument", F.window("ts", period)).agg(*sides, F.count("*").alias("tick_count")).select("instrument", F.col("window.start").alias("start_time"), F.col("window.end").alias("end_time"), *[f"{s}_{p}" for s in ("bid", "ask") for p in PRICES], "tick_count")


def sealed_groups(observations: DataFrame, delay: str = "1 millisecond") -> DataFrame:
    """Groups of observations that became known at one time (available_at), emitted once a row more than ``delay`` later is seen.

    A group at the newest time stays open, as more rows of that time may come.
    """
    return observations.withWatermark("available_at", delay).groupBy("instrument", "available_at").agg(F.count("*").alias("n"), F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"))


def late_rows(rows: DataFrame, sealed: DataFrame) -> DataFrame:
    """Of a batch, the rows that a stream sealed through ``sealed`` (instrument, sealed_through) must not accept."""
    return rows.join(sealed, "instrument").where(F.col("available_at") <= F.col("sealed_through")).drop("sealed_through")


def run_to_end(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what its source holds now, into a memory table; for tests and backfills."""
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
