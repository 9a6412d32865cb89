"""Irregular readings onto a regular grid, one row per source and period."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.shards import micros, ordered_ticks, pieces

PERIOD_US = 900_000_000
SHARD_DDL = "export_id long, bucket_start_us long, shard int, n long, first_us long, last_us long, first_id long, last_id long, max_gap_us long"


def summaries_of_shard(period_us: int):
    """Per shard, export and period: count, first and last reading and longest gap between its readings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            bucket = p.ts // period_us * period_us
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(starts[1:], len(p)) - 1
            gap = np.append(0, np.diff(p.ts))
            gap[starts] = 0
            k = len(starts)
            yield pa.record_batch(
                [pa.array([p.export_id] * k, pa.int64()), pa.array(bucket[starts]), pa.array([p.shard] * k, pa.int32()), pa.array(ends - starts + 1, pa.int64()), pa.array(p.ts[starts]), pa.array(p.ts[ends]), pa.array(p.tick_id[starts]), pa.array(p.tick_id[ends]), pa.array(np.maximum.reduceat(gap, starts), pa.int64())],
                names=["export_id", "bucket_start_us", "shard", "n", "first_us", "last_us", "first_id", "last_id", "max_gap_us"],
            )

    return run


def period_summaries(ticks: DataFrame, period_us: int = PERIOD_US) -> DataFrame:
    """Per export and period with readings: tick_count, first_us, last_us, max_gap_us. Copies of a tick count once.

    A period cut by a shard's edge has one summary per shard. The carry across an edge is the earlier part's last reading;
    it is passed on by a scan over the parts of one period, which are at most as many as the shards.
    """
    parts = ordered_ticks(ticks).mapInArrow(summaries_of_shard(period_us), SHARD_DDL)
    w = Window.partitionBy("export_id", "bucket_start_us").orderBy("shard")
    carried = parts.withColumn("before_us", F.lag("last_us").over(w)).withColumn("before_id", F.lag("last_id").over(w))
    return carried.groupBy("export_id", "bucket_start_us").agg(
        F.sum(F.col("n") - F.coalesce((F.col("before_id") == F.col("first_id")).cast("int"), F.lit(0))).alias("tick_count"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.max(F.greatest("max_gap_us", F.coalesce(F.col("first_us") - F.col("before_us"), F.lit(0)))).alias("max_gap_us"),
    )


def merged_closures(closures: DataFrame) -> DataFrame:
    """(calendar_id, start_us, end_us), null or empty intervals left out."""
    return closures.select("calendar_id", micros(F.col("closure_start")).alias("start_us"), micros(F.col("closure_end")).alias("end_us")).where("calendar_id is not null and start_us < end_us").distinct()


DAY_US = 86_400_000_000


def closures_by_day(closures: DataFrame) -> DataFrame:
    """(calendar_id, day, shut): the closures that touch a UTC day, as an array of (start_us, end_us). One row per calendar and day."""
    days = F.explode(F.sequence(F.floor(F.col("start_us") / DAY_US), F.floor((F.col("end_us") - 1) / DAY_US)))
    return merged_closures(closures).select("calendar_id", days.alias("day"), "start_us", "end_us").groupBy("calendar_id", "day").agg(F.collect_list(F.struct("start_us", "end_us")).alias("shut"))


SHARD_PERIODS = 4096


def _carry_last(filled: DataFrame, period_us: int, shard_periods: int) -> DataFrame:
    """Add previous_us, the last reading before each period.

    Time shards of ``shard_periods`` periods are filled independently; the carry into each is a prefix scan over the shards'
    last readings, a table of one row per source and shard.
    """
    rows = filled.withColumn("shard", F.floor(F.col("bucket_start_us") / F.lit(period_us * shard_periods)))
    inside = Window.partitionBy("export_id", "shard").orderBy("bucket_start_us").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("export_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("export_id", "shard").agg(F.max("last_us").alias("shard_last_us")).withColumn("carry_us", F.last("shard_last_us", True).over(across)).select("export_id", "shard", "carry_us")
    return rows.withColumn("local_us", F.last("last_us", True).over(inside)).join(carry, ["export_id", "shard"], "left").withColumn("previous_us", F.coalesce("local_us", "carry_us"))


def regular_grid(ticks: DataFrame, exports: DataFrame, closures: DataFrame, period_us: int = PERIOD_US, shard_periods: int = SHARD_PERIODS) -> DataFrame:
    """One row per export and UTC period wholly within its coverage.

    tick_count counts each tick once, with any prices and however late. maximum_intertick_seconds is the longest gap
    between neighbouring ticks inside the period, null with fewer than two. status: ``observed``; ``closed`` without ticks
    and wholly within one closure of the export's calendar; else ``missing``. For a missing or closed period
    since_last_tick_us is the time from the export's last tick before it to its start, null before the first tick.
    Ticks outside the coverage, or of an unknown export, fall on no row. An export with a null or empty coverage has no
    rows; repeated rows of an export count once; a null calendar has no closures.
    """
    p = F.lit(period_us).cast("long")
    covered = exports.select("export_id", "feed_id", "calendar_id", (F.ceil(micros(F.col("coverage_start")) / p) * p).cast("long").alias("a"), (F.floor(micros(F.col("coverage_end")) / p) * p - p).cast("long").alias("b")).where("export_id is not null and a <= b").dropDuplicates(["export_id"])
    grid = covered.select("export_id", "feed_id", "calendar_id", F.explode(F.sequence("a", "b", p)).alias("bucket_start_us"))
    filled = grid.join(period_summaries(ticks, period_us), ["export_id", "bucket_start_us"], "left")
    shut = closures_by_day(closures)
    rows = _carry_last(filled, period_us, shard_periods).withColumn("day", F.floor(F.col("bucket_start_us") / DAY_US)).join(shut, ["calendar_id", "day"], "left")
    start, end = F.col("bucket_start_us"), F.col("bucket_start_us") + period_us
    rows = rows.withColumn("closed", F.exists("shut", lambda c: (c["start_us"] <= start) & (c["end_us"] >= end)))
    return rows.select(
        "export_id",
        "feed_id",
        "bucket_start_us",
        F.coalesce("tick_count", F.lit(0)).alias("tick_count"),
        F.when(F.col("tick_count") > 1, F.col("max_gap_us") / 1e6).alias("maximum_intertick_seconds"),
        F.when(F.col("tick_count") > 0, "observed").when(F.col("closed"), "closed").otherwise("missing").alias("status"),
        F.when(F.col("tick_count").isNull(), F.col("bucket_start_us") - F.col("previous_us")).alias("since_last_tick_us"),
    )
