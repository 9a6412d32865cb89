"""Session closures as exclusion intervals: buckets, eligible inputs and open time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.grid import PERIOD_US, merged_closures, period_summaries
from quotemill.operators.joins import interval_join, merge_intervals
from quotemill.operators.shards import micros


def closed_time(closures: DataFrame, period_us: int = PERIOD_US) -> DataFrame:
    """(calendar_id, bucket_start_us, closed_us): closed microseconds of each period that a closure touches."""
    p = F.lit(period_us)
    d = merge_intervals(merged_closures(closures), ["calendar_id"], "start_us", "end_us")
    d = d.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_us") / p), F.floor((F.col("end_us") - 1) / p))))
    begin = F.col("slot") * period_us
    return d.groupBy("calendar_id", begin.cast("long").alias("bucket_start_us")).agg(F.sum(F.least("end_us", begin + period_us) - F.greatest("start_us", begin)).alias("closed_us"))


def session_buckets(ticks: DataFrame, exports: DataFrame, closures: DataFrame, period_us: int = PERIOD_US) -> DataFrame:
    """Per export and period of its coverage: open and closed time, state and observation status.

    state: full_open, partial_open, closed. status: observed with ticks; else closed, or missing_open_data.
    """
    p = F.lit(period_us).cast("long")
    covered = exports.select("export_id", "calendar_id", (F.ceil(micros(F.col("coverage_start")) / p) * p).cast("long").alias("a"), (F.floor(micros(F.col("coverage_end")) / p) * p - p).cast("long").alias("b")).where("export_id is not null and a <= b").dropDuplicates(["export_id"])
    grid = covered.select("export_id", "calendar_id", F.explode(F.sequence("a", "b", p)).alias("bucket_start_us"))
    d = grid.join(period_summaries(ticks, period_us), ["export_id", "bucket_start_us"], "left").join(closed_time(closures, period_us), ["calendar_id", "bucket_start_us"], "left")
    d = d.withColumn("closed_us", F.coalesce("closed_us", F.lit(0))).withColumn("tick_count", F.coalesce("tick_count", F.lit(0)))
    state = F.when(F.col("closed_us") == 0, "full_open").when(F.col("closed_us") < period_us, "partial_open").otherwise("closed")
    status = F.when(F.col("tick_count") > 0, "observed").when(F.col("closed_us") == period_us, "closed").otherwise("missing_open_data")
    return d.select("export_id", "bucket_start_us", "tick_count", (period_us - F.col("closed_us")).alias("open_us"), "closed_us", state.alias("state"), status.alias("status"), "first_us", "last_us", "max_gap_us")


def session_hours(buckets: DataFrame, period_us: int = PERIOD_US) -> DataFrame:
    """Hours of four periods: eligible if some period is open and every open one is observed."""
    hour = (F.floor(F.col("bucket_start_us") / F.lit(4 * period_us)) * 4 * period_us).cast("long")
    opened = F.col("state") != "closed"
    return buckets.groupBy("export_id", hour.alias("hour_us")).agg(F.count("*").alias("n_buckets"), F.count_if(opened).alias("open_buckets"), F.count_if(opened & (F.col("status") == "observed")).alias("observed_open_buckets"), F.sum("open_us").alias("open_us"), F.sum("tick_count").alias("tick_count")).withColumn("eligible", (F.col("n_buckets") == 4) & (F.col("open_buckets") > 0) & (F.col("open_buckets") == F.col("observed_open_buckets")))


def hour_prices(ticks: DataFrame, buckets: DataFrame, period_us: int = PERIOD_US) -> DataFrame:
    """session_hours with each side's open, high, low and close over the hour's observed open periods; null unless eligible.

    Order is (ts, source_row, tick_id). A side that is null, NaN, infinite or not positive is no price.
    Ticks in the closed part of a period that is partly open count, as in session_buckets.
    """
    rows = ticks.select("export_id", (F.floor(micros(F.col("ts")) / F.lit(period_us)) * period_us).cast("long").alias("bucket_start_us"), F.struct(micros(F.col("ts")).alias("ts_us"), "source_row", "tick_id").alias("at"), *(F.col(s).cast("double").alias(s) for s in ("bid", "ask")))
    first, hours = [], []
    for s in ("bid", "ask"):
        good = (F.col(s) > 0) & (F.col(s) < float("inf"))
        at, price = F.when(good, F.col("at")), F.when(good, F.col(s))
        first += [F.min_by(s, at).alias(f"{s}_open"), F.max(price).alias(f"{s}_high"), F.min(price).alias(f"{s}_low"), F.max_by(s, at).alias(f"{s}_close")]
        known = F.when(F.col(f"{s}_open").isNotNull(), F.col("bucket_start_us"))
        hours += [F.min_by(f"{s}_open", known).alias(f"{s}_open"), F.max(f"{s}_high").alias(f"{s}_high"), F.min(f"{s}_low").alias(f"{s}_low"), F.max_by(f"{s}_close", known).alias(f"{s}_close")]
    opened = buckets.where("state <> 'closed' and status = 'observed'").select("export_id", "bucket_start_us")
    hour = (F.floor(F.col("bucket_start_us") / F.lit(4 * period_us)) * 4 * period_us).cast("long")
    prices = rows.groupBy("export_id", "bucket_start_us").agg(*first).join(opened, ["export_id", "bucket_start_us"]).groupBy("export_id", hour.alias("hour_us")).agg(*hours)
    names = [c for c in prices.columns if c not in ("export_id", "hour_us")]
    d = session_hours(buckets, period_us).join(prices, ["export_id", "hour_us"], "left")
    return d.withColumns({c: F.when(F.col("eligible"), F.col(c)) for c in names})


def next_boundaries(buckets: DataFrame, exports: DataFrame, closures: DataFrame, period_us: int = PERIOD_US) -> DataFrame:
    """Per bucket whether its end is open, and why: ``outside_coverage``, ``inside_closure`` or ``scheduled_open``.

    next_eligible: the end is open, and the bucket is not closed and was observed.
    """
    e = exports.where("export_id is not null").select("export_id", "calendar_id", micros(F.col("coverage_end")).alias("coverage_end_us")).dropDuplicates(["export_id"])
    d = buckets.select("export_id", "bucket_start_us", "state", "status", (F.col("bucket_start_us") + period_us).alias("boundary_us")).join(e, "export_id")
    points = d.select("calendar_id", "boundary_us").distinct()
    inside = in_closures(points, closures, "boundary_us").select("calendar_id", "boundary_us", F.lit(True).alias("inside"))
    d = d.join(inside, ["calendar_id", "boundary_us"], "left")
    reason = F.when(F.col("boundary_us") >= F.col("coverage_end_us"), "outside_coverage").when(F.col("inside"), "inside_closure").otherwise("scheduled_open")
    is_open = reason == "scheduled_open"
    return d.select("export_id", "bucket_start_us", is_open.alias("next_open"), reason.alias("next_reason"), (is_open & (F.col("state") != "closed") & (F.col("status") == "observed")).alias("next_eligible"))


def tick_diagnostics(ticks: DataFrame, period_us: int = PERIOD_US) -> DataFrame:
    """What an importer reports per export and observed period: count, first and last tick, longest gap, silences at both ends."""
    d = period_summaries(ticks, period_us)
    return d.select("export_id", "bucket_start_us", "tick_count", "first_us", "last_us", "max_gap_us", (F.col("first_us") - F.col("bucket_start_us")).alias("start_silence_us"), (F.col("bucket_start_us") + period_us - F.col("last_us")).alias("end_silence_us"))


def open_time(spans: DataFrame, closures: DataFrame, start: str, end: str, width_us: int = 24 * 3_600_000_000) -> DataFrame:
    """Add open_us, a span's length without the closures of its calendar. Spans need a key column span_id and calendar_id."""
    w = F.lit(width_us)
    slots = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / w), F.floor((F.col(b) - 1) / w)))
    c = merge_intervals(merged_closures(closures), ["calendar_id"], "start_us", "end_us").withColumn("slot", slots("start_us", "end_us")).withColumnsRenamed({"start_us": "c_start", "end_us": "c_end"})
    s = spans.where(F.col(start) < F.col(end)).withColumn("slot", slots(start, end))
    low, high = F.col("slot") * width_us, (F.col("slot") + 1) * width_us
    part = F.greatest(F.lit(0), F.least(end, "c_end", high) - F.greatest(start, "c_start", low))
    lost = s.join(c, ["calendar_id", "slot"]).groupBy("span_id").agg(F.sum(part).alias("closed_us"))
    return spans.join(lost, "span_id", "left").withColumn("open_us", F.col(end) - F.col(start) - F.coalesce("closed_us", F.lit(0))).drop("closed_us")


def in_closures(points: DataFrame, closures: DataFrame, point: str, width_us: int = 24 * 3_600_000_000) -> DataFrame:
    """Points (with calendar_id) inside the united closures of their calendar, with the closure's start_us and end_us."""
    united = merge_intervals(merged_closures(closures), ["calendar_id"], "start_us", "end_us")
    return interval_join(points, united, ["calendar_id"], point, "start_us", "end_us", width_us)


def next_open(points: DataFrame, closures: DataFrame, point: str) -> DataFrame:
    """Add next_open_us: the point itself, or the end of the united closure that holds it. Needs a unique key point_id."""
    held = in_closures(points, closures, point).select("point_id", F.col("end_us").alias("closed_until_us"))
    return points.join(held, "point_id", "left").withColumn("next_open_us", F.coalesce("closed_until_us", point)).drop("closed_until_us")
