"""Ticks to bid/ask bars, bars to parent bars, and checks of both.

Times are microseconds since 1970-01-01 UTC. A bar covers [start_us, end_us) and became known at available_us. Bars are the
unit of all windows below: an instrument has one per period, however many ticks it has, so a window over an instrument's
bars is bounded by time, not by the data. Everything that grows with the ticks is a mergeable aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.shards import micros

HOUR_US = 3_600_000_000
PRICES = ("open", "high", "low", "close")


def by_instrument() -> Window:
    return Window.partitionBy("instrument").orderBy("start_us")


def ticks_of_events(events: DataFrame) -> DataFrame:
    """A quote stream of the events table: one instrument per event type, bid 2000 + value, received up to ten minutes late."""
    ts = micros(F.col("ts"))
    bid = F.lit(2000.0) + F.col("value")
    return events.select(F.col("event_type").alias("instrument"), ts.alias("ts_us"), F.col("event_id").alias("source_row"), bid.alias("bid"), (bid + F.lit(0.26)).alias("ask"), (ts + F.col("event_id") % 11 * 60_000_000).alias("available_us"))


def ticks_of_feeds(ticks: DataFrame) -> DataFrame:
    """Quotes of bid_ask_ticks, the feed as instrument: a tick counts once, known from its first delivery.

    Left out are ticks without key or time, and those of which a side is null, NaN, infinite or not positive, or whose ask lies below the
    bid: a bar is made of whole quotes only. Copies are merged by one shuffle with partial aggregation.
    """
    price = [F.col(c).cast("double").alias(c) for c in ("bid", "ask")]
    d = ticks.select("tick_id", F.col("feed_id").alias("instrument"), micros(F.col("ts")).alias("ts_us"), "source_row", *price, micros(F.col("available_at")).alias("available_us"))
    # NaN and infinity are above all numbers
    d = d.where((F.col("bid") > 0) & (F.col("ask") < float("inf")) & (F.col("bid") <= F.col("ask")) & F.col("tick_id").isNotNull())
    return d.groupBy("tick_id", "instrument", "ts_us", "source_row", "bid", "ask").agg(F.min("available_us").alias("available_us")).drop("tick_id")


def ticks_to_bars(ticks: DataFrame, period_us: int = HOUR_US) -> DataFrame:
    """One bar per instrument and period with ticks. Equal times keep their source_row order; ticks with a null key, time or side are left out."""
    at = F.struct("ts_us", "source_row")
    whole = ticks.where("instrument is not null and ts_us is not null and source_row is not null and bid is not null and ask is not null")
    start = F.floor(F.col("ts_us") / F.lit(period_us)) * period_us
    sides = [f(s).alias(f"{s}_{p}") for s in ("bid", "ask") for p, f in zip(PRICES, (lambda c: F.min_by(c, at), F.max, F.min, lambda c: F.max_by(c, at)))]
    return (
        whole.withColumn("start_us", start.cast("long"))
        .groupBy("instrument", "start_us")
        .agg(*sides, F.count("*").alias("tick_count"), F.max("available_us").alias("received_us"))
        .withColumn("end_us", F.col("start_us") + period_us)
        .withColumn("available_us", F.greatest("end_us", "received_us"))
        .drop("received_us")
    )


def bars_to_parents(bars: DataFrame, period_us: int = HOUR_US, children: int = 4) -> DataFrame:
    """Parent bars of exactly ``children`` bars; incomplete parents are left out. Known when the last child is known."""
    width = period_us * children
    sides = [f(f"{s}_{p}").alias(f"{s}_{p}") for s in ("bid", "ask") for p, f in zip(PRICES, (lambda c: F.min_by(c, "start_us"), F.max, F.min, lambda c: F.max_by(c, "start_us")))]
    return (
        bars.withColumn("parent_us", (F.floor(F.col("start_us") / F.lit(width)) * width).cast("long"))
        .groupBy("instrument", "parent_us")
        .agg(*sides, F.sum("tick_count").alias("tick_count"), F.count("*").alias("n"), F.max("available_us").alias("available_us"), F.max_by("start_us", F.struct("available_us", "start_us")).alias("last_known_child_us"))
        .where(F.col("n") == children)
        .withColumnRenamed("parent_us", "start_us")
        .withColumn("end_us", F.col("start_us") + width)
        .drop("n")
    )


def mid(price: str) -> Column:
    return (F.col(f"bid_{price}") + F.col(f"ask_{price}")) / 2


def with_mids(bars: DataFrame) -> DataFrame:
    return bars.select("*", *[mid(p).alias(p) for p in PRICES])


def spread_bps(price: str) -> Column:
    return (F.col(f"ask_{price}") - F.col(f"bid_{price}")) / mid(price) * 10_000


def direction(doji: str = "neither") -> Column:
    """Directions of a candle: 1 bullish, -1 bearish; a doji has none, or both."""
    both = F.array(F.lit(1), F.lit(-1)) if doji == "both" else F.array().cast("array<int>")
    return F.when(F.col("close") > F.col("open"), F.array(F.lit(1))).when(F.col("close") < F.col("open"), F.array(F.lit(-1))).otherwise(both)


def segments(bars: DataFrame) -> DataFrame:
    """Number each instrument's stretches of bars without a gap; segment starts at 1."""
    new = F.coalesce((F.lag("end_us").over(by_instrument()) != F.col("start_us")).cast("int"), F.lit(1))
    return bars.withColumn("new_segment", new).withColumn("segment", F.sum("new_segment").over(by_instrument())).drop("new_segment")


def segment_summary(bars: DataFrame, parent_us: int = 4 * HOUR_US) -> DataFrame:
    """Contiguous stretches with their bars and the complete parent periods inside."""
    whole = F.floor(F.max("end_us") / F.lit(parent_us)) - F.ceil(F.min("start_us") / F.lit(parent_us))
    return segments(bars).groupBy("instrument", "segment").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_bars"), F.greatest(F.lit(0), whole).cast("long").alias("complete_parents"))


def gaps(bars: DataFrame) -> DataFrame:
    """Pauses between neighbouring bars: gap_start_us, gap_end_us."""
    before = F.lag("end_us").over(by_instrument())
    return bars.withColumn("gap_start_us", before).where(F.col("gap_start_us") < F.col("start_us")).select("instrument", "gap_start_us", F.col("start_us").alias("gap_end_us"))


def cadence(bars: DataFrame, period_us: int = HOUR_US) -> DataFrame:
    """Per instrument: bars, short and long steps between starts, wrong durations, the longest step, and whether the cadence is exact."""
    step = F.col("start_us") - F.lag("start_us").over(by_instrument())
    d = bars.withColumn("step", step)
    short, long_, wrong = F.count_if(F.col("step") < period_us), F.count_if(F.col("step") > period_us), F.count_if(F.col("end_us") - F.col("start_us") != period_us)
    return d.groupBy("instrument").agg(F.count("*").alias("n_bars"), short.alias("short_steps"), long_.alias("gaps"), wrong.alias("wrong_durations"), F.coalesce(F.max("step"), F.lit(0)).alias("longest_step_us"), ((short == 0) & (long_ == 0) & (wrong == 0)).alias("exact"))


def bar_violations(bars: DataFrame) -> DataFrame:
    """(instrument, start_us, code) of every broken rule of a bar or of its place after the one before."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    names = [f"{s}_{p}" for s in ("bid", "ask") for p in PRICES]
    all_finite = F.lit(True)
    for n in names:
        all_finite = all_finite & finite(n) & (F.col(n) > 0)
    bad_range = F.lit(False)
    for s in ("bid", "ask"):
        bad_range = bad_range | (F.col(f"{s}_high") < F.greatest(f"{s}_open", f"{s}_close")) | (F.col(f"{s}_low") > F.least(f"{s}_open", f"{s}_close"))
    crossed = F.lit(False)
    for p in PRICES:
        crossed = crossed | (F.col(f"bid_{p}") > F.col(f"ask_{p}"))
    bars = bars.withColumn("before_us", F.lag("end_us").over(by_instrument()))
    rules = {"not_positive": ~all_finite, "range": bad_range, "crossed": crossed, "empty_interval": F.col("start_us") >= F.col("end_us"), "early": F.col("available_us") < F.col("end_us"), "overlap": F.col("before_us") > F.col("start_us")}
    codes = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    return bars.select("instrument", "start_us", F.explode(codes).alias("code"))


def visible(rows: DataFrame, as_of_us: int) -> DataFrame:
    """What was known at a time."""
    return rows.where(F.col("available_us") <= as_of_us)


def broken_prefix(bars: DataFrame, as_of_us: int) -> DataFrame:
    """Instruments whose bars known at as_of_us are no prefix: a later bar is visible while an earlier one is not."""
    seen = F.col("available_us") <= as_of_us
    return bars.groupBy("instrument").agg(F.max(F.when(seen, F.col("start_us"))).alias("last_visible_us"), F.min(F.when(~seen, F.col("start_us"))).alias("first_hidden_us")).where("last_visible_us > first_hidden_us")


def preflight(bars: DataFrame, period_us: int = HOUR_US // 4, children: int = 4, minimum: int = 100, known_at_close: bool = False) -> DataFrame:
    """(instrument, code, start_us, n) of everything that keeps an instrument's bars from being replayed as a whole.

    By bar: invalid_duration, invalid_alignment, invalid_order, availability_before_close, availability_order and, with known_at_close,
    availability_must_equal_close. By instrument (start_us null): partial_hour_start, partial_hour_end, incomplete_hours; if all
    intervals are in order also data_gaps (n: how many) and insufficient_history (n: rows in complete parents of the longest stretch),
    else segments_unavailable. n is 1 elsewhere. Bars need start, end and availability.
    """
    width = period_us * children
    w = by_instrument()
    d = bars.select("instrument", "start_us", "end_us", "available_us", F.lag("end_us").over(w).alias("before_us"), F.lag("available_us").over(w).alias("known_before"))
    rules = {
        "invalid_duration": F.col("end_us") - F.col("start_us") != period_us,
        "invalid_alignment": F.col("start_us") % period_us != 0,
        "invalid_order": F.col("start_us") < F.col("before_us"),
        "availability_before_close": F.col("available_us") < F.col("end_us"),
        "availability_order": F.col("available_us") < F.col("known_before"),
        "availability_must_equal_close": F.lit(known_at_close) & (F.col("available_us") != F.col("end_us")),
    }
    d = d.withColumn("codes", F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))
    one = F.lit(1).cast("long").alias("n")
    rows = d.select("instrument", F.explode("codes").alias("code"), "start_us", one)
    wrong = F.arrays_overlap("codes", F.array(*[F.lit(c) for c in ("invalid_duration", "invalid_alignment", "invalid_order")]))
    gap = F.coalesce(F.col("before_us") < F.col("start_us"), F.lit(False))
    d = d.withColumn("gap", gap).withColumn("segment", F.sum(gap.cast("int")).over(w))
    parts = d.groupBy("instrument", "segment").agg(
        F.min("start_us").alias("first"), F.max("end_us").alias("last"), F.count("*").alias("rows"), F.bool_or(wrong).alias("wrong"), F.count_if("gap").alias("gaps")
    )
    whole = F.greatest(F.lit(0), F.floor(F.col("last") / width) - F.ceil(F.col("first") / width)) * children
    all_ = parts.groupBy("instrument").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows"), F.bool_or("wrong").alias("wrong"), F.sum("gaps").alias("gaps"), F.max(whole).alias("longest")
    )
    said = F.array(
        F.when(F.col("first") % width != 0, F.struct(F.lit("partial_hour_start").alias("code"), one)),
        F.when(F.col("last") % width != 0, F.struct(F.lit("partial_hour_end").alias("code"), one)),
        F.when(F.col("rows") % children != 0, F.struct(F.lit("incomplete_hours").alias("code"), one)),
        F.when(F.col("wrong"), F.struct(F.lit("segments_unavailable").alias("code"), one)),
        F.when(~F.col("wrong") & (F.col("gaps") > 0), F.struct(F.lit("data_gaps").alias("code"), F.col("gaps").cast("long").alias("n"))),
        F.when(~F.col("wrong") & (F.col("longest") < minimum), F.struct(F.lit("insufficient_history").alias("code"), F.col("longest").cast("long").alias("n"))),
    )
    each = all_.select("instrument", F.explode(F.array_compact(said)).alias("x")).select("instrument", "x.code", F.lit(None).cast("long").alias("start_us"), "x.n")
    return rows.unionByName(each)


def usable_suffix(bars: DataFrame) -> DataFrame:
    """The bars of each instrument after its last gap."""
    last = F.max("segment").over(Window.partitionBy("instrument"))
    return segments(bars).withColumn("last", last).where(F.col("segment") == F.col("last")).drop("segment", "last")
