"""Price levels around an event, as of what was known: latest swing and ATR, and the pivots beyond a price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators.joins import as_of_latest, salted_join


def to_grid(price: Column, step: float, way: str) -> Column:
    """A price on a grid of step: ``up``, ``down`` or ``near`` (half up), exact in decimals of eight places."""
    units = price.cast("decimal(28,8)") / F.lit(step).cast("decimal(10,8)")
    whole = {"up": F.ceil, "down": F.floor, "near": lambda c: F.floor(c + 0.5)}[way](units)
    return (whole * F.lit(step).cast("decimal(10,8)")).cast("double")


def protective_levels(events: DataFrame, swings: DataFrame, atr: DataFrame, multiple: float = 0.15, step: float = 0.01) -> DataFrame:
    """Per event (instrument, start_us, direction, available_us) a level beyond the latest visible swing against it, by a part of the ATR.

    Direction 1 takes the latest swing low less ``multiple`` ATR, rounded down to the grid; -1 is its mirror. Where events
    have zone_lower and zone_upper, the level starts at the zone's far side if that lies beyond the swing. Both as-of joins pick
    the newest bar among those known by the event's time. Null where no swing or no ATR was known.
    """
    e = events.withColumn("kind", F.when(F.col("direction") == 1, "low").otherwise("high"))
    s = swings.select("instrument", "kind", F.col("start_us").alias("swing_us"), F.col("price").alias("swing_price"), F.col("available_us").alias("swing_known_us"))
    a = atr.select("instrument", F.col("start_us").alias("atr_us"), "atr", F.col("available_us").alias("atr_known_us"))
    d = as_of_latest(e, s, ["instrument", "kind"], "available_us", "swing_known_us", ["swing_us"], ["swing_us", "swing_price"])
    d = as_of_latest(d, a, ["instrument"], "available_us", "atr_known_us", ["atr_us"], ["atr"])
    lower = upper = F.col("swing_price")
    if {"zone_lower", "zone_upper"} <= set(events.columns):
        known = F.col("swing_price").isNotNull()
        lower, upper = F.when(known, F.least("swing_price", "zone_lower")), F.when(known, F.greatest("swing_price", "zone_upper"))
    low, high = to_grid(lower - multiple * F.col("atr"), step, "down"), to_grid(upper + multiple * F.col("atr"), step, "up")
    return d.withColumn("level", F.when(F.col("direction") == 1, low).otherwise(high)).drop("kind")


def _visible(events: DataFrame, rows: DataFrame, salts: int = 8) -> DataFrame:
    """Pairs of an event and a row of its instrument and kind that was confirmed and known by then.

    ``rows`` are pivots or ATR values, whose number time bounds; the events of a hot instrument are spread over ``salts`` tasks.
    """
    return salted_join(events, rows, ["instrument", "kind"], F.col("start_us"), "inner", salts).where(
        (F.col("known_us") <= F.col("available_us")) & (F.col("confirmed_us") <= F.col("end_us"))
    )


def ladders(events: DataFrame, pivots: DataFrame, step: float = 0.01) -> DataFrame:
    """Per event with a price all pivots strictly beyond it, nearest first, as confirmed by its end_us and known by its available_us.

    Pivots of the direction's kind only: highs above for 1, lows below for -1, their prices rounded towards the event. Pivots of one
    rounded price are rungs of their own, the newest first. There is no limit to the distance. Events without a rung are left out.
    """
    e = events.withColumn("kind", F.when(F.col("direction") == 1, "high").otherwise("low"))
    p = pivots.select("instrument", "kind", F.col("start_us").alias("pivot_us"), F.col("price").alias("pivot_price"), F.col("available_us").alias("known_us"), "confirmed_us")
    target = F.when(F.col("direction") == 1, to_grid(F.col("pivot_price"), step, "down")).otherwise(to_grid(F.col("pivot_price"), step, "up"))
    d = _visible(e, p).withColumn("target", target).where((F.col("target") - F.col("price")) * F.col("direction") > 0)
    rung = F.struct(F.abs(F.col("target") - F.col("price")).alias("away"), (-F.col("pivot_us")).alias("newest"), "target", "pivot_us")
    d = d.groupBy("instrument", "start_us", "direction", "price").agg(F.array_sort(F.collect_list(rung)).alias("ladder"))
    return d.withColumn("ladder", F.transform("ladder", lambda x: x.dropFields("newest")))


# Why a decision gives no plan, in the order in which the reasons are tried, and what it is if none holds.
EXIT_REASONS = (
    "pre_roll",
    "candidate_no_trade",
    "ambiguous_selected_zone",
    "zone_direction_mismatch",
    "zone_not_visible",
    "no_visible_m15_swing",
    "no_visible_h1_atr",
    "non_positive_h1_atr",
    "no_visible_target",
    "non_positive_stop",
    "non_positive_target",
)
EXIT_READY = "structural_evidence_ready_entry_target_unselected"


def exit_plans(
    decisions: DataFrame, swings: DataFrame, atr: DataFrame, pivots: DataFrame, multiple: float = 0.15, step: float = 0.01
) -> DataFrame:
    """A stop and a ladder of targets for each decision, or the first reason why there is none.

    decisions: instrument, start_us, end_us, available_us, direction (1, -1; 0 or null: no trade), n_zones, zone_direction,
    zone_lower, zone_upper, zone_known_us, zone_formed_us, pre_roll. Evidence counts if it was confirmed by the bar's end and known
    by the decision. The stop lies ``multiple`` ATR beyond the farther of zone and latest swing, rounded outwards. Targets are all
    visible pivots of the direction's kind, nearest first for a trade entered below (above) them all; equal prices are all kept.
    A null flag counts as false, a null n_zones as 0. Result: instrument, start_us, reason, stop, targets (null unless ready).
    """
    key = ["instrument", "start_us"]
    d = decisions.withColumn("direction", F.coalesce("direction", F.lit(0)))
    base = d.where("direction <> 0").select(*key, "end_us", "available_us", "direction")
    against = base.withColumn("kind", F.when(F.col("direction") == 1, "low").otherwise("high"))
    along = base.withColumn("kind", F.when(F.col("direction") == 1, "high").otherwise("low"))
    pivot = lambda t: t.select("instrument", "kind", F.col("start_us").alias("at_us"), "price", F.col("available_us").alias("known_us"), "confirmed_us")
    newest = F.struct("at_us", "confirmed_us", "known_us")
    swing = _visible(against, pivot(swings)).groupBy(*key).agg(F.max_by("price", newest).alias("swing"))
    values = atr.select("instrument", F.lit("atr").alias("kind"), "atr", F.col("available_us").alias("known_us"), F.col("end_us").alias("confirmed_us"))
    range_ = _visible(base.withColumn("kind", F.lit("atr")), values).groupBy(*key).agg(F.max_by("atr", F.struct("confirmed_us", "known_us")).alias("atr"))
    price = F.when(F.col("direction") == 1, to_grid(F.col("price"), step, "down")).otherwise(to_grid(F.col("price"), step, "up"))
    rungs = _visible(along, pivot(pivots)).select(*key, "direction", price.alias("target"))
    targets = rungs.groupBy(*key).agg(F.array_sort(F.collect_list(F.col("target") * F.col("direction"))).alias("ranked"), F.min("target").alias("lowest"))
    d = d.join(swing, key, "left").join(range_, key, "left").join(targets, key, "left")
    up = F.col("direction") == 1
    room = multiple * F.col("atr")
    stop = F.when(up, to_grid(F.least("zone_lower", "swing") - room, step, "down")).otherwise(to_grid(F.greatest("zone_upper", "swing") + room, step, "up"))
    holds = (
        F.coalesce("pre_roll", F.lit(False)),
        F.col("direction") == 0,
        F.coalesce("n_zones", F.lit(0)) != 1,
        ~F.col("zone_direction").eqNullSafe(F.col("direction")),
        ~F.coalesce((F.col("zone_known_us") <= F.col("available_us")) & (F.col("zone_formed_us") <= F.col("end_us")), F.lit(False)),
        F.col("swing").isNull(),
        F.col("atr").isNull(),
        F.col("atr") <= 0,
        F.col("ranked").isNull(),
        stop <= 0,
        F.col("lowest") <= 0,
    )
    reason = F.coalesce(*[F.when(h, r) for h, r in zip(holds, EXIT_REASONS)], F.lit(EXIT_READY))
    ready = F.col("reason") == EXIT_READY
    signed = F.transform("ranked", lambda x: x * F.col("direction"))
    return d.withColumn("reason", reason).select(*key, "direction", "reason", F.when(ready, stop).alias("stop"), F.when(ready, signed).alias("targets"))


def entry_target(targets: Column, direction: Column, price: Column) -> Column:
    """The nearest frozen target strictly beyond the entry price; null if there is none. A nearer one is never skipped."""
    beyond = F.filter(targets, lambda x: (x - price) * direction > 0)
    return F.when(direction == 1, F.array_min(beyond)).otherwise(F.array_max(beyond))
