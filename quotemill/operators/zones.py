"""Impulses, the zones that they leave, and what later bars do to them, set at a time.

Zones don't depend on each other: the bar that ends a zone is a minimum over later parent bars; bars that touch it before are
islands of neighbouring bar numbers. No state machine is needed. Zones are joined to summaries of time slots, one row a month and
instrument, and only to the bars of slots that matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.bars import HOUR_US, by_instrument
from quotemill.operators.indicators import frame, with_atr
from quotemill.operators.joins import as_of_latest

PARENT, BASE = 0, 1  # at one time of availability, parent bars come first


def impulses(bars: DataFrame, period: int = 14, method: str = "wilder", timing: int = -1, least: int = 3, movement: str = "net", move_atr: float = 1.5, body_atr: float = 0.8) -> DataFrame:
    """Windows of four bars that move far in one direction, by the ATR of the bar ``timing`` places from the window's first.

    movement: ``net`` (open to close), ``range`` (of the whole window) or ``bodies`` (sum of the direction's bodies). One row per
    direction: 1 or -1. available_us covers the window and all that the ATR depends on.
    """
    w = frame(0, 3)
    d = with_atr(bars, period, method)
    lead = lambda c, n: F.lead(c, n).over(by_instrument()) if n > 0 else F.lag(c, -n).over(by_instrument()) if n < 0 else F.col(c)
    body = F.abs(F.col("close") - F.col("open"))
    d = d.select(
        "instrument", "start_us", F.count("*").over(w).alias("n"), lead("end_us", 3).alias("end_us"), F.greatest(F.max("available_us").over(w), lead("atr_known_us", timing)).alias("available_us"), lead("atr", timing).alias("atr"), F.max(body).over(w).alias("largest_body"),
        F.sum((F.col("close") > F.col("open")).cast("int")).over(w).alias("n_up"), F.sum((F.col("close") < F.col("open")).cast("int")).over(w).alias("n_down"), (lead("close", 3) - F.col("open")).alias("net"), (F.max("high").over(w) - F.min("low").over(w)).alias("reach"),
        F.sum(F.greatest(F.col("close") - F.col("open"), F.lit(0.0))).over(w).alias("up"), F.sum(F.greatest(F.col("open") - F.col("close"), F.lit(0.0))).over(w).alias("down"),
    ).where("n = 4 and atr is not null")
    move = {"net": F.col("net") * F.col("direction"), "range": F.col("reach"), "bodies": F.when(F.col("direction") == 1, F.col("up")).otherwise(F.col("down"))}[movement]
    d = d.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("movement", move).withColumn("n_directional", F.when(F.col("direction") == 1, F.col("n_up")).otherwise(F.col("n_down")))
    return d.where((F.col("n_directional") >= least) & (F.col("movement") >= move_atr * F.col("atr")) & (F.col("largest_body") >= body_atr * F.col("atr"))).select("instrument", "start_us", "end_us", "direction", "n_directional", "movement", "largest_body", "atr", "available_us")


def zones(bars: DataFrame, lookback: int = 20, through_window: bool = False, **impulse_policy) -> DataFrame:
    """Demand (direction 1) and supply (-1) zones: the latest opposite candle at most ``lookback`` bars before an impulse.

    A demand zone is [low, open] of its origin, a supply zone [open, high]. It is known when the impulse and all
    candles between the origin and the window are.
    """
    w = frame(-lookback, 3 if through_window else -1)
    at = F.struct("start_us", "open", "high", "low")
    last = lambda c: F.last(F.when(c, at), True).over(w)
    origins = bars.withColumn("bar_no", F.row_number().over(by_instrument())).select("instrument", "start_us", last(F.col("close") < F.col("open")).alias("bear"), last(F.col("close") > F.col("open")).alias("bull"), F.collect_list(F.struct("start_us", "available_us")).over(w).alias("seen"))
    d = impulses(bars, **impulse_policy).join(origins, ["instrument", "start_us"]).withColumn("o", F.when(F.col("direction") == 1, F.col("bear")).otherwise(F.col("bull"))).where("o is not null")
    proof = F.array_max(F.transform(F.filter("seen", lambda x: x["start_us"] >= F.col("o.start_us")), lambda x: x["available_us"]))
    lower, upper = F.when(F.col("direction") == 1, F.col("o.low")).otherwise(F.col("o.open")), F.when(F.col("direction") == 1, F.col("o.open")).otherwise(F.col("o.high"))
    return d.select("instrument", F.col("start_us").alias("impulse_us"), "direction", F.col("o.start_us").alias("origin_us"), F.col("end_us").alias("formed_us"), lower.alias("lower"), upper.alias("upper"), F.greatest("available_us", proof).alias("available_us"))


def observation_key(timeframe: int, parents_first: bool = True) -> Column:
    """The order in which bars are seen: by availability, end, timeframe (parent bars first or last), start."""
    rank = timeframe if parents_first else 1 - timeframe
    return F.struct("available_us", "end_us", F.lit(rank).alias("timeframe"), "start_us")


SLOT_US = 30 * 24 * HOUR_US


def invalidations(found: DataFrame, parents: DataFrame, parents_first: bool = True, slot_us: int = SLOT_US) -> DataFrame:
    """Per zone the first parent bar, wholly after the zone became known, that closes strictly beyond its far side.

    First is by the order in which bars are seen. Zones meet summaries of time slots, and bars only of the slots that may hold the
    first one: those in which some bar closes beyond, up to the first of them whose bars all lie after the zone became known.
    """
    slot = F.floor(F.col("available_us") / F.lit(slot_us))
    p = parents.select("instrument", slot.alias("slot"), F.col("start_us").alias("p_us"), F.col("close").alias("p_close"), observation_key(PARENT, parents_first).alias("p_key"))
    sums = p.groupBy("instrument", "slot").agg(F.min("p_close").alias("lowest"), F.max("p_close").alias("highest"), F.min("p_us").alias("first_us"), F.max("p_us").alias("last_us"))
    up = F.col("direction") == 1
    z = found.select("instrument", "impulse_us", "direction", "lower", "upper", "available_us")
    far = z.join(sums, "instrument").where((F.col("last_us") >= F.col("available_us")) & F.when(up, F.col("lowest") < F.col("lower")).otherwise(F.col("highest") > F.col("upper")))
    sure = F.min(F.when(F.col("first_us") >= F.col("available_us"), F.col("slot"))).over(Window.partitionBy("instrument", "impulse_us", "direction"))
    far = far.withColumn("sure", sure).where(F.col("sure").isNull() | (F.col("slot") <= F.col("sure"))).drop("lowest", "highest", "first_us", "last_us", "sure")
    beyond = F.when(up, F.col("p_close") < F.col("lower")).otherwise(F.col("p_close") > F.col("upper"))
    hits = far.join(p, ["instrument", "slot"]).where((F.col("p_us") >= F.col("available_us")) & beyond)
    return hits.groupBy("instrument", "impulse_us", "direction").agg(F.min("p_key").alias("ended_key"), F.min_by("p_close", "p_key").alias("ended_close"))


def episodes(found: DataFrame, parents: DataFrame, bars: DataFrame, parents_first: bool = True, slot_us: int = SLOT_US) -> DataFrame:
    """Contiguous touches of each zone while it lasts: ordinal, first and last touching bar, how the episode ended.

    Zones meet summaries of time slots first, then the bars of those slots of their life whose range reaches them.

    ended: ``left`` (the next bar seen while the zone lasts doesn't touch), ``invalidated``, or null while open.
    """
    numbered = bars.withColumn("bar_no", F.row_number().over(by_instrument()))
    next_key = F.lead(observation_key(BASE, parents_first)).over(by_instrument())
    b = numbered.select("instrument", "bar_no", F.col("start_us").alias("b_us"), F.col("end_us").alias("b_end_us"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.col("available_us").alias("b_known_us"), observation_key(BASE, parents_first).alias("b_key"), next_key.alias("next_key"))
    lasting = found.join(invalidations(found, parents, parents_first), ["instrument", "impulse_us", "direction"], "left")
    meets = (F.col("b_us") >= F.col("available_us")) & (F.col("ended_key").isNull() | (F.col("b_key") < F.col("ended_key"))) & (F.col("b_low") <= F.col("upper")) & (F.col("b_high") >= F.col("lower"))
    b = b.withColumn("slot", F.floor(F.col("b_us") / F.lit(slot_us)))
    sums = b.groupBy("instrument", "slot").agg(F.min("b_low").alias("lowest"), F.max("b_high").alias("highest"), F.max("b_us").alias("last_us"), F.min("b_us").alias("first_us"))
    alive = (F.col("last_us") >= F.col("available_us")) & (F.col("ended_key").isNull() | (F.col("first_us") < F.col("ended_key.available_us")))
    reached = (F.col("lowest") <= F.col("upper")) & (F.col("highest") >= F.col("lower"))
    near = lasting.join(sums, "instrument").where(alive & reached).drop("lowest", "highest", "first_us", "last_us")
    touch = near.join(b, ["instrument", "slot"]).where(meets)
    zone = ["instrument", "impulse_us", "direction"]
    w = Window.partitionBy(*zone).orderBy("bar_no")
    island = touch.withColumn("island", F.col("bar_no") - F.row_number().over(w)).groupBy(*zone, "island").agg(
        F.min("b_us").alias("first_touch_us"), F.min("b_end_us").alias("first_touch_end_us"), F.min_by("b_known_us", "bar_no").alias("available_us"), F.max("b_end_us").alias("last_touch_end_us"), F.count("*").alias("n_bars"), F.max_by("next_key", "bar_no").alias("next_key"), F.first("ended_key").alias("ended_key"), F.first("origin_us").alias("origin_us")
    )
    left = F.col("next_key").isNotNull() & (F.col("ended_key").isNull() | (F.col("next_key") < F.col("ended_key")))
    return island.select(*zone, "origin_us", F.row_number().over(Window.partitionBy(*zone).orderBy("first_touch_us")).alias("ordinal"), "first_touch_us", "first_touch_end_us", "last_touch_end_us", "n_bars", "available_us", F.when(left, "left").when(F.col("ended_key").isNotNull(), "invalidated").alias("ended"), F.col("ended_key.available_us").alias("invalid_from_us"), "ended_key")


def zone_state(found: DataFrame, parents: DataFrame, as_of_us: int) -> DataFrame:
    """Zones known at a time, and whether each still lasts then."""
    d = found.where(F.col("available_us") <= as_of_us).join(invalidations(found, parents), ["instrument", "impulse_us", "direction"], "left")
    return d.select("instrument", "impulse_us", "direction", "lower", "upper", (F.col("ended_key").isNull() | (F.col("ended_key.available_us") > as_of_us)).alias("valid"))


def retest_selection(confirmed: DataFrame, touches: DataFrame, expiry: int = 2, minimum: int = 0, period_us: int = HOUR_US) -> DataFrame:
    """For each confirmation the newest first touch of a zone of its direction, ``minimum`` to ``expiry`` bars before its end.

    The interval join is an equi-join: a confirmation meets the few bar ends at which its touch may lie. The zone must still last
    when the confirmation's bar ends; of zones touched in one bar the one with the newest origin counts.
    """
    c = confirmed.withColumn("back", F.explode(F.sequence(F.lit(minimum), F.lit(expiry)))).withColumn("first_touch_end_us", F.col("end_us") - F.col("back") * period_us).select("instrument", "direction", "first_touch_end_us", F.col("start_us").alias("confirmation_us"), F.col("end_us").alias("confirmation_end_us"), "back")
    t = touches.where("ordinal = 1").select("instrument", "direction", "first_touch_end_us", "impulse_us", "origin_us", "available_us", "invalid_from_us")
    d = c.join(t, ["instrument", "direction", "first_touch_end_us"]).where((F.col("available_us") <= F.col("confirmation_end_us")) & (F.col("invalid_from_us").isNull() | (F.col("invalid_from_us") > F.col("confirmation_end_us"))))
    w = Window.partitionBy("instrument", "direction", "confirmation_us").orderBy("back", F.desc("origin_us"), "impulse_us")
    return d.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("instrument", "direction", "confirmation_us", "impulse_us", "origin_us", F.col("back").alias("bars_since_touch"))


def decisions(bars: DataFrame, confirmed: DataFrame, regime: DataFrame, retests: DataFrame) -> DataFrame:
    """One row per bar: the evidence that meets at it, and the first reason why it gives no action."""
    c = confirmed.where(F.col("available_us") <= F.col("end_us")).groupBy("instrument", "start_us").agg(F.count("*").alias("n_confirmations"), F.max("direction").alias("direction"))
    r = retests.select("instrument", F.col("confirmation_us").alias("start_us"), "direction", "impulse_us")
    d = bars.select("instrument", "start_us").join(c, ["instrument", "start_us"], "left").join(regime.select("instrument", "start_us", "regime"), ["instrument", "start_us"], "left").join(r, ["instrument", "start_us", "direction"], "left")
    wanted = F.when(F.col("direction") == 1, "bullish").otherwise("bearish")
    reason = F.when(F.col("n_confirmations").isNull(), "no_confirmation").when(F.col("n_confirmations") > 1, "conflicting_confirmations").when(F.col("regime").isNull(), "no_regime").when(F.col("regime") != wanted, "regime_not_aligned").when(F.col("impulse_us").isNull(), "no_retest").otherwise("evidence_complete")
    action = F.when(reason == "evidence_complete", F.when(F.col("direction") == 1, "up").otherwise("down")).otherwise("none")
    return d.select("instrument", "start_us", action.alias("action"), reason.alias("reason"))


# Why a bar gives no action, in the order in which the first three groups are tried; regime and retest reasons go together.
LATE, NO_CONFIRMATION, CONFLICT = "m15_transition_late_for_next_open", "no_timely_confirmation", "conflicting_timely_confirmations"
NO_REGIME, UNKNOWN_REGIME, RANGE_REGIME, OTHER_REGIME = "no_visible_h1_regime", "h1_regime_unknown", "h1_regime_range", "h1_regime_direction_mismatch"
NO_RETEST, TOUCH_BAR, EXPIRED, INVALID = "no_eligible_directional_retest", "touch_bar_confirmation_excluded", "confirmation_window_expired", "zone_invalid_at_m15_step"
MET = {1: "buy_criteria_met", -1: "sell_criteria_met"}


def candidates(
    bars: DataFrame,
    confirmed: DataFrame,
    regimes_seen: DataFrame,
    touches: DataFrame,
    found: DataFrame,
    ended: DataFrame,
    expiry: int = 2,
    minimum: int = 0,
    prior_touches: int = 0,
    all_zones: bool = False,
    parents_first: bool = True,
    period_us: int = HOUR_US,
) -> DataFrame:
    """One row per bar: action (buy, sell, no_trade), reasons, and the impulses of the selected zones.

    A confirmation counts if it was known by its bar's end, a touch (of at most ``prior_touches`` earlier ones of its zone) if it ended and
    was known by then, ``minimum`` to ``expiry`` bars before. Its zone must last after the bar was seen; parent bars seen at the same time
    come before or after it. Of the newest touches' zones all are selected, or the one with the newest origin. bars may have a column
    next_open_reason that says why no open follows; it is the first reason, then a late bar. regimes_seen: instrument, start_us, regime.
    """
    key = ["instrument", "start_us"]
    timely = confirmed.where(F.col("available_us") <= F.col("end_us")).groupBy(*key).agg(F.count_distinct("direction").alias("n"), F.max("direction").alias("direction"))
    b = bars.withColumn("b_key", observation_key(BASE, parents_first)).withColumnRenamed("end_us", "b_end")
    if "next_open_reason" not in bars.columns:
        b = b.withColumn("next_open_reason", F.lit(None).cast("string"))
    b = b.select(*key, "b_end", "b_key", "available_us", "next_open_reason", "low", "high")
    asked = b.join(timely.where("n = 1"), key)
    starts = touches.where(F.col("ordinal") <= 1 + prior_touches).select("instrument", "direction", F.col("first_touch_end_us").alias("touch_end"), "impulse_us", "origin_us", F.col("available_us").alias("touch_known"), "ended_key")
    window = asked.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(max(expiry, minimum))))).withColumn("touch_end", F.col("b_end") - F.col("back") * period_us)
    near = window.join(starts, ["instrument", "direction", "touch_end"]).where(F.col("touch_known") <= F.col("b_end"))
    timed = F.col("back").between(minimum, expiry)
    lasts = timed & (F.col("ended_key").isNull() | (F.col("ended_key") > F.col("b_key")))
    zone = F.struct("origin_us", "impulse_us")
    near = near.groupBy(*key).agg(
        F.bool_or(timed).alias("timed"), F.bool_or(F.col("back") < minimum).alias("too_soon"), F.min(F.when(lasts, F.col("back"))).alias("newest"),
        F.collect_list(F.when(lasts, F.struct("back", zone.alias("zone")))).alias("lasting"),
    )
    # the earliest touch known by the bar's end tells whether some window has expired
    first = as_of_latest(asked.select(*key, "direction", "b_end"), starts.withColumn("early", -F.col("touch_end")), ["instrument", "direction"], "b_end", "touch_known", ["early"], ["early"])
    first = first.select(*key, (F.col("b_end") + F.col("early") > expiry * period_us).alias("expired"))
    gone = found.select("instrument", "direction", "impulse_us", "lower", "upper").join(ended.select("instrument", "direction", "impulse_us", "ended_key"), ["instrument", "direction", "impulse_us"])
    over = asked.join(gone, ["instrument", "direction"]).where((F.col("ended_key") <= F.col("b_key")) & (F.col("low") <= F.col("upper")) & (F.col("high") >= F.col("lower")))
    over = over.select(*key).distinct().withColumn("overlaps", F.lit(True))
    d = b.join(timely, key, "left").join(regimes_seen.select(*key, "regime"), key, "left").join(near, key, "left").join(first, key, "left").join(over, key, "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    wanted = F.when(F.col("direction") == 1, "bullish").otherwise("bearish")
    regime = F.when(F.col("regime").isNull(), NO_REGIME).when(F.col("regime") == "unknown", UNKNOWN_REGIME).when(F.col("regime") == "range", RANGE_REGIME).when(F.col("regime") != wanted, OTHER_REGIME)
    selected = F.col("newest").isNotNull()
    lost = ~selected & (flag("timed") | flag("overlaps"))
    timing = ~selected & ~lost
    retest = (F.when(lost, INVALID), F.when(timing & flag("too_soon"), TOUCH_BAR), F.when(timing & flag("expired"), EXPIRED), F.when(timing & ~flag("too_soon") & ~flag("expired"), NO_RETEST))
    alone = F.when(F.col("next_open_reason").isNotNull(), F.col("next_open_reason")).when(F.col("available_us") > F.col("b_end"), LATE).when(F.col("n").isNull(), NO_CONFIRMATION).when(F.col("n") > 1, CONFLICT)
    evidence = F.array_compact(F.array(regime, *retest))
    met = F.when(F.col("direction") == 1, MET[1]).otherwise(MET[-1])
    reasons = F.when(alone.isNotNull(), F.array(alone)).when(F.size(evidence) > 0, evidence).otherwise(F.array(met))
    d = d.withColumn("reasons", reasons)
    acts = F.get("reasons", F.lit(0)).isin(*MET.values())
    at_newest = F.array_sort(F.transform(F.filter("lasting", lambda x: x["back"] == F.col("newest")), lambda x: F.struct((-x["zone"]["origin_us"]).alias("o"), x["zone"]["impulse_us"].alias("i"))))
    chosen = F.transform(at_newest if all_zones else F.slice(at_newest, 1, 1), lambda x: x["i"])
    action = F.when(acts, F.when(F.col("direction") == 1, "buy").otherwise("sell")).otherwise("no_trade")
    return d.select(*key, action.alias("action"), "reasons", F.when(acts, chosen).alias("selected"))
