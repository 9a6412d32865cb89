"""Moving windows, linear recurrences and patterns over bars.

Each derived value is known when the last bar that it depends on is known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.operators.bars import by_instrument, segments


def frame(first: int, last: int) -> Window:
    return by_instrument().rowsBetween(first, last)


def since_start() -> Window:
    return by_instrument().rowsBetween(Window.unboundedPreceding, 0)


def true_range() -> Column:
    before = F.lag("close").over(by_instrument())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def full(value: Column, column: str, n: int, w: Window) -> Column:
    """value where its frame holds n values of column, else null."""
    return F.when(F.count(column).over(w) == n, value)


def recurrence(rows: DataFrame, value: str, out: str, gain: float, period: int, seed: str = "mean", keys: tuple[str, ...] = ("instrument",), order: str = "start_us") -> DataFrame:
    """Add ``out``: y[t] = y[t-1] + gain * (x[t] - y[t-1]) along ``order``.

    seed ``mean``: the first output is the mean of the first ``period`` values, at the last of them; ``first``: the first value. A
    null or NaN value gives no output and starts anew. The fold is exact and sequential per key; with bars as rows its groups are
    bounded by time.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    need = period if seed == "mean" else 1

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        result, held, y = [], [], None
        for x in pdf[value].to_numpy(dtype=float, na_value=np.nan).tolist():
            if x != x:
                held, y = [], None
            elif y is None:
                held.append(x)
                if len(held) == need:
                    y = sum(held) / need
            else:
                y += gain * (x - y)
            result.append(y)
        return pdf.assign(**{out: pd.Series(result, index=pdf.index, dtype="float64")})

    return rows.groupBy(*keys).applyInPandas(fold, schema)


def ema(rows: DataFrame, period: int, out: str = "ema", value: str = "close", seed: str = "mean", keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    return recurrence(rows, value, out, 2 / (period + 1), period, seed, keys)


def wilder(rows: DataFrame, period: int, out: str, value: str, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    return recurrence(rows, value, out, 1 / period, period, "mean", keys)


def with_atr(bars: DataFrame, period: int = 14, method: str = "wilder") -> DataFrame:
    """Add tr, atr and atr_known_us. Wilder's value depends on all bars since the first, the mean's on its window and one bar before."""
    d = bars.withColumn("tr", true_range())
    if method == "mean":
        w = frame(-(period - 1), 0)
        return d.withColumn("atr", full(F.avg("tr").over(w), "tr", period, w)).withColumn("atr_known_us", F.max("available_us").over(frame(-period, 0)))
    return wilder(d, period, "atr", "tr").withColumn("atr_known_us", F.max("available_us").over(since_start()))


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Add rsi per segment without gaps: Wilder means of gains and losses; 50 without any move, 100 without a loss."""
    w = Window.partitionBy("instrument", "segment").orderBy("start_us")
    d = segments(bars).withColumn("change", F.col("close") - F.lag("close").over(w))
    d = d.withColumn("gain", F.greatest("change", F.lit(0.0))).withColumn("loss", F.greatest(-F.col("change"), F.lit(0.0)))
    d = d.withColumn("gain", F.when(F.col("change").isNotNull(), F.col("gain"))).withColumn("loss", F.when(F.col("change").isNotNull(), F.col("loss")))
    d = wilder(wilder(d, period, "mean_gain", "gain", ("instrument", "segment")), period, "mean_loss", "loss", ("instrument", "segment"))
    return d.withColumn("rsi", F.when((F.col("mean_gain") == 0) & (F.col("mean_loss") == 0), 50.0).when(F.col("mean_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("mean_gain"), F.col("mean_loss")))))


def rolling(bars: DataFrame, period: int) -> DataFrame:
    """Add sma, rolling_high, rolling_low over ``period`` bars of one segment; null until the segment is long enough."""
    w = Window.partitionBy("instrument", "segment").orderBy("start_us").rowsBetween(-(period - 1), 0)
    d = segments(bars)
    return d.select("*", full(F.avg("close").over(w), "close", period, w).alias("sma"), full(F.max("high").over(w), "high", period, w).alias("rolling_high"), full(F.min("low").over(w), "low", period, w).alias("rolling_low"))


def pivots(bars: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    """Strict local highs and lows of the mids, known once ``right`` further bars are; a tie is none."""
    a, b = frame(-left, -1), frame(1, right)
    enough = (F.count("high").over(a) == left) & (F.count("high").over(b) == right)
    high = enough & (F.col("high") > F.max("high").over(a)) & (F.col("high") > F.max("high").over(b))
    low = enough & (F.col("low") < F.min("low").over(a)) & (F.col("low") < F.min("low").over(b))
    kinds = F.array_compact(F.array(F.when(high, F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(low, F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))))
    d = bars.select("instrument", "start_us", kinds.alias("kinds"), F.lead("end_us", right).over(by_instrument()).alias("confirmed_us"), F.max("available_us").over(frame(-left, right)).alias("available_us"))
    return d.select("instrument", "start_us", "confirmed_us", "available_us", F.explode("kinds").alias("k")).select("instrument", "start_us", "confirmed_us", "available_us", "k.kind", "k.price")


def regimes(found: DataFrame) -> DataFrame:
    """Market structure after each pivot bar: rising, falling or equal last two highs and lows, and what they make together.

    A bar's high and low pivot are one step. available_us is that of the latest of the pivots used.
    """
    per_bar = found.groupBy("instrument", "start_us").agg(
        F.max(F.when(F.col("kind") == "high", F.struct("price", "available_us"))).alias("h"), F.max(F.when(F.col("kind") == "low", F.struct("price", "available_us"))).alias("l"), F.max("available_us").alias("step_known_us")
    )
    for k in ("h", "l"):
        # the last two of a kind up to here: the current or last one, and the one before it
        per_bar = per_bar.withColumn(f"{k}_n", F.count(k).over(since_start()))
        per_bar = per_bar.withColumn(f"{k}1", F.last(k, True).over(since_start()))
        starts = per_bar.where(F.col(k).isNotNull()).select("instrument", (F.col(f"{k}_n") + 1).alias(f"{k}_n"), F.col(k).alias(f"{k}2"))
        per_bar = per_bar.join(starts, ["instrument", f"{k}_n"], "left")
    leg = lambda a, b: F.when(F.col(f"{a}.price") > F.col(f"{b}.price"), "rising").when(F.col(f"{a}.price") < F.col(f"{b}.price"), "falling").when(F.col(f"{a}.price") == F.col(f"{b}.price"), "equal")
    d = per_bar.withColumn("highs", leg("h1", "h2")).withColumn("lows", leg("l1", "l2"))
    regime = (
        F.when(F.col("highs").isNull() | F.col("lows").isNull(), "unknown")
        .when((F.col("highs") == "rising") & (F.col("lows") == "rising"), "bullish")
        .when((F.col("highs") == "falling") & (F.col("lows") == "falling"), "bearish")
        .otherwise("range")
    )
    known = F.greatest("step_known_us", "h1.available_us", "h2.available_us", "l1.available_us", "l2.available_us")
    return d.select("instrument", "start_us", "highs", "lows", regime.alias("regime"), known.alias("available_us"))


def engulfing(strict: bool = False) -> Column:
    """1 or -1 where a candle's body covers the opposite candle's before it, else 0."""
    o, c = F.lag("open").over(by_instrument()), F.lag("close").over(by_instrument())
    low, high = F.least("open", "close"), F.greatest("open", "close")
    covers = (low < F.least(o, c)) & (high > F.greatest(o, c)) if strict else (low <= F.least(o, c)) & (high >= F.greatest(o, c))
    bull = covers & (F.col("close") > F.col("open")) & (c < o)
    bear = covers & (F.col("close") < F.col("open")) & (c > o)
    return F.when(bull, 1).when(bear, -1).otherwise(0)


def displacement(lookback: int = 20, multiple: float = 1.2, median: str = "mean", inclusive: bool = False) -> Column:
    """1 or -1 where a candle's body is at least ``multiple`` medians of the bodies before it (or up to it), else 0."""
    w = frame(-(lookback - 1), 0) if inclusive else frame(-lookback, -1)
    bodies = F.sort_array(F.collect_list("body").over(w))
    low, high = bodies[(lookback - 1) // 2], bodies[lookback // 2]
    middle = {"mean": (low + high) / 2, "lower": low, "upper": high}[median]
    big = (F.size(bodies) == lookback) & (F.col("body") >= multiple * F.when(F.size(bodies) == lookback, middle))
    return F.when(big & (F.col("close") > F.col("open")), 1).when(big & (F.col("close") < F.col("open")), -1).otherwise(0)


def crossover(line: str = "ema", reference: str = "current") -> Column:
    """1 or -1 where the close crosses a line: not beyond it one bar before, strictly beyond its current (or prior) value now."""
    before, line_before = F.lag("close").over(by_instrument()), F.lag(line).over(by_instrument())
    ref = F.col(line) if reference == "current" else line_before
    return F.when((before <= line_before) & (F.col("close") > ref), 1).when((before >= line_before) & (F.col("close") < ref), -1).otherwise(0)


def confirmations(
    bars: DataFrame,
    period: int = 8,
    lookback: int = 20,
    multiple: float = 1.2,
    combination: str = "or",
    seed: str = "mean",
    reference: str = "current",
    strict: bool = False,
    median: str = "mean",
    inclusive: bool = False,
) -> DataFrame:
    """Crossovers of the EMA that an engulfing or a displacement candle of the same direction proves, by the chosen combination.

    combination: engulfing, displacement, or, and. seed is the EMA's, reference the crossover's, strict the engulfing candle's,
    lookback, multiple, median and inclusive the displacement's. patterns lists what proves it; available_us is that of the EMA's last input.
    """
    d = ema(bars.withColumn("body", F.abs(F.col("close") - F.col("open"))), period, seed=seed)
    big = displacement(lookback, multiple, median, inclusive)
    d = d.withColumn("cross", crossover(reference=reference)).withColumn("engulf", engulfing(strict)).withColumn("displace", big).withColumn("known_us", F.max("available_us").over(since_start()))
    e, p = F.col("engulf") == F.col("cross"), F.col("displace") == F.col("cross")
    proof = {"engulfing": e, "displacement": p, "or": e | p, "and": e & p}[combination]
    named = F.concat_ws("+", F.when(e & F.lit(combination != "displacement"), "engulfing"), F.when(p & F.lit(combination != "engulfing"), "displacement"))
    return d.where((F.col("cross") != 0) & proof).select("instrument", "start_us", "end_us", F.col("cross").alias("direction"), named.alias("patterns"), F.col("known_us").alias("available_us"))


def all_of_last(state: str, k: int) -> Column:
    """Three-valued AND over the last k bars: false if any is false, null if any is unknown or missing."""
    w = frame(-(k - 1), 0)
    return F.when(F.min(F.col(state).cast("int")).over(w) == 0, False).when(F.count(state).over(w) == k, True)


def sma_cross_target(bars: DataFrame, fast: int = 12, slow: int = 48, long_only: bool = False) -> DataFrame:
    """Add target: 1 above, -1 below (0 if long_only), 0 while warming up or equal."""
    a, b = frame(-(fast - 1), 0), frame(-(slow - 1), 0)
    d = bars.withColumn("fast", full(F.avg("close").over(a), "close", fast, a)).withColumn("slow", full(F.avg("close").over(b), "close", slow, b))
    return d.withColumn("target", F.when(F.col("fast") > F.col("slow"), 1).when(F.col("fast") < F.col("slow"), 0 if long_only else -1).otherwise(0))


def drawdowns(curve: DataFrame, equity: str = "equity", worst: str = "worst", initial: float = 0.0) -> DataFrame:
    """Add drawdown from the running peak, and worst_drawdown from the peak before the row."""
    peak = F.greatest(F.lit(initial), F.max(equity).over(since_start()))
    earlier = F.greatest(F.lit(initial), F.max(equity).over(by_instrument().rowsBetween(Window.unboundedPreceding, -1)))
    return curve.select("*", ((peak - F.col(equity)) / peak).alias("drawdown"), ((earlier - F.col(worst)) / earlier).alias("worst_drawdown"))
