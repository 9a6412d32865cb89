"""Replay of a target column on bars: fills at the next open, costs, marks and risk limits.

The account is a fold over an instrument's bars: each fill depends on the equity before it. Instruments, and any further key such as
a parameter set, are replayed in parallel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
LEDGER_DDL = (
    "instrument string, start_us long, position double, fill double, price double, commission double, spread_cost double, "
    "slippage_cost double, financing double, cash double, equity double, worst double, exposed boolean, n_fills int, n_closed int, "
    "halted boolean, refused string"
)


@dataclass(frozen=True)
class Costs:
    """Start, size and costs of a replay, and the limits of its account; a limit of None is none.

    max_drawdown: part of the highest checked equity; max_daily_loss: part of the UTC day's first checked equity; both halt for good
    once reached. max_spread_bps: above it a position may only be closed. max_units: larger targets are refused.
    """

    cash: float = 10_000.0
    units: float = 1.0
    slippage_bps: float = 0.0
    commission: float = 0.0  # per unit
    financing: float = 0.0  # per unit and bar in position
    max_drawdown: float | None = None
    max_daily_loss: float | None = None
    max_spread_bps: float | None = None
    max_units: float | None = None
    allow_short: bool = True

    def guarded(self) -> bool:
        limits = (self.max_drawdown, self.max_daily_loss, self.max_spread_bps, self.max_units)
        return not self.allow_short or any(x is not None for x in limits)


# Why a target is refused.
HALTED = ("equity", "drawdown", "daily loss")
REFUSED = {
    ("review", "equity"): "non-positive or invalid equity",
    ("review", "drawdown"): "maximum drawdown reached",
    ("review", "daily loss"): "maximum daily loss reached",
    ("review", "units"): "requested units exceed policy limit",
    ("review", "short"): "short positions are disabled",
    ("review", "spread"): "spread exceeds policy limit",
    ("open", "equity"): "non-positive or invalid equity",
    ("open", "drawdown"): "maximum drawdown reached before execution",
    ("open", "daily loss"): "maximum daily loss reached before execution",
    ("open", "units"): "requested units exceed policy limit",
    ("open", "spread"): "open spread exceeds policy limit",
}


class Guard:
    """What an account may do, from the equities at which it was checked: at each close by the worst of the bar, at each open by its mark."""

    def __init__(self, costs: Costs, first_day: int):
        self.c = costs
        self.peak = self.day_start = costs.cash
        self.day = first_day
        self.halted: str | None = None

    def check(self, at: str, wanted: int, held: int, equity: float, day: int, spread_bps: float) -> tuple[int, str | None]:
        """The target allowed, and why it is not the one wanted (None: it is)."""
        c = self.c
        if at == "open" and self.halted:
            return 0, self.halted
        if not (math.isfinite(equity) and equity > 0):
            return self.halt(at, "equity")
        if at == "open" and wanted and c.max_units is not None and c.units > c.max_units:
            return 0, REFUSED[at, "units"]  # tried before the day begins
        late_day = at == "open" and c.max_drawdown is not None and (self.peak - equity) / self.peak >= c.max_drawdown
        if late_day:
            return self.halt(at, "drawdown")
        if day != self.day:
            self.day, self.day_start = day, equity
        if at == "review":
            self.peak = max(self.peak, equity)
            if self.halted:
                return 0, self.halted
            if c.max_drawdown is not None and (self.peak - equity) / self.peak >= c.max_drawdown:
                return self.halt(at, "drawdown")
        if c.max_daily_loss is not None and (self.day_start - equity) / self.day_start >= c.max_daily_loss:
            return self.halt(at, "daily loss")
        if wanted and c.max_units is not None and c.units > c.max_units:
            return 0, REFUSED[at, "units"]
        if at == "review" and wanted < 0 and not c.allow_short:
            return min(held, 0), REFUSED[at, "short"]  # a long is closed; a short, if any, is kept
        if c.max_spread_bps is not None and spread_bps > c.max_spread_bps and wanted not in (0, held):
            return 0, REFUSED[at, "spread"]
        return wanted, None

    def halt(self, at: str, why: str) -> tuple[int, str]:
        self.halted = self.halted or REFUSED[at, why]
        return 0, REFUSED[at, why]


def replay(bars: DataFrame, costs: Costs = Costs(), keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """The ledger of bars with a column target (-1, 0, 1), known at a bar's close and filled at the next open.

    A reversal goes through flat first and opens a bar later. Limits are checked at each close, by the worst equity of the bar, and
    again at the next open; refused says why a target was not followed. The last bar closes whatever is open at its close. Null
    targets count as 0; bars with a null price are left out.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        c = costs
        pdf = pdf.sort_values("start_us", kind="stable")
        names = ["instrument", "start_us", "end_us", "bid_open", "ask_open", "bid_low", "ask_high", "bid_close", "ask_close", "target"]
        rows = list(pdf[names].itertuples(index=False, name=None))
        guard = Guard(c, rows[0][2] // DAY_US) if c.guarded() else None
        cash, held, pending, out = c.cash, 0, None, []
        bps = lambda bid, ask: (ask - bid) / ((ask + bid) / 2) * 1e4
        mark = lambda cash, held, bid, ask: cash + held * c.units * ((bid if held > 0 else ask) if held else 0.0)
        for i, (name, start, end, bid_open, ask_open, bid_low, ask_high, bid_close, ask_close, target) in enumerate(rows):
            row = dict.fromkeys(("fill", "price", "commission", "spread_cost", "slippage_cost", "n_fills", "n_closed"), 0)

            def trade(new: int, bid: float, ask: float) -> None:
                nonlocal cash, held
                q = (new - held) * c.units
                if q == 0:
                    return
                quote = ask if q > 0 else bid
                price = quote * (1 + math.copysign(c.slippage_bps, q) / 1e4)
                fee = abs(q) * c.commission
                row["price"] = price
                for k, v in (("fill", q), ("commission", fee), ("spread_cost", abs(q) * abs(quote - (bid + ask) / 2)), ("slippage_cost", abs(q) * abs(price - quote))):
                    row[k] += v
                row["n_fills"] += 1
                row["n_closed"] += held != 0
                cash -= q * price + fee
                held = new

            refused = None
            if pending is not None:
                wanted = 0 if pending * held < 0 else pending
                if guard:
                    wanted, refused = guard.check("open", wanted, held, mark(cash, held, bid_open, ask_open), start // DAY_US, bps(bid_open, ask_open))
                trade(wanted, bid_open, ask_open)
            exposed = held != 0
            financing = c.financing * abs(held) * c.units
            cash -= financing
            equity, worst = mark(cash, held, bid_close, ask_close), mark(cash, held, bid_low, ask_high)
            if i < len(rows) - 1:
                pending = 0 if target is None or target != target else int(target)
                if guard:
                    pending, why = guard.check("review", pending, held, min(equity, worst), end // DAY_US, bps(bid_close, ask_close))
                    refused = refused or why
            elif held:
                trade(0, bid_close, ask_close)
                equity, worst = cash, min(worst, cash)
            halted = bool(guard and guard.halted)
            out.append((name, start, held * c.units, *[row[k] for k in ("fill", "price", "commission", "spread_cost", "slippage_cost")], financing, cash, equity, worst, exposed, row["n_fills"], row["n_closed"], halted, refused))
        return pd.DataFrame(out, columns=[x.split()[0] for x in LEDGER_DDL.split(", ")])

    need = ["bid_open", "ask_open", "bid_low", "ask_high", "bid_close", "ask_close"]
    d = bars.dropna(subset=[*keys, "start_us", *need]).withColumn("target", F.col("target").cast("double"))
    return d.select(*dict.fromkeys(["instrument", *keys]), "start_us", "end_us", *need, "target").groupBy(*keys).applyInPandas(fold, LEDGER_DDL)


def summary(ledger: DataFrame, cash: float = 10_000.0) -> DataFrame:
    """Per instrument: net, gross and relative profit, costs, exposure, fills, closed positions, and the largest drawdown of the
    equity and of the worst of each bar from the peak before it."""
    w = Window.partitionBy("instrument").orderBy("start_us")
    peak = F.greatest(F.lit(cash), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = F.greatest(F.lit(cash), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = ledger.withColumn("drawdown", (peak - F.col("equity")) / peak).withColumn("inside", F.greatest(F.lit(0.0), (earlier - F.col("worst")) / earlier))
    costs = ("commission", "spread_cost", "slippage_cost", "financing")
    net = F.max_by("equity", "start_us") - cash
    paid = sum((F.sum(c) for c in costs[1:]), F.sum(costs[0]))
    return d.groupBy("instrument").agg(
        net.alias("net"), (net + paid).alias("gross"), (net / cash).alias("return_share"), *[F.sum(c).alias(c) for c in costs],
        F.avg(F.col("exposed").cast("double")).alias("exposure"), F.sum("n_fills").alias("n_fills"), F.sum("n_closed").alias("n_closed"),
        F.max("drawdown").alias("max_drawdown"), F.max("inside").alias("max_intrabar_drawdown"), F.bool_or("halted").alias("halted"),
    )
