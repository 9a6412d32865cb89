"""Hand values of bars, indicators, rules and replays."""

import pytest
from pyspark.sql import functions as F

from quotemill.operators import backtest as T
from quotemill.operators import bars as B
from quotemill.operators import indicators as I
from quotemill.operators import joins as J
from quotemill.operators import rules as R
from quotemill.operators import sessions as S

H = B.HOUR_US
BAR = "instrument string, start_us long, end_us long, available_us long, bid_open double, bid_high double, bid_low double, bid_close double, ask_open double, ask_high double, ask_low double, ask_close double"


def bars(spark, mids, spread=0.2, shift=lambda i: 0, late=lambda i: 0, name="X"):
    """Bars of mid (open, high, low, close), or of closes alone."""
    rows = []
    for i, m in enumerate(mids):
        o, h, lo, c = m if isinstance(m, tuple) else (m, m + 0.5, m - 0.5, m)
        s = (i + shift(i)) * H
        rows.append((name, s, s + H, s + H + late(i), *[x - spread / 2 for x in (o, h, lo, c)], *[x + spread / 2 for x in (o, h, lo, c)]))
    return B.with_mids(spark.createDataFrame(rows, BAR))


def column(df, c):
    return [None if v is None else round(v, 9) for v in df.orderBy("start_us").select(c).toPandas()[c].astype(object).where(lambda x: x.notna(), None)]


def test_atr_methods(spark):
    d = bars(spark, [(10, 11, 9, 10), (10, 13, 10, 12), (12, 14, 11, 12)])
    assert column(d.select("start_us", I.true_range().alias("tr")), "tr") == [2, 3, 3]
    assert column(I.with_atr(d, 2, "mean"), "atr") == [None, 2.5, 3.0]
    assert column(I.with_atr(d, 2), "atr") == [None, 2.5, 2.75]


def test_ema_seeds_and_nan_restart(spark):
    d = bars(spark, [1.0, 2.0, 3.0, 5.0])
    assert column(I.ema(d, 2), "ema") == [None, 1.5, 2.5, round(2.5 + 2 / 3 * 2.5, 9)]
    assert column(I.ema(d, 3, seed="first"), "ema") == [1, 1.5, 2.25, 3.625]
    broken = d.withColumn("close", F.when(F.col("start_us") != H, F.col("close")))
    assert column(I.ema(broken, 2), "ema") == [None, None, None, 4.0]


def test_rsi_flat_and_rising(spark):
    assert column(I.rsi(bars(spark, [1.0, 2.0, 3.0]), 2), "rsi") == [None, None, 100.0]
    assert column(I.rsi(bars(spark, [1.0, 1.0, 1.0]), 2), "rsi") == [None, None, 50.0]


def test_pivots_need_strict_neighbours(spark):
    d = bars(spark, [1.0, 2.0, 3.0, 9.0, 3.0, 2.0, 1.0])
    assert [(r.kind, r.start_us // H, r.confirmed_us // H) for r in I.pivots(d).collect()] == [("high", 3, 7)]
    assert I.pivots(bars(spark, [1.0, 2.0, 3.0, 9.0, 9.0, 2.0, 1.0, 0.0])).collect() == []


def test_later_bars_change_nothing(spark):
    closes = [100 + ((i * 7919) % 31) / 3 - ((i * 104729) % 17) / 2 for i in range(60)]
    long, short = bars(spark, closes), bars(spark, closes[:40])
    for f in (I.confirmations, lambda d: I.pivots(d), lambda d: I.regimes(I.pivots(d))):
        cut = 40 * H
        a = {tuple(r) for r in f(long).where(F.col("available_us") <= cut).collect()}
        b = {tuple(r) for r in f(short).collect()}
        assert a == b


def test_as_of_prefers_newer_structure(spark):
    left = spark.createDataFrame([("X", 10), ("X", 20), ("X", 30)], "k string, t long")
    right = spark.createDataFrame([("X", 10, 5, "a"), ("X", 15, 9, "b"), ("X", 25, 7, "late")], "k string, a long, r long, v string")
    get = lambda inclusive: [r.v for r in J.as_of_latest(left, right, ["k"], "t", "a", ["r"], ["r", "v"], inclusive).orderBy("t").collect()]
    assert get(True) == ["a", "b", "b"] and get(False) == [None, "b", "b"]


def test_intervals(spark):
    r = spark.createDataFrame([("c", 0, 10), ("c", 5, 12), ("c", 12, 13), ("c", 20, 20), ("c", 30, 31), ("d", 1, 2)], "k string, a long, z long")
    assert sorted(map(tuple, J.merge_intervals(r, ["k"], "a", "z").collect())) == [("c", 0, 13), ("c", 30, 31), ("d", 1, 2)]
    p = spark.createDataFrame([("c", 5), ("c", 12), ("c", 13), ("d", 5)], "k string, t long")
    got = sorted((x.k, x.t, x.a) for x in J.interval_join(p, r, ["k"], "t", "a", "z", 4).collect())
    assert got == [("c", 5, 0), ("c", 5, 5), ("c", 12, 12)]
    assert {x.side for x in J.set_difference_both(p, p.limit(3)).collect()} <= {"left"}


def test_open_time_random(spark):
    import datetime as dt
    import random

    rng, t0 = random.Random(7), dt.datetime(2025, 1, 1)
    closures = [("c", t0 + dt.timedelta(minutes=a), t0 + dt.timedelta(minutes=a + rng.randint(1, 90)), "r") for a in rng.sample(range(6000), 60)]
    shut = {m for _, a, z, _ in closures for m in range(int((a - t0).total_seconds() // 60), int((z - t0).total_seconds() // 60))}
    base = int((t0 - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    spans = [(i, "c", base + a * 60_000_000, base + (a + n) * 60_000_000) for i, (a, n) in enumerate((rng.randrange(6000), rng.randint(1, 4000)) for _ in range(40))]
    got = {r.span_id: r.open_us for r in S.open_time(spark.createDataFrame(spans, "span_id int, calendar_id string, a long, z long"), spark.createDataFrame(closures, "calendar_id string, closure_start timestamp_ntz, closure_end timestamp_ntz, reason string"), "a", "z", 7_200_000_000).collect()}
    for i, _, a, z in spans:
        minutes = range((a - base) // 60_000_000, (z - base) // 60_000_000)
        assert got[i] == sum(m not in shut for m in minutes) * 60_000_000


def rules(**features):
    return {"parameters": {}, "features": features, "conditions": {}}


def test_rule_features(spark):
    r = rules(fast={"kind": "sma", "period": 2}, slow={"kind": "sma", "period": 3}, a={"kind": "atr", "period": 2}, e={"kind": "ema", "period": 2}, r={"kind": "rsi", "period": 2}, hi={"kind": "rolling_high", "period": 2, "source": "close"}, lo={"kind": "rolling_low", "period": 2, "source": "close"})
    last = R.with_features(bars(spark, [1.0, 2.0, 3.0]), r).orderBy(F.desc("start_us")).first()
    assert (last.f_fast, last.f_slow, last.f_a, last.f_e, last.f_r, last.f_hi, last.f_lo) == pytest.approx((2.5, 2, 1.5, 2.5, 100, 3, 2))


def test_rule_cross_and_gaps(spark):
    x = {"op": "crosses_above", "left": {"feature": "fast"}, "right": {"feature": "slow"}}
    r = {"parameters": {}, "features": {"fast": {"kind": "sma", "period": 1}, "slow": {"kind": "sma", "period": 2}}, "conditions": {"long": x}}
    closes = [3.0, 2.0, 1.0, 4.0]
    assert [s.signal for s in R.signals(bars(spark, closes), r).orderBy("start_us").collect()] == ["warming_up", "none", "none", "long"]
    gap = R.signals(bars(spark, closes, shift=lambda i: i == 3), r).orderBy("start_us").collect()
    assert gap[3].signal == "warming_up" and gap[3].long is None and gap[3].short is False
    late = R.signals(bars(spark, closes, late=lambda i: int(i == 2)), r).orderBy("start_us").collect()
    assert [s.signal for s in late] == ["warming_up", "none", "unusable_bar", "warming_up"]


def test_rule_faults():
    bad = [
        {"x": 1}, rules(a={"kind": "sma", "period": 0}), rules(a={"kind": "no", "period": 1}), rules(a={"kind": "sma", "period": 1, "source": "a"}), {"parameters": {"p": True}},
        {"conditions": {"long": {"all": []}}}, {"conditions": {"long": {"op": "gt", "left": {"bar": "close"}, "right": {"feature": "no"}}}}, {"conditions": {"long": {"op": "gt", "left": {"value": True}, "right": {"value": 1}}}},
    ]
    for r in bad:
        with pytest.raises(R.RuleError):
            R.validate(r)
    deep = {"op": "gt", "left": {"value": 1}, "right": {"value": 0}}
    for _ in range(40):
        deep = {"not": deep}
    with pytest.raises(R.RuleError):
        R.validate({"conditions": {"long": deep}})
    assert R.identity({"a": 1, "b": 2}) == R.identity({"b": 2, "a": 1})


def test_backtest_costs(spark):
    d = bars(spark, [(100, 100, 100, 100)] * 3, spread=2.0).withColumn("target", F.lit(1))
    net = lambda c: round(T.summary(T.replay(d, c)).first().net, 6)
    assert net(T.Costs()) == -2.0
    assert net(T.Costs(slippage_bps=10, commission=0.5)) == pytest.approx(-2 - 0.101 - 0.099 - 1.0)


def test_backtest_reversal_and_halt(spark):
    closes = [100.0, 100.0, 100.0, 100.0, 100.0]
    d = bars(spark, closes, spread=0.0).withColumn("target", F.when(F.col("start_us") == 0, 1).otherwise(-1))
    assert column(T.replay(d), "position") == [0, 1, 0, -1, 0]
    fall = bars(spark, [(100, 100, 100, 100), (100, 100, 40, 50), (50, 50, 50, 50), (50, 50, 50, 50)], spread=0.0).withColumn("target", F.lit(1))
    assert column(T.replay(fall, T.Costs(cash=100, max_drawdown=0.3)), "position") == [0, 1, 0, 0]
    assert T.replay(fall.where("false")).collect() == []


def test_backtest_limits(spark):
    flat = [(100, 100, 100, 100)] * 4
    refused = lambda d, **c: [r.refused for r in T.replay(d, T.Costs(cash=1000.0, **c)).orderBy("start_us").collect()]
    long, short = (bars(spark, flat, spread=2.0).withColumn("target", F.lit(t)) for t in (1, -1))
    assert set(refused(long, units=2.0, max_units=1.0)) == {"requested units exceed policy limit", None}
    assert refused(short, allow_short=False)[0] == "short positions are disabled"
    assert refused(long, max_spread_bps=100.0)[0] == "spread exceeds policy limit" and set(refused(long, max_spread_bps=300.0)) == {None}
    # the peak rises by the worst of a bar, not by its close: 1000 + 50 - 40 = 1010, so a fall to 990 is just under 2 percent
    up = bars(spark, [(100, 100, 100, 100), (100, 150, 110, 150), (150, 150, 90, 90), (90, 90, 90, 90)], spread=0.0).withColumn("target", F.lit(1))
    assert refused(up, max_drawdown=0.019) == [None, None, "maximum drawdown reached", "maximum drawdown reached"]
    assert refused(up, max_drawdown=0.03)[2] is None
    # the UTC day of a review is that of the bar's end; its first checked equity is the day's start
    days = bars(spark, [(100, 100, 100, 100)] * 23 + [(100, 100, 60, 60), (60, 60, 40, 40), (40, 40, 40, 40)], spread=0.0).withColumn("target", F.lit(1))
    assert refused(days, max_daily_loss=0.03)[23:] == [None, None, None] and refused(days, max_daily_loss=0.02)[24] == "maximum daily loss reached"
    s = T.summary(T.replay(long, T.Costs(cash=1000.0)), 1000.0).first()
    assert (s.net, s.gross, s.n_fills, s.n_closed, s.exposure) == pytest.approx((-2.0, 0.0, 2, 1, 0.75))
