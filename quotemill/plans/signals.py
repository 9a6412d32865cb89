"""Queries for the rule language and replays, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.operators import backtest as T
from quotemill.operators import brackets as K
from quotemill.operators import indicators as I
from quotemill.operators import rules as R
from quotemill.operators.bars import HOUR_US
from quotemill.plans.market import BARS, SEGMENTS, W, base, rounded
from quotemill.session import stored

QUERIES: dict = {}
RULES = {
    "parameters": {"least": 0.5},
    "features": {"fast": {"kind": "sma", "period": 2}, "slow": {"kind": "sma", "period": 4}, "top": {"kind": "rolling_high", "period": 3}, "smooth": {"kind": "sma", "period": 2, "source": "fast"}},
    "conditions": {
        "long": {"all": [{"op": "crosses_above", "left": {"feature": "fast"}, "right": {"feature": "slow"}}, {"not": {"op": "lt", "left": {"bar": "close"}, "right": {"feature": "smooth"}}}]},
        "short": {"any": [{"op": "crosses_below", "left": {"feature": "fast"}, "right": {"feature": "slow"}}, {"all": [{"op": "gte", "left": {"quote": "bid"}, "right": {"feature": "top"}}, {"op": "gt", "left": {"param": "least"}, "right": {"value": 1}}]}]},
    },
}
COSTS = T.Costs(commission=0.5, slippage_bps=10.0)


def dsl_signals(spark, folder):
    d = base(spark, folder).withColumn("available_us", F.col("end_us"))
    return rounded(R.signals(d, RULES), "f_fast", "f_slow", "f_smooth").select("instrument", "start_us", F.col("f_fast").alias("fast"), F.col("f_slow").alias("slow"), F.col("f_smooth").alias("smooth"), "long", "short", "signal")


def _targets(spark, folder):
    return I.sma_cross_target(base(spark, folder), 6, 24, long_only=True)


def backtest_ledger(spark, folder):
    return rounded(T.replay(_targets(spark, folder), COSTS), "cash", "equity").select("instrument", "start_us", "position", "fill", "cash", "equity")


GUARDED = T.Costs(commission=0.5, slippage_bps=1.0, financing=0.01, max_drawdown=0.06, max_daily_loss=0.02, max_spread_bps=1.274)


def _guarded(spark, folder):
    """Long, short and flat by the averages, under limits that are met now and then."""
    return T.replay(I.sma_cross_target(base(spark, folder), 6, 24), GUARDED)


def backtest_guarded(spark, folder):
    d = rounded(_guarded(spark, folder), "cash", "equity", "worst")
    return d.select("instrument", "start_us", "position", "n_fills", "cash", "equity", "worst", "halted", "refused")


def backtest_summary(spark, folder):
    d = T.summary(_guarded(spark, folder))
    return rounded(d, "net", "gross", "return_share", "commission", "spread_cost", "slippage_cost", "financing", "exposure", "max_drawdown", "max_intrabar_drawdown")


def bracket_events(spark, folder):
    """Brackets at each confirmation, on the opens of the bars as quotes; an account per instrument."""
    b = stored(base(spark, folder), "bars")
    quotes = b.select(F.col("instrument").alias("account"), F.col("start_us").alias("quoted_us"), F.col("start_us").alias("received_us"), F.round("bid_open", 2).alias("bid"), F.round("ask_open", 2).alias("ask"))
    c = I.confirmations(b).join(b.select("instrument", "start_us", F.round("bid_close", 2).alias("price")), ["instrument", "start_us"])
    away = lambda x: F.round(F.col("price") + F.col("direction") * x, 2)
    intents = c.select(
        F.col("instrument").alias("account"), F.col("start_us").cast("string").alias("intent_id"), F.when(F.col("direction") == 1, "buy").otherwise("sell").alias("side"),
        F.col("end_us").alias("created_us"), F.col("end_us").alias("not_before_us"), (F.col("end_us") + 4 * HOUR_US).alias("expires_us"),
        away(-20.0).alias("stop"), F.array(away(60.0)).alias("targets"), F.lit(False).alias("exact_open"),
    )
    terms = K.Terms(min_lots=K.Decimal("0.0001"), lot_step=K.Decimal("0.0001"), max_holding_us=72 * HOUR_US, max_losses_per_day=2, max_weekly_drawdown_fraction=K.Decimal("0.03"))
    return K.replay_brackets(quotes, intents, terms)


def bracket_reasons(spark, folder):
    return bracket_events(spark, folder).groupBy("kind", "reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (dsl_signals, backtest_ledger, backtest_guarded, backtest_summary, bracket_events, bracket_reasons)}
V = "(PARTITION BY instrument, segment ORDER BY start_us ROWS {} PRECEDING)"
SQL = {
    "dsl_signals": f"""WITH {BARS}{SEGMENTS}, f AS (SELECT *, CASE WHEN count(*) OVER {V.format(1)}=2 THEN avg("close") OVER {V.format(1)} END fast, CASE WHEN count(*) OVER {V.format(3)}=4 THEN avg("close") OVER {V.format(3)} END slow, CASE WHEN count(*) OVER {V.format(2)}=3 THEN max(high) OVER {V.format(2)} END hi FROM sg),
g AS (SELECT *, CASE WHEN count(fast) OVER {V.format(1)}=2 THEN avg(fast) OVER {V.format(1)} END smooth, CASE WHEN lag(segment) OVER {W}=segment THEN lag(fast) OVER {W} END pf, CASE WHEN lag(segment) OVER {W}=segment THEN lag(slow) OVER {W} END ps, lag(segment) OVER {W}=segment joined FROM f),
h AS (SELECT *, (CASE WHEN joined THEN pf<=ps AND fast>slow END) AND NOT ("close"<smooth) "long", (CASE WHEN joined THEN pf>=ps AND fast<slow END) OR (bid_close>=hi AND 0.5>1) "short" FROM g)
SELECT instrument, start_us, round(fast,6) fast, round(slow,6) slow, round(smooth,6) smooth, "long", "short", CASE WHEN fast IS NULL OR slow IS NULL OR hi IS NULL OR smooth IS NULL THEN 'warming_up' WHEN "long" AND "short" THEN 'conflict' WHEN "long" THEN 'long' WHEN "short" THEN 'short' ELSE 'none' END signal FROM h""",
    "backtest_ledger": f"""WITH {BARS}, s AS (SELECT *, row_number() OVER {W} n, count(*) OVER (PARTITION BY instrument) total, CASE WHEN row_number() OVER {W}>=24 AND avg("close") OVER (PARTITION BY instrument ORDER BY start_us ROWS 5 PRECEDING)>avg("close") OVER (PARTITION BY instrument ORDER BY start_us ROWS 23 PRECEDING) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END target FROM b),
p AS (SELECT *, coalesce(lag(target) OVER {W}, 0) pos FROM s), q AS (SELECT *, pos-coalesce(lag(pos) OVER {W}, 0) d FROM p),
m AS (SELECT *, CASE WHEN d>0 THEN ask_open*1.001 ELSE bid_open*0.999 END*d+abs(d)*0.5 spent, CASE WHEN n=total THEN -pos*bid_close*0.999+pos*0.5 ELSE 0 END closing FROM q)
SELECT instrument, start_us, CASE WHEN n=total THEN 0.0::DOUBLE ELSE pos END "position", CASE WHEN n=total THEN d-pos ELSE d END fill, round(10000-sum(spent+closing) OVER (PARTITION BY instrument ORDER BY start_us ROWS UNBOUNDED PRECEDING),6) cash, round(10000-sum(spent+closing) OVER (PARTITION BY instrument ORDER BY start_us ROWS UNBOUNDED PRECEDING)+CASE WHEN n=total THEN 0 ELSE pos*bid_close END,6) equity FROM m""",
}

G = GUARDED
# One step of the recursion per bar: x: what is asked at the open; y: whether the open lets it pass; z: the fill; u: marks; v: the review.
GUARD = f"""WITH RECURSIVE {BARS}, s AS (SELECT *, row_number() OVER {W} n, count(*) OVER (PARTITION BY instrument) total,
    avg("close") OVER (PARTITION BY instrument ORDER BY start_us ROWS 5 PRECEDING) f, avg("close") OVER (PARTITION BY instrument ORDER BY start_us ROWS 23 PRECEDING) sl FROM b),
t0 AS (SELECT *, CASE WHEN n<24 THEN 0 WHEN f>sl THEN 1 WHEN f<sl THEN -1 ELSE 0 END tg, (ask_open-bid_open)/((ask_open+bid_open)/2)*1e4 so, (ask_close-bid_close)/((ask_close+bid_close)/2)*1e4 sc FROM s),
r AS (
  SELECT instrument, 0::BIGINT n, 0::BIGINT start_us, {G.cash}::DOUBLE cash, 0 held, NULL::INT pending, {G.cash}::DOUBLE peak, {G.cash}::DOUBLE day_start, end_us//86400000000 d, NULL::VARCHAR halt,
    0 n_fills, 0.0::DOUBLE equity, 0.0::DOUBLE worst, NULL::VARCHAR refused, 0.0::DOUBLE spent, 0.0::DOUBLE spread, 0.0::DOUBLE slip, 0.0::DOUBLE fee, 0.0::DOUBLE fin, 0 closed, false exposed FROM t0 WHERE n=1
  UNION ALL
  SELECT instrument, n, start_us, cash2, CASE WHEN n=total THEN 0 ELSE h END, CASE WHEN n<total THEN CASE WHEN why IS NULL THEN tg ELSE 0 END END, peak2, day_start2, d2, halt2, n_fills2,
    CASE WHEN n=total THEN cash2 ELSE eq END, CASE WHEN n=total AND h<>0 THEN least(wo, cash2) ELSE wo END, coalesce(no, why), 0.0, spread2, slip2, fee2, fin2, closed2, h<>0
  FROM (SELECT *, CASE WHEN n=total THEN NULL WHEN chk<=0 THEN 'non-positive or invalid equity' WHEN halt1 IS NOT NULL THEN halt1 WHEN (peak2-chk)/peak2>={G.max_drawdown} THEN 'maximum drawdown reached'
      WHEN (day_start2-chk)/day_start2>={G.max_daily_loss} THEN 'maximum daily loss reached' WHEN sc>{G.max_spread_bps} AND tg<>0 AND tg<>h THEN 'spread exceeds policy limit' END why,
    CASE WHEN n=total OR halt1 IS NOT NULL THEN halt1 WHEN chk<=0 THEN 'non-positive or invalid equity' WHEN (peak2-chk)/peak2>={G.max_drawdown} THEN 'maximum drawdown reached'
      WHEN (day_start2-chk)/day_start2>={G.max_daily_loss} THEN 'maximum daily loss reached' END halt2,
    CASE WHEN n=total AND h<>0 THEN cash1+h*px_end-{G.commission} ELSE cash1 END cash2, CASE WHEN n=total AND h<>0 THEN nf+1 ELSE nf END n_fills2, CASE WHEN n=total AND h<>0 THEN cl+1 ELSE cl END closed2,
    fee1+CASE WHEN n=total AND h<>0 THEN {G.commission} ELSE 0 END fee2, spread1+CASE WHEN n=total AND h<>0 THEN (ask_close-bid_close)/2 ELSE 0 END spread2,
    slip1+CASE WHEN n=total AND h<>0 THEN abs(px_end-CASE WHEN h>0 THEN bid_close ELSE ask_close END) ELSE 0 END slip2
  FROM (SELECT *, least(eq, wo) chk, CASE WHEN n=total THEN pk ELSE greatest(pk, least(eq, wo)) END peak2, CASE WHEN n<total AND end_us//86400000000<>d1 THEN least(eq, wo) ELSE day_start1 END day_start2, CASE WHEN n<total THEN end_us//86400000000 ELSE d1 END d2
  FROM (SELECT *, cash1+h*CASE WHEN h>0 THEN bid_close WHEN h<0 THEN ask_close ELSE 0 END eq, cash1+h*CASE WHEN h>0 THEN bid_low WHEN h<0 THEN ask_high ELSE 0 END wo,
    CASE WHEN h>0 THEN bid_close*(1-{G.slippage_bps}/1e4) ELSE ask_close*(1+{G.slippage_bps}/1e4) END px_end
  FROM (SELECT *, cash-(h-held)*CASE WHEN h<>held THEN px ELSE 0 END-abs(h-held)*{G.commission}-abs(h)*{G.financing} cash1, CASE WHEN h<>held THEN 1 ELSE 0 END nf, CASE WHEN h<>held AND held<>0 THEN 1 ELSE 0 END cl,
    abs(h)*{G.financing} fin2, abs(h-held)*{G.commission} fee1, abs(h-held)*(ask_open-bid_open)/2 spread1, abs(h-held)*abs(px-CASE WHEN h>held THEN ask_open ELSE bid_open END) slip1
  FROM (SELECT *, CASE WHEN pending IS NULL THEN held WHEN no IS NULL THEN x ELSE 0 END h, CASE WHEN CASE WHEN no IS NULL THEN x ELSE 0 END>held THEN ask_open*(1+{G.slippage_bps}/1e4) ELSE bid_open*(1-{G.slippage_bps}/1e4) END px,
    CASE WHEN pending IS NULL OR halt IS NOT NULL OR no IS NULL OR no='open spread exceeds policy limit' THEN halt ELSE no END halt1
  FROM (SELECT *, CASE WHEN pending IS NULL THEN NULL WHEN halt IS NOT NULL THEN halt WHEN mo<=0 THEN 'non-positive or invalid equity' WHEN (pk-mo)/pk>={G.max_drawdown} THEN 'maximum drawdown reached before execution'
      WHEN (day_start1-mo)/day_start1>={G.max_daily_loss} THEN 'maximum daily loss reached before execution' WHEN so>{G.max_spread_bps} AND x<>0 AND x<>held THEN 'open spread exceeds policy limit' END no
  FROM (SELECT *, CASE WHEN moves THEN mo ELSE day_start END day_start1, CASE WHEN moves THEN b_day ELSE d END d1
  FROM (SELECT *, b_day<>d AND pending IS NOT NULL AND halt IS NULL AND mo>0 AND (pk-mo)/pk<{G.max_drawdown} moves
  FROM (SELECT t0.*, r.cash, r.held, r.pending, r.peak pk, r.day_start, r.d, r.halt, t0.start_us//86400000000 b_day, CASE WHEN r.pending*r.held<0 THEN 0 ELSE r.pending END x,
      r.cash+r.held*CASE WHEN r.held>0 THEN bid_open WHEN r.held<0 THEN ask_open ELSE 0 END mo FROM r JOIN t0 ON t0.instrument=r.instrument AND t0.n=r.n+1)))))))))
), g AS (SELECT * FROM r WHERE n>0)"""
SQL["backtest_guarded"] = GUARD + ' SELECT instrument, start_us, held::DOUBLE "position", n_fills, round(cash,6) cash, round(equity,6) equity, round(worst,6) worst, halt IS NOT NULL halted, refused FROM g'
PEAK = f"greatest({G.cash}, max(equity) OVER (PARTITION BY instrument ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND {{}}))"
SQL["backtest_summary"] = GUARD + f""", h AS (SELECT *, ({PEAK.format("CURRENT ROW")}-equity)/{PEAK.format("CURRENT ROW")} dd, greatest(0, (coalesce({PEAK.format("1 PRECEDING")}, {G.cash})-worst)/coalesce({PEAK.format("1 PRECEDING")}, {G.cash})) inside FROM g)
SELECT instrument, round(arg_max(equity, start_us)-{G.cash},6) net, round(arg_max(equity, start_us)-{G.cash}+sum(fee+spread+slip+fin),6) gross, round((arg_max(equity, start_us)-{G.cash})/{G.cash},6) return_share,
  round(sum(fee),6) commission, round(sum(spread),6) spread_cost, round(sum(slip),6) slippage_cost, round(sum(fin),6) financing, round(avg(exposed::INT),6) exposure, sum(n_fills)::BIGINT n_fills, sum(closed)::BIGINT n_closed,
  round(max(dd),6) max_drawdown, round(max(inside),6) max_intrabar_drawdown, bool_or(halt IS NOT NULL) halted FROM h GROUP BY 1"""
