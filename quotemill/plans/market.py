"""Queries for bars, indicators, zones and sessions, each with the DuckDB statement that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators import bars as B
from quotemill.operators import indicators as I
from quotemill.operators import joins as J
from quotemill.operators import levels as L
from quotemill.operators import sessions as S
from quotemill.operators import zones as Z
from quotemill.session import stored, table

H = B.HOUR_US
AS_OF = 1_705_276_800_000_000  # 2024-01-15
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return B.ticks_of_events(table(spark, folder, "events"))


def raw_bars(spark: SparkSession, folder: str) -> DataFrame:
    return B.ticks_to_bars(ticks(spark, folder))


def base(spark: SparkSession, folder: str) -> DataFrame:
    return B.with_mids(raw_bars(spark, folder))


def stored_bars(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Bars and parent bars, written once for queries that read them in many places."""
    b = stored(base(spark, folder), "bars")
    return b, stored(B.with_mids(B.bars_to_parents(b.drop(*B.PRICES))), "parents")


def parents(spark: SparkSession, folder: str) -> DataFrame:
    return B.with_mids(B.bars_to_parents(raw_bars(spark, folder)))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Shared statements
TICKS = "t AS (SELECT event_type instrument, epoch_us(ts) ts_us, event_id source_row, 2000.0+value bid, 2000.0+value+0.26 ask, epoch_us(ts)+event_id%11*60000000 available_us FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL)"
OHLC = (("open", "arg_min({}, {})"), ("high", "max({})"), ("low", "min({})"), ("close", "arg_max({}, {})"))
MIDS = ", ".join(f'(bid_{p}+ask_{p})/2 "{p}"' for p in ("open", "high", "low", "close"))


def bars_sql(quotes: str, width: int) -> str:
    cells = ", ".join(f.format(s, "(ts_us, source_row)") + f" {s}_{p}" for s in ("bid", "ask") for p, f in OHLC)
    return quotes + f""", rb AS (SELECT instrument, ts_us//{width}*{width} start_us, {cells}, count(*) tick_count, max(available_us) received FROM t GROUP BY 1,2),
b AS (SELECT * EXCLUDE (received), start_us+{width} end_us, greatest(start_us+{width}, received) available_us, {MIDS} FROM rb)"""


def parents_sql(width: int) -> str:
    """Parents of four bars of a width."""
    cells = ", ".join(f.format(f"{s}_{p}", "start_us") + f" {s}_{p}" for s in ("bid", "ask") for p, f in OHLC)
    return f""", rp AS (SELECT instrument, start_us//{4 * width}*{4 * width} start_us, {cells}, sum(tick_count)::BIGINT tick_count, count(*) n,
  max(available_us) available_us, arg_max(start_us, (available_us, start_us)) last_known_child_us FROM b GROUP BY 1, start_us//{4 * width}*{4 * width} HAVING count(*)=4),
p AS (SELECT * EXCLUDE (n), start_us+{4 * width} end_us, {MIDS} FROM rp)"""


BARS, PARENTS = bars_sql(TICKS, H), parents_sql(H)
W = "(PARTITION BY instrument ORDER BY start_us)"


def recur(source: str, x: str, gain: str, period: int, out: str, name: str, first: bool = False) -> str:
    """Recursive statement of a linear recurrence over rows numbered rn per instrument, without nulls."""
    seed = f"SELECT instrument, rn, {x} y FROM {source} WHERE rn=1" if first else f"SELECT instrument, {period}::BIGINT rn, avg({x}) y FROM {source} WHERE rn<={period} GROUP BY 1 HAVING count(*)={period}"
    return f"{name} AS ({seed} UNION ALL SELECT s.instrument, s.rn, r.y+({gain})*(s.{x}-r.y) FROM {name} r JOIN {source} s ON s.instrument=r.instrument AND s.rn=r.rn+1)"


TR = """, q AS (SELECT *, row_number() OVER w rn, CASE WHEN lag("close") OVER w IS NULL THEN high-low ELSE greatest(high-low, abs(high-lag("close") OVER w), abs(low-lag("close") OVER w)) END tr, max(available_us) OVER (PARTITION BY instrument ORDER BY start_us ROWS UNBOUNDED PRECEDING) known FROM {0} WINDOW w AS (PARTITION BY instrument ORDER BY start_us))"""


@query(f"WITH {BARS} SELECT instrument, start_us, end_us, available_us, bid_open, bid_high, bid_low, bid_close, ask_open, ask_high, ask_low, ask_close, tick_count FROM b")
def tick_to_bar(spark, folder):
    return raw_bars(spark, folder).select("instrument", "start_us", "end_us", "available_us", *[f"{s}_{p}" for s in ("bid", "ask") for p in B.PRICES], "tick_count")


@query(f"WITH {BARS}{PARENTS} SELECT instrument, start_us, end_us, available_us, bid_open, bid_high, bid_low, bid_close, ask_open, ask_high, ask_low, ask_close, tick_count, last_known_child_us FROM p")
def bar_to_parent(spark, folder):
    return B.bars_to_parents(raw_bars(spark, folder)).select("instrument", "start_us", "end_us", "available_us", *[f"{s}_{p}" for s in ("bid", "ask") for p in B.PRICES], "tick_count", "last_known_child_us")


@query(f"""WITH {BARS} SELECT instrument, start_us, round(open,6) "open", round(high,6) high, round(low,6) low, round("close",6) "close", round(abs("close"-open),6) body, CASE WHEN "close">open THEN 1 WHEN "close"<open THEN -1 ELSE 0 END direction, round((ask_open-bid_open)/open*10000,6) spread_open_bps, round((ask_close-bid_close)/"close"*10000,6) spread_close_bps FROM b""")
def bar_mid_spread(spark, folder):
    d = base(spark, folder).withColumn("body", F.abs(F.col("close") - F.col("open"))).withColumn("direction", F.coalesce(F.get(B.direction(), F.lit(0)), F.lit(0)))
    d = d.withColumn("spread_open_bps", B.spread_bps("open")).withColumn("spread_close_bps", B.spread_bps("close"))
    return rounded(d, *B.PRICES, "body", "spread_open_bps", "spread_close_bps").select("instrument", "start_us", *B.PRICES, "body", "direction", "spread_open_bps", "spread_close_bps")


@query(f"WITH {BARS} SELECT instrument, prev gap_start_us, start_us gap_end_us FROM (SELECT *, lag(end_us) OVER {W} prev FROM b) WHERE prev<start_us")
def cadence_gaps(spark, folder):
    return B.gaps(raw_bars(spark, folder))


@query(f"WITH {BARS} SELECT instrument, count(*) n_bars, count(*) FILTER (step<{H}) short_steps, count(*) FILTER (step>{H}) gaps, 0::BIGINT wrong_durations, coalesce(max(step),0) longest_step_us, count(*) FILTER (step<>{H})=0 exact FROM (SELECT *, start_us-lag(start_us) OVER {W} step FROM b) GROUP BY 1")
def cadence_report(spark, folder):
    return B.cadence(raw_bars(spark, folder))


SEGMENTS = f", sg AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM start_us THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY start_us ROWS UNBOUNDED PRECEDING)::BIGINT segment FROM (SELECT *, lag(end_us) OVER {W} prev FROM b))"


@query(f"WITH {BARS}{SEGMENTS} SELECT instrument, segment, min(start_us) start_us, max(end_us) end_us, count(*) n_bars, greatest(0, max(end_us)//{4 * H}-(min(start_us)+{4 * H}-1)//{4 * H})::BIGINT complete_parents FROM sg GROUP BY 1,2")
def contiguous_segments(spark, folder):
    return B.segment_summary(raw_bars(spark, folder))


@query(
    "WITH x AS (SELECT DISTINCT tick_id, ts, bid, ask FROM bid_ask_ticks) SELECT code, count(*) n_ticks FROM (SELECT unnest([CASE WHEN bid IS NULL THEN 'no_bid' END, CASE WHEN ask IS NULL THEN 'no_ask' END, CASE WHEN NOT isfinite(bid) OR bid<=0 THEN 'impossible_bid' END, CASE WHEN NOT isfinite(ask) OR ask<=0 THEN 'impossible_ask' END, CASE WHEN NOT isnan(bid) AND NOT isnan(ask) AND bid>ask THEN 'crossed' END]) code FROM x) WHERE code IS NOT NULL GROUP BY 1"
)
def tick_violations(spark, folder):
    d = table(spark, folder, "bid_ask_ticks").select("tick_id", "ts", "bid", "ask").distinct()
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) <= 0)
    rules = {"no_bid": F.col("bid").isNull(), "no_ask": F.col("ask").isNull(), "impossible_bid": bad("bid"), "impossible_ask": bad("ask"), "crossed": ~F.isnan("bid") & ~F.isnan("ask") & (F.col("bid") > F.col("ask"))}
    codes = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    return d.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n_ticks"))


@query(
    f"""WITH {BARS}, s AS (SELECT * REPLACE (CASE WHEN start_us//{H}%5=0 THEN bid_high+0.001 ELSE bid_low END AS bid_low, CASE WHEN start_us//{H}%5=1 THEN bid_low-0.001 ELSE ask_low END AS ask_low, CASE WHEN start_us//{H}%5=2 THEN end_us-1 ELSE available_us END AS available_us) FROM b)
SELECT instrument, start_us, 'range' code FROM s WHERE bid_high<greatest(bid_open,bid_close) OR bid_low>least(bid_open,bid_close) OR ask_high<greatest(ask_open,ask_close) OR ask_low>least(ask_open,ask_close)
UNION ALL SELECT instrument, start_us, 'crossed' FROM s WHERE bid_open>ask_open OR bid_high>ask_high OR bid_low>ask_low OR bid_close>ask_close UNION ALL SELECT instrument, start_us, 'early' FROM s WHERE available_us<end_us"""
)
def bar_violations(spark, folder):
    """Checks a copy of the bars that is broken on purpose, by the hour."""
    k = F.floor(F.col("start_us") / H) % 5
    d = raw_bars(spark, folder)
    d = d.withColumn("bid_low", F.when(k == 0, F.col("bid_high") + 0.001).otherwise(F.col("bid_low"))).withColumn("ask_low", F.when(k == 1, F.col("bid_low") - 0.001).otherwise(F.col("ask_low"))).withColumn("available_us", F.when(k == 2, F.col("end_us") - 1).otherwise(F.col("available_us")))
    return B.bar_violations(d)


@query(f"WITH RECURSIVE {BARS}{TR.format('b')} SELECT instrument, start_us, round(tr,6) tr FROM q")
def true_range(spark, folder):
    return base(spark, folder).select("instrument", "start_us", F.round(I.true_range(), 6).alias("tr"))


@query(f"WITH {BARS}{TR.format('b')} SELECT instrument, start_us, round(avg(tr) OVER (PARTITION BY instrument ORDER BY start_us ROWS 13 PRECEDING),6) atr, max(available_us) OVER (PARTITION BY instrument ORDER BY start_us ROWS 14 PRECEDING) available_us FROM q QUALIFY rn>=14")
def atr_sma(spark, folder):
    return rounded(I.with_atr(base(spark, folder), method="mean").where("atr is not null"), "atr").select("instrument", "start_us", "atr", F.col("atr_known_us").alias("available_us"))


@query(f"WITH RECURSIVE {BARS}{TR.format('b')}, {recur('q', 'tr', '1/14.0', 14, 'atr', 'r')} SELECT q.instrument, start_us, round(y,6) atr, known available_us FROM q JOIN r USING (instrument, rn)")
def atr_wilder(spark, folder):
    return rounded(I.with_atr(base(spark, folder)).where("atr is not null"), "atr").select("instrument", "start_us", "atr", F.col("atr_known_us").alias("available_us"))


@query(f"WITH RECURSIVE {BARS}{TR.format('b')}, {recur('q', 'close', '2/9.0', 8, 'ema', 'r')} SELECT q.instrument, start_us, round(y,6) ema FROM q JOIN r USING (instrument, rn)")
def ema_sma_seed(spark, folder):
    return rounded(I.ema(base(spark, folder), 8).where("ema is not null"), "ema").select("instrument", "start_us", "ema")


@query(f"WITH RECURSIVE {BARS}{TR.format('b')}, {recur('q', 'close', '2/9.0', 8, 'ema', 'r', True)} SELECT q.instrument, start_us, round(y,6) ema FROM q JOIN r USING (instrument, rn)")
def ema_first_seed(spark, folder):
    return rounded(I.ema(base(spark, folder), 8, seed="first"), "ema").select("instrument", "start_us", "ema")


SEGMENT_WINDOW = "(PARTITION BY instrument, segment ORDER BY start_us ROWS 2 PRECEDING)"


@query(f"""WITH {BARS}{SEGMENTS} SELECT instrument, start_us, segment, CASE WHEN n=3 THEN round(a,6) END sma, CASE WHEN n=3 THEN round(h,6) END rolling_high, CASE WHEN n=3 THEN round(l,6) END rolling_low FROM (SELECT *, count(*) OVER v n, avg("close") OVER v a, max(high) OVER v h, min(low) OVER v l FROM sg WINDOW v AS {SEGMENT_WINDOW})""")
def rolling_in_segments(spark, folder):
    return rounded(I.rolling(base(spark, folder), 3), "sma", "rolling_high", "rolling_low").select("instrument", "start_us", "segment", "sma", "rolling_high", "rolling_low")


@query(
    f"""WITH RECURSIVE {BARS}{SEGMENTS}, c AS (SELECT instrument||'/'||segment instrument, instrument i, start_us, "close"-lag("close") OVER w ch, row_number() OVER w - 1 rn FROM sg WINDOW w AS (PARTITION BY instrument, segment ORDER BY start_us)),
g AS (SELECT *, greatest(ch,0) up, greatest(-ch,0) down FROM c WHERE rn>0), {recur("g", "up", "1/3.0", 3, "", "u")}, {recur("g", "down", "1/3.0", 3, "", "d")}
SELECT i instrument, start_us, round(CASE WHEN u.y=0 AND d.y=0 THEN 50 WHEN d.y=0 THEN 100 ELSE 100-100/(1+u.y/d.y) END,6) rsi FROM g JOIN u USING (instrument, rn) JOIN d USING (instrument, rn)"""
)
def rsi_wilder(spark, folder):
    return rounded(I.rsi(base(spark, folder), 3).where("rsi is not null"), "rsi").select("instrument", "start_us", "rsi")


def pivot_sql(source: str, left: int, right: int) -> str:
    a, b = (f"(PARTITION BY instrument ORDER BY start_us ROWS BETWEEN {x} AND {y})" for x, y in ((f"{left} PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", f"{right} FOLLOWING")))
    return f""", pw AS (SELECT *, count(*) OVER {a} na, count(*) OVER {b} nb, max(high) OVER {a} ha, max(high) OVER {b} hb, min(low) OVER {a} la, min(low) OVER {b} lb, lead(end_us,{right}) OVER {W} confirmed_us, max(available_us) OVER (PARTITION BY instrument ORDER BY start_us ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING) known FROM {source}),
pv AS (SELECT instrument, start_us, confirmed_us, known available_us, 'high' kind, high price FROM pw WHERE na={left} AND nb={right} AND high>ha AND high>hb UNION ALL SELECT instrument, start_us, confirmed_us, known, 'low', low FROM pw WHERE na={left} AND nb={right} AND low<la AND low<lb)"""


@query(f"WITH {BARS}{PARENTS}{pivot_sql('p', 3, 3)} SELECT instrument, start_us, confirmed_us, available_us, kind, round(price,6) price FROM pv")
def pivots_confirmed(spark, folder):
    return rounded(I.pivots(parents(spark, folder)), "price")


@query(f"WITH {BARS}{pivot_sql('b', 2, 4)} SELECT instrument, start_us, confirmed_us, available_us, kind, round(price,6) price FROM pv")
def swings_lr(spark, folder):
    return rounded(I.pivots(base(spark, folder), 2, 4), "price")


REGIMES = """, rs AS (SELECT instrument, start_us, max(CASE kind WHEN 'high' THEN price END) h, max(CASE kind WHEN 'low' THEN price END) l, max(CASE kind WHEN 'high' THEN available_us END) hk, max(CASE kind WHEN 'low' THEN available_us END) lk, max(available_us) sk FROM pv GROUP BY 1,2),
r1 AS (SELECT x.instrument, x.start_us, x.sk, (SELECT list({'p': y.h, 'k': y.hk} ORDER BY y.start_us DESC) FROM rs y WHERE y.instrument=x.instrument AND y.start_us<=x.start_us AND y.h IS NOT NULL) hs, (SELECT list({'p': y.l, 'k': y.lk} ORDER BY y.start_us DESC) FROM rs y WHERE y.instrument=x.instrument AND y.start_us<=x.start_us AND y.l IS NOT NULL) ls FROM rs x),
r2 AS (SELECT *, CASE WHEN hs[1].p>hs[2].p THEN 'rising' WHEN hs[1].p<hs[2].p THEN 'falling' WHEN hs[1].p=hs[2].p THEN 'equal' END highs, CASE WHEN ls[1].p>ls[2].p THEN 'rising' WHEN ls[1].p<ls[2].p THEN 'falling' WHEN ls[1].p=ls[2].p THEN 'equal' END lows FROM r1),
rg AS (SELECT instrument, start_us, highs, lows, CASE WHEN highs IS NULL OR lows IS NULL THEN 'unknown' WHEN highs='rising' AND lows='rising' THEN 'bullish' WHEN highs='falling' AND lows='falling' THEN 'bearish' ELSE 'range' END regime, greatest(sk, hs[1].k, hs[2].k, ls[1].k, ls[2].k) available_us FROM r2)"""


@query(f"WITH {BARS}{pivot_sql('b', 3, 3)}{REGIMES} SELECT instrument, start_us, highs, lows, regime, available_us FROM rg")
def regimes(spark, folder):
    return I.regimes(I.pivots(base(spark, folder)))


def seen_regimes(b, inclusive=True):
    found = stored(I.regimes(I.pivots(b)).withColumnRenamed("start_us", "structure_us"), "regimes")
    left = b.select("instrument", "start_us", F.col("available_us").alias("seen_us"))
    return J.as_of_latest(left, found, ["instrument"], "seen_us", "available_us", ["structure_us", "available_us"], ["structure_us", "regime"], inclusive)


ASOF = ", sr AS (SELECT b.instrument, b.start_us, max(rg.start_us) structure_us, arg_max(rg.regime, (rg.start_us, rg.available_us)) regime FROM b LEFT JOIN rg ON rg.instrument=b.instrument AND rg.available_us<=b.available_us GROUP BY 1,2)"


@query(f"WITH {BARS}{pivot_sql('b', 3, 3)}{REGIMES}{ASOF} SELECT * FROM sr")
def regime_asof(spark, folder):
    return seen_regimes(stored_bars(spark, folder)[0]).select("instrument", "start_us", "structure_us", "regime")


CANDLES = f""", cd AS (SELECT *, lag(open) OVER {W} po, lag("close") OVER {W} pc, abs("close"-open) body FROM b),
ce AS (SELECT *, CASE WHEN least(open,"close")<=least(po,pc) AND greatest(open,"close")>=greatest(po,pc) THEN CASE WHEN "close">open AND pc<po THEN 1 WHEN "close"<open AND pc>po THEN -1 ELSE 0 END ELSE 0 END engulf, list_sort(list(body) OVER (PARTITION BY instrument ORDER BY start_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) bodies FROM cd),
cf AS (SELECT *, CASE WHEN len(bodies)=20 AND body>=1.2*((bodies[10]+bodies[11])/2) THEN CASE WHEN "close">open THEN 1 WHEN "close"<open THEN -1 ELSE 0 END ELSE 0 END displace FROM ce)"""


@query(f"WITH {BARS}{CANDLES} SELECT instrument, start_us, engulf FROM cf WHERE engulf<>0")
def engulfing(spark, folder):
    return base(spark, folder).select("instrument", "start_us", I.engulfing().alias("engulf")).where("engulf <> 0")


@query(f"WITH {BARS}{CANDLES} SELECT instrument, start_us, displace FROM cf WHERE displace<>0")
def displacement(spark, folder):
    return base(spark, folder).withColumn("body", F.abs(F.col("close") - F.col("open"))).select("instrument", "start_us", I.displacement().alias("displace")).where("displace <> 0")


CROSS = f"""{CANDLES}, q AS (SELECT *, row_number() OVER {W} rn, max(available_us) OVER (PARTITION BY instrument ORDER BY start_us ROWS UNBOUNDED PRECEDING) known FROM cf), {recur("q", "close", "2/9.0", 8, "ema", "r")},
cr AS (SELECT *, CASE WHEN pcl<=py AND "close">y THEN 1 WHEN pcl>=py AND "close"<y THEN -1 ELSE 0 END crossing FROM (SELECT q.*, y, lag("close") OVER w pcl, lag(y) OVER w py FROM q LEFT JOIN r USING (instrument, rn) WINDOW w AS (PARTITION BY q.instrument ORDER BY start_us))),
cn AS (SELECT instrument, start_us, end_us, crossing direction, concat_ws('+', CASE WHEN engulf=crossing THEN 'engulfing' END, CASE WHEN displace=crossing THEN 'displacement' END) patterns, known available_us FROM cr WHERE crossing<>0 AND (engulf=crossing OR displace=crossing))"""


@query(f"WITH RECURSIVE {BARS}{CROSS} SELECT instrument, start_us, crossing FROM cr WHERE crossing<>0")
def crossovers(spark, folder):
    return I.ema(base(spark, folder), 8).select("instrument", "start_us", I.crossover().alias("crossing")).where("crossing <> 0")


@query(f"WITH RECURSIVE {BARS}{CROSS} SELECT * FROM cn")
def confirmations(spark, folder):
    return I.confirmations(base(spark, folder))


IMPULSES = f"""{PARENTS}{TR.format("p")}, {recur("q", "tr", "1/5.0", 5, "atr", "r")},
iw AS (SELECT q.*, y, lag(y) OVER {W} atr, lag(known) OVER {W} atr_known, count(*) OVER f n, lead(end_us,3) OVER {W} w_end, max(available_us) OVER f w_known, max(abs("close"-open)) OVER f largest_body, sum(("close">open)::INT) OVER f n_up, sum(("close"<open)::INT) OVER f n_down, lead("close",3) OVER {W}-open net FROM q LEFT JOIN r USING (instrument, rn) WINDOW f AS (PARTITION BY q.instrument ORDER BY start_us ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
im AS (SELECT instrument, start_us, w_end end_us, d direction, CASE WHEN d=1 THEN n_up ELSE n_down END::BIGINT n_directional, net*d movement, largest_body, atr, greatest(w_known, atr_known) available_us FROM iw, (VALUES (1),(-1)) v(d) WHERE n=4 AND atr IS NOT NULL AND CASE WHEN d=1 THEN n_up ELSE n_down END>=2 AND net*d>=0.5*atr AND largest_body>=0.5*atr)"""
# With random walks of no trend few windows are as strong as the defaults ask for, so the queries use gentler numbers.
GENTLE = {"period": 5, "least": 2, "move_atr": 0.5, "body_atr": 0.5}


@query(f"WITH RECURSIVE {BARS}{IMPULSES} SELECT instrument, start_us, end_us, direction, n_directional, round(movement,6) movement, round(largest_body,6) largest_body, round(atr,6) atr, available_us FROM im")
def impulses(spark, folder):
    return rounded(Z.impulses(parents(spark, folder), **GENTLE), "movement", "largest_body", "atr")


ZONES = f"""{IMPULSES}, pn AS (SELECT *, row_number() OVER {W} rn FROM p),
zo AS (SELECT im.*, wn.rn w_no, max(o.rn) o_no FROM im JOIN pn wn USING (instrument, start_us) JOIN pn o ON o.instrument=im.instrument AND o.rn BETWEEN wn.rn-20 AND wn.rn-1 AND CASE WHEN direction=1 THEN o."close"<o.open ELSE o."close">o.open END GROUP BY ALL),
zn AS (SELECT zo.instrument, zo.start_us impulse_us, direction, o.start_us origin_us, zo.end_us formed_us, CASE WHEN direction=1 THEN o.low ELSE o.open END lower, CASE WHEN direction=1 THEN o.open ELSE o.high END upper, greatest(zo.available_us, (SELECT max(x.available_us) FROM pn x WHERE x.instrument=zo.instrument AND x.rn BETWEEN o_no AND w_no-1)) available_us FROM zo JOIN pn o ON o.instrument=zo.instrument AND o.rn=o_no)"""


@query(f'WITH RECURSIVE {BARS}{ZONES} SELECT instrument, impulse_us, direction, origin_us, formed_us, round(lower,6) "lower", round(upper,6) "upper", available_us FROM zn')
def zones(spark, folder):
    return rounded(Z.zones(parents(spark, folder), **GENTLE), "lower", "upper")


INVALID = f"""{ZONES}, iv AS (SELECT zn.instrument, impulse_us, direction, arg_min(p."close", (p.available_us, p.end_us, p.start_us)) ended_close, min((p.available_us, p.end_us, 0, p.start_us)) ended_key FROM zn JOIN p ON p.instrument=zn.instrument AND p.start_us>=zn.available_us AND CASE WHEN direction=1 THEN p."close"<lower ELSE p."close">upper END GROUP BY 1,2,3)"""


@query(f"WITH RECURSIVE {BARS}{INVALID} SELECT instrument, impulse_us, direction, ended_key[1] ended_us, round(ended_close,6) ended_close FROM iv")
def zone_invalidations(spark, folder):
    p = stored_bars(spark, folder)[1]
    return rounded(Z.invalidations(Z.zones(p, **GENTLE), p), "ended_close").select("instrument", "impulse_us", "direction", F.col("ended_key.available_us").alias("ended_us"), "ended_close")


EPISODES = f"""{INVALID}, bn AS (SELECT *, row_number() OVER {W} rn, (available_us, end_us, 1, start_us) k FROM b),
bl AS (SELECT x.*, y.k nk FROM bn x LEFT JOIN bn y ON y.instrument=x.instrument AND y.rn=x.rn+1),
tc AS (SELECT zn.*, iv.ended_key, bl.rn, bl.start_us b_us, bl.end_us b_end, bl.available_us b_known, nk, (nk IS NOT NULL AND (iv.ended_key IS NULL OR nk<iv.ended_key)) lets_go, bl.rn-row_number() OVER (PARTITION BY zn.instrument, zn.impulse_us, zn.direction ORDER BY bl.rn) island FROM zn LEFT JOIN iv ON iv.instrument=zn.instrument AND iv.impulse_us=zn.impulse_us AND iv.direction=zn.direction JOIN bl ON bl.instrument=zn.instrument AND bl.start_us>=zn.available_us AND (iv.ended_key IS NULL OR bl.k<iv.ended_key) AND bl.low<=zn.upper AND bl.high>=zn.lower),
eq AS (SELECT instrument, impulse_us, direction, island, any_value(origin_us) origin_us, min(b_us) first_touch_us, min(b_end) first_touch_end_us, max(b_end) last_touch_end_us, count(*) n_bars, arg_min(b_known, rn) available_us, arg_max(lets_go, rn) lets_go, any_value(ended_key) ended_key FROM tc GROUP BY 1,2,3,4),
ep AS (SELECT instrument, impulse_us, direction, origin_us, row_number() OVER (PARTITION BY instrument, impulse_us, direction ORDER BY first_touch_us) ordinal, first_touch_us, first_touch_end_us, last_touch_end_us, n_bars, available_us, CASE WHEN lets_go THEN 'left' WHEN ended_key IS NOT NULL THEN 'invalidated' END ended, ended_key[1] invalid_from_us, ended_key FROM eq)"""


def found_episodes(b, p):
    return Z.episodes(stored(Z.zones(p, **GENTLE), "zones"), p, b)


@query(f"WITH RECURSIVE {BARS}{EPISODES} SELECT instrument, impulse_us, direction, ordinal, first_touch_us, last_touch_end_us, n_bars, available_us, ended FROM ep")
def retest_episodes(spark, folder):
    return found_episodes(*stored_bars(spark, folder)).select("instrument", "impulse_us", "direction", F.col("ordinal").cast("long").alias("ordinal"), "first_touch_us", "last_touch_end_us", "n_bars", "available_us", "ended")


@query(f'WITH RECURSIVE {BARS}{INVALID} SELECT zn.instrument, zn.impulse_us, zn.direction, round(lower,6) "lower", round(upper,6) "upper", coalesce(ended_key[1]>{AS_OF}, true) valid FROM zn LEFT JOIN iv ON iv.instrument=zn.instrument AND iv.impulse_us=zn.impulse_us AND iv.direction=zn.direction WHERE available_us<={AS_OF}')
def zone_state_asof(spark, folder):
    p = stored_bars(spark, folder)[1]
    return rounded(Z.zone_state(Z.zones(p, **GENTLE), p, AS_OF), "lower", "upper")


RETESTS = f"""{EPISODES}{CROSS.replace(", q AS", ", q2 AS").replace("FROM q LEFT JOIN r USING", "FROM q2 q LEFT JOIN er r USING").replace("r AS (SELECT instrument, 8", "er AS (SELECT instrument, 8").replace("avg(close) y FROM q", "avg(close) y FROM q2").replace("FROM r r JOIN q s", "FROM er r JOIN q2 s")},
rt AS (SELECT cn.instrument, cn.direction, cn.start_us confirmation_us, ep.impulse_us, ep.origin_us, ((cn.end_us-ep.first_touch_end_us)//{H})::INT bars_since_touch FROM cn JOIN ep ON ep.instrument=cn.instrument AND ep.direction=cn.direction AND ep.ordinal=1 AND ep.first_touch_end_us BETWEEN cn.end_us-2*{H} AND cn.end_us AND ep.available_us<=cn.end_us AND (invalid_from_us IS NULL OR invalid_from_us>cn.end_us) QUALIFY row_number() OVER (PARTITION BY cn.instrument, cn.direction, cn.start_us ORDER BY cn.end_us-ep.first_touch_end_us, ep.origin_us DESC, ep.impulse_us)=1)"""


@query(f"WITH RECURSIVE {BARS}{RETESTS} SELECT * FROM rt")
def retest_selection(spark, folder):
    b, p = stored_bars(spark, folder)
    return Z.retest_selection(I.confirmations(b), found_episodes(b, p))


DECISIONS = f"""{RETESTS}{pivot_sql("b", 3, 3)}{REGIMES}{ASOF},
dc AS (SELECT b.instrument, b.start_us, cn.direction, sr.regime, rt.impulse_us FROM b LEFT JOIN cn ON cn.instrument=b.instrument AND cn.start_us=b.start_us AND cn.available_us<=b.end_us LEFT JOIN sr ON sr.instrument=b.instrument AND sr.start_us=b.start_us LEFT JOIN rt ON rt.instrument=b.instrument AND rt.confirmation_us=b.start_us AND rt.direction=cn.direction),
dd AS (SELECT instrument, start_us, CASE WHEN direction IS NULL THEN 'no_confirmation' WHEN regime IS NULL THEN 'no_regime' WHEN regime<>CASE direction WHEN 1 THEN 'bullish' ELSE 'bearish' END THEN 'regime_not_aligned' WHEN impulse_us IS NULL THEN 'no_retest' ELSE 'evidence_complete' END reason, direction FROM dc),
de AS (SELECT instrument, start_us, CASE WHEN reason<>'evidence_complete' THEN 'none' WHEN direction=1 THEN 'up' ELSE 'down' END "action", reason FROM dd)"""


def all_decisions(spark, folder):
    b, p = stored_bars(spark, folder)
    c = stored(I.confirmations(b), "confirmations")
    return Z.decisions(b, c, seen_regimes(b), Z.retest_selection(c, found_episodes(b, p)))


@query(f"WITH RECURSIVE {BARS}{DECISIONS} SELECT * FROM de")
def candidate_decisions(spark, folder):
    return all_decisions(spark, folder)


VARIANTS = {
    "default": {},
    "one_prior": {"prior_touches": 1, "expiry": 6},
    "touch_bar_excluded": {"minimum": 1, "expiry": 6},
    "base_first": {"parents_first": False, "expiry": 6, "all_zones": True},
}


def candidates_sql(expiry: int = 2, minimum: int = 0, prior_touches: int = 0, all_zones: bool = False, parents_first: bool = True) -> str:
    """Reasons and selected zones of each bar, by looking at every touch and zone for each confirmation."""
    episodes, asof = EPISODES, ASOF
    if not parents_first:
        episodes = episodes.replace("p.end_us, 0, p.start_us", "p.end_us, 1, p.start_us").replace("end_us, 1, start_us) k", "end_us, 0, start_us) k")
        asof = asof.replace("rg.available_us<=b.available_us", "rg.available_us<b.available_us")
    text = RETESTS.replace(EPISODES, episodes) + pivot_sql("b", 3, 3) + REGIMES + asof
    same = "s.instrument=a.instrument AND s.direction=a.direction"
    return f"""{text},
ca AS (SELECT bl.instrument, bl.start_us, bl.end_us, bl.available_us, bl.k, bl.low, bl.high, cn.direction, sr.regime FROM bl
  LEFT JOIN cn ON cn.instrument=bl.instrument AND cn.start_us=bl.start_us AND cn.available_us<=bl.end_us LEFT JOIN sr ON sr.instrument=bl.instrument AND sr.start_us=bl.start_us),
cs AS (SELECT *, first_touch_end_us touch_end FROM ep WHERE ordinal<={1 + prior_touches}),
ct AS (SELECT a.*, t.* EXCLUDE (instrument, start_us), EXISTS (SELECT 1 FROM zn s JOIN iv USING (instrument, impulse_us, direction) WHERE {same} AND iv.ended_key<=a.k AND a.low<=s.upper AND a.high>=s.lower) over_gone
  FROM ca a LEFT JOIN (SELECT a.instrument, a.start_us, count(*) FILTER (back BETWEEN {minimum} AND {expiry}) n_timed, count(*) FILTER (back<{minimum}) n_soon, count(*) FILTER (back>{expiry}) n_old,
    min(back) FILTER (lasts) newest, list({{'b': back, 'o': -origin_us, 'i': impulse_us}} ORDER BY back, -origin_us, impulse_us) FILTER (lasts) zs
    FROM (SELECT a.instrument, a.start_us, s.origin_us, s.impulse_us, (a.end_us-s.touch_end)//{H} back, (a.end_us-s.touch_end)//{H} BETWEEN {minimum} AND {expiry} AND (s.ended_key IS NULL OR s.ended_key>a.k) lasts
      FROM ca a JOIN cs s ON {same} AND s.touch_end<=a.end_us AND s.available_us<=a.end_us) a GROUP BY 1,2) t USING (instrument, start_us)),
cu AS (SELECT *, CASE WHEN available_us>end_us THEN '{Z.LATE}' WHEN direction IS NULL THEN '{Z.NO_CONFIRMATION}' END alone,
  CASE WHEN regime IS NULL THEN '{Z.NO_REGIME}' WHEN regime='unknown' THEN '{Z.UNKNOWN_REGIME}' WHEN regime='range' THEN '{Z.RANGE_REGIME}' WHEN regime<>CASE direction WHEN 1 THEN 'bullish' ELSE 'bearish' END THEN '{Z.OTHER_REGIME}' END rr,
  CASE WHEN newest IS NOT NULL THEN NULL WHEN coalesce(n_timed,0)>0 OR over_gone THEN '{Z.INVALID}' ELSE concat_ws('+', CASE WHEN n_soon>0 THEN '{Z.TOUCH_BAR}' END, CASE WHEN n_old>0 THEN '{Z.EXPIRED}' END,
    CASE WHEN coalesce(n_soon,0)=0 AND coalesce(n_old,0)=0 THEN '{Z.NO_RETEST}' END) END rt FROM ct),
cv AS (SELECT *, coalesce(alone, nullif(concat_ws('+', rr, rt), ''), CASE direction WHEN 1 THEN 'buy_criteria_met' ELSE 'sell_criteria_met' END) reasons FROM cu)
SELECT instrument, start_us, CASE reasons WHEN 'buy_criteria_met' THEN 'buy' WHEN 'sell_criteria_met' THEN 'sell' ELSE 'no_trade' END "action", reasons,
  CASE WHEN reasons IN ('buy_criteria_met', 'sell_criteria_met') THEN {"len(list_filter(zs, lambda x: x.b=newest))" if all_zones else "1"}::BIGINT END n_zones,
  CASE WHEN reasons IN ('buy_criteria_met', 'sell_criteria_met') THEN zs[1].i END impulse_us FROM cv"""


def _variant(name: str):
    how = VARIANTS[name]

    @query(f"WITH RECURSIVE {BARS}{candidates_sql(**how)}")
    def run(spark, folder):
        b, p = stored_bars(spark, folder)
        first = how.get("parents_first", True)
        z = stored(Z.zones(p, **GENTLE), "zones")
        touches = stored(Z.episodes(z, p, b, first), "touches")
        c = stored(I.confirmations(b), "confirmations")
        d = Z.candidates(b, c, seen_regimes(b, first), touches, z, Z.invalidations(z, p, first), **how)
        d = d.withColumn("n_zones", F.when(F.col("selected").isNotNull(), F.size("selected").cast("long"))).withColumn("impulse_us", F.get("selected", F.lit(0)))
        return d.select("instrument", "start_us", "action", F.array_join("reasons", "+").alias("reasons"), "n_zones", "impulse_us")

    QUERIES[f"candidates_{name}"], SQL[f"candidates_{name}"] = QUERIES.pop("run"), SQL.pop("run")


for _name in VARIANTS:
    _variant(_name)

CONFIRMING = {
    "strict": ({"strict": True}, (('least(open,"close")<=least(po,pc) AND greatest(open,"close")>=greatest(po,pc)', 'least(open,"close")<least(po,pc) AND greatest(open,"close")>greatest(po,pc)'),)),
    "lower_median": ({"median": "lower"}, (("((bodies[10]+bodies[11])/2)", "bodies[10]"),)),
    "upper_median": ({"median": "upper"}, (("((bodies[10]+bodies[11])/2)", "bodies[11]"),)),
    "inclusive": ({"inclusive": True}, (("BETWEEN 20 PRECEDING AND 1 PRECEDING", "BETWEEN 19 PRECEDING AND CURRENT ROW"),)),
    "prior_line": ({"reference": "prior"}, (('"close">y THEN', '"close">py THEN'), ('"close"<y THEN', '"close"<py THEN'))),
    "both": ({"combination": "and"}, (("(engulf=crossing OR displace=crossing)", "(engulf=crossing AND displace=crossing)"),)),
}


def _confirming_sql() -> str:
    parts = []
    for name, (_, changes) in CONFIRMING.items():
        text = CROSS
        for old, new in changes:
            assert old in text, name
            text = text.replace(old, new)
        parts.append(f"SELECT '{name}' variant, * FROM (WITH RECURSIVE {BARS}{text} SELECT * FROM cn)")
    return " UNION ALL ".join(parts)


@query(_confirming_sql())
def confirmation_variants(spark, folder):
    """Confirmations under every policy that is not the default."""
    b = stored_bars(spark, folder)[0]
    parts = [I.confirmations(b, **how).withColumn("variant", F.lit(name)) for name, (how, _) in CONFIRMING.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f'WITH RECURSIVE {BARS}{DECISIONS} SELECT "action", reason, count(*) n FROM de GROUP BY GROUPING SETS (("action"), (reason), ())')
def decision_counts_grouping_sets(spark, folder):
    return all_decisions(spark, folder).groupingSets([["action"], ["reason"], []], "action", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {BARS} SELECT instrument, start_us, CASE WHEN n>=6 THEN round(f,6) END fast, CASE WHEN n>=24 THEN round(s,6) END slow, CASE WHEN n<24 THEN 0 WHEN f>s THEN 1 WHEN f<s THEN -1 ELSE 0 END target FROM (SELECT instrument, start_us, row_number() OVER {W} n, avg(\"close\") OVER (PARTITION BY instrument ORDER BY start_us ROWS 5 PRECEDING) f, avg(\"close\") OVER (PARTITION BY instrument ORDER BY start_us ROWS 23 PRECEDING) s FROM b)")
def sma_cross_target(spark, folder):
    return rounded(I.sma_cross_target(base(spark, folder), 6, 24).select("instrument", "start_us", "fast", "slow", "target"), "fast", "slow")


@query(f"WITH {BARS} SELECT instrument, start_us, round((greatest(0,max(\"close\") OVER u)-\"close\")/greatest(0,max(\"close\") OVER u),9) drawdown FROM b WINDOW u AS (PARTITION BY instrument ORDER BY start_us ROWS UNBOUNDED PRECEDING)")
def drawdown_curve(spark, folder):
    return rounded(I.drawdowns(base(spark, folder), "close", "low"), "drawdown", places=9).select("instrument", "start_us", "drawdown")


@query(f"WITH {BARS} SELECT instrument, start_us, CASE WHEN min(s) OVER f=0 THEN false WHEN count(s) OVER f=3 THEN true END confirmed FROM (SELECT instrument, start_us, CASE WHEN tick_count>1 THEN (\"close\">open)::INT END s FROM b) WINDOW f AS (PARTITION BY instrument ORDER BY start_us ROWS 2 PRECEDING)")
def multi_bar_confirmation(spark, folder):
    d = base(spark, folder).withColumn("state", F.when(F.col("tick_count") > 1, F.col("close") > F.col("open")))
    return d.select("instrument", "start_us", I.all_of_last("state", 3).alias("confirmed"))


@query(f"WITH {BARS} SELECT instrument, start_us FROM b WHERE available_us<={AS_OF}")
def as_of_filter(spark, folder):
    return B.visible(raw_bars(spark, folder), AS_OF).select("instrument", "start_us")


@query(
    f"""WITH {BARS}, l AS (SELECT instrument, start_us, available_us+CASE WHEN start_us//{H}%3=0 THEN {5 * H} ELSE 0 END k FROM b)
SELECT instrument, max(start_us) FILTER (k<={AS_OF}) last_visible_us, min(start_us) FILTER (k>{AS_OF}) first_hidden_us FROM l GROUP BY 1
HAVING max(start_us) FILTER (k<={AS_OF})>min(start_us) FILTER (k>{AS_OF})"""
)
def broken_prefix(spark, folder):
    """Checks bars of which every third is late by five hours on purpose."""
    late = F.when(F.floor(F.col("start_us") / H) % 3 == 0, 5 * H).otherwise(0)
    return B.broken_prefix(raw_bars(spark, folder).withColumn("available_us", F.col("available_us") + late), AS_OF)


@query(f"WITH {BARS}{PARENTS} SELECT instrument, timeframe, start_us, end_us, available_us, row_number() OVER (PARTITION BY instrument ORDER BY available_us, end_us, timeframe, start_us) seen_no FROM (SELECT instrument, 0 timeframe, start_us, end_us, available_us FROM p UNION ALL SELECT instrument, 1, start_us, end_us, available_us FROM b)")
def union_observations(spark, folder):
    from pyspark.sql import Window

    cols = ["instrument", "timeframe", "start_us", "end_us", "available_us"]
    rows = raw_bars(spark, folder)
    both = B.bars_to_parents(rows).withColumn("timeframe", F.lit(0)).select(*cols).unionByName(rows.withColumn("timeframe", F.lit(1)).select(*cols))
    return both.withColumn("seen_no", F.row_number().over(Window.partitionBy("instrument").orderBy("available_us", "end_us", "timeframe", "start_us")).cast("long"))


@query(f"WITH {BARS} SELECT instrument, available_us, count(*) n_bars, min(start_us) first_us, max(start_us) last_us FROM b GROUP BY 1,2")
def availability_groups(spark, folder):
    return raw_bars(spark, folder).groupBy("instrument", "available_us").agg(F.count("*").alias("n_bars"), F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"))


@query(f"""WITH {BARS} SELECT t.instrument, b.start_us, count(*) n_quotes, (arg_min(t.bid,(ts_us,source_row))=any_value(bid_open) AND max(t.bid)=any_value(bid_high) AND min(t.bid)=any_value(bid_low) AND arg_max(t.bid,(ts_us,source_row))=any_value(bid_close)) coherent FROM t JOIN b ON b.instrument=t.instrument AND t.ts_us>=b.start_us AND t.ts_us<b.end_us GROUP BY 1,2""")
def quote_bar_reconcile(spark, folder):
    from pyspark.sql import functions as F

    t, b = ticks(spark, folder), raw_bars(spark, folder).select("instrument", "start_us", "end_us", *[f"bid_{p}" for p in B.PRICES])
    d = J.interval_join(t, b, ["instrument"], "ts_us", "start_us", "end_us", H)
    at = F.struct("ts_us", "source_row")
    same = (F.min_by("bid", at) == F.first("bid_open")) & (F.max("bid") == F.first("bid_high")) & (F.min("bid") == F.first("bid_low")) & (F.max_by("bid", at) == F.first("bid_close"))
    return d.groupBy("instrument", "start_us").agg(F.count("*").alias("n_quotes"), same.alias("coherent"))


@query(f"WITH {BARS}, g AS (SELECT instrument, prev a, start_us z FROM (SELECT *, lag(end_us) OVER {W} prev FROM b) WHERE prev<start_us), s AS (SELECT instrument, a, CASE WHEN a//{H}%3=0 THEN z+1 ELSE z END z FROM g) SELECT coalesce(g.instrument,s.instrument) instrument, coalesce(g.a,s.a) gap_start_us, coalesce(g.z,s.z) gap_end_us, CASE WHEN s.a IS NULL THEN 'left' ELSE 'right' END side FROM g FULL JOIN s ON g.instrument=s.instrument AND g.a=s.a AND g.z=s.z WHERE g.a IS NULL OR s.a IS NULL")
def manifest_gap_diff(spark, folder):
    """Observed gaps against stated ones of which a third is wrong on purpose."""
    observed = B.gaps(raw_bars(spark, folder))
    stated = observed.withColumn("gap_end_us", F.when(F.floor(F.col("gap_start_us") / H) % 3 == 0, F.col("gap_end_us") + 1).otherwise(F.col("gap_end_us")))
    return J.set_difference_both(observed, stated)


@query("SELECT o_orderkey AS run_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_quantity>45)")
def ledger_antijoin(spark, folder):
    known = table(spark, folder, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").join(known, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("run_id"))


@query(f"WITH {BARS}{pivot_sql('b', 3, 3)} SELECT instrument, start_us, kind, round(price,6) price, row_number() OVER (PARTITION BY instrument, kind ORDER BY price DESC, start_us DESC) rank FROM pv QUALIFY row_number() OVER (PARTITION BY instrument, kind ORDER BY price DESC, start_us DESC)<=3")
def topk_targets(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("instrument", "kind").orderBy(F.desc("price"), F.desc("start_us"))
    d = I.pivots(base(spark, folder)).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")
    return rounded(d, "price").select("instrument", "start_us", "kind", "price", "rank")


@query("SELECT event_id, isoyear(ts)::VARCHAR||'-W'||lpad(week(ts)::VARCHAR,2,'0') iso_week, isodow(ts)::INT weekday, (isodow(ts)<=5 AND strftime(ts,'%H:%M')>='08:00' AND strftime(ts,'%H:%M')<'17:30' AND NOT (isodow(ts)=5 AND strftime(ts,'%H:%M')>='16:00')) scheduled FROM events")
def schedule_filter(spark, folder):
    ts = F.col("ts")
    clock = F.date_format(ts, "HH:mm")
    day = F.weekday(ts) + 1
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))
    ok = (day <= 5) & (clock >= "08:00") & (clock < "17:30") & ~((day == 5) & (clock >= "16:00"))
    return table(spark, folder, "events").select("event_id", week.alias("iso_week"), day.cast("int").alias("weekday"), ok.alias("scheduled"))


MONTH = 30 * 24 * H


@query(
    f"""WITH {BARS}, c AS (SELECT instrument, start_us//{MONTH} part, sha256(string_agg(start_us::VARCHAR||':'||tick_count::VARCHAR, chr(10) ORDER BY start_us)) h FROM b GROUP BY 1,2)
SELECT instrument, sha256(string_agg(h, chr(10) ORDER BY part)) fingerprint FROM c GROUP BY 1"""
)
def ordered_fingerprint(spark, folder):
    """Hash of an instrument's bars in order: of the hashes of its stretches of 30 days, so that no task holds more than one."""
    row = F.struct("start_us", F.concat(F.col("start_us").cast("string"), F.lit(":"), F.col("tick_count").cast("string")).alias("line"))
    joined = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), "\n"), 256)
    parts = raw_bars(spark, folder).groupBy("instrument", F.floor(F.col("start_us") / MONTH).alias("part")).agg(joined(row).alias("line"))
    return parts.groupBy("instrument").agg(joined(F.struct("part", "line")).alias("fingerprint"))


DISTINCT_TICKS = "x AS (SELECT DISTINCT ON (tick_id) * FROM bid_ask_ticks)"
Q = 900_000_000
SUMMARIES = f"{DISTINCT_TICKS}, gp AS (SELECT export_id, epoch_us(ts)//{Q}*{Q} bucket_start_us, epoch_us(ts) ts_us, epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY export_id, epoch_us(ts)//{Q} ORDER BY ts, source_row)) gap FROM x), sm AS (SELECT export_id, bucket_start_us, count(*) tick_count, min(ts_us) first_us, max(ts_us) last_us, coalesce(max(gap),0) max_gap_us FROM gp GROUP BY 1,2)"


@query(f"WITH {SUMMARIES} SELECT *, first_us-bucket_start_us start_silence_us, bucket_start_us+{Q}-last_us end_silence_us FROM sm")
def tick_bucket_diagnostics(spark, folder):
    return S.tick_diagnostics(table(spark, folder, "bid_ask_ticks"))


MERGED = "ci AS (SELECT DISTINCT calendar_id, epoch_us(closure_start) a, epoch_us(closure_end) z FROM session_closures WHERE closure_start<closure_end), cj AS (SELECT *, CASE WHEN a>max(z) OVER (PARTITION BY calendar_id ORDER BY a,z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END nw FROM ci), ck AS (SELECT *, sum(nw) OVER (PARTITION BY calendar_id ORDER BY a,z ROWS UNBOUNDED PRECEDING) isl FROM cj), mc AS (SELECT calendar_id, min(a) a, max(z) z FROM ck GROUP BY calendar_id, isl)"
GRID = f"{SUMMARIES}, {MERGED}, gr AS (SELECT export_id, calendar_id, unnest(generate_series(epoch_us(coverage_start), epoch_us(coverage_end)-{Q}, {Q})) bucket_start_us FROM tick_exports), gc AS (SELECT gr.export_id, gr.bucket_start_us, coalesce(sum(least(z, gr.bucket_start_us+{Q})-greatest(a, gr.bucket_start_us)) FILTER (a IS NOT NULL),0)::BIGINT closed_us FROM gr LEFT JOIN mc ON mc.calendar_id=gr.calendar_id AND a<gr.bucket_start_us+{Q} AND z>gr.bucket_start_us GROUP BY 1,2), sb AS (SELECT gc.export_id, gc.bucket_start_us, coalesce(tick_count,0) tick_count, {Q}-closed_us open_us, closed_us, CASE WHEN closed_us=0 THEN 'full_open' WHEN closed_us<{Q} THEN 'partial_open' ELSE 'closed' END state, CASE WHEN tick_count>0 THEN 'observed' WHEN closed_us={Q} THEN 'closed' ELSE 'missing_open_data' END status, first_us, last_us, max_gap_us FROM gc LEFT JOIN sm USING (export_id, bucket_start_us))"


def buckets(spark, folder):
    return S.session_buckets(*(table(spark, folder, t) for t in ("bid_ask_ticks", "tick_exports", "session_closures")))


@query(f"WITH {GRID} SELECT * FROM sb")
def session_buckets(spark, folder):
    return buckets(spark, folder)


@query(f"WITH {GRID} SELECT export_id, bucket_start_us//{4 * Q}*{4 * Q} hour_us, count(*) n_buckets, count(*) FILTER (state<>'closed') open_buckets, count(*) FILTER (state<>'closed' AND status='observed') observed_open_buckets, sum(open_us)::BIGINT open_us, sum(tick_count)::BIGINT tick_count, (count(*)=4 AND count(*) FILTER (state<>'closed')>0 AND count(*) FILTER (state<>'closed')=count(*) FILTER (state<>'closed' AND status='observed')) eligible FROM sb GROUP BY 1,2")
def session_policy_h1(spark, folder):
    return S.session_hours(buckets(spark, folder))


@query(f"WITH {GRID} SELECT state, status, count(*) n, sum(tick_count)::BIGINT tick_count FROM sb GROUP BY 1,2")
def bucket_state_summary(spark, folder):
    return buckets(spark, folder).groupBy("state", "status").agg(F.count("*").alias("n"), F.sum("tick_count").alias("tick_count"))


@query(f"WITH {MERGED}, e AS (SELECT DISTINCT ON (export_id) export_id span_id, calendar_id, epoch_us(coverage_start) a0, epoch_us(retrieved_at) z0 FROM tick_exports) SELECT e.span_id, (z0-a0-coalesce(sum(least(z,z0)-greatest(a,a0)) FILTER (a IS NOT NULL),0))::BIGINT open_us FROM e LEFT JOIN mc ON mc.calendar_id=e.calendar_id AND a<z0 AND z>a0 WHERE z0>a0 GROUP BY 1, z0, a0")
def calendar_open_time(spark, folder):
    from quotemill.operators.shards import micros

    e = table(spark, folder, "tick_exports").select(F.col("export_id").alias("span_id"), "calendar_id", micros(F.col("coverage_start")).alias("a0"), micros(F.col("retrieved_at")).alias("z0")).dropDuplicates(["span_id"]).where("z0 > a0")
    return S.open_time(e, table(spark, folder, "session_closures"), "a0", "z0").select("span_id", "open_us")


@query("SELECT o_orderpriority, o_orderstatus, count(*) n, min(o_totalprice) lowest FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_counts(spark, folder):
    return table(spark, folder, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lowest"))


MOVED = 24 * H  # no tick lies in a closure, so the check gets them moved by a day


@query(
    f"""WITH {DISTINCT_TICKS}, {MERGED}, e AS (SELECT DISTINCT export_id, calendar_id FROM tick_exports)
SELECT x.export_id, count(*) n_ticks FROM x JOIN e USING (export_id) JOIN mc ON mc.calendar_id=e.calendar_id
  AND epoch_us(ts)+{MOVED}>=a AND epoch_us(ts)+{MOVED}<z GROUP BY 1"""
)
def ticks_in_closures(spark, folder):
    from quotemill.operators.shards import micros

    e = table(spark, folder, "tick_exports").select("export_id", "calendar_id").distinct()
    t = table(spark, folder, "bid_ask_ticks").select("tick_id", "export_id", (micros(F.col("ts")) + MOVED).alias("ts_us")).distinct()
    d = J.salted_join(t, e, ["export_id"], F.col("tick_id"), "inner")
    return S.in_closures(d, table(spark, folder, "session_closures"), "ts_us").groupBy("export_id").agg(F.count("*").alias("n_ticks"))


@query(f"WITH {MERGED} SELECT export_id point_id, coalesce(max(z), epoch_us(any_value(coverage_end))) next_open_us FROM tick_exports e LEFT JOIN mc ON mc.calendar_id=e.calendar_id AND epoch_us(coverage_end)>=a AND epoch_us(coverage_end)<z GROUP BY 1")
def next_open_start(spark, folder):
    from quotemill.operators.shards import micros

    e = table(spark, folder, "tick_exports").select(F.col("export_id").alias("point_id"), "calendar_id", micros(F.col("coverage_end")).alias("at_us")).dropDuplicates(["point_id"])
    return S.next_open(e, table(spark, folder, "session_closures"), "at_us").select("point_id", "next_open_us")


LEVELS = f"""{CROSS}{pivot_sql("b", 2, 2)}, tq AS (SELECT *, row_number() OVER {W} rn, CASE WHEN lag("close") OVER {W} IS NULL THEN high-low ELSE greatest(high-low, abs(high-lag("close") OVER {W}), abs(low-lag("close") OVER {W})) END tr, max(available_us) OVER (PARTITION BY instrument ORDER BY start_us ROWS UNBOUNDED PRECEDING) known FROM b),
atr_rows AS (SELECT instrument, start_us, avg(tr) OVER (PARTITION BY instrument ORDER BY start_us ROWS 13 PRECEDING) atr, max(available_us) OVER (PARTITION BY instrument ORDER BY start_us ROWS 14 PRECEDING) known FROM tq QUALIFY rn>=14)"""


@query(
    f"""WITH RECURSIVE {BARS}{LEVELS}, sw AS (SELECT cn.instrument, cn.start_us, cn.direction, arg_max(price, pv.start_us) swing_price FROM cn LEFT JOIN pv ON pv.instrument=cn.instrument AND pv.available_us<=cn.available_us AND pv.kind=CASE direction WHEN 1 THEN 'low' ELSE 'high' END GROUP BY ALL),
ar AS (SELECT cn.instrument, cn.start_us, cn.direction, arg_max(atr, atr_rows.start_us) atr FROM cn LEFT JOIN atr_rows ON atr_rows.instrument=cn.instrument AND atr_rows.known<=cn.available_us GROUP BY ALL)
SELECT instrument, start_us, direction, round(swing_price,6) swing_price, round(atr,6) atr, round(CASE direction WHEN 1 THEN floor((swing_price-0.15*atr)::DECIMAL(28,8)*100) ELSE ceil((swing_price+0.15*atr)::DECIMAL(28,8)*100) END::DOUBLE/100,6) "level" FROM sw JOIN ar USING (instrument, start_us, direction)"""
)
def protective_levels(spark, folder):
    b = stored_bars(spark, folder)[0]
    atr = I.with_atr(b, method="mean").where("atr is not null").select("instrument", "start_us", "atr", F.col("atr_known_us").alias("available_us"))
    d = L.protective_levels(I.confirmations(b).select("instrument", "start_us", "direction", "available_us"), I.pivots(b, 2, 2), atr)
    return rounded(d, "swing_price", "atr", "level").select("instrument", "start_us", "direction", "swing_price", "atr", "level")


@query(
    f"""WITH RECURSIVE {BARS}{LEVELS}, ev AS (SELECT cn.*, b."close" price FROM cn JOIN b USING (instrument, start_us)),
tg AS (
  SELECT ev.instrument, ev.start_us, ev.direction, ev.price,
    CASE direction WHEN 1 THEN floor(pv.price::DECIMAL(28,8)*100) ELSE ceil(pv.price::DECIMAL(28,8)*100) END::DOUBLE/100 target
  FROM ev JOIN pv ON pv.instrument=ev.instrument AND pv.available_us<=ev.available_us AND pv.confirmed_us<=ev.end_us
    AND pv.kind=CASE direction WHEN 1 THEN 'high' ELSE 'low' END)
SELECT instrument, start_us, direction, count(*) n_targets,
  round(CASE direction WHEN 1 THEN min(target) ELSE max(target) END,6) nearest,
  round(CASE direction WHEN 1 THEN max(target) ELSE min(target) END,6) farthest
FROM tg WHERE (target-price)*direction>0 GROUP BY instrument, start_us, direction"""
)
def target_ladders(spark, folder):
    b = stored_bars(spark, folder)[0]
    closes = b.select("instrument", "start_us", F.col("close").alias("price"))
    e = I.confirmations(b).select("instrument", "start_us", "end_us", "direction", "available_us").join(closes, ["instrument", "start_us"])
    d = L.ladders(e, I.pivots(b, 2, 2))
    d = d.select(
        "instrument", "start_us", "direction", F.size("ladder").cast("long").alias("n_targets"),
        F.get("ladder", F.lit(0))["target"].alias("nearest"), F.element_at("ladder", -1)["target"].alias("farthest"),
    )
    return rounded(d, "nearest", "farthest")


PRE_ROLL_END = 1_704_153_600_000_000  # 2024-01-02


@query(
    f"""WITH RECURSIVE {BARS}{EPISODES}{pivot_sql("b", 2, 2)},
ed AS (
  SELECT ep.instrument, first_touch_us start_us, max(first_touch_end_us) end_us, max(ep.available_us) available_us,
    max((ep.direction, ep.impulse_us, zn.lower, zn.upper, zn.available_us, zn.formed_us)) z, count(*) n_zones
  FROM ep JOIN zn USING (instrument, impulse_us, direction) WHERE ordinal=1 GROUP BY 1,2),
dn AS (
  SELECT instrument, start_us, end_us, available_us, n_zones, CASE WHEN start_us//{H}%11=0 THEN 0 ELSE z[1] END direction,
    CASE WHEN start_us//{H}%7=0 THEN -z[1] ELSE z[1] END zone_direction, z[3] lo, z[4] hi, z[5] z_known, z[6] z_formed,
    start_us<{PRE_ROLL_END} pre_roll FROM ed),
ax AS (SELECT p.instrument, p.end_us, q.known, r.y atr FROM q JOIN r USING (instrument, rn) JOIN p ON p.instrument=q.instrument AND p.start_us=q.start_us),
dv AS (
  SELECT dn.*,
    (SELECT arg_max(price, (pv.start_us, pv.confirmed_us, pv.available_us)) FROM pv WHERE pv.instrument=dn.instrument
      AND pv.kind=CASE direction WHEN 1 THEN 'low' ELSE 'high' END AND pv.confirmed_us<=dn.end_us AND pv.available_us<=dn.available_us) swing,
    (SELECT arg_max(atr, (ax.end_us, ax.known)) FROM ax WHERE ax.instrument=dn.instrument AND ax.end_us<=dn.end_us AND ax.known<=dn.available_us) atr,
    (SELECT list(CASE direction WHEN 1 THEN floor(price::DECIMAL(28,8)*100) ELSE ceil(price::DECIMAL(28,8)*100) END::DOUBLE/100) FROM pv
      WHERE pv.instrument=dn.instrument AND pv.kind=CASE direction WHEN 1 THEN 'high' ELSE 'low' END
      AND pv.confirmed_us<=dn.end_us AND pv.available_us<=dn.available_us) targets FROM dn),
dr AS (
  SELECT *, CASE direction WHEN 1 THEN floor((least(lo,swing)-0.15*atr)::DECIMAL(28,8)*100) ELSE ceil((greatest(hi,swing)+0.15*atr)::DECIMAL(28,8)*100) END::DOUBLE/100 st,
    CASE WHEN pre_roll THEN 'pre_roll' WHEN direction=0 THEN 'candidate_no_trade' WHEN n_zones<>1 THEN 'ambiguous_selected_zone'
      WHEN zone_direction<>direction THEN 'zone_direction_mismatch' WHEN z_known>available_us OR z_formed>end_us THEN 'zone_not_visible'
      WHEN swing IS NULL THEN 'no_visible_m15_swing' WHEN atr IS NULL THEN 'no_visible_h1_atr' WHEN atr<=0 THEN 'non_positive_h1_atr'
      WHEN targets IS NULL THEN 'no_visible_target' ELSE '{L.EXIT_READY}' END reason FROM dv)
SELECT instrument, start_us, direction, reason, CASE WHEN reason='{L.EXIT_READY}' THEN round(st,6) END stop,
  CASE WHEN reason='{L.EXIT_READY}' THEN len(targets) END n_targets,
  CASE WHEN reason='{L.EXIT_READY}' THEN round(CASE direction WHEN 1 THEN list_min(targets) ELSE list_max(targets) END,6) END first_target FROM dr"""
)
def exit_plans(spark, folder):
    """Plans at the first touch of each zone; some decisions are turned aside on purpose, by the hour."""
    b, p = stored_bars(spark, folder)
    z = stored(Z.zones(p, **GENTLE), "zones")
    zone = F.struct("direction", "impulse_us", "lower", "upper", F.col("known_us").alias("known_us"), "formed_us")
    e = Z.episodes(z, p, b).where("ordinal = 1").join(z.withColumnRenamed("available_us", "known_us").drop("origin_us"), ["instrument", "impulse_us", "direction"])
    e = e.groupBy("instrument", F.col("first_touch_us").alias("start_us")).agg(
        F.max("first_touch_end_us").alias("end_us"), F.max("available_us").alias("available_us"), F.max(zone).alias("z"), F.count("*").alias("n_zones")
    )
    hour = F.floor(F.col("start_us") / H)
    d = e.select(
        "instrument", "start_us", "end_us", "available_us", "n_zones",
        F.when(hour % 11 == 0, 0).otherwise(F.col("z.direction")).alias("direction"),
        F.when(hour % 7 == 0, -F.col("z.direction")).otherwise(F.col("z.direction")).alias("zone_direction"),
        F.col("z.lower").alias("zone_lower"), F.col("z.upper").alias("zone_upper"), F.col("z.known_us").alias("zone_known_us"),
        F.col("z.formed_us").alias("zone_formed_us"), (F.col("start_us") < PRE_ROLL_END).alias("pre_roll"),
    )
    atr = I.with_atr(p, GENTLE["period"]).where("atr is not null").select("instrument", "end_us", "atr", F.col("atr_known_us").alias("available_us"))
    swings = I.pivots(b, 2, 2)
    x = L.exit_plans(d, swings, atr, swings)
    x = x.select("instrument", "start_us", "direction", "reason", "stop", F.size("targets").cast("long").alias("n"), F.get("targets", F.lit(0)).alias("first_target"))
    x = x.withColumn("n_targets", F.when(F.col("n") >= 0, F.col("n"))).drop("n")
    return rounded(x, "stop", "first_target")


# Bars of the feeds' own ticks, with their copies, nulls, impossible prices and late rows.
FEED_TICKS = """t AS (SELECT feed_id instrument, epoch_us(ts) ts_us, source_row, bid, ask, min(epoch_us(available_at)) available_us FROM bid_ask_ticks
  WHERE feed_id IS NOT NULL AND ts IS NOT NULL AND source_row IS NOT NULL AND isfinite(bid) AND isfinite(ask) AND bid>0 AND bid<=ask GROUP BY tick_id, feed_id, ts, source_row, bid, ask)"""
FEED_BARS, FEED_HOURS = bars_sql(FEED_TICKS, Q), parents_sql(Q)
SHAPE = ("instrument", "start_us", "end_us", "available_us", *[f"{s}_{p}" for s in ("bid", "ask") for p in B.PRICES], "tick_count")


def feed_quarters(spark, folder):
    return B.ticks_to_bars(B.ticks_of_feeds(table(spark, folder, "bid_ask_ticks")), Q)


@query(f"WITH {FEED_BARS} SELECT {', '.join(SHAPE)} FROM b")
def feed_bars_m15(spark, folder):
    return feed_quarters(spark, folder).select(*SHAPE)


@query(f"WITH {FEED_BARS}{FEED_HOURS} SELECT {', '.join(SHAPE)}, last_known_child_us FROM p")
def feed_bars_h1(spark, folder):
    return B.bars_to_parents(feed_quarters(spark, folder), Q).select(*SHAPE, "last_known_child_us")


@query(f"WITH {FEED_BARS} SELECT instrument, prev gap_start_us, start_us gap_end_us FROM (SELECT *, lag(end_us) OVER {W} prev FROM b) WHERE prev<start_us")
def feed_gaps(spark, folder):
    return B.gaps(feed_quarters(spark, folder))


@query(f"WITH RECURSIVE {FEED_BARS}{TR.format('b')}, {recur('q', 'tr', '1/14.0', 14, 'atr', 'r')} SELECT q.instrument, start_us, round(y,5) atr, known available_us FROM q JOIN r USING (instrument, rn)")
def feed_atr_m15(spark, folder):
    d = I.with_atr(B.with_mids(feed_quarters(spark, folder))).where("atr is not null")
    return rounded(d, "atr", places=5).select("instrument", "start_us", "atr", F.col("atr_known_us").alias("available_us"))


@query(f"WITH {FEED_BARS}{FEED_HOURS}{pivot_sql('p', 3, 3)} SELECT instrument, start_us, confirmed_us, available_us, kind, round(price,6) price FROM pv")
def feed_pivots_h1(spark, folder):
    return rounded(I.pivots(B.with_mids(B.bars_to_parents(feed_quarters(spark, folder), Q))), "price")


@query(
    f"""WITH {FEED_BARS}, c AS (SELECT *, lag(end_us) OVER {W} pe, lag(available_us) OVER {W} pa FROM b), d AS (SELECT *, coalesce(pe<start_us, false) gap FROM c),
e AS (SELECT *, sum(gap::INT) OVER (PARTITION BY instrument ORDER BY start_us ROWS UNBOUNDED PRECEDING) seg FROM d),
f AS (SELECT instrument, seg, min(start_us) a, max(end_us) z, count(*) n, count(*) FILTER (gap) g FROM e GROUP BY 1,2),
h AS (SELECT instrument, min(a) a, max(z) z, sum(n) n, sum(g)::BIGINT g, max(greatest(0, z//{4 * Q}-(a+{4 * Q}-1)//{4 * Q})*4)::BIGINT longest FROM f GROUP BY 1)
SELECT instrument, 'availability_order' code, start_us, 1::BIGINT n FROM c WHERE available_us<pa
UNION ALL SELECT instrument, 'availability_must_equal_close', start_us, 1 FROM c WHERE available_us<>end_us
UNION ALL SELECT instrument, 'partial_hour_start', NULL, 1 FROM h WHERE a%{4 * Q}<>0 UNION ALL SELECT instrument, 'partial_hour_end', NULL, 1 FROM h WHERE z%{4 * Q}<>0
UNION ALL SELECT instrument, 'incomplete_hours', NULL, 1 FROM h WHERE n%4<>0 UNION ALL SELECT instrument, 'data_gaps', NULL, g FROM h WHERE g>0
UNION ALL SELECT instrument, 'insufficient_history', NULL, longest FROM h WHERE longest<100"""
)
def feed_preflight(spark, folder):
    return B.preflight(feed_quarters(spark, folder), Q, known_at_close=True)


@query(f"WITH {FEED_BARS}, g AS (SELECT *, lag(end_us) OVER {W} pe FROM b), l AS (SELECT instrument, max(start_us) FILTER (pe<start_us) last FROM g GROUP BY 1) SELECT g.instrument, start_us FROM g JOIN l USING (instrument) WHERE start_us>=coalesce(last, start_us)")
def feed_usable_suffix(spark, folder):
    return B.usable_suffix(feed_quarters(spark, folder)).select("instrument", "start_us")


@query(
    f"""WITH {GRID}, e AS (SELECT export_id, any_value(calendar_id) calendar_id, any_value(epoch_us(coverage_end)) z_us FROM tick_exports GROUP BY 1),
nb AS (SELECT sb.*, CASE WHEN sb.bucket_start_us+{Q}>=z_us THEN 'outside_coverage'
  WHEN EXISTS (SELECT 1 FROM mc WHERE mc.calendar_id=e.calendar_id AND a<=sb.bucket_start_us+{Q} AND z>sb.bucket_start_us+{Q}) THEN 'inside_closure' ELSE 'scheduled_open' END next_reason
  FROM sb JOIN e USING (export_id))
SELECT export_id, bucket_start_us, next_reason='scheduled_open' next_open, next_reason, (next_reason='scheduled_open' AND state<>'closed' AND status='observed') next_eligible FROM nb"""
)
def session_next_boundaries(spark, folder):
    exports, closures = table(spark, folder, "tick_exports"), table(spark, folder, "session_closures")
    return S.next_boundaries(stored(buckets(spark, folder), "buckets"), exports, closures)
