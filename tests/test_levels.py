"""Grid rounding, next open times, and zone episodes against a bar-by-bar account."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quotemill.operators import bars as B
from quotemill.operators import sessions as S
from quotemill.operators import zones as Z
from quotemill.operators.levels import to_grid
from test_market import bars


def test_grid(spark):
    row = spark.range(1).select(*[to_grid(F.lit(x), 0.05, w).alias(f"{w}{i}") for i, x in enumerate((1.07, 1.1, -1.07)) for w in ("up", "down", "near")]).first().asDict()
    assert row == {"up0": 1.1, "down0": 1.05, "near0": 1.05, "up1": 1.1, "down1": 1.1, "near1": 1.1, "up2": -1.05, "down2": -1.1, "near2": -1.05}


def test_next_open(spark):
    t = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    base = int((t(0) - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
    closures = spark.createDataFrame([("c", t(1), t(2), "a"), ("c", t(2), t(50), "b")], "calendar_id string, closure_start timestamp_ntz, closure_end timestamp_ntz, reason string")
    points = spark.createDataFrame([(i, "c" if i < 4 else None, base + h * B.HOUR_US) for i, h in enumerate((0, 1, 30, 50, 1))], "point_id int, calendar_id string, at_us long")
    got = {r.point_id: (r.next_open_us - base) // B.HOUR_US for r in S.next_open(points, closures, "at_us").collect()}
    assert got == {0: 0, 1: 50, 2: 50, 3: 50, 4: 1}


def sequential(zones, parents, base):
    """Episodes of each zone by walking all bars in the order in which they become known."""
    seen = sorted([((p.available_us, p.end_us, 0, p.start_us), p) for p in parents] + [((b.available_us, b.end_us, 1, b.start_us), b) for b in base], key=lambda x: x[0])
    out = set()
    for z in zones:
        active, ordinal = None, 0
        for key, bar in seen:
            if bar.start_us < z.available_us:
                continue
            if key[2] == 0:
                if bar.close < z.lower if z.direction == 1 else bar.close > z.upper:
                    if active:
                        out.add((z.impulse_us, z.direction, *active, "invalidated"))
                    active = None
                    break
            elif bar.low <= z.upper and bar.high >= z.lower:
                if active:
                    active = (*active[:2], bar.end_us)
                else:
                    ordinal += 1
                    active = (ordinal, bar.start_us, bar.end_us)
            elif active:
                out.add((z.impulse_us, z.direction, *active, "left"))
                active = None
        else:
            if active:
                out.add((z.impulse_us, z.direction, *active, None))
    return out


def test_episodes_equal_a_bar_by_bar_account(spark):
    rng = random.Random(11)
    mids, c = [], 100.0
    for i in range(240):
        o, c = c, c + rng.gauss(0.25 if i // 12 % 2 else -0.25, 0.5)
        mids.append((o, max(o, c) + rng.random() / 3, min(o, c) - rng.random() / 3, c))
    b = bars(spark, mids, late=lambda i: i * 7919 % 5 * 60_000_000).withColumn("tick_count", F.lit(1).cast("long"))
    p = B.with_mids(B.bars_to_parents(b.drop(*B.PRICES)))
    z = Z.zones(p, period=5, least=2, move_atr=0.5, body_atr=0.4)
    got = {(r.impulse_us, r.direction, r.ordinal, r.first_touch_us, r.last_touch_end_us, r.ended) for r in Z.episodes(z, p, b).collect()}
    want = sequential(z.collect(), p.collect(), b.collect())
    assert got == want and len(got) > 10
    for width in (3, 17):
        cut = Z.episodes(z, p, b, slot_us=width * B.HOUR_US).collect()
        assert {(r.impulse_us, r.direction, r.ordinal, r.first_touch_us, r.last_touch_end_us, r.ended) for r in cut} == want
        ended = lambda w: sorted(map(str, Z.invalidations(z, p, slot_us=w).collect()))
        assert ended(width * B.HOUR_US) == ended(10**6 * B.HOUR_US)
