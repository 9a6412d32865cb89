"""Hours' prices from their observed open quarters, and whether the next boundary is open."""

import datetime as dt

from quotemill.operators.sessions import hour_prices, next_boundaries, session_buckets
from tests.test_ordered import CLOSURES, EXPORTS, T0, frame


def test_partial_hours_and_next_boundaries(spark):
    h = lambda m: T0 + dt.timedelta(minutes=m)
    us = lambda m: int((h(m) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    rows = [(1, 1, "F", h(1), 2, 10.0, 11.0), (2, 1, "F", h(1), 3, 14.0, None), (3, 1, "F", h(16), 4, float("nan"), 9.0), (4, 1, "F", h(50), 5, 12.0, 13.0), (5, 1, "F", h(40), 6, 99.0, 99.0), (6, 1, "F", h(61), 7, 1.0, 2.0)]
    exports = spark.createDataFrame([(1, "F", "C", h(0), h(120), "x"), (2, "F", None, h(0), h(30), "x")], EXPORTS)
    closures = spark.createDataFrame([("C", h(20), h(45), "a"), ("C", h(110), h(130), "b")], CLOSURES)
    ticks = frame(spark, rows + rows[:2])
    buckets = session_buckets(ticks, exports, closures)
    got = {(r.export_id, r.hour_us): r for r in hour_prices(ticks, buckets).collect()}
    r = got[(1, us(0))]
    assert r.eligible and (r.bid_open, r.bid_high, r.bid_low, r.bid_close) == (10.0, 14.0, 10.0, 12.0)
    assert (r.ask_open, r.ask_high, r.ask_low, r.ask_close) == (11.0, 13.0, 9.0, 13.0)
    assert not got[(1, us(60))].eligible and got[(1, us(60))].bid_open is None
    found = {(r.export_id, r.bucket_start_us): (r.next_open, r.next_reason, r.next_eligible) for r in next_boundaries(buckets, exports, closures).collect()}
    assert len(found) == buckets.count() == 10
    assert found[(1, us(0))] == (True, "scheduled_open", True) and found[(1, us(15))] == (False, "inside_closure", False)
    assert found[(1, us(30))] == (True, "scheduled_open", False) and found[(1, us(60))] == (True, "scheduled_open", True)
    assert found[(1, us(75))] == (True, "scheduled_open", False) and found[(1, us(105))] == (False, "outside_coverage", False)
    assert found[(2, us(0))] == (True, "scheduled_open", False) and found[(2, us(15))] == (False, "outside_coverage", False)
