"""Runs of repeated ticks: shards must not show, odd rows must have defined results."""

import datetime as dt
import random
from contextlib import contextmanager

import numpy as np

from quotemill.llm.runs import agglomerate, collapse_runs

TICKS = "tick_id long, export_id long, feed_id string, ts timestamp_ntz, source_row long, bid double, ask double, available_at timestamp_ntz, n long, shard int, edge int"
FEEDS = "feed_id string, price_tick double, n int"
T0 = dt.datetime(2025, 1, 6)


@contextmanager
def many_shards(spark, n):
    keys = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def frame(spark, rows):
    return spark.createDataFrame([(*r, T0, 1, 2, 3) for r in rows], TICKS)


def test_shards_do_not_show(spark):
    """A hot export, a tick copied 500 times and oddities give the same runs with one shard and with eleven."""
    rng, rows, level = random.Random(1), [], 1000.0
    for i in range(3000):
        if rng.random() < 0.6:
            level = round(level + rng.choice([-0.1, 0.1]), 2)
        bid = rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.01 else level
        rows.append((i, 1 if i < 2400 else 2 + i % 3, "F", T0 + dt.timedelta(seconds=i), i, bid, round(level + 0.2, 2)))
    rows += [rows[rng.randrange(len(rows))] for _ in range(300)] + [rows[100]] * 500
    rng.shuffle(rows)
    ticks = frame(spark, rows).repartition(7)
    feeds = spark.createDataFrame([("F", 0.1, 1)], FEEDS)
    found = []
    for n in (1, 11):
        with many_shards(spark, n):
            found.append(set(map(tuple, collapse_runs(ticks, feeds).collect())))
    assert found[0] == found[1] and len(found[0]) > 20


def test_agglomeration_equals_islands():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 500):
        d = rng.choice([0.0, 0.3, 0.7, 1.0, 2.0, np.inf], n - 1)
        assert agglomerate(d).tolist() == [0, *(np.flatnonzero(d >= 1) + 1).tolist()]


def test_run_rules(spark):
    s = lambda k: T0 + dt.timedelta(seconds=k)
    rows = [(1, 1, "F", s(1), 2, 10.0, 11.0), (2, 1, "F", s(1), 3, 10.04, 11.0), (3, 1, "F", s(2), 4, 10.08, 11.0), (4, 1, "F", s(3), 5, None, 11.0), (5, 1, "F", s(4), 6, 10.08, 11.0), (6, 1, "F", s(5), 7, 10.08, 11.0), (7, 2, "G", s(1), 2, 5.0, 6.0), (8, 2, "G", s(2), 3, 5.0, 6.0), (9, 3, None, s(1), 2, 5.0, 6.0), (10, 3, None, None, 3, 5.0, 6.0), (11, None, "F", s(1), 2, 5.0, 6.0), (12, None, "F", s(2), 2, 5.0, 6.0)]
    feeds = spark.createDataFrame([("F", 0.1, 1), ("G", None, 1)], FEEDS)
    got = {(r.first_tick_id, r.last_tick_id, r.n_ticks, r.duration_us) for r in collapse_runs(frame(spark, rows + rows[:2]), feeds).collect()}
    assert got == {(1, 3, 3, 1_000_000), (5, 6, 2, 1_000_000), (11, 12, 2, 1_000_000)}
    limited = {(r.first_tick_id, r.last_tick_id) for r in collapse_runs(frame(spark, rows), feeds, time_limit_us=500_000).collect()}
    assert limited == {(1, 2)}


def test_empty_tables_and_many_feeds(spark):
    assert collapse_runs(frame(spark, []), spark.createDataFrame([], FEEDS)).collect() == []
    rows = [(i * 10 + k, k, f"F{k}" if k else None, T0 + dt.timedelta(seconds=i), i, 10.0 + i // 3 % 3, 20.0) for k in range(5) for i in range(80)]
    feeds = spark.createDataFrame([(f"F{k}", 0.1 * k - 0.1, 1) for k in range(5)], FEEDS)
    whole, joined = (sorted(map(str, collapse_runs(frame(spark, rows), feeds, max_feeds_sent=n).collect())) for n in (50_000, 2))
    assert whole == joined and len(whole) > 50
