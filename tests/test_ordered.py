"""Spikes, runs and grid: shards must not show, odd rows must have defined results."""

import datetime as dt
import random
from contextlib import contextmanager

import numpy as np

import pytest

from quotemill.operators.grid import regular_grid
from quotemill.operators.implausible import SpikePolicy, flag_implausible, spikes

TICKS = "tick_id long, export_id long, feed_id string, ts timestamp_ntz, source_row long, bid double, ask double, available_at timestamp_ntz, n long, shard int, edge int"
EXPORTS = "export_id long, feed_id string, calendar_id string, coverage_start timestamp_ntz, coverage_end timestamp_ntz, status string"
CLOSURES = "calendar_id string, closure_start timestamp_ntz, closure_end timestamp_ntz, reason string"
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


def market(seed, n=4000):
    """A hot export with most of the ticks, a few small ones; spikes, stuck stretches, copies, nulls and oddities."""
    rng = random.Random(seed)
    rows, level, want = [], 1000.0, {}
    i = 0
    while i < n:
        export = 1 if i < n * 0.8 else 2 + i % 3
        kind = rng.random()
        ts = T0 + dt.timedelta(microseconds=i * 1_300_000 + rng.randrange(900_000))
        if kind < 0.004:
            for k in range(rng.randint(1, 3)):
                rows.append((i, export, "F", ts, i, round(level + 40, 2), round(level + 40.2, 2)))
                want[i] = "spike"
                i += 1
            continue
        if kind < 0.006 and i < n * 0.75:
            level = round(level + 0.1, 2)
            for k in range(60):
                rows.append((i, export, "F", ts + dt.timedelta(microseconds=k), i, level, round(level + 0.2 + rng.random(), 2)))
                i += 1
            level = round(level + 0.3, 2)
            continue
        if kind < 0.012:
            rows.append((i, export, "F", ts, i, rng.choice([None, float("nan"), float("inf"), 0.0, -5.0]), round(level + 0.2, 2)))
        else:
            level = round(level + rng.choice([-0.2, -0.1, 0.0, 0.1, 0.2]), 2)
            rows.append((i, export, "F", ts, i, level, round(level + 0.2, 2)))
        i += 1
    copies = [rows[rng.randrange(len(rows))] for _ in range(300)] + [rows[100]] * 500
    rows += copies
    rng.shuffle(rows)
    return rows, want


@pytest.mark.parametrize("seed", [1])
def test_shards_do_not_show(spark, seed):
    rows, _ = market(seed)
    ticks = frame(spark, rows).repartition(7)
    exports = spark.createDataFrame([(e, "F", "C", T0, T0 + dt.timedelta(hours=4), "x") for e in (1, 2, 3, 4)], EXPORTS)
    closures = spark.createDataFrame([("C", T0 + dt.timedelta(hours=3), T0 + dt.timedelta(hours=3, minutes=20), "r")], CLOSURES)
    results = []
    for n in (1, 11):
        with many_shards(spark, n):
            flags = set(map(tuple, flag_implausible(ticks, SpikePolicy(context=32)).distinct().collect()))
            grid = set(map(tuple, regular_grid(ticks, exports, closures).collect()))
            results.append((flags, grid))
    one, many = results
    assert one[1] == many[1] and len(one[1]) > 10
    assert one[0] == many[0] and {r for _, r in one[0]} == {"impossible", "spike", "stuck"}


def test_flags_what_was_planted(spark):
    rows, want = market(3)
    got = {}
    for r in flag_implausible(frame(spark, rows)).collect():
        got.setdefault(r.reason, set()).add(r.tick_id)
    assert got["spike"] == set(want)
    once = {r[0]: r for r in rows}
    assert got["impossible"] == {i for i, r in once.items() if r[5] is not None and not (np.isfinite(r[5]) and r[5] > 0)}
    assert len(got["stuck"]) % 60 < 10 and len(got["stuck"]) >= 60


def level_spikes(y):
    return spikes(y, 1.0, 0.0, 5.0, 5)[0]


def test_level_shift_and_long_excursion_are_no_spikes():
    y = [100.0] * 10 + [150.0] * 10
    assert level_spikes(y) == []
    assert level_spikes([100.0] * 5 + [150.0] * 5 + [100.0] * 5) == [5, 6, 7, 8, 9]
    assert level_spikes([100.0] * 5 + [150.0] * 6 + [100.0] * 5) == []
    assert level_spikes([100.0] * 5 + [150.0]) == []
    assert level_spikes([1.0, 9.0]) == [] and level_spikes([]) == []


def test_grid_cases(spark):
    h = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, 1, "F", h(1), 2, None, None), (2, 1, "F", h(3), 3, 1.0, 2.0), (3, 9, "F", h(1), 2, 1.0, 2.0), (4, 1, "F", h(500), 9, 1.0, 2.0)]
    exports = spark.createDataFrame([(1, "F", "C", h(0), h(75), "x"), (1, "F", "C", h(0), h(75), "x"), (2, "F", None, h(5), h(40), "x"), (3, "F", "C", None, h(5), "x"), (4, "F", "C", h(5), h(5), "x")], EXPORTS)
    closures = spark.createDataFrame([("C", h(20), h(46), "a"), ("C", h(46), h(60), "b"), ("C", h(60), h(60), "e"), (None, h(0), h(60), "n")], CLOSURES)
    got = {(r.export_id, (r.bucket_start_us - int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)) // 60_000_000): (r.tick_count, r.maximum_intertick_seconds, r.status, r.since_last_tick_us) for r in regular_grid(frame(spark, rows), exports, closures).collect()}
    assert got[(1, 0)] == (2, 120.0, "observed", None)
    assert got[(1, 15)] == (0, None, "missing", 720_000_000) and got[(1, 30)][2] == "closed" and got[(1, 45)][2] == "missing" and got[(1, 60)][2] == "missing"
    assert got[(2, 15)] == (0, None, "missing", None) and {k for k in got if k[0] == 2} == {(2, 15)}
    assert {k[0] for k in got} == {1, 2}


def test_fill_shards_do_not_show(spark):
    """A silence over several fill shards: the last reading is carried through those without any."""
    at = (3, 4, 700, 1300)
    ticks = frame(spark, [(i, 1, "F", T0 + dt.timedelta(minutes=m), i, 1.0, 2.0) for i, m in enumerate(at)])
    exports = spark.createDataFrame([(1, "F", "C", T0, T0 + dt.timedelta(days=1), "x")], EXPORTS)
    closures = spark.createDataFrame([], CLOSURES)
    one, many = (sorted(map(tuple, regular_grid(ticks, exports, closures, shard_periods=n).collect())) for n in (4096, 5))
    assert one == many and len(one) == 96 and one[45][-1] == (45 * 15 - 4) * 60_000_000


def test_empty_tables(spark):
    ticks = frame(spark, [])
    exports, closures = (spark.createDataFrame([], x) for x in (EXPORTS, CLOSURES))
    assert flag_implausible(ticks).collect() == []
    assert regular_grid(ticks, exports, closures).collect() == []


def test_many_sources_go_in_parts(spark):
    rows = [(i * 10 + k, k, f"F{k}", T0 + dt.timedelta(seconds=i), i, 10.0 + i % 3 + 90 * (i == 40), 20.0 + i % 3) for k in range(5) for i in range(80)]
    ticks = frame(spark, [(r[0] + 10_000 * r[1], *r[1:]) for r in rows])
    whole, parts = (sorted(map(tuple, flag_implausible(ticks, SpikePolicy(max_sources_sent=n)).distinct().collect())) for n in (50_000, 2))
    assert whole == parts and len({i // 10_000 for i, _ in whole}) == 5
