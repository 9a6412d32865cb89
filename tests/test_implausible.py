"""Stuck stretches against a feed's own ordinary repeats; spikes across several shards."""

import datetime as dt
import random

import numpy as np
import pytest

from quotemill.operators.implausible import SpikePolicy, flag_implausible, innovations, spikes, steady, stuck_length, vanishing
from tests.test_ordered import T0, frame, many_shards


def quotes(rng, export, feed, first_id, lengths):
    """Ticks of one export whose bid stands still for the given numbers of ticks, while its ask moves at every tick."""
    rows, level, ask = [], 1000, 1100
    for m in lengths:
        level += rng.choice([-2, -1, 1, 2])
        for _ in range(m):
            ask += rng.choice([-2, -1, 1, 2])
            i = len(rows)
            rows.append((first_id + i, export, feed, T0 + dt.timedelta(seconds=i), i, level / 10, (ask + 1000) / 10))
    return rows


@pytest.mark.parametrize("shards", [1, 9])
def test_stretches_too_long_for_their_feed(spark, shards):
    rng = random.Random(2)
    rare = [1 if rng.random() < 0.985 else rng.choice([2, 2, 2, 3, 4]) for _ in range(4000)]
    for k, m in enumerate((12, 14, 17, 20, 25, 30)):
        rare[300 + 600 * k] = m
    tiny = [1] * 60
    tiny[20], tiny[40] = 2, 12
    often = [1 + min(int(rng.expovariate(1.05)), 11) for _ in range(3000)]
    rows, want = [], set()
    for export, (feed, lengths, long) in enumerate((("rare", rare, 12), ("tiny", tiny, 12), ("often", often, 99)), 1):
        rows += quotes(rng, export, feed, export * 100_000, lengths)
        ends = np.cumsum(lengths) + export * 100_000
        want |= {i for m, end in zip(lengths, ends) if m >= long for i in range(end - m, end)}
    with many_shards(spark, shards):
        got = {r.tick_id for r in flag_implausible(frame(spark, rows).repartition(3)).collect() if r.reason == "stuck"}
    assert got == want and len(want) == 12 + 14 + 17 + 20 + 25 + 30 + 12


def test_gate_is_near_the_longest_ordinary_repeat():
    stuck = {m: 2 for m in range(14, 61)}
    ordinary = {1: 477_000, 2: 4500, 3: 1950, 4: 990, 5: 9}
    for share in (1, 10, 100, 1000):
        h = {m: n // share for m, n in ordinary.items() if n >= share}
        for more in (stuck, {20: 1}, {}):
            at, n = (np.array(x) for x in zip(*(h | more).items()))
            if sum(more.values()) < sum(h.values()) / 10:
                assert 5 < stuck_length(at, n, SpikePolicy().stuck_expected) <= 13
    polled = np.arange(18, 23)
    assert stuck_length(polled, np.full(5, 100), 1e-3) > 40
    assert stuck_length(np.zeros(0, int), np.zeros(0, int), 1e-3) == 2**31 - 1


@pytest.mark.parametrize("shards", [1, 11])
@pytest.mark.parametrize("copied", [(200,), (200, 201), (199, 200, 201, 202)])
def test_copied_spike_fills_several_shards(spark, shards, copied):
    rng = random.Random(4)
    rows = quotes(rng, 1, "F", 0, [1] * 400)
    away = [i for i in copied if i in (200, 201)]
    for i in away:
        rows[i] = (*rows[i][:5], rows[i][5] + 500, rows[i][6] + 500)
    rows += [rows[i] for i in copied for _ in range(3000 // len(copied))]
    rng.shuffle(rows)
    with many_shards(spark, shards):
        got = {(r.tick_id, r.reason) for r in flag_implausible(frame(spark, rows).repartition(16)).collect()}
    assert got == {(i, "spike") for i in away}


@pytest.mark.parametrize("shards", [1, 11])
def test_spikes_of_a_side_that_is_seldom_quoted(spark, shards):
    rows = quotes(random.Random(5), 1, "F", 0, [1] * 16000)
    spiked = set(range(680, 16000, 1440))
    rows = [(*r[:5], None if r[0] % 40 else r[5] + 500 * (r[0] in spiked), r[6] + 500) for r in rows]
    with many_shards(spark, shards):
        got = {(r.tick_id, r.reason) for r in flag_implausible(frame(spark, rows).repartition(3)).collect()}
    assert got == {(i, "spike") for i in spiked}


def test_spike_among_shards_of_one_tick(spark):
    rows = quotes(random.Random(6), 1, "F", 0, [1] * 30)
    rows[4] = (*rows[4][:5], rows[4][5] + 500, rows[4][6] + 500)
    rows = [r for r in rows for _ in range(200)]
    found = []
    for shards in (1, 60):
        with many_shards(spark, shards):
            found.append({(r.tick_id, r.reason) for r in flag_implausible(frame(spark, rows).repartition(16)).collect()})
    assert found == [{(4, "spike")}] * 2


def test_gate_widens_and_gain_follows_the_variances():
    """With noise the gain is below 1 and settles; a reading that returns after a long spike is back though the level has drifted."""
    settled, innovation = steady(1.0, 4.0)
    assert abs((settled + 1.0) / innovation - 0.3903882032) < 1e-9 and steady(1.0, 0.0) == (0.0, 1.0)
    calm = [100.0, 100.5, 99.5] * 20
    assert spikes(calm + [200.0, 200.0, 104.0] + calm, 1.0, 0.0, 3.0, 5)[0] == [60, 61]  # 104 lies outside the first gate
    assert spikes(calm + [200.0] * 9 + [201.0] * 9, 1.0, 0.0, 3.0, 5) == ([], [60])


def test_innovation_variance_vanishes_on_stretches():
    rng = np.random.default_rng(2)
    for q, r in ((1.0, 0.0), (1.0, 0.3), (0.2, 1.0)):
        y = 100 + np.cumsum(np.round(rng.normal(0, 1, 600), 1))
        y[200:230] = y[200]
        found, moved = spikes(y.tolist(), q, r, 14.0, 5)
        still = vanishing(innovations(y, q, r, found, moved), q, r, 12, 14.0)
        assert still[211:230].all()
        if r < 1:
            assert not still[:200].any() and not still[240:].any()
