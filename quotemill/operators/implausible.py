"""Implausible readings: spikes, stuck values and impossible prices, judged per source.

Each side of a source's quotes is forecast by a local-level state-space model

    level[t+1] = level[t] + w,  var(w) = Q        reading[t] = level[t] + e,  var(e) = R

and filtered by Kalman's recursion. Q and R come from all of the source's moves over one and two readings (trimmed second
moments of mergeable histograms). A standardised innovation above the threshold is withheld: the state keeps its level and
grows less certain by Q at each withheld reading, so the gate widens. If the readings come back to the level within a few
ticks they were spikes; if not, the level has moved, the filter restarts there and nothing is flagged.

A source is stuck where the variance of its last innovations vanishes: while a reading repeats, what is left of an earlier
innovation shrinks by one minus the gain at each step, and nothing else comes in. An exact check follows: the stretch must
hold one value for longer than the source's own repeats explain (fewer than ``stuck_expected`` such stretches expected).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.joins import salted_join
from quotemill.operators.shards import Piece, ordered_ticks, pieces
from quotemill.session import stored

SIDES = ("bid", "ask")
ZERO_BIN = -(2**30)
BINS_PER_OCTAVE = 16


@dataclass(frozen=True)
class SpikePolicy:
    """threshold: standard deviations of the innovation. max_spike: ticks that a spike may last. context: readings taken
    on either side of a shard's edge, half of which are decided there. stuck_expected: how many ordinary stretches of a
    source's side, whatever its size, are expected to be as long as a stuck one. max_sources_sent: up to so many sources,
    their three numbers a side are sent to all tasks; of more they are joined to the ticks, which costs one more shuffle."""

    threshold: float = 14.0
    max_spike: int = 5
    context: int = 128
    stuck_expected: float = 1e-3
    max_sources_sent: int = 50_000


PROFILE_SCHEMA = "feed_id string, side int, kind int, bin int, n long, export_id long, shard int, edge int, bid double, first_id long, last_id long"
PARAM_SCHEMA = "feed_id string, side int, q double, r double, stuck_length int"
NEVER = 2**31 - 1
UNKNOWN = (0.0, 0.0, NEVER)
OUT_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("tick_id", pa.int64()), ("shard", pa.int32()), ("edge", pa.int32()), ("side", pa.int32()), ("export_id", pa.int64()), ("feed_id", pa.string()), ("pos", pa.int32()), ("owned", pa.bool_()), ("bid", pa.float64()), ("n", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("reason", pa.string())]
)
OUT_DDL = "kind int, tick_id long, shard int, edge int, side int, export_id long, feed_id string, pos int, owned boolean, bid double, n long, first_id long, last_id long, reason string"
FLAG, PENDING, RUN, EDGE = range(4)
FIRST, LAST, WHOLE = range(3)


def usable(values: np.ndarray, has: np.ndarray) -> np.ndarray:
    return has & np.isfinite(values) & (values > 0)


def impossible(p: Piece) -> np.ndarray:
    """A present side that is NaN, infinite, zero or negative, or an ask below its bid."""
    bad = (p.has_bid & ~usable(p.bid, p.has_bid)) | (p.has_ask & ~usable(p.ask, p.has_ask))
    with np.errstate(invalid="ignore"):
        return bad | (p.has_bid & p.has_ask & (p.ask < p.bid))


def equal_runs(values: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of one usable value; an unusable reading ends a stretch."""
    if not len(values):
        return np.zeros(0, int), np.zeros(0, int)
    same = np.zeros(len(values), bool)
    same[1:] = ok[1:] & ok[:-1] & (values[1:] == values[:-1])
    starts = np.flatnonzero(~same)
    return starts, np.diff(np.append(starts, len(values)))


def edge_kinds(p: Piece, k: int) -> np.ndarray:
    """For each of a piece's k stretches, the edge of the shard that it touches; -1 if none."""
    edge = np.full(k, -1)
    if p.first:
        edge[0] = FIRST
    if p.last:
        edge[k - 1] = WHOLE if p.first and k == 1 else LAST
    return edge


def join_stretches(pdf: pd.DataFrame) -> tuple[list[list], list[list[tuple[int, int]]]]:
    """Join the stretches of one export and side that meet at shards' edges: [value, length, last tick], and the (shard, edge) of each."""
    pdf = pdf.sort_values(["shard", "edge"])
    groups: list[list] = []
    members: list[list[tuple[int, int]]] = []
    last_edge = None
    for shard, edge, value, n, first_id, last_id in pdf[["shard", "edge", "bid", "n", "first_id", "last_id"]].itertuples(index=False):
        joins = groups and last_edge in (LAST, WHOLE) and edge in (FIRST, WHOLE) and value == groups[-1][0]
        if joins:
            groups[-1][1] += n - (first_id == groups[-1][2])
            groups[-1][2] = last_id
            members[-1].append((shard, edge))
        else:
            groups.append([value, n, last_id])
            members.append([(shard, edge)])
        last_edge = edge
    return groups, members


# --- what a source normally does -----------------------------------------------------------------------------------


def _bins(moves: np.ndarray) -> Counter:
    zero = moves == 0
    found = np.floor(np.log2(moves[~zero]) * BINS_PER_OCTAVE).astype(int)
    at, n = np.unique(found, return_counts=True)
    out = Counter(dict(zip(at.tolist(), n.tolist())))
    out[ZERO_BIN] = int(zero.sum())
    return out


def profile_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per source and side: counts of moves over one (kind 1) and two readings (kind 2), and of stretches by length (kind 0).

    Stretches at a shard's edge may go on beyond it: they come out one by one (kind 3) and are counted once joined. So do the
    two readings (kind 4) between which and those of other shards there are moves; n is their place.
    """
    total: dict[tuple, Counter] = {}
    rows = []
    for p in pieces(batches):
        for side in (0, 1):
            values, has = (p.bid, p.has_bid) if side == 0 else (p.ask, p.has_ask)
            ok = usable(values, has)
            y = values[ok]
            for lag in (1, 2):
                if len(y) > lag:
                    total.setdefault((p.feed_id, side, lag), Counter()).update(_bins(np.abs(y[lag:] - y[:-lag])))
            places = np.arange(len(y))
            for i in places[(p.first & (places < 2)) | (p.last & (places >= len(y) - 2))]:
                rows.append((p.feed_id, side, 4, 0, int(i), p.export_id, p.shard, 0, float(y[i]), int(p.tick_id[ok][i]), 0))
            starts, lengths = equal_runs(values, ok)
            edge = edge_kinds(p, len(starts))
            at, n = np.unique(lengths[ok[starts] & (edge < 0)], return_counts=True)
            total.setdefault((p.feed_id, side, 0), Counter()).update(dict(zip(at.tolist(), n.tolist())))
            for r in np.flatnonzero(edge >= 0):
                a, m = int(starts[r]), int(lengths[r])
                value = float(values[a]) if ok[a] else None
                rows.append((p.feed_id, side, 3, 0, m, p.export_id, p.shard, int(edge[r]), value, int(p.tick_id[a]), int(p.tick_id[a + m - 1])))
    rows += [(*k, b, n, 0, 0, 0, None, 0, 0) for k, c in total.items() for b, n in c.items() if n]
    if rows:
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in PROFILE_SCHEMA.split(", ")]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)


def moves_over_edges(pdf: pd.DataFrame) -> dict[int, Counter]:
    """Moves over one and two readings of one export and side between different shards, from the readings at their edges."""
    seen: list[list] = []  # tick, reading, first and last shard that holds it
    for tick, value, shard in pdf.sort_values(["shard", "n"])[["first_id", "bid", "shard"]].itertuples(index=False):
        if seen and seen[-1][0] == tick != -(2**63):
            seen[-1][3] = shard
        else:
            seen.append([tick, value, shard, shard])
    out = {}
    for lag in (1, 2):
        moves = [abs(b[1] - a[1]) for a, b in zip(seen, seen[lag:]) if a[3] < b[2]]
        out[lag] = _bins(np.array(moves, float))
    return out


def _quantile(size: np.ndarray, n: np.ndarray, q: float) -> float:
    return float(size[np.searchsorted(np.cumsum(n), q * n.sum())])


def stuck_length(lengths: np.ndarray, n: np.ndarray, expected: float) -> int:
    """Length from which a stretch is stuck, from the whole histogram of one source's stretch lengths on one side.

    Ordinary are the shortest nine tenths of the stretches and all up to 3, then whatever is shorter than the gate that these
    give, until nothing is added; so outlying stretches have no say. Half a stretch is expected just beyond the longest
    ordinary one, and of each further length only the share of ordinary repeats that go on (4 of 10 are added, so that a few
    repeats don't settle it). The gate is where fewer than ``expected`` are left.
    """
    order = np.argsort(lengths)
    lengths, n = lengths[order], n[order]
    if not n.sum():
        return NEVER
    top = max(3, int(lengths[np.searchsorted(np.cumsum(n), max(1, int(0.9 * n.sum())))]))
    while True:
        body = lengths <= top
        longest = int(lengths[body].max(initial=1))
        repeats = np.maximum(lengths[body] - 1, 0)
        chance = min((float((np.maximum(repeats - 1, 0) * n[body]).sum()) + 4) / (float((repeats * n[body]).sum()) + 10), 0.9999)
        gate = longest + 1 + max(0, math.ceil(math.log(2 * expected) / math.log(chance)))
        if not ((lengths > top) & (lengths < gate)).any():
            return min(gate, NEVER)
        top = gate - 1


def fit(histogram: pd.DataFrame, policy: SpikePolicy) -> tuple[float, float, int]:
    """Q, R and length of a stuck stretch from one source's histograms (columns kind, bin, n) of one side.

    A source without any move gets variances of 0 and is never flagged: nothing is known about how it normally quotes.
    """
    square = {}
    scale = 0.0
    for lag in (1, 2):
        h = histogram[histogram.kind == lag].sort_values("bin")
        if h.empty:
            return UNKNOWN
        size = np.where(h.bin == ZERO_BIN, 0.0, np.exp2((h.bin.to_numpy() + 0.5) / BINS_PER_OCTAVE))
        n = h.n.to_numpy()
        if lag == 1:
            scale = _quantile(size, n, 0.9) / 1.645
            if scale == 0 and (size > 0).any():
                scale = _quantile(size[size > 0], n[size > 0], 0.5)
            if scale == 0:
                return UNKNOWN
        normal = size <= 6 * lag**0.5 * scale
        square[lag] = float((size[normal] ** 2 * n[normal]).sum() / n[normal].sum())
    one, two = square[1], square[2]
    q = min(max(two - one, 0.1 * one), one)
    r = max((one - q) / 2, 0.0)
    runs = histogram[histogram.kind == 0]
    return q, r, stuck_length(runs.bin.to_numpy(), runs.n.to_numpy(), policy.stuck_expected)


def source_parameters(ordered: DataFrame, policy: SpikePolicy) -> DataFrame:
    profile = ordered.mapInArrow(profile_shard, PROFILE_SCHEMA)
    histogram = profile.groupBy(*(x for x in profile.columns if x != "n")).agg(F.sum("n").alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        at_edges = [g for _, e in pdf[pdf.kind == 3].groupby("export_id") for g in join_stretches(e)[0]]
        joined = Counter(int(n) for value, n, _ in at_edges if not pd.isna(value))
        more = [(0, b, n) for b, n in joined.items()]
        more += [(lag, b, n) for _, e in pdf[pdf.kind == 4].groupby("export_id") for lag, c in moves_over_edges(e).items() for b, n in c.items() if n]
        histogram = pd.concat([pdf.loc[pdf.kind < 3, ["kind", "bin", "n"]], pd.DataFrame(more, columns=["kind", "bin", "n"], dtype="int64")])
        q, r, length = fit(histogram.groupby(["kind", "bin"], as_index=False).sum(), policy)
        return pd.DataFrame({"feed_id": [pdf.feed_id.iloc[0]], "side": [pdf.side.iloc[0]], "q": [q], "r": [r], "stuck_length": [length]})

    return histogram.groupBy("feed_id", "side").applyInPandas(one, PARAM_SCHEMA)


# --- filtering -----------------------------------------------------------------------------------------------------


def steady(q: float, r: float) -> tuple[float, float]:
    """Variance of the level after an update, and of the innovation, once the recursion has settled."""
    before = (q + math.sqrt(q * q + 4 * q * r)) / 2
    return before * r / (before + r) if before + r else 0.0, before + r


def spikes(y: list[float], q: float, r: float, threshold: float, max_spike: int) -> tuple[list[int], list[int]]:
    """Places in y of readings that leave the filtered level for at most max_spike readings and come back to it; and the places at
    which the filter restarts, as the level has moved.

    A reading is back if its innovation is inside the gate, which widens while readings are withheld, and if it is much
    nearer to the reading before the spike than the spike ever was.
    """
    found: list[int] = []
    restarts: list[int] = []
    if len(y) < 3 or q + r <= 0:
        return found, restarts
    settled, innovation = steady(q, r)
    usual_gain, usual_gate = (settled + q) / innovation, threshold * math.sqrt(innovation)
    level, p, i, n = y[0], r, 1, len(y)
    while i < n:
        v = y[i]
        if abs(p - settled) <= 1e-9 * innovation:
            p, gain, gate = settled, usual_gain, usual_gate
        else:
            gain, gate = (p + q) / (p + q + r), threshold * math.sqrt(p + q + r)
        if abs(v - level) <= gate:
            level += gain * (v - level)
            p = (1 - gain) * (p + q)
            i += 1
            continue
        away, j, stop = abs(v - level), i + 1, min(n, i + max_spike + 1)
        p += q  # withheld: the level stays, and is less certain
        while j < stop:
            gate = threshold * math.sqrt(p + q + r)
            if abs(y[j] - level) <= gate and abs(y[j] - y[i - 1]) <= 0.6 * away:
                break
            away = min(away, abs(y[j] - level))
            p += q
            j += 1
        if j < stop:
            found.extend(range(i, j))
            i = j
        elif j < n:  # the level has moved: start again at it
            level, p = v, r
            restarts.append(i)
            i += 1
        else:  # the end comes before the readings return
            break
    return found, restarts


def innovations(y: np.ndarray, q: float, r: float, withheld: list[int], restarts: list[int]) -> np.ndarray:
    """Innovations of the settled filter at each reading; 0 where it starts, NaN where the reading is withheld."""
    settled, innovation = steady(q, r)
    gain = (settled + q) / innovation
    out = np.full(len(y), np.nan)
    use = np.ones(len(y), bool)
    use[withheld] = False
    for a, b in zip([0, *restarts], [*restarts, len(y)]):
        at = a + np.flatnonzero(use[a:b])
        if len(at):
            level = pd.Series(y[at]).ewm(alpha=gain, adjust=False).mean().to_numpy()
            out[at[0]] = 0.0
            out[at[1:]] = y[at[1:]] - level[:-1]
    return out


def vanishing(nu: np.ndarray, q: float, r: float, length: int, threshold: float) -> np.ndarray:
    """Where the mean square of the last half of ``length`` innovations has vanished: not above what the filter's own decay leaves, in
    the other half, of the largest innovation that it accepts. True at every place by which ``length`` equal readings have passed."""
    m = max(1, length // 2)
    out = np.zeros(len(nu), bool)
    if len(nu) < length or q + r <= 0:
        return out
    settled, innovation = steady(q, r)
    rest = (1 - (settled + q) / innovation) ** (length - 1 - m)
    square = np.concatenate([[0.0], np.cumsum(np.nan_to_num(nu) ** 2)])
    variance = (square[m:] - square[:-m]) / m
    slack = 1e-12 * square[m:] + 1e-9 * innovation  # of the running sum, and of nothing at all
    out[m - 1 :] = variance <= (threshold * rest) ** 2 * innovation + slack
    return out


def _rows(**columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values() if isinstance(v, (np.ndarray, list)))
    arrays = []
    for f in OUT_SCHEMA:
        v = columns.get(f.name)
        arrays.append(pa.nulls(n, f.type) if v is None else pa.array(v if isinstance(v, (np.ndarray, list)) else [v] * n, f.type))
    return pa.record_batch(arrays, schema=OUT_SCHEMA)


def flag_shard(param_of, policy: SpikePolicy):
    """Per shard: flagged ticks; ticks of edge stretches that are not decided yet, and these stretches' summaries; and each side's readings around each edge.

    A piece with fewer readings than the context has not enough of them to decide anything: all are left to its edges.
    """
    c = policy.context

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            n = len(p)
            param = param_of(p)
            stuck = np.zeros(n, bool)
            spike = np.zeros(n, bool)
            for side in (0, 1):
                values, has = (p.bid, p.has_bid) if side == 0 else (p.ask, p.has_ask)
                q, r, length = param.get((p.feed_id, side), UNKNOWN)
                ok = usable(values, has)
                at = np.flatnonzero(ok)
                m = len(at)
                half = c // 2 if m >= c else m
                head, tail = half if p.first else 0, half if p.last else 0
                still = np.zeros(n, bool)
                if q + r > 0 and m:
                    out, moved = spikes(values[at].tolist(), q, r, policy.threshold, policy.max_spike)
                    still[at] = vanishing(innovations(values[at], q, r, out, moved), q, r, length, policy.threshold)
                    spike[at[[i for i in out if head <= i < m - tail]]] = True
                whole = p.first and p.last and m < c
                for on, kind, some, mine in ((whole, WHOLE, slice(0, m), (0, m)), (p.first and not whole, FIRST, slice(0, c), (0, head)), (p.last and not whole, LAST, slice(max(0, m - c), m), (m - tail, m))):
                    if on and m:
                        pos = np.arange(m, dtype=np.int32)[some]
                        owned = (pos >= mine[0]) & (pos < mine[1])
                        yield _rows(kind=EDGE, shard=p.shard, edge=kind, side=side, export_id=p.export_id, feed_id=p.feed_id, pos=pos, owned=owned, tick_id=p.tick_id[at[some]], bid=values[at[some]])
                starts, lengths = equal_runs(values, ok)
                edge = edge_kinds(p, len(starts))
                for k in np.flatnonzero(ok[starts] & (lengths >= length) & (edge < 0)):
                    a, b = int(starts[k]), int(starts[k] + lengths[k])
                    if still[b - 1]:
                        stuck[a:b] = True
                for k in np.flatnonzero(edge >= 0):  # decided once their parts in other shards are known
                    a, m = int(starts[k]), int(lengths[k])
                    summary = {"shard": p.shard, "edge": int(edge[k]), "side": side, "export_id": p.export_id, "feed_id": p.feed_id}
                    yield _rows(kind=RUN, bid=[values[a] if ok[a] else None], n=[m], first_id=[int(p.tick_id[a])], last_id=[int(p.tick_id[a + m - 1])], **summary)
                    if ok[a]:
                        yield _rows(kind=PENDING, tick_id=p.tick_id[a : a + m], **summary)
            for reason, mask in (("impossible", impossible(p)), ("spike", spike), ("stuck", stuck)):
                if mask.any():
                    yield _rows(kind=FLAG, tick_id=p.tick_id[mask], reason=reason)

    return run


def _edge_spikes(param_of, policy: SpikePolicy):
    """One side's readings around one edge: the last ones of a shard, all of the short shards after it, the first ones of the next."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "pos"])
        side = int(pdf.side.iloc[0])
        out: list[int] = []
        for _, g in pdf.groupby("export_id", sort=False, dropna=False):
            same = g.tick_id.eq(g.tick_id.shift()) & g.tick_id.ne(-(2**63))
            g = g[~same]
            feed = g.feed_id.iloc[0]
            p = Piece(0, 0, feed, True, True, *[np.zeros(0)] * 7)
            q, r, _ = param_of(p).get((feed, side), UNKNOWN)
            found = np.zeros(len(g), bool)
            found[spikes(g.bid.tolist(), q, r, policy.threshold, policy.max_spike)[0]] = True
            out += g.tick_id[found & g.owned.to_numpy().astype(bool)].tolist()
        return pd.DataFrame({"tick_id": pd.Series(out, dtype="int64")})

    return run


def _merge_runs(param_of):
    """Join the stretches that meet at shards' edges, and say which of them are stuck. One row per shard and edge."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups, members = join_stretches(pdf)
        feed, side = pdf.feed_id.iloc[0], int(pdf.side.iloc[0])
        p = Piece(0, 0, feed, True, True, *[np.zeros(0)] * 7)
        length = param_of(p).get((feed, side), UNKNOWN)[2]
        stuck = [(s, e, side) for g, m in zip(groups, members) if g[1] >= length for s, e in m]
        return pd.DataFrame(stuck, columns=["shard", "edge", "side"]).astype("int32")

    return run


def flag_implausible(ticks: DataFrame, policy: SpikePolicy = SpikePolicy()) -> DataFrame:
    """(tick_id, reason) of every tick of ``ticks`` that is not believable for its feed; a tick may have several rows.

    reason: ``impossible`` (a present side is NaN, infinite, not positive, or ask < bid), ``spike`` or ``stuck``.
    Null sides are no readings: they are skipped by the filter, end a stretch and are never flagged by themselves.
    Copies of a tick count once; ties in ts are ordered by source_row, then tick_id. Null keys form an export, and a null
    feed a feed, of their own. An export of fewer than three readings has no spikes. An empty table gives an empty result.
    """
    spark = ticks.sparkSession
    ordered = ordered_ticks(ticks).persist(StorageLevel.DISK_ONLY)  # on executors' disks: lost parts are sorted anew
    params = stored(source_parameters(ordered, policy), "implausible-params")
    if params.select("feed_id").distinct().count() > policy.max_sources_sent:
        ordered.unpersist()
        return _flagged(ordered_ticks(_travelling(ticks, params)), _travelled, policy)
    known = {(r.feed_id, r.side): (r.q, r.r, r.stuck_length) for r in params.collect()}
    sent = spark.sparkContext.broadcast(known)
    return _flagged(ordered, lambda p: sent.value, policy)


NULL_FEED = "\0"


def _travelling(ticks: DataFrame, params: DataFrame) -> DataFrame:
    """Ticks whose feed_id begins with their feed's parameters, joined by a salted shuffle: for more feeds than are sent to all tasks."""
    numbers = [F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}{side}") for side in (0, 1) for c in ("q", "r", "stuck_length")]
    one = params.groupBy(F.coalesce("feed_id", F.lit(NULL_FEED)).alias("_feed")).agg(*numbers)
    text = [F.coalesce(F.col(f"{c}{side}"), F.lit(v)).cast("string") for side in (0, 1) for c, v in zip(("q", "r", "stuck_length"), UNKNOWN)]
    one = one.select("_feed", F.concat_ws("|", *text, "_feed").alias("_named"))
    d = salted_join(ticks.withColumn("_feed", F.coalesce("feed_id", F.lit(NULL_FEED))), one, ["_feed"], F.col("tick_id"))
    return d.withColumn("feed_id", F.col("_named")).drop("_feed", "_named")


def _travelled(p: Piece) -> dict:
    """The parameters in front of a feed's name."""
    if p.feed_id is None:
        return {}
    n = p.feed_id.split("|", 6)
    return {(p.feed_id, side): (float(n[3 * side]), float(n[3 * side + 1]), int(float(n[3 * side + 2]))) for side in (0, 1)}


def _flagged(ordered: DataFrame, param_of, policy: SpikePolicy) -> DataFrame:
    out = stored(ordered.mapInArrow(flag_shard(param_of, policy), OUT_DDL), "implausible", "kind")
    ordered.unpersist()
    pending = out.where(F.col("kind") == PENDING).select("tick_id", "shard", "edge", "side")
    stuck = out.where(F.col("kind") == RUN).select("shard", "edge", "side", "export_id", "feed_id", "bid", "n", "first_id", "last_id").groupBy("export_id", "side").applyInPandas(_merge_runs(param_of), "shard int, edge int, side int")
    edges = out.where(F.col("kind") == EDGE).select("shard", "edge", "side", "export_id", "feed_id", "pos", "owned", "tick_id", "bid")
    # A window begins with the last readings of a shard and goes on to the first ones of the next shard that is not short, over
    # all the short ones (and those without readings) between; the list that says where has a row per shard and side.
    so_far = Window.partitionBy("side").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = edges.groupBy("side", "shard").agg(F.max(F.when(F.col("edge") == LAST, F.col("shard"))).alias("last")).select("side", "shard", F.coalesce(F.max("last").over(so_far), F.lit(-1)).alias("before"))
    edges = edges.join(before, ["side", "shard"]).withColumn("window", F.when(F.col("edge") == LAST, F.col("shard")).otherwise(F.col("before"))).drop("before")
    at_edges = edges.groupBy("side", "window").applyInPandas(_edge_spikes(param_of, policy), "tick_id long")
    return (
        out.where(F.col("kind") == FLAG)
        .select("tick_id", "reason")
        .unionByName(pending.join(stuck, ["shard", "edge", "side"]).select("tick_id", F.lit("stuck").alias("reason")))
        .unionByName(at_edges.select("tick_id", F.lit("spike").alias("reason")))
    )
