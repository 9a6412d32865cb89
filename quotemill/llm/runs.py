"""Runs of repeated consecutive events, collapsed to one row each."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.joins import salted_join
from quotemill.operators.shards import Piece, ordered_ticks, pieces
from quotemill.session import stored

RUN_DDL = "edge int, shard int, export_id long, feed_id string, first_tick_id long, last_tick_id long, first_us long, last_us long, n long, first_bid double, first_ask double, last_bid double, last_ask double"
RUN_SCHEMA = pa.schema(
    [("edge", pa.int32()), ("shard", pa.int32()), ("export_id", pa.int64()), ("feed_id", pa.string()), ("first_tick_id", pa.int64()), ("last_tick_id", pa.int64()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("n", pa.int64()), ("first_bid", pa.float64()), ("first_ask", pa.float64()), ("last_bid", pa.float64()), ("last_ask", pa.float64())]
)
RESULT_DDL = "export_id long, feed_id string, first_tick_id long, last_tick_id long, n_ticks long, first_us long, last_us long, duration_us long"
INNER, FIRST, LAST, WHOLE = range(4)


def dissimilarity(a_bid, a_ask, b_bid, b_ask, limit):
    """The larger of the two sides' moves, in limits; below 1 the two readings say the same. Not finite: never."""
    with np.errstate(invalid="ignore", over="ignore"):
        d = np.maximum(np.abs(b_bid - a_bid), np.abs(b_ask - a_ask)) / limit
    return np.where(np.isfinite(d), d, np.inf)


def agglomerate(distance: np.ndarray) -> np.ndarray:
    """Adjacent agglomeration of n readings; distance[i] lies between reading i and i + 1. Returns each run's first reading.

    Runs form a linked list; a priority queue holds the neighbouring pairs that meet the limit (distance below 1), and
    the most similar pair is merged first. Two runs are as similar as the readings at which they meet, so a merge leaves
    the distances to the outer neighbours as they are. Pairs of distance 0 need no queue: they come first in any order.
    """
    n = len(distance) + 1
    head = np.ones(n, bool)
    head[1:] = distance != 0
    starts = np.flatnonzero(head)
    gaps = np.flatnonzero((distance > 0) & (distance < 1))
    if not len(gaps):
        return starts
    following = {int(a): int(b) for a, b in zip(starts, np.append(starts[1:], n))}
    run_of = np.cumsum(head) - 1
    first_of = {int(g): int(starts[run_of[g]]) for g in gaps}  # the run that ends at gap g began here
    parent: dict[int, int] = {}

    def first(a: int) -> int:
        while a in parent:
            parent[a] = parent.get(parent[a], parent[a])
            a = parent[a]
        return a

    queue = [(float(distance[g]), int(g)) for g in gaps]
    heapq.heapify(queue)
    while queue:
        _, g = heapq.heappop(queue)
        left, right = first(first_of[g]), g + 1
        following[left] = following.pop(right)
        parent[right] = left
    return np.array(sorted(following), dtype=np.int64)


def runs_of_shard(limit_of, time_limit_us: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            limit = limit_of.get(p.feed_id, 0.0)
            d = _distances(p, limit, time_limit_us)
            starts = agglomerate(d)
            n = np.diff(np.append(starts, len(p)))
            ends = starts + n - 1
            edge = np.full(len(starts), INNER)
            if p.first:
                edge[0] = FIRST
            if p.last:
                edge[-1] = WHOLE if p.first and len(starts) == 1 else LAST
            keep = (n > 1) | (edge != INNER)
            s, e = starts[keep], ends[keep]
            k = len(s)
            if not k:
                continue
            bid, ask = np.where(p.has_bid, p.bid, np.nan), np.where(p.has_ask, p.ask, np.nan)
            yield pa.record_batch(
                [pa.array(edge[keep], pa.int32()), pa.array([p.shard] * k, pa.int32()), pa.array([p.export_id] * k, pa.int64()), pa.array([p.feed_id] * k, pa.string()), pa.array(p.tick_id[s]), pa.array(p.tick_id[e]), pa.array(p.ts[s]), pa.array(p.ts[e]), pa.array(n[keep], pa.int64()), pa.array(bid[s]), pa.array(ask[s]), pa.array(bid[e]), pa.array(ask[e])],
                schema=RUN_SCHEMA,
            )

    return run


def _distances(p: Piece, limit: float, time_limit_us: int | None) -> np.ndarray:
    bid, ask = np.where(p.has_bid, p.bid, np.nan), np.where(p.has_ask, p.ask, np.nan)
    d = dissimilarity(bid[:-1], ask[:-1], bid[1:], ask[1:], limit) if limit > 0 else np.full(len(p) - 1, np.inf)
    if time_limit_us is not None:
        d[np.diff(p.ts) > time_limit_us] = np.inf
    return d


def _merge_edges(limit_of, time_limit_us: int | None):
    """Join the runs of one export that meet at shards' edges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "edge"])
        limit = limit_of.get(pdf.feed_id.iloc[0], 0.0)
        out: list[dict] = []
        open_edge = False
        for r in pdf.to_dict("records"):
            meets = False
            if open_edge and r["edge"] in (FIRST, WHOLE):
                a = out[-1]
                copy = a["last_tick_id"] == r["first_tick_id"]
                near = limit > 0 and dissimilarity(a["last_bid"], a["last_ask"], r["first_bid"], r["first_ask"], limit) < 1
                near = near and (time_limit_us is None or r["first_us"] - a["last_us"] <= time_limit_us)
                meets = copy or near
                if meets:
                    a["n"] += r["n"] - copy
                    a |= {k: r[k] for k in ("last_tick_id", "last_us", "last_bid", "last_ask")}
            if not meets:
                out.append(r)
            open_edge = r["edge"] in (LAST, WHOLE)
        rows = [(r["export_id"], r["feed_id"], r["first_tick_id"], r["last_tick_id"], r["n"], r["first_us"], r["last_us"], r["last_us"] - r["first_us"]) for r in out if r["n"] > 1]
        return pd.DataFrame(rows, columns=["export_id", "feed_id", "first_tick_id", "last_tick_id", "n_ticks", "first_us", "last_us", "duration_us"])

    return run


MAX_FEEDS_SENT = 50_000


def collapse_runs(ticks: DataFrame, feeds: DataFrame, time_limit_us: int | None = None, max_feeds_sent: int = MAX_FEEDS_SENT) -> DataFrame:
    """One row per maximal run of two or more consecutive ticks that say the same bid and ask.

    Neighbours of an export, ordered by (ts, source_row), say the same if each side moves by less than half the feed's
    price_tick (and, with time_limit_us, follow each other that soon). A tick with a null, NaN or infinite side is in no
    run and ends one. Copies of a tick count once. A feed that ``feeds`` lacks, or whose price_tick is null or not
    positive, has no runs. Null keys sort first; an empty table gives an empty result. The steps of up to ``max_feeds_sent`` feeds are
    sent to all tasks; more are joined to the ticks and travel in front of the feed's name.
    """
    stepped = feeds.where(F.col("price_tick") > 0).groupBy("feed_id").agg(F.max("price_tick").alias("step"))
    if stepped.count() > max_feeds_sent:
        named = F.concat_ws("|", F.coalesce(F.col("step").cast("string"), F.lit("0")), "feed_id")
        found = _collapsed(salted_join(ticks, stepped, ["feed_id"], F.col("tick_id")).withColumn("feed_id", named), _Travelling(), time_limit_us)
        return found.withColumn("feed_id", F.when(F.instr("feed_id", "|") > 0, F.expr("substring(feed_id, instr(feed_id, '|') + 1)")))
    return _collapsed(ticks, {r.feed_id: r.step / 2 for r in stepped.collect()}, time_limit_us)


class _Travelling:
    """The limits of feeds whose name begins with their step."""

    def get(self, feed: str | None, default: float) -> float:
        return float(feed.split("|", 1)[0]) / 2 if feed else default


def _collapsed(ticks: DataFrame, limit_of, time_limit_us: int | None) -> DataFrame:
    found = stored(ordered_ticks(ticks).mapInArrow(runs_of_shard(limit_of, time_limit_us), RUN_DDL), "runs", "edge")
    duration = (F.col("last_us") - F.col("first_us")).alias("duration_us")
    inner = found.where(F.col("edge") == INNER).select("export_id", "feed_id", "first_tick_id", "last_tick_id", F.col("n").alias("n_ticks"), "first_us", "last_us", duration)
    edges = found.where(F.col("edge") != INNER).groupBy("export_id").applyInPandas(_merge_edges(limit_of, time_limit_us), RESULT_DDL)
    return inner.unionByName(edges)
