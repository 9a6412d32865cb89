"""Ordered shards: one global order cut into ranges of even size.

A window over one hot key sorts all its rows in one task. Here rows are range-partitioned by the key *and* the order
columns, so a key that holds a third of all rows is spread over a third of the shards. Each shard is read once in order
by an Arrow function; what crosses a shard's edge leaves it as a summary and is joined up afterwards, over rows whose
number is a small multiple of the number of shards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TICK_COLUMNS = ("tick_id", "export_id", "feed_id", "ts_us", "source_row", "bid", "ask")


def micros(column):
    """Microseconds since 1970-01-01 of a timestamp with or without zone, read as UTC."""
    return F.unix_micros(column.cast("timestamp"))


def ordered_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks in shards ordered by (export_id, ts, source_row), copies of a tick side by side.

    The number of the input split is the last range column: copies of one tick may then fall into several shards, so that
    even a tick repeated without bound stays split. The functions below drop the copies inside a shard and at its edges.
    A null in export_id, ts or source_row takes the lowest place.
    """
    low = F.lit(-(2**63))
    rows = ticks.select(
        "tick_id",
        F.coalesce(F.col("export_id"), low).alias("export_id"),
        "feed_id",
        F.coalesce(micros(F.col("ts")), low).alias("ts_us"),
        F.coalesce(F.col("source_row"), low).alias("source_row"),
        F.col("bid").cast("double").alias("bid"),
        F.col("ask").cast("double").alias("ask"),
        F.spark_partition_id().alias("split"),
    )
    keys = ["export_id", "ts_us", "source_row", "tick_id"]
    return rows.repartitionByRange(*keys, "split").sortWithinPartitions(*keys).drop("split")


@dataclass
class Piece:
    """The ticks of one export inside one shard, copies dropped. Absent sides are NaN and not in has_*."""

    shard: int
    export_id: int
    feed_id: str | None
    first: bool
    last: bool
    tick_id: np.ndarray
    ts: np.ndarray
    row: np.ndarray
    bid: np.ndarray
    ask: np.ndarray
    has_bid: np.ndarray
    has_ask: np.ndarray

    def __len__(self) -> int:
        return len(self.tick_id)


def _side(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    has = column.is_valid().to_numpy()
    return column.fill_null(float("nan")).to_numpy(), has


def _piece(parts: list[pa.RecordBatch], shard: int, first: bool, last: bool) -> Piece:
    t = pa.Table.from_batches(parts)
    ids = t["tick_id"].fill_null(-(2**63)).to_numpy()
    ts, row = t["ts_us"].to_numpy(), t["source_row"].to_numpy()
    bid, has_bid = _side(t["bid"])
    ask, has_ask = _side(t["ask"])
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (ids[1:] == -(2**63))
    arrays = (ids, ts, row, bid, ask, has_bid, has_ask)
    if not keep.all():
        arrays = tuple(a[keep] for a in arrays)
    return Piece(shard, t["export_id"][0].as_py(), t["feed_id"][0].as_py(), first, last, *arrays)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[Piece]:
    """Cut a shard's batches where the export changes."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    first = True
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        exports = batch.column(batch.schema.get_field_index("export_id")).to_numpy()
        cuts = [0, *(np.flatnonzero(exports[1:] != exports[:-1]) + 1), len(exports)]
        for a, b in zip(cuts, cuts[1:]):
            if held and exports[a] != current:
                yield _piece(held, shard, first, False)
                held, first = [], False
            current = exports[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield _piece(held, shard, first, True)
