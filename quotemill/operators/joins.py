"""Join helpers: salted lookups, as-of joins and interval joins without cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 8) -> DataFrame:
    """Join a large table to a lookup with unique keys, a hot key's rows spread over ``salts`` tasks by ``spread``.

    Rows with a null key match nothing.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


AS_OF_SLOT_US = 30 * 86_400_000_000


def as_of_latest(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    rank: list[str],
    value: list[str],
    inclusive: bool = True,
    slot: int = AS_OF_SLOT_US,
) -> DataFrame:
    """Add to each left row the right row of highest ``rank`` among those visible by its time.

    A late arrival of an older rank doesn't replace a newer one. Both sides are united and cut into slots of time, so that a hot key
    is spread over its slots; in a slot the running maximum of (rank, value) is read at the left rows, and the maximum of
    all earlier slots, one row per key and slot, is carried in. Null where nothing is visible; a null time sees and shows nothing.
    """
    best = F.struct(*rank, *[v for v in value if v not in rank])
    first, second = (1, 0) if inclusive else (0, 1)  # at equal times
    in_slot = F.floor(F.col("_time") / F.lit(slot)).alias("_slot")
    names = [f"_k{i}" for i in range(len(keys))]
    key = [F.col(k).alias(n) for k, n in zip(keys, names)]
    lefts = left.select(*key, F.col(left_time).alias("_time"), F.lit(first).alias("_side"), F.struct(*left.columns).alias("_row"))
    rights = right.where(F.col(right_time).isNotNull()).select(*key, F.col(right_time).alias("_time"), F.lit(second).alias("_side"), best.alias("_best"))
    d = lefts.unionByName(rights, allowMissingColumns=True).select("*", in_slot)
    # the best of all slots before a slot: one row per key and slot, however many rows there are
    before = F.max("_best").over(Window.partitionBy(*names).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    carried = d.groupBy(*names, "_slot").agg(F.max("_best").alias("_best")).withColumn("_carried", before).where("_carried is not null")
    carried = carried.select(F.struct(*names, "_slot").alias("_key"), "_carried")
    w = Window.partitionBy(*names, "_slot").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_seen", F.max("_best").over(w)).where(F.col("_row").isNotNull())
    d = d.join(carried, [F.col(n).eqNullSafe(F.col(f"_key.{n}")) for n in [*names, "_slot"]], "left")
    newer = F.col("_carried").isNull() | F.col("_time").isNull() | (F.col("_seen") >= F.col("_carried"))
    d = d.withColumn("_top", F.when(newer, F.col("_seen")).otherwise(F.col("_carried")))
    return d.select("_row.*", *[F.col(f"_top.{v}").alias(v) for v in value])


def interval_join(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Join points to the half-open ranges that hold them, by an equi-join on time slots of ``width``.

    A range is repeated once per slot it touches, so width should be of the order of the ranges' length.
    """
    slots = F.sequence(F.floor(F.col(start) / F.lit(width)), F.floor((F.col(end) - 1) / F.lit(width)))
    r = ranges.where(F.col(start) < F.col(end)).withColumn("_slot", F.explode(slots))
    p = points.withColumn("_slot", F.floor(F.col(point) / F.lit(width)))
    condition = [p[k] == r[k] for k in [*keys, "_slot"]] + [p[point] >= r[start], p[point] < r[end]]
    return p.join(r, condition, how).select(*[p[c] for c in points.columns], *[r[c] for c in ranges.columns if c not in keys])


def merge_intervals(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching ranges of a key united; empty and null ones are left out."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col(start) > F.max(end).over(w)).cast("int"), F.lit(1))
    d = ranges.where(F.col(start) < F.col(end)).withColumn("_new", new).withColumn("_island", F.sum("_new").over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def set_difference_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side`` left or right; equal inputs give none."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
