"""Deterministic demo bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def demo_bars(spark: SparkSession, count: int, period_us: int = 900_000_000, start_us: int = 1_704_067_200_000_000, instrument: str = "DEMO") -> DataFrame:
    """Bars of two sine waves on a triangle: close = 2000 + 0.035 tri(i) + 3.2 sin(i/19) + 0.9 sin(i/4)."""
    i = F.col("i").cast("double")
    tri = F.when(F.col("i") < count // 2, F.col("i")).otherwise(count - F.col("i"))
    d = spark.range(count).withColumnRenamed("id", "i")
    d = d.withColumn("close", F.lit(2000.0) + 0.035 * tri + 3.2 * F.sin(i / 19) + 0.9 * F.sin(i / 4))
    d = d.withColumn("open", F.coalesce(F.lag("close").over(Window.orderBy("i")), F.col("close")))
    pad, spread = 0.20 + 0.08 * F.abs(F.sin(i / 6)), 0.26 + 0.03 * (1 + F.sin(i / 11))
    d = d.withColumn("high", F.greatest("open", "close") + pad).withColumn("low", F.least("open", "close") - pad).withColumn("spread", spread)
    sides = [(F.col(p) + sign * F.col("spread") / 2).alias(f"{s}_{p}") for s, sign in (("bid", -1), ("ask", 1)) for p in ("open", "high", "low", "close")]
    begin = F.lit(start_us) + F.col("i") * period_us
    return d.select(F.lit(instrument).alias("instrument"), begin.alias("start_us"), (begin + period_us).alias("end_us"), (begin + period_us).alias("available_us"), F.lit("synthetic").alias("availability_basis"), *sides, (250 + 30 * F.abs(F.sin(i / 8))).alias("volume"), F.lit(4).cast("long").alias("tick_count"))
