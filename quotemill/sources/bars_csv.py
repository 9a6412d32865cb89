"""Quote bars as CSV: a closed header, explicit offsets, no repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.bars import bar_violations

TIMES = ("start_time", "timestamp", "available_at")
PRICES = tuple(f"{s}_{p}" for s in ("bid", "ask") for p in ("open", "high", "low", "close"))
COLUMNS = (*TIMES, "availability_basis", *PRICES, "volume")
BASES = ("synthetic", "historical_close_assumption", "observed_receipt")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def _instant(text):
    """Microseconds of an ISO stamp with Z or an explicit offset; null for any other."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})\z")
    return F.unix_micros(F.when(shaped, text).try_cast("timestamp"))


def read_bars_csv(spark: SparkSession, path: str, instrument: str) -> tuple[DataFrame, DataFrame]:
    """(bars, faults) of CSV files with exactly the columns COLUMNS.

    Faulty rows are kept apart with their code: ``unreadable`` (a time without offset, an unknown basis, a value that is no
    number) or a code of bar_violations. A wrong header raises. A blank volume is null.
    """
    header = spark.read.option("header", True).option("enforceSchema", False).csv(path, schema=", ".join(f"{c} string" for c in COLUMNS), mode="FAILFAST")
    number = lambda c: F.when(F.col(c).rlike(NUMBER), F.col(c)).try_cast("double")
    d = header.select(
        F.lit(instrument).alias("instrument"), _instant(F.col("start_time")).alias("start_us"), _instant(F.col("timestamp")).alias("end_us"), _instant(F.col("available_at")).alias("available_us"), F.when(F.col("availability_basis").isin(*BASES), F.col("availability_basis")).alias("availability_basis"),
        *[number(c).alias(c) for c in PRICES], number("volume").alias("volume"), (F.col("volume").isNotNull() & (F.col("volume") != "") & number("volume").isNull()).alias("bad_volume"),
    )
    broken = F.col("bad_volume")
    for c in ("start_us", "end_us", "available_us", "availability_basis", *PRICES):
        broken = broken | F.col(c).isNull()
    good = d.where(~broken).drop("bad_volume")
    faults = d.where(broken).select("instrument", "start_us", F.lit("unreadable").alias("code")).unionByName(bar_violations(good))
    return good.join(faults.select("instrument", "start_us").distinct(), ["instrument", "start_us"], "left_anti"), faults


def write_bars_csv(bars: DataFrame, path: str) -> None:
    """Write bars with the columns COLUMNS, times in ISO form with Z; an existing path is an error."""
    iso = lambda c: F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.timestamp_micros(c), F.current_timezone()), "UTC"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    out = bars.select(iso("start_us").alias("start_time"), iso("end_us").alias("timestamp"), iso("available_us").alias("available_at"), "availability_basis", *PRICES, "volume")
    out.write.mode("errorifexists").option("header", True).csv(path)
