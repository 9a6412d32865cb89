"""Commands over the library: python -m quotemill <command> --help."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators import backtest, bars, indicators
from quotemill.session import local_session, release, table
from quotemill.sources import bars_csv, generators, tick_files

HOUR, QUARTER = bars.HOUR_US, bars.HOUR_US // 4


def validate_data(spark: SparkSession, a: argparse.Namespace) -> int:
    """Show what is wrong with a bar CSV: rows that cannot be read, broken rules, gaps. 1 if anything but a gap is."""
    good, faults = bars_csv.read_bars_csv(spark, a.input, a.instrument)
    broken = bars.bar_violations(good)
    show("faults", faults)
    show("violations", broken)
    show("gaps", bars.gaps(good))
    show("cadence", bars.cadence(good, a.minutes * 60_000_000))
    return int(bool(faults.head(1) or broken.head(1)))


def import_ticks(spark: SparkSession, a: argparse.Namespace) -> int:
    """Tick files to bars as parquet, with their faults and what was observed per quarter-hour beside them. 1 if there are faults."""
    ticks, faults = tick_files.read_ticks(spark, a.input, a.utc_offset_minutes)
    named = ticks.select(F.lit(a.instrument).alias("instrument"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "source_row", "bid", "ask")
    # a historical file tells nothing about receipt: ticks count as known when they happened, bars at their close
    made = bars.ticks_to_bars(named.withColumn("available_us", F.col("ts_us")), a.minutes * 60_000_000)
    made.write.mode("errorifexists").parquet(f"{a.output}/bars")
    faults.write.mode("errorifexists").parquet(f"{a.output}/faults")
    show("bars", made.groupBy("instrument").agg(F.count("*").alias("n_bars"), F.sum("tick_count").alias("n_ticks"), F.min("start_us").alias("first_us"), F.max("end_us").alias("end_us")))
    show("faults", faults.groupBy("path", "reason").agg(F.count("*").alias("n")))
    return int(bool(faults.head(1)))


def demo(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write demo bars as CSV."""
    bars_csv.write_bars_csv(generators.demo_bars(spark, a.bars), a.output)
    return 0


def run_backtest(spark: SparkSession, a: argparse.Namespace) -> int:
    """Replay the crossing of two averages on a bar CSV and show what it earned."""
    good, faults = bars_csv.read_bars_csv(spark, a.input, a.instrument)
    if faults.head(1) or bars.bar_violations(good).head(1):
        print("the bars are not valid: see validate-data", file=sys.stderr)
        return 1
    costs = backtest.Costs(cash=a.cash, slippage_bps=a.slippage_bps, commission=a.commission, max_drawdown=a.max_drawdown, max_daily_loss=a.max_daily_loss)
    book = backtest.replay(indicators.sma_cross_target(bars.with_mids(good), a.fast, a.slow, a.long_only), costs)
    show("summary", backtest.summary(book, a.cash))
    return 0


def query(spark: SparkSession, a: argparse.Namespace) -> int:
    """Run a registered query on a folder of tables and write it as parquet, or show its first rows."""
    from quotemill.plans import market, problems, signals

    known = problems.QUERIES | market.QUERIES | signals.QUERIES
    if a.name not in known:
        print("one of: " + " ".join(known), file=sys.stderr)
        return 2
    found = known[a.name](spark, a.folder)
    if a.output:
        found.write.mode("errorifexists").parquet(a.output)
    else:
        show(a.name, found)
    return 0


def show(name: str, rows: DataFrame) -> None:
    print(f"-- {name}")
    rows.show(20, False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quotemill")
    commands = top.add_subparsers(required=True)

    def add(name, run, *arguments):
        sub = commands.add_parser(name, help=run.__doc__)
        sub.set_defaults(run=run)
        for flag, how in arguments:
            sub.add_argument(flag, **how)

    text, number, whole = {"required": True}, {"type": float}, {"type": int}
    source, name = ("--input", text), ("--instrument", {"default": "X"})
    add("validate-data", validate_data, source, name, ("--minutes", whole | {"default": 15}))
    add("import-ticks", import_ticks, source, name, ("--output", text), ("--utc-offset-minutes", whole | {"required": True}), ("--minutes", whole | {"default": 15}))
    add("demo-bars", demo, ("--output", text), ("--bars", whole | {"default": 100}))
    limits = [("--max-drawdown", number), ("--max-daily-loss", number), ("--cash", number | {"default": 10_000.0}), ("--slippage-bps", number | {"default": 0.0}), ("--commission", number | {"default": 0.0})]
    add("backtest", run_backtest, source, name, ("--fast", whole | {"default": 12}), ("--slow", whole | {"default": 48}), ("--long-only", {"action": "store_true"}), *limits)
    add("query", query, ("name", {}), ("folder", {}), ("--output", {}))
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.getActiveSession() or local_session()
    try:
        return a.run(spark, a)
    finally:
        release(spark)


if __name__ == "__main__":
    sys.exit(main())
