"""Commands: exit codes and what they write."""

from pyspark.sql import functions as F

from quotemill.__main__ import main


def test_commands(spark, tmp_path, tiny, capsys):
    csv = str(tmp_path / "demo")
    assert main(["demo-bars", "--output", csv, "--bars", "120"]) == 0
    assert main(["validate-data", "--input", csv, "--instrument", "DEMO"]) == 0
    assert main(["backtest", "--input", csv, "--instrument", "DEMO", "--fast", "3", "--slow", "9"]) == 0
    (tmp_path / "ticks").mkdir()
    line = "2024.01.01,00:{:02d}:00,1.5,1.75,,\n"
    (tmp_path / "ticks" / "a.csv").write_text("<DATE>,<TIME>,<BID>,<ASK>,<LAST>,<VOLUME>\n" + "".join(line.format(m) for m in range(20)) + "broken\n")
    out = str(tmp_path / "out")
    assert main(["import-ticks", "--input", str(tmp_path / "ticks"), "--output", out, "--utc-offset-minutes", "0"]) == 1
    made = spark.read.parquet(f"{out}/bars").orderBy("start_us")
    assert [(r.tick_count, r.bid_open, r.ask_close) for r in made.collect()] == [(15, 1.5, 1.75), (5, 1.5, 1.75)]
    assert [r.reason for r in spark.read.parquet(f"{out}/faults").collect()] == ["wrong column count"]
    assert main(["query", "cube_counts", tiny, "--output", f"{out}/cube"]) == 0 and main(["query", "none", tiny]) == 2
    assert spark.read.parquet(f"{out}/cube").agg(F.count("*")).first()[0] > 0
    assert "-- summary" in capsys.readouterr().out
