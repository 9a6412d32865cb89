"""Sources, sinks and streams: round trips and faults."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quotemill.operators import bars as B
from quotemill.sources import bars_csv, documents, generators, ledger, tick_files
from quotemill.streaming import bars as stream_bars


def test_bars_csv_round_trip(spark, tmp_path):
    d = generators.demo_bars(spark, 8)
    bars_csv.write_bars_csv(d, str(tmp_path / "b"))
    good, faults = bars_csv.read_bars_csv(spark, str(tmp_path / "b"), "DEMO")
    assert faults.collect() == []
    cols = good.columns
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, d.select(*cols).collect()))
    with pytest.raises(Exception):
        bars_csv.write_bars_csv(d, str(tmp_path / "b"))


def test_bars_csv_faults(spark, tmp_path):
    ok = "2024-01-01T00:00:00Z,2024-01-01T00:15:00Z,2024-01-01T00:15:00Z,synthetic,1,2,0.5,1,1.1,2.1,0.6,1.1,"
    rows = [ok, ok.replace("T00:", "T01:").replace("00Z,2024", "00,2024", 1), ok.replace("T00:", "T02:").replace("synthetic", "guess"), ok.replace("T00:", "T03:").replace(",1,2,0.5,1,", ",1,0.7,0.5,1,")]
    (tmp_path / "x.csv").write_text(",".join(bars_csv.COLUMNS) + "\n" + "\n".join(rows) + "\n")
    good, faults = bars_csv.read_bars_csv(spark, str(tmp_path / "x.csv"), "X")
    assert good.count() == 1 and sorted(r.code for r in faults.collect()) == ["range", "unreadable", "unreadable"]
    (tmp_path / "y.csv").write_text("a," + ",".join(bars_csv.COLUMNS[1:]) + "\n" + ok + "\n")
    with pytest.raises(Exception):
        bars_csv.read_bars_csv(spark, str(tmp_path / "y.csv"), "X")[0].collect()


def test_tick_files(spark, tmp_path):
    text = "<DATE>\t<TIME>\t<BID>\t<ASK>\t<LAST>\t<VOLUME>\r\n2024.01.01\t00:30:00.5\t1\t2\t\t\r\nbroken\r\n"
    (tmp_path / "a.txt").write_bytes(text.encode("utf-16"))
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "c.txt").write_bytes(b"\xff\x00\xfe")
    lines = tick_files.read_tick_lines(spark, str(tmp_path))
    assert lines.where("fault is null").count() == 6 and lines.where("fault is not null").count() == 1
    found, faults = tick_files.read_ticks(spark, str(tmp_path), 60)
    ticks = found.collect()
    said = sorted((f.path[-5:], f.source_row, f.reason) for f in faults.collect())
    assert said == [("a.txt", 3, "wrong column count"), ("b.txt", 3, "wrong column count"), ("c.txt", 0, "not UTF-8")]
    assert [(t.source_row, t.bid, t.ask, t.ts) for t in ticks] == [(2, 1.0, 2.0, dt.datetime(2023, 12, 31, 23, 30, 0, 500000))] * 2
    with pytest.raises(ValueError):
        tick_files.read_ticks(spark, str(tmp_path), 900)


def test_large_and_broken_tick_files(spark, tmp_path):
    head = "<DATE>,<TIME>,<BID>,<ASK>,<LAST>,<VOLUME>\n"
    row = lambda i: f"2024.01.01,{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d},1,2,,\n"
    big = head + "".join(row(i) for i in range(3000))
    (tmp_path / "big.txt").write_text("\ufeff" + big)
    (tmp_path / "broken.txt").write_bytes(big.encode() + b"\xff\xfe\xff\n")
    (tmp_path / "wide.txt").write_bytes(big.encode("utf-16"))
    (tmp_path / "head.txt").write_text("<TIME>,<DATE>,<BID>,<ASK>,<LAST>,<VOLUME>\n" + row(0))
    (tmp_path / "back.txt").write_text(head + row(5) + row(9) + row(7) + row(9))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # several ranges a file
    try:
        ticks, faults = tick_files.read_ticks(spark, str(tmp_path), 0, whole_bytes=1000)
        rows = ticks.groupBy("file_id").agg(F.count("*").alias("n"), F.min("source_row").alias("a"), F.max("source_row").alias("b"), F.count_if(F.col("source_row") - 2 == F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("placed"))
        assert sorted((r.n, r.a, r.b, r.placed) for r in rows.collect()) == [(4, 2, 5, 0), (3000, 2, 3001, 3000)]
        said = sorted((f.path.rsplit("/")[-1], f.source_row, f.reason) for f in faults.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    unknown = "unknown header"
    assert said == [("back.txt", 4, "steps back in time"), ("broken.txt", 0, "not UTF-8"), ("head.txt", 1, unknown), ("head.txt", 2, unknown), ("wide.txt", 0, "UTF-16 and too large")]


def test_shared_folder_must_be_named_on_a_cluster():
    from quotemill.session import shared_dir

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: "spark://host:7077" if name == "spark.master" else default)

    with pytest.raises(RuntimeError):
        shared_dir(Cluster())


def calendar(**change):
    base = {k: "x" for k in documents.CALENDAR_FIELDS} | {"id": "C", "coverage_start": "2024-01-01T00:00:00Z", "coverage_end": "2024-01-02T00:00:00+00:00", "closures": [{"start": "2024-01-01T01:00:00Z", "end": "2024-01-01T02:00:00Z", "reason": "r"}]}
    return base | change


def test_calendar_document(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(calendar()))
    assert documents.calendar_table(spark, str(path)).collect()[0].closure_end == dt.datetime(2024, 1, 1, 2)
    faults = [calendar(more=1), calendar(coverage_end="2024-01-01T00:00:00Z"), calendar(coverage_start="2024-01-01T00:00:00"), calendar(closures=calendar()["closures"] * 2), calendar(closures=[{"start": "2023-01-01T01:00:00Z", "end": "2024-01-01T02:00:00Z", "reason": "r"}])]
    for c in faults:
        path.write_text(json.dumps(c))
        with pytest.raises(documents.DocumentError):
            documents.load_calendar(str(path))
    for raw in ('{"a": 1, "a": 2}', '{"a": NaN}', "[]", "{"):
        path.write_text(raw)
        with pytest.raises(documents.DocumentError):
            documents.load_json(str(path))
    assert documents.fingerprint({"b": 1, "a": [2]}) == documents.fingerprint({"a": [2], "b": 1})


def test_manifest(spark):
    d = generators.demo_bars(spark, 12).where(F.col("start_us") != 1_704_067_200_000_000 + 5 * 900_000_000)
    first = 1_704_067_200_000_000
    m = {"row_count": 11, "start_us": first, "end_us": first + 12 * 900_000_000, "known_gaps": [[first + 5 * 900_000_000, first + 6 * 900_000_000]]}
    assert documents.manifest_faults(d, m) == []
    assert documents.manifest_faults(d, m | {"row_count": 12, "known_gaps": [[0, 1]]}) == ["row_count", "undeclared_gap", "unobserved_gap"]


def test_ledger_and_publish(spark, tmp_path):
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, n int")
    path = str(tmp_path / "ledger")
    assert ledger.append_runs(spark, path, runs) == 2
    with pytest.raises(ValueError):
        ledger.append_runs(spark, path, runs.where("n = 1"))
    with pytest.raises(ValueError):
        ledger.append_runs(spark, path, runs.withColumn("run_id", F.lit("c")))
    assert spark.read.json(path).count() == 2
    ledger.publish({"x": runs, "y": runs}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "y")).count() == 2
    with pytest.raises(FileExistsError):
        ledger.publish({"x": runs}, str(tmp_path / "out"))
    with pytest.raises(Exception):
        ledger.publish({"x": runs, "y": runs.withColumn("z", F.raise_error(F.lit("no")))}, str(tmp_path / "half"))
    assert not (tmp_path / "half").exists()


def test_stream_equals_batch(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    rows = events.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("source_row"), (F.lit(2000.0) + F.col("value")).alias("bid")).withColumn("ask", F.col("bid") + F.lit(0.26))
    # two late files would be dropped, so the stream gets the rows in order, and a last row that seals all others
    end = rows.agg(F.max("ts")).first()[0] + dt.timedelta(days=1)
    last = spark.createDataFrame([("end", end, 0, 1.0, 2.0)], rows.schema)
    rows.unionByName(rows.limit(50)).write.parquet(str(tmp_path / "in" / "a"))
    last.write.parquet(str(tmp_path / "in" / "b"))
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = stream_bars.run_to_end(stream_bars.bars_of_stream(source), "bars_out", str(tmp_path / "check")).where("instrument <> 'end'")
    want = B.ticks_to_bars(B.ticks_of_events(events))
    cols = ["instrument", *[f"{s}_{p}" for s in ("bid", "ask") for p in B.PRICES], "tick_count"]
    a = sorted((F_ := tuple(r)) for r in got.select(F.unix_micros("start_time").alias("start_us"), *cols).collect())
    assert a == sorted(tuple(r) for r in want.select("start_us", *cols).collect()) and F_ is not None


def test_sealed_groups_and_late_rows(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "instrument string, start_time timestamp, available_at timestamp"
    spark.createDataFrame([("X", t(0), t(15)), ("X", t(1), t(15)), ("X", t(15), t(30)), ("X", t(30), t(45))], schema).write.parquet(str(tmp_path / "o"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "o"))
    got = stream_bars.run_to_end(stream_bars.sealed_groups(source), "groups_out", str(tmp_path / "check"))
    assert sorted((r.available_at.minute, r.n) for r in got.collect()) == [(15, 2), (30, 1)]
    late = stream_bars.late_rows(spark.createDataFrame([("X", t(0), t(10)), ("X", t(31), t(50))], schema), spark.createDataFrame([("X", t(30))], "instrument string, sealed_through timestamp"))
    assert late.count() == 1
