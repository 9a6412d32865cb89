"""Rejected lines: one case per rule, and the tables against a row-by-row reading."""

import datetime as dt
import math
import re

from quotemill.operators.bad_rows import loaded_lines, rejected_lines

LINES = "file_id long, source_row long, line string, reason string"
FILES = "file_id long, delimiter string, column_names array<string>, names string"
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.A)


def valid(head, line):
    d = "\t" if "\t" in head else ","
    f = (line[:-1] if line.endswith("\r") else line).split(d)
    if len(f) != len(head.split(d)):
        return False
    f = [v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' else v for v in f]
    try:
        dt.datetime.strptime(f[0], "%Y.%m.%d")
        numbers = [float(v) for v in f[2:4]]
        rest = [float(v) for v in f[4:6] if v]
    except ValueError:
        return False
    ok = re.fullmatch(r"[0-9]{4}\.[0-9]{2}\.[0-9]{2}", f[0]) and re.fullmatch(r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,3})?", f[1])
    ok = ok and all(NUMBER.fullmatch(v) for v in f[2:4]) and all(NUMBER.fullmatch(v) for v in f[4:6] if v)
    ok = ok and all(0 < x < math.inf for x in numbers) and numbers[0] <= numbers[1] and all(0 <= x < math.inf for x in rest)
    return bool(ok and (len(f) < 7 or re.fullmatch("[0-9]{1,3}", f[6]) and not int(f[6]) & ~126))


def test_tables(spark, tiny):
    lines, files = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("raw_tick_lines", "raw_tick_files"))
    rows = lines.collect()
    heads = {r.file_id: r.line.lstrip("﻿").rstrip("\r") for r in rows if r.source_row == 1}
    want = {(r.file_id, r.source_row) for r in rows if r.source_row > 1 and not valid(heads[r.file_id], r.line)}
    bad = rejected_lines(lines, files)
    assert {(r.file_id, r.source_row) for r in bad.collect()} == want
    assert loaded_lines(lines, files).where("local_time is not null and bid > 0").count() == sum(r.source_row > 1 for r in rows) - len(want)


def test_reasons(spark):
    head = "﻿<DATE>,<TIME>,<BID>,<ASK>,<LAST>,<VOLUME>,<FLAGS>\r"
    good = "2024.02.29,23:59:59.123,1e2,+100.5,,0,006\r"
    cases = [
        (good, None), ('"2024.02.29","00:00:00","1.","2",".5","","0"', None), ("2023.02.29,00:00:00,1,2,,,0", "date: no real day"), ("2024.2.29,00:00:00,1,2,,,0", "date: date not yyyy.MM.dd"), ("2024.02.29,24:00:00,1,2,,,0", "time: time not HH:mm:ss with at most three decimals"),
        ("2024.02.29,00:00:00,2,1,,,0", "ask below bid"), ("2024.02.29,00:00:00,0,1,,,0", "bid: not positive"), ("2024.02.29,00:00:00,1e999,1,,,0", "bid: not finite"), ("2024.02.29,00:00:00,1,１,,,0", "ask: not a number"), ("2024.02.29,00:00:00,1, 2,,,0", "ask: not a number"), ("2024.02.29,00:00:00,1,2,-1,,0", "last: negative"),
        ("2024.02.29,00:00:00,1,2,,,1", "flags: unknown flag bits"), ("2024.02.29,00:00:00,1,2,,,", "flags: flags not one to three digits"), ("2024.02.29,00:00:00,1,2,,0", "wrong column count"), ('2024.02.29,00:00:00,"1,2,,,0', "broken quoting"), ("", "wrong column count"), (None, "null line"), ("x" * 200_000, "wrong column count"), (good + "\r", "flags: flags not one to three digits"),
    ]
    rows = [(1, 1, head, "x")] + [(1, i + 2, line, "x") for i, (line, _) in enumerate(cases)]
    rows += [(2, 2, good, "x"), (3, 2, "2024.02.29\t00:00:00\t1\t2\t\t", "x"), (None, 5, good, "x"), (1, None, good, "x")]
    files = [(3, "\t", ["<DATE>", "<TIME>", "<BID>", "<ASK>", "<LAST>", "<VOLUME>"], "n"), (2, None, None, "n")]
    bad = {(r.file_id, r.source_row): r.reason for r in rejected_lines(spark.createDataFrame(rows, LINES), spark.createDataFrame(files, FILES)).collect()}
    want = {(1, i + 2): why for i, (_, why) in enumerate(cases) if why} | {(2, 2): "no header", (None, 5): "no header"}
    assert bad == want


def test_empty(spark):
    assert rejected_lines(spark.createDataFrame([], LINES), spark.createDataFrame([], FILES)).collect() == []
