"""Stamps against a plain reading with zoneinfo, row by row."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from quotemill.operators.stamps import FORMATS, SLASHED, mixture_weights, normalise_stamps

UTC = dt.timezone.utc
EPOCH = dt.datetime(1970, 1, 1)
ABBR = {"UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "JST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "Z": 0}


def us(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def plain(raw, rule, offset):
    raw, rule = raw or "", rule or ""
    if re.fullmatch(r"\d{10}(\.\d+)?", raw):
        a, _, b = raw.partition(".")
        return int(a) * 10**6 + int((b + "000000")[:6])
    if re.fullmatch(r"\d{13}", raw):
        return int(raw) * 1000
    if re.fullmatch(r"\d{16}", raw):
        return int(raw)
    text = re.sub(r"^[A-Z][a-z]{2}, (?=\d)", "", raw)
    own = None
    m = re.search(r"\s*([+-]\d\d:?\d\d|Z|[A-Z]{3,4})$", text)
    if m:
        z = m[1]
        own = ABBR[z] if z in ABBR else (1 if z[0] == "+" else -1) * (int(z[1:3]) * 60 + int(z[-2:]))
        text = text[: m.start()]
    text = text.replace(",", ".") if re.match(r"\d{4}-", text) else text
    slash = "%d/%m/%Y" if "day first" in rule else "%m/%d/%Y" if "month first" in rule else None
    days = ["%Y.%m.%d ", "%Y-%m-%d ", "%Y-%m-%dT", "%Y%m%d ", "%d %b %Y ", "%b %d, %Y "] + ([slash + " "] if slash else [])
    local = None
    for d in days:
        for c in ("%H:%M", "%H:%M:%S", "%H:%M:%S.%f", "%H%M%S", "%H%M%S.%f", "%I:%M %p", "%I:%M:%S %p", "%I:%M:%S.%f %p"):
            try:
                local = local or dt.datetime.strptime(text, d + c)
            except ValueError:
                pass
    if local is None:
        return None
    zone = re.search(r"[A-Z][a-z]+/[A-Z][A-Za-z_]+", rule)
    if own is None and zone:
        z, seen = ZoneInfo(zone[0]), set()
        for fold in (0, 1):
            t = local.replace(tzinfo=z, fold=fold).astimezone(UTC)
            if t.astimezone(z).replace(tzinfo=None) == local:
                seen.add(us(t.replace(tzinfo=None)))
        return seen.pop() if len(seen) == 1 else None
    if own is None:
        m = re.search(r"UTC([+-])(\d\d):(\d\d)", rule)
        n = re.search(r"(\d+) minutes (ahead of|behind) UTC", rule)
        own = (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3])) if m else (int(n[1]) if n[2] == "ahead of" else -int(n[1])) if n else offset
    return None if own is None else us(local) - own * 60_000_000


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_against_plain_reading(spark, scale):
    folder = f"/root/testdata/{scale}"
    stamps, files = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("raw_tick_stamps", "raw_tick_files"))
    got = {r.record_id: r.utc_us for r in normalise_stamps(stamps, files).collect()}
    rows = stamps.join(files, "file_id", "left").select("record_id", "raw_timestamp", "time_normalization_rule", "utc_offset_minutes").collect()
    want = {r.record_id: plain(r.raw_timestamp, r.time_normalization_rule, r.utc_offset_minutes) for r in rows}
    wrong = {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]}
    assert not wrong and len(got) == len(want)


STAMPS = "record_id long, file_id long, source_row long, raw_timestamp string, extra int, status string"
FILES = "file_id long, time_normalization_rule string, utc_offset_minutes int, status string"


def run(spark, stamps, files):
    s = spark.createDataFrame([(i, f, 2, raw, 1, "x") for i, (f, raw) in enumerate(stamps)], STAMPS)
    f = spark.createDataFrame([(*x, "y") for x in files], FILES)
    return {r.record_id: (r.utc_us, r.status) for r in normalise_stamps(s, f).collect()}


def test_defined_cases(spark):
    files = [(1, "Server clock follows Europe/Berlin including daylight saving", None), (2, None, 60), (3, None, None), (3, None, None), (4, "follows No/Such", None)]
    stamps = [(1, "2024-03-31 02:30:00"), (1, "2024-10-27 02:30"), (1, "2024-07-01 12:00"), (2, "2024-07-01 12:00"), (3, "2024-07-01 12:00"), (None, "2024-07-01T12:00Z"), (9, "2024-07-01 12:00"), (4, "2024-07-01 12:00"), (2, None), (2, ""), (2, "x" * 100_000), (2, "2024-02-30 00:00:00"), (2, "2024-07-01 12:00:00 CST"), (2, "Mon, 02 Jul 2024 00:00:00 +0000"), (2, "Tue, 02 Jul 2024 00:00:00 +0000"), (2, "2024-07-01 00:00:00+19:00")]
    noon = us(dt.datetime(2024, 7, 1, 12))
    got = run(spark, stamps, files)
    assert [got[i][1] for i in range(len(stamps))] == ["skipped", "shown twice", "determined", "determined", "no zone", "determined", "no zone", "no zone", "null", "unreadable", "unreadable", "impossible", "unclear zone name", "impossible", "determined", "impossible"]
    assert got[2][0] == noon - 7_200_000_000 and got[3][0] == noon - 3_600_000_000 and got[5][0] == noon


def test_mixture_resolves_slashes_by_their_source(spark):
    clear = [(1, f"{d:02}/03/2024 00:00") for d in range(13, 29)] * 8
    stamps = clear + [(1, "04/05/2024 00:00"), (2, "04/05/2024 00:00"), (2, "05/05/2024 00:00"), (3, "04/05/2024 00:00")]
    got = run(spark, stamps, [(1, None, 0), (2, None, 0), (3, "slashed dates are month first", 0)])
    n = len(clear)
    assert got[n] == (us(dt.datetime(2024, 5, 4)), "determined")
    assert got[n + 1] == (None, "ambiguous format")
    assert got[n + 2] == (us(dt.datetime(2024, 5, 5)), "determined")
    assert got[n + 3] == (us(dt.datetime(2024, 4, 5)), "determined")


def test_weights_sum_to_one():
    w = mixture_weights(np.array([1 << SLASHED[0] | 1 << SLASHED[1], 1 << SLASHED[0], 1]), np.array([5, 3, 2]), np.array([None], object), np.zeros(3, int))[0]
    assert len(w) == len(FORMATS) and abs(w.sum() - 1) < 1e-9 and abs(w[SLASHED[0]] - 0.8) < 1e-6


def test_empty(spark):
    assert run(spark, [], []) == {}
