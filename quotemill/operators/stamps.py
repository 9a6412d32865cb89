"""Mixed timestamp formats and time zones, brought to one UTC instant or to a stated doubt."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.operators.joins import salted_join
from quotemill.session import stored

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
# Abbreviations of civil time with their offsets in minutes. Where one is used on several continents, the
# zone that the source's rule names decides, and without it the stamp stays undetermined.
ABBREVIATIONS = {
    "UTC": {"": 0}, "GMT": {"": 0}, "Z": {"": 0}, "WET": {"": 0}, "WEST": {"": 60}, "CET": {"": 60}, "CEST": {"": 120}, "EET": {"": 120}, "EEST": {"": 180}, "MSK": {"": 180},
    "JST": {"": 540}, "KST": {"": 540}, "HKT": {"": 480}, "SGT": {"": 480}, "AEST": {"": 600}, "AEDT": {"": 660}, "ACST": {"": 570}, "ACDT": {"": 630}, "AWST": {"": 480}, "NZST": {"": 720}, "NZDT": {"": 780}, "WAT": {"": 60}, "CAT": {"": 120}, "EAT": {"": 180}, "SAST": {"": 120},
    "EST": {"": -300}, "EDT": {"": -240}, "CDT": {"": -300}, "MDT": {"": -360}, "PST": {"": -480}, "PDT": {"": -420}, "MST": {"": -420},
    "CST": {"America": -360, "Asia": 480}, "IST": {"Asia": 330, "Europe": 60}, "BST": {"Europe": 60, "Asia": 360},
}
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
ZONE = r"\s*(Z|[+-]\d{2}:?\d{2}|[A-Z]{3,4})?\Z"
# name, pattern, groups of (year, month, day, hour, minute, second, fraction, half of the day, zone); 0: none
FORMATS = (
    ("ymd", r"^(\d{4})([-./])(\d{1,2})\2(\d{1,2})[T ]" + CLOCK + ZONE, (1, 3, 4, 5, 6, 7, 8, 0, 9)),
    ("compact", r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?" + ZONE, (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    ("day_name_first", r"^(?:([A-Z][a-z]{2}), )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) " + CLOCK + ZONE, (4, 3, 2, 5, 6, 7, 8, 0, 9)),
    ("month_name_first", r"^([A-Z][a-z]{2}) (\d{1,2}), (\d{4}) " + CLOCK + r"(?: ([AP]M))?" + ZONE, (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    ("slash_day_first", r"^(\d{1,2})/(\d{1,2})/(\d{4}) " + CLOCK + r"(?: ([AP]M))?" + ZONE, (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    ("slash_month_first", r"^(\d{1,2})/(\d{1,2})/(\d{4}) " + CLOCK + r"(?: ([AP]M))?" + ZONE, (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    ("epoch", r"^(\d{9,10})(?:\.(\d{1,9}))?\Z", None),
    ("epoch_ms", r"^(\d{12,13})\Z", None),
    ("epoch_us", r"^(\d{15,16})\Z", None),
)
BROADCAST_BYTES = 32 * 1024 * 1024  # what files state is sent to all tasks up to this size, else joined by a salted shuffle
SLASHED = (4, 5)
EPOCH = 6
WEEKDAYS = "Mon Tue Wed Thu Fri Sat Sun".split()


PARSED = "record_id long, file_id long, raw_timestamp string, kind int, main long, swapped long, zone_text string"


def _readings() -> Callable[[str], tuple[int, int | None, int | None, str] | None]:
    """A function that reads one stamp: the number of its format, its wall clock in microseconds as if in UTC (null if there is no
    such day or time), the same with day and month exchanged if slashed, and the zone as written. None if no format fits."""
    import datetime as dt
    import re

    forms = [(k, re.compile(pattern, re.ASCII).match, groups) for k, (_, pattern, groups) in enumerate(FORMATS) if k != SLASHED[1]]
    months = {m: i + 1 for i, m in enumerate(MONTHS)}
    epoch_day = dt.date(1970, 1, 1).toordinal()

    def micros(digits: str | None) -> int:
        return int((digits or "").ljust(6, "0")[:6])

    def wall(year: int, month: int, day: int, clock: tuple[int, int, int, int, str]) -> int | None:
        hour, minute, second, fraction, half = clock
        if half:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if half == "PM" else 0)
        if hour > 23 or minute > 59 or second > 59:
            return None
        try:
            days = dt.date(year, month, day).toordinal() - epoch_day
        except ValueError:
            return None
        return (((days * 24 + hour) * 60 + minute) * 60 + second) * 1_000_000 + fraction

    def read(text: str) -> tuple[int, int | None, int | None, str] | None:
        text = text.strip(" ")
        for k, match, groups in forms:
            m = match(text)
            if m:
                break
        else:
            return None
        if k >= EPOCH:
            at = int(m[1]) * (1_000_000, 1000, 1)[k - EPOCH] + (micros(m[2]) if k == EPOCH else 0)
            return k, at, None, ""
        year, month, day, hour, minute, second, fraction, half, zone = (m[g] if g else None for g in groups)
        month = months.get(month, 0) if month.isalpha() else int(month)
        clock = (int(hour), int(minute), int(second or 0), micros(fraction), half or "")
        main = wall(int(year), month, int(day), clock)
        if k == 2 and m[1] and main is not None and WEEKDAYS[(main // 86_400_000_000 + 3) % 7] != m[1]:
            main = None  # a weekday must be the day's own
        return k, main, wall(int(year), int(day), month, clock) if k == SLASHED[0] else None, zone or ""

    return read


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = _readings()
    types = (pa.int32(), pa.int64(), pa.int64(), pa.string())
    for b in batches:
        raw = b.column(2).dictionary_encode()
        nothing = (None,) * 4
        found = [read(t) or nothing for t in raw.dictionary.to_pylist()]
        columns = zip(*found) if found else [()] * 4
        values = [pa.array(v, t).take(raw.indices) for v, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays([*b.columns, *values], names=[x.split()[0] for x in PARSED.split(", ")])


def parsed_stamps(stamps: DataFrame) -> DataFrame:
    """Stamps with every valid reading, each distinct text of a batch read once: kind is the number of the format, null if none fits;
    main and swapped are its wall clocks in microseconds, swapped with day and month exchanged (slashed dates only)."""
    rows = stamps.select(F.col("record_id").cast("long"), F.col("file_id").cast("long"), F.col("raw_timestamp").cast("string"))
    return rows.mapInArrow(_parse, PARSED)


def signature() -> Column:
    """The bits of the formats in which a stamp is a valid reading."""
    main = F.when(F.col("main").isNotNull(), F.expr("shiftleft(1, kind)")).otherwise(0)
    return main + F.when(F.col("swapped").isNotNull(), 1 << SLASHED[1]).otherwise(0)


def mixture_weights(signatures: np.ndarray, counts: np.ndarray, orders: np.ndarray, source: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Expectation-maximisation for the format weights of several sources at once; one row of weights per source.

    A value gives likelihood 1 under each format in which it is a valid reading. Counts enter as signatures (bits of the valid
    formats) with their number; source is the number of each row's source, 0 and up without gaps. orders has per source the
    stated order of slashed dates, ``day``, ``month`` or None: the other order's weight is 0.
    """
    k, n = len(FORMATS), len(orders)
    can = (signatures[:, None] >> np.arange(k) & 1).astype(float)
    allowed = np.ones((n, k))
    allowed[orders == "day", SLASHED[1]] = 0
    allowed[orders == "month", SLASHED[0]] = 0
    weights = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        joint = can * weights[source]
        total = joint.sum(axis=1, keepdims=True)
        share = np.divide(joint, total, out=np.zeros_like(joint), where=total > 0) * counts[:, None]
        mass = np.stack([np.bincount(source, share[:, f], n) for f in range(k)], axis=1) * allowed + 1e-9 * allowed
        new = mass / mass.sum(axis=1, keepdims=True)
        done = np.abs(new - weights).max() < 1e-12
        weights = new
        if done:
            break
    return weights


WEIGHTS_DDL = "file_id long, weights array<double>"


def _weights_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weights of the sources of one partition, which is ordered by file_id; a source cut by a batch's end waits for the next."""

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        source, files = pd.factorize(pdf.file_id)
        orders = pdf.slash_order.to_numpy(dtype=object)[np.unique(source, return_index=True)[1]]
        w = mixture_weights(pdf.signature.to_numpy(), pdf.n.to_numpy(), orders, source)
        return pd.DataFrame({"file_id": files, "weights": list(w)})

    held = None
    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf])
        if len(pdf):
            cut = (pdf.file_id != pdf.file_id.iloc[-1]).to_numpy()
            held, ready = pdf[~cut], pdf[cut]
            if len(ready):
                yield solved(ready)
    if held is not None and len(held):
        yield solved(held)


@F.pandas_udf(T.StringType())
def _known_zone(names: pd.Series) -> pd.Series:
    """The name where the time zone data of the Python workers, which also does the arithmetic, has such a zone; else null."""
    import zoneinfo

    there = zoneinfo.available_timezones()
    return names.where(names.isin(there), None)


@F.pandas_udf(T.StructType([T.StructField("early", T.LongType()), T.StructField("late", T.LongType())]))
def _in_zone(local: pd.Series, zone: pd.Series) -> pd.DataFrame:
    """The earlier and later instant at which a zone's clock shows local; null where it doesn't. Both are one if it shows it once."""
    import datetime as dt
    import zoneinfo

    start, unit = dt.datetime(1970, 1, 1), dt.timedelta(microseconds=1)
    clocks: dict = {}
    early: list = []
    late: list = []
    for us, name in zip(local.astype("Int64").tolist(), zone.tolist()):
        a = b = None
        if name is not None and us is not pd.NA:
            if name not in clocks:
                clocks[name] = zoneinfo.ZoneInfo(name)
            try:
                at = (start + dt.timedelta(microseconds=us)).replace(tzinfo=clocks[name])
                first, second = at.utcoffset() // unit, at.replace(fold=1).utcoffset() // unit
                if first >= second:  # else the clock skips it
                    a, b = us - first, us - second
            except OverflowError:
                pass
        early.append(a)
        late.append(b)
    return pd.DataFrame({"early": pd.array(early, dtype="Int64"), "late": pd.array(late, dtype="Int64")})


def read_rules(files: DataFrame) -> DataFrame:
    """Per file what its rule and offset state: rule_zone, rule_offset (minutes ahead of UTC), declared offset, slash_order."""
    rule = F.coalesce("time_normalization_rule", F.lit(""))
    zone = F.regexp_extract(rule, r"\b([A-Z][A-Za-z]+/[A-Z][A-Za-z_\-]+(?:/[A-Z][A-Za-z_\-]+)?)", 1)
    sign, hours, minutes = (F.regexp_extract(rule, r"UTC([+-])(\d{1,2}):?(\d{2})", i) for i in (1, 2, 3))
    clock = F.when(sign != "", F.when(sign == "-", -1).otherwise(1) * (hours.try_cast("int") * 60 + minutes.try_cast("int")))
    ahead, way = (F.regexp_extract(rule, r"(\d+) minutes (ahead of|behind) UTC", i) for i in (1, 2))
    said = F.when(way == "ahead of", ahead.try_cast("int")).when(way == "behind", -ahead.try_cast("int"))
    order = F.when(F.lower(rule).contains("day first"), "day").when(F.lower(rule).contains("month first"), "month")
    offset = F.when(F.col("utc_offset_minutes").between(-18 * 60, 18 * 60), F.col("utc_offset_minutes"))
    one = files.where("file_id is not null").select("file_id", zone.alias("z"), F.coalesce(clock, said).alias("rule_offset"), offset.alias("declared"), order.alias("slash_order"))
    named = one.withColumn("z", F.when(F.col("z") != "", F.col("z"))).dropDuplicates(["file_id"])
    return named.withColumn("rule_zone", _known_zone("z")).drop("z")


def _stamp_offset(zone_text: Column, rule_zone: Column) -> Column:
    """Minutes ahead of UTC that the stamp itself states; null if it states none that is clear."""
    sign = F.when(zone_text.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone_text, "[^0-9]", "")
    h, m = digits.substr(1, 2).try_cast("int"), digits.substr(3, 2).try_cast("int")
    out = F.when(zone_text.rlike("^[+-]"), F.when((h * 60 + m <= 18 * 60) & (m < 60), sign * (h * 60 + m)))
    region = F.substring_index(rule_zone, "/", 1)
    for name, by_region in ABBREVIATIONS.items():
        value = F.lit(by_region[""]) if "" in by_region else F.coalesce(*[F.when(region == r, v) for r, v in by_region.items()])
        out = out.when(zone_text == name, value)
    return out


def normalise_stamps(stamps: DataFrame, files: DataFrame, certainty: float = 0.99) -> DataFrame:
    """record_id, file_id, raw_timestamp, format, posterior, utc_us, status of every stamp.

    status: ``determined`` with utc_us in microseconds; else utc_us is null and status says why: ``null``, ``unreadable``
    (no known notation), ``impossible`` (no such day or time, or no such offset), ``ambiguous format`` (no reading with a
    posterior of ``certainty`` among readings that differ), ``unclear zone name``, ``no zone``, ``skipped`` or ``shown twice``
    by the zone's clock. A zone or offset in the stamp counts first, bare epoch numbers are UTC, then the rule's zone
    or offset, then utc_offset_minutes. Missing seconds are zero; decimals beyond six are cut off. A stamp with a null or
    unknown file_id has only its own zone. Repeated file rows count once; extra columns are left out.
    """
    parsed = stored(parsed_stamps(stamps), "stamps")
    rules = read_rules(files)
    seen = parsed.where("file_id is not null and kind is not null").groupBy("file_id", signature().alias("signature")).agg(F.count("*").alias("n"))
    stated = seen.join(rules.select("file_id", "slash_order"), "file_id", "left")
    weights = stated.repartition("file_id").sortWithinPartitions("file_id", "signature").mapInPandas(_weights_of, WEIGHTS_DDL)
    layout = stored(rules.join(weights, "file_id", "full"), "stamp-layouts")
    n_bytes = layout.count() * (64 + 8 * len(FORMATS) + 32)
    rows = parsed.join(F.broadcast(layout), "file_id", "left") if n_bytes <= BROADCAST_BYTES else salted_join(parsed, layout, ["file_id"], F.col("record_id"))
    # the share of each reading; a file without weights leaves all formats even
    share = lambda k, reading: F.when(F.col(reading).isNotNull(), F.coalesce(F.get("weights", k), F.lit(1.0))).otherwise(0.0)
    rows = rows.withColumns({"m": share(F.col("kind"), "main"), "s": share(F.lit(SLASHED[1]), "swapped")}).withColumn("total", F.col("m") + F.col("s"))
    first = F.col("m") >= F.col("s")
    rows = rows.withColumns({
        "at": F.when(F.col("total") > 0, F.when(first, F.col("kind")).otherwise(SLASHED[1])),
        "posterior": F.when(F.col("total") > 0, F.greatest("m", "s") / F.col("total")),
        "local": F.when(F.col("total") > 0, F.when(first, F.col("main")).otherwise(F.col("swapped"))),
        "differ": (F.col("m") > 0) & (F.col("s") > 0) & (F.col("main") != F.col("swapped")),
    })
    names = F.array(*[F.lit(n) for n, _, _ in FORMATS])
    epoch = F.col("at") >= EPOCH
    rows = rows.withColumn("has_zone_text", ~epoch & (F.col("zone_text") != ""))
    rows = rows.withColumn("own", F.when(epoch, 0).when(F.col("has_zone_text"), _stamp_offset(F.col("zone_text"), F.col("rule_zone"))))
    fixed = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("rule_zone").isNull(), F.coalesce("rule_offset", "declared"))
    use_zone = F.col("own").isNull() & F.col("rule_zone").isNotNull() & ~F.col("has_zone_text")
    rows = rows.withColumn("fixed", F.when(~F.col("has_zone_text") | F.col("own").isNotNull(), fixed)).withColumn("use_zone", use_zone)
    rows = rows.withColumn("shown", _in_zone(F.when(F.col("use_zone"), F.col("local")), F.when(F.col("use_zone"), F.col("rule_zone"))))
    rows = rows.withColumn("early", F.col("shown.early")).withColumn("late", F.col("shown.late"))
    status = (
        F.when(F.col("raw_timestamp").isNull(), "null")
        .when(F.col("kind").isNull(), "unreadable")
        .when(F.col("local").isNull(), "impossible")
        .when(F.col("differ") & (F.col("posterior") < certainty), "ambiguous format")
        .when(F.col("has_zone_text") & F.col("own").isNull(), F.when(F.col("zone_text").rlike("^[+-]"), "impossible").otherwise("unclear zone name"))
        .when(F.col("use_zone") & F.col("early").isNull(), "skipped")
        .when(F.col("use_zone") & (F.col("early") != F.col("late")), "shown twice")
        .when(~F.col("use_zone") & F.col("fixed").isNull(), "no zone")
        .otherwise("determined")
    )
    utc = F.when(F.col("use_zone"), F.col("early")).otherwise(F.col("local") - F.col("fixed") * F.lit(60_000_000).cast("long"))
    return rows.withColumn("status", status).select("record_id", "file_id", "raw_timestamp", F.get(names, F.col("at")).alias("format"), "posterior", F.when(F.col("status") == "determined", utc).alias("utc_us"), "status")
