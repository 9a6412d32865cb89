"""Tick export files as lines, whatever their encoding, in file order, with every fault beside them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.operators.bad_rows import loaded_lines, rejected_lines

WHOLE_BYTES = 64 * 1024 * 1024  # files up to this size are decoded whole; larger ones are read in ranges of lines
LINES_DDL = "file_id long, source_row long, line string, path string, raw_sha256 string, fault string"
LINE_COLUMNS = [x.split()[0] for x in LINES_DDL.split(", ")]
# The columns of a tick export, the last of them optional.
TICK_HEADER = ("date", "time", "bid", "ask", "last", "volume", "flags")


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import codecs
    import hashlib

    for pdf in frames:
        for file_id, path, content in pdf[["file_id", "path", "content"]].itertuples(index=False):
            raw = bytes(content)
            digest = hashlib.sha256(raw).hexdigest()
            wide = raw.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE))
            try:
                lines = raw.decode("utf-16" if wide else "utf-8-sig").split("\n")
            except UnicodeDecodeError:
                fault = "not UTF-16" if wide else "not UTF-8"
                yield pd.DataFrame([(file_id, 0, None, path, digest, fault)], columns=LINE_COLUMNS)
                continue
            if lines and lines[-1] == "":
                lines.pop()
            row = range(1, len(lines) + 1)
            yield pd.DataFrame({"file_id": file_id, "source_row": row, "line": lines, "path": path, "raw_sha256": digest, "fault": None})


def _lines_in_ranges(spark: SparkSession, path: str, above: int) -> DataFrame:
    """Lines of large UTF-8 files. Each task reads a range of bytes; a line's row is its place in the range plus the lines before it.

    Places come from the scan itself (rows of one range stand in file order), so both reads of the files see the same ones.
    """
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    rows = text.where(F.col("_metadata.file_size") > above).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    broken = ~F.is_valid_utf8("value")
    wide = (F.col("block") == 0) & F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).isin("FFFE", "FEFF")
    ranges = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.bool_or(broken).alias("broken"), F.bool_or(wide).alias("wide"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("path")
    fault = F.when(F.max("wide").over(whole), "UTF-16 and too large").when(F.max("broken").over(whole), "not UTF-8")
    starts = ranges.select("path", "block", "first", before.alias("before"), fault.alias("fault"))
    placed = rows.join(starts, ["path", "block"]).withColumn("source_row", F.col("place") - F.col("first") + F.col("before") + 1)
    good = placed.where("fault is null").withColumn("line", F.when(F.col("source_row") == 1, F.ltrim("value", F.lit("\ufeff"))).otherwise(F.col("value")))
    bad = starts.where("fault is not null and block = 0").select(F.lit(0).cast("long").alias("source_row"), F.lit(None).cast("string").alias("line"), "path", "fault")
    return (
        good.select("source_row", "line", "path", "fault")
        .unionByName(bad)
        .select(F.xxhash64("path").alias("file_id"), "source_row", "line", "path", F.lit(None).cast("string").alias("raw_sha256"), "fault")
    )


def read_tick_lines(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Lines of tick files with their row in the file, its path and hash. file_id is the hash of the path.

    UTF-8 with or without mark and UTF-16 with one are read. Files up to ``whole_bytes`` are decoded whole, one per row, so memory is
    bounded by it; larger UTF-8 files are read in ranges of lines and have no hash. A file in another encoding, and a UTF-16 file too
    large to be decoded whole, give one row 0 with the fault. An empty file gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    uri = F.xxhash64("path").alias("file_id")
    small = files.where(F.col("length") <= whole_bytes).select(uri, "path", "content").mapInPandas(_decode, LINES_DDL)
    if not files.where(F.col("length") > whole_bytes).select("path").head(1):
        return small
    return small.unionByName(_lines_in_ranges(spark, path, whole_bytes))


def _unknown_headers(lines: DataFrame) -> DataFrame:
    """Files whose first line is no known list of columns in its order, under exactly one of the two delimiters."""
    head = lines.where("source_row = 1").withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    tab, comma = F.col("line").contains("\t"), F.col("line").contains(",")
    names = F.split(F.lower(F.regexp_replace("line", "[<>\"]", "")), "[\t,]", -1)
    known = F.lit(False)
    for n in (len(TICK_HEADER) - 1, len(TICK_HEADER)):
        known = known | (names == F.array(*[F.lit(c) for c in TICK_HEADER[:n]]))
    return head.where((tab == comma) | ~known).select("file_id", "path", "source_row", "line", F.lit("unknown header").alias("reason"))


def backward_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks (file_id, source_row) whose time lies before that of an earlier row of their file.

    A file may be large, so the running maximum is carried over chunks of rows: a window inside each chunk and one over the chunks.
    """
    chunk = F.floor(F.col("source_row") / 65536)
    t = ticks.where("ts is not null").withColumn("chunk", chunk)
    inside = Window.partitionBy("file_id", "chunk").orderBy("source_row").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = t.groupBy("file_id", "chunk").agg(F.max("ts").alias("top")).select("file_id", "chunk", F.max("top").over(over).alias("carry"))
    d = t.withColumn("latest", F.max("ts").over(inside)).join(carry, ["file_id", "chunk"])
    return d.where(F.col("ts") < F.greatest("latest", "carry")).select("file_id", "source_row")


def read_ticks(spark: SparkSession, path: str, utc_offset_minutes: int, whole_bytes: int = WHOLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(ticks, faults) of tick files whose clock is a fixed offset ahead of UTC.

    ticks: typed ticks of the valid lines, ts in UTC. faults (file_id, path, source_row, line, reason): whole files that could not be
    read (source_row 0) or whose header is unknown (1; their lines are faults too, never ticks), every line that is no valid record,
    and ticks that step back in time (which stay among the ticks, as their order is the file's).
    """
    if not -840 <= utc_offset_minutes <= 840:
        raise ValueError("utc_offset_minutes is not between -840 and 840")
    lines = read_tick_lines(spark, path, whole_bytes)
    files = spark.createDataFrame([], "file_id long, delimiter string, column_names array<string>")
    unknown = _unknown_headers(lines)
    known = lines.join(unknown.select("file_id"), "file_id", "left_anti")
    shift = F.make_dt_interval(mins=F.lit(utc_offset_minutes))
    ticks = loaded_lines(known, files).withColumn("ts", F.col("local_time") - shift).drop("local_time")
    paths = lines.where("source_row = 1").select("file_id", "path")
    under = lines.where("source_row > 1").join(unknown.select("file_id"), "file_id", "left_semi")
    rejected = rejected_lines(known, files).join(paths, "file_id")
    back = backward_ticks(ticks).join(lines.select("file_id", "source_row", "path", "line"), ["file_id", "source_row"])
    shape = ["file_id", "path", "source_row", "line", "reason"]
    faults = (
        lines.where("fault is not null").withColumnRenamed("fault", "reason").select(*shape)
        .unionByName(unknown.select(*shape))
        .unionByName(under.withColumn("reason", F.lit("unknown header")).select(*shape))
        .unionByName(rejected.select(*shape))
        .unionByName(back.withColumn("reason", F.lit("steps back in time")).select(*shape))
    )
    return ticks, faults
