"""Rows that fail to parse: told apart with a reason, all others loaded as typed ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators.joins import salted_join
from quotemill.session import stored

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DATE = r"^[0-9]{4}\.[0-9]{2}\.[0-9]{2}\z"
TIME = r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,3})?\z"
FLAG_BITS = 2 + 4 + 8 + 16 + 32 + 64
BROADCAST_BYTES = 32 * 1024 * 1024  # lookups up to this size, measured, are sent to all tasks; larger ones are joined by a shuffle
COLUMNS = ("date", "time", "bid", "ask", "last", "volume", "flags")


def _unquoted(field: Column) -> Column:
    """The content of a field that double quotes enclose, else the field."""
    return F.when(field.startswith('"') & field.rlike(r'^"[^"]*"\z'), field.substr(F.lit(2), F.length(field) - 2)).otherwise(field)


def split_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines with source_row >= 2, each with its file's header names and its own fields.

    The header line's delimiter is the tab if it holds one, else the comma. A file without a header line takes the names
    and the delimiter of ``files``. A final carriage return and, on a header, a byte-order mark are taken off.
    """
    body = F.regexp_replace("line", r"\r\z", "")
    head = lines.where((F.col("source_row") == 1) & F.col("line").isNotNull() & F.col("file_id").isNotNull()).select("file_id", F.regexp_replace(body, "^﻿", "").alias("head"))
    head = head.groupBy("file_id").agg(F.min("head").alias("head"))
    known = files.where("file_id is not null").groupBy("file_id").agg(F.min("delimiter").alias("stated"), F.min("column_names").alias("stated_names"))
    delimiter = F.when(F.col("head").contains("\t"), "\t").when(F.col("head").contains(","), ",").otherwise(F.col("stated"))
    names = F.coalesce(F.split("head", F.concat(F.lit("["), F.col("delimiter"), F.lit("]")), -1), F.col("stated_names"))
    layout = (
        head.join(known, "file_id", "full")
        .withColumn("delimiter", delimiter)
        .select("file_id", "delimiter", F.transform(names, lambda x: F.lower(F.regexp_replace(_unquoted(x), "[<>]", ""))).alias("names"))
        .where(F.col("delimiter").isin("\t", ",") & F.col("names").isNotNull())
    )
    layout = stored(layout, "line-layouts")
    rows = lines.where("source_row >= 2").select("file_id", "source_row", "line", body.alias("body"))
    size = layout.agg(F.sum(F.lit(64) + F.length(F.concat_ws(",", "names")))).first()[0] or 0
    joined = rows.join(F.broadcast(layout), "file_id", "left") if size <= BROADCAST_BYTES else salted_join(rows, layout, ["file_id"], F.col("source_row"))
    fields = F.when(F.col("delimiter") == "\t", F.split("body", "\t", -1)).otherwise(F.split("body", ",", -1))
    plain = F.when(F.col("body").contains('"'), F.transform("raw_fields", _unquoted)).otherwise(F.col("raw_fields"))
    return joined.withColumn("raw_fields", fields).withColumn("fields", plain).withColumn("count_ok", F.size("fields") == F.size("names"))


def _real_day(value: Column) -> Column:
    """Whether yyyy.MM.dd, of that shape, is a day of the calendar."""
    y, m, d = (value.substr(a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= days)


def invalid_reason(kind: Column, value: Column) -> Column:
    """Why a value is none of its column's, or null if it is. Unknown columns take any value."""
    number = F.when(value.rlike(NUMBER), value).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    flags = F.when(value.rlike(r"^[0-9]{1,3}\z"), value).cast("int")
    price = F.when(~value.rlike(NUMBER), "not a number").when(~finite, "not finite").when(number <= 0, "not positive")
    size = F.when(value == "", None).when(~value.rlike(NUMBER), "not a number").when(~finite, "not finite").when(number < 0, "negative")
    return (
        F.when(kind == "date", F.when(~value.rlike(DATE), "date not yyyy.MM.dd").when(~_real_day(F.when(value.rlike(DATE), value)), "no real day"))
        .when(kind == "time", F.when(~value.rlike(TIME), "time not HH:mm:ss with at most three decimals"))
        .when(kind.isin("bid", "ask"), price)
        .when(kind.isin("last", "volume"), size)
        .when(kind == "flags", F.when(flags.isNull(), "flags not one to three digits").when(flags.bitwiseAND(F.lit(~FLAG_BITS)) != 0, "unknown flag bits"))
    )


def checked_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines with source_row >= 2, split once and written: structural says what is wrong with a line as a whole (null: nothing),
    cells are its fields with their column, crossed whether ask lies below bid. All further steps read this table, not the lines."""
    stray = F.col("body").contains('"') & F.exists("raw_fields", lambda x: x.contains('"') & ~x.rlike(r'^"[^"]*"\z'))
    reason = F.when(F.col("names").isNull(), "no header").when(F.col("line").isNull(), "null line").when(stray, "broken quoting").when(~F.col("count_ok"), "wrong column count")
    d = split_lines(lines, files).withColumn("structural", reason)
    pairs = F.arrays_zip(F.col("names").alias("kind"), F.col("fields").alias("value"))
    d = d.withColumn("cells", F.when(F.col("structural").isNull(), F.filter(pairs, lambda c: c["kind"].isin(*COLUMNS))))
    crossed = F.coalesce(_field("ask").try_cast("double") < _field("bid").try_cast("double"), F.lit(False))
    return stored(d.select("file_id", "source_row", "structural", "cells", crossed.alias("crossed")), "checked-lines")


def _field(name: str) -> Column:
    """A line's first field of a column; null where its file lacks the column."""
    return F.get(F.filter("cells", lambda c: c["kind"] == name), F.lit(0))["value"]


def _rejects(checked: DataFrame) -> DataFrame:
    cells = checked.where("structural is null").select("file_id", "source_row", F.posexplode("cells").alias("at", "cell"))
    cells = cells.select("file_id", "source_row", "at", F.col("cell.kind").alias("kind"), F.col("cell.value").alias("value"))
    distinct = cells.select("kind", "value").distinct()
    dictionary = stored(distinct.withColumn("why", invalid_reason(F.col("kind"), F.col("value"))).where("why is not null"), "invalid-values")
    size = dictionary.agg(F.sum(F.lit(128) + F.length("value"))).first()[0] or 0
    found = cells.join(F.broadcast(dictionary) if size <= BROADCAST_BYTES else dictionary, ["kind", "value"])
    wrong = found.groupBy("file_id", "source_row").agg(F.min_by(F.concat("kind", F.lit(": "), "why"), "at").alias("reason"))
    crossed = checked.where("crossed").select("file_id", "source_row", F.lit("ask below bid").alias("reason"))
    structural = checked.where("structural is not null").select("file_id", "source_row", F.col("structural").alias("reason"))
    return structural.unionByName(wrong).unionByName(crossed.join(wrong, ["file_id", "source_row"], "left_anti"))


def rejects(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, source_row, reason) of every line with source_row >= 2 that is no valid record.

    Each distinct value of a column is cast once; the invalid ones make a dictionary with reasons, which is joined back to
    the fields. Structural checks stand beside it. Reasons, the first that holds: ``no header`` (neither a header line nor
    a stated layout), ``null line``, ``broken quoting``, ``wrong column count``, ``<column>: <why>`` for the leftmost
    invalid column, ``ask below bid``. Empty lines have a wrong count. Rows with a null file_id have no header; a null
    source_row is no record. Lines are not shuffled: only distinct values and what is wrong are.
    """
    return _rejects(checked_lines(lines, files))


def rejected_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The rejects with their line. Lines of one place (file_id, source_row) are told apart only if it is unique, as it should be."""
    bad = rejects(lines, files)
    a, b = bad.alias("a"), lines.where("source_row >= 2").select("file_id", "source_row", "line").alias("b")
    same = F.col("a.file_id").eqNullSafe(F.col("b.file_id")) & (F.col("a.source_row") == F.col("b.source_row"))
    return a.join(b, same).select("a.file_id", "a.source_row", "a.reason", "b.line")


def loaded_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Typed ticks of the valid lines; local_time is the stamp as written, without zone."""
    checked = checked_lines(lines, files)
    good = checked.where("structural is null and not crossed").join(_rejects(checked), ["file_id", "source_row"], "left_anti")
    stamp = F.concat(F.regexp_replace(_field("date"), r"\.", "-"), F.lit(" "), _field("time"))
    typed = [F.when(F.col(c) != "", F.col(c)).try_cast("int" if c == "flags" else "double").alias(c) for c in COLUMNS[2:]]
    good = good.select("file_id", "source_row", stamp.alias("_s"), *[_field(c).alias(c) for c in COLUMNS[2:]])
    return good.select("file_id", "source_row", F.col("_s").try_cast("timestamp_ntz").alias("local_time"), *typed)
