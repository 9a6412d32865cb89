"""Queries p1 and p3 to p5: training-data preparation of the core, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.bad_rows import loaded_lines, rejected_lines, rejects
from quotemill.operators.grid import regular_grid
from quotemill.operators.implausible import flag_implausible
from quotemill.operators.stamps import normalise_stamps
from quotemill.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return flag_implausible(table(spark, folder, "bid_ask_ticks")).select("tick_id").distinct()


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged ticks by feed and reason; a tick counts once per reason."""
    ticks = table(spark, folder, "bid_ask_ticks")
    found = flag_implausible(ticks).distinct()
    feeds = ticks.select("tick_id", "feed_id").dropDuplicates(["tick_id"])
    return found.join(feeds, "tick_id").groupBy("feed_id", "reason").agg(F.count("*").alias("n_ticks"))


def p1_impossible(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks by feed that no price can be: the part of p1 that needs no forecast."""
    return p1_reasons(spark, folder).where("reason = 'impossible'").select("feed_id", "n_ticks")


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid(table(spark, folder, "bid_ask_ticks"), table(spark, folder, "tick_exports"), table(spark, folder, "session_closures"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).where(F.col("status") == "missing").select("export_id", "bucket_start_us")


def p3_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).select("export_id", "bucket_start_us", "tick_count", "maximum_intertick_seconds", "status", "since_last_tick_us")


def _lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "raw_tick_lines"), table(spark, folder, "raw_tick_files")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects(*_lines(spark, folder)).select("file_id", "source_row")


def p4_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return rejected_lines(*_lines(spark, folder))


def p4_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return loaded_lines(*_lines(spark, folder))


def _stamps(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_stamps(table(spark, folder, "raw_tick_stamps"), table(spark, folder, "raw_tick_files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _stamps(spark, folder).where(F.col("utc_us").isNotNull()).select("record_id", "utc_us")


def p5_stamps(spark: SparkSession, folder: str) -> DataFrame:
    return _stamps(spark, folder)


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_impossible, p3_found, p3_grid, p4_found, p4_rejects, p4_loaded, p5_found, p5_stamps)}

Q = 900_000_000
GRID = f"""WITH t AS (SELECT DISTINCT ON (tick_id) * FROM bid_ask_ticks), b AS (SELECT export_id, s, count(*) n, max(u) last_us, max(gap) mg FROM (SELECT export_id, epoch_us(ts) u, epoch_us(ts)//{Q}*{Q} s, epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY export_id, epoch_us(ts)//{Q} ORDER BY ts, source_row)) gap FROM t) GROUP BY 1,2),
g AS (SELECT export_id, calendar_id, unnest(generate_series((epoch_us(coverage_start)+{Q - 1})//{Q}*{Q}, epoch_us(coverage_end)//{Q}*{Q}-{Q}, {Q})) s FROM tick_exports),
r AS (SELECT g.export_id, g.s bucket_start_us, coalesce(n,0) tick_count, CASE WHEN n>1 THEN mg/1e6 END maximum_intertick_seconds, CASE WHEN n>0 THEN 'observed' WHEN EXISTS (SELECT 1 FROM session_closures c WHERE c.calendar_id=g.calendar_id AND epoch_us(closure_start)<=g.s AND epoch_us(closure_end)>=g.s+{Q}) THEN 'closed' ELSE 'missing' END status,
CASE WHEN n IS NULL THEN g.s-max(last_us) OVER (PARTITION BY g.export_id ORDER BY g.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END since_last_tick_us FROM g LEFT JOIN b ON b.export_id=g.export_id AND b.s=g.s)"""
NUMBER = "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'"
LINES = f"""WITH h AS (SELECT file_id, regexp_replace(regexp_replace(line, '\\r$', ''), '^\\x{{FEFF}}', '') head FROM raw_tick_lines WHERE source_row=1),
l AS (SELECT r.file_id, source_row, CASE WHEN contains(head, chr(9)) THEN chr(9) ELSE ',' END d, head, regexp_replace(line, '\\r$', '') body FROM raw_tick_lines r JOIN h USING (file_id) WHERE source_row>=2),
f AS (SELECT file_id, source_row, len(string_split(head, d)) n, list_transform(string_split(body, d), lambda x: CASE WHEN regexp_full_match(x, '"[^"]*"') THEN x[2:-2] ELSE x END) v FROM l),
c AS (SELECT *, try_cast(v[3] AS DOUBLE) bid, try_cast(v[4] AS DOUBLE) ask, try_cast(v[5] AS DOUBLE) lst, try_cast(v[6] AS DOUBLE) vol FROM f),
k AS (SELECT file_id, source_row, coalesce(len(v)=n AND regexp_full_match(v[1], '[0-9]{{4}}\\.[0-9]{{2}}\\.[0-9]{{2}}') AND try_cast(replace(v[1], '.', '-') AS DATE) IS NOT NULL AND regexp_full_match(v[2], '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]{{1,3}})?')
AND regexp_full_match(v[3], {NUMBER}) AND regexp_full_match(v[4], {NUMBER}) AND isfinite(bid) AND isfinite(ask) AND bid>0 AND ask>=bid AND (v[5]='' OR regexp_full_match(v[5], {NUMBER}) AND isfinite(lst) AND lst>=0) AND (v[6]='' OR regexp_full_match(v[6], {NUMBER}) AND isfinite(vol) AND vol>=0)
AND (n<7 OR regexp_full_match(v[7], '[0-9]{{1,3}}') AND try_cast(v[7] AS INT) & ~126 = 0), false) valid FROM c)"""
WHY_PRICE = """CASE WHEN NOT regexp_full_match({0}, {1}) THEN '{2}: not a number' WHEN {3} IS NULL OR NOT isfinite({3}) THEN '{2}: not finite' WHEN {3}<=0 THEN '{2}: not positive' END"""
WHY_SIZE = """CASE WHEN {0}='' THEN NULL WHEN NOT regexp_full_match({0}, {1}) THEN '{2}: not a number' WHEN {3} IS NULL OR NOT isfinite({3}) THEN '{2}: not finite' WHEN {3}<0 THEN '{2}: negative' END"""
REJECTS = LINES + f""", q AS (SELECT l.file_id, l.source_row, l.body, r.line, string_split(body, d) raw FROM l JOIN raw_tick_lines r ON r.file_id=l.file_id AND r.source_row=l.source_row),
w AS (SELECT c.*, q.line, len(list_filter(raw, lambda x: contains(x, '"') AND NOT regexp_full_match(x, '"[^"]*"')))>0 stray FROM c JOIN q USING (file_id, source_row)),
y AS (SELECT *, CASE WHEN line IS NULL THEN 'null line' WHEN stray THEN 'broken quoting' WHEN len(v)<>n THEN 'wrong column count' ELSE coalesce(
  CASE WHEN NOT regexp_full_match(v[1], '[0-9]{{4}}\\.[0-9]{{2}}\\.[0-9]{{2}}') THEN 'date: date not yyyy.MM.dd' WHEN try_cast(replace(v[1], '.', '-') AS DATE) IS NULL THEN 'date: no real day' END,
  CASE WHEN NOT regexp_full_match(v[2], '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]{{1,3}})?') THEN 'time: time not HH:mm:ss with at most three decimals' END,
  {WHY_PRICE.format("v[3]", NUMBER, "bid", "bid")}, {WHY_PRICE.format("v[4]", NUMBER, "ask", "ask")}, {WHY_SIZE.format("v[5]", NUMBER, "last", "lst")}, {WHY_SIZE.format("v[6]", NUMBER, "volume", "vol")},
  CASE WHEN n<7 THEN NULL WHEN NOT regexp_full_match(v[7], '[0-9]{{1,3}}') THEN 'flags: flags not one to three digits' WHEN try_cast(v[7] AS INT) & ~126 <> 0 THEN 'flags: unknown flag bits' END,
  CASE WHEN ask<bid THEN 'ask below bid' END) END reason FROM w)"""
SQL: dict[str, str] = {
    "p3_found": GRID + " SELECT export_id, bucket_start_us FROM r WHERE status='missing'",
    "p3_grid": GRID + " SELECT * FROM r",
    "p1_impossible": """SELECT feed_id, count(*) n_ticks FROM (SELECT DISTINCT tick_id, feed_id, bid, ask FROM bid_ask_ticks)
        WHERE NOT isfinite(bid) OR NOT isfinite(ask) OR bid<=0 OR ask<=0 OR (NOT isnan(bid) AND NOT isnan(ask) AND ask<bid) GROUP BY 1""",
    "p4_rejects": REJECTS + " SELECT file_id, source_row, reason, line FROM y WHERE reason IS NOT NULL",
    "p4_loaded": REJECTS
    + """ SELECT file_id, source_row, try_cast(replace(v[1], '.', '-')||' '||v[2] AS TIMESTAMP) local_time, bid, ask, lst "last", vol volume,
        CASE WHEN n=7 THEN try_cast(v[7] AS INT) END flags FROM y WHERE reason IS NULL""",
    "p4_found": LINES + " SELECT file_id, source_row FROM k WHERE NOT valid",
}
