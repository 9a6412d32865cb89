"""Small JSON documents with closed schemas: session calendars, manifests and run records. They are metadata, read on the driver."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MAX_BYTES = 1024 * 1024
CALENDAR_FIELDS = {"schema", "version", "id", "revision", "provider_name", "provider_legal_entity", "instrument", "product_form", "coverage_start", "coverage_end", "source_reference", "retrieved_at", "closures"}


class DocumentError(ValueError):
    """A document that breaks its schema."""


def load_json(path: str, max_bytes: int = MAX_BYTES) -> dict:
    """A JSON object; repeated keys, NaN and larger files are errors."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise DocumentError("repeated key")
        return dict(items)

    def constant(name):
        raise DocumentError(f"{name} is not allowed")

    raw = Path(path).read_bytes()
    if len(raw) > max_bytes:
        raise DocumentError("too large")
    try:
        out = json.loads(raw, object_pairs_hook=pairs, parse_constant=constant)
    except UnicodeDecodeError as e:
        raise DocumentError("not UTF-8") from e
    except json.JSONDecodeError as e:
        raise DocumentError(f"not JSON: {e}") from e
    if not isinstance(out, dict):
        raise DocumentError("not an object")
    return out


def closed(document: dict, fields: set[str], name: str) -> None:
    if unknown := set(document) - fields:
        raise DocumentError(f"{name}: unknown {sorted(unknown)}")
    if missing := fields - set(document):
        raise DocumentError(f"{name}: missing {sorted(missing)}")


def instant(text: object, name: str) -> dt.datetime:
    try:
        t = dt.datetime.fromisoformat(text) if isinstance(text, str) else None
    except ValueError:
        t = None
    if t is None or t.tzinfo is None:
        raise DocumentError(f"{name}: no time with an offset")
    return t.astimezone(dt.timezone.utc).replace(tzinfo=None)


def load_calendar(path: str) -> tuple[dict, list[tuple[str, dt.datetime, dt.datetime, str]]]:
    """(header, closures) of a session calendar. Closures lie inside the coverage, in order, apart from each other."""
    c = load_json(path)
    closed(c, CALENDAR_FIELDS, "calendar")
    start, end = instant(c["coverage_start"], "coverage_start"), instant(c["coverage_end"], "coverage_end")
    if start >= end:
        raise DocumentError("coverage is empty")
    rows, before = [], None
    for i, x in enumerate(c["closures"]):
        closed(x, {"start", "end", "reason"}, f"closures/{i}")
        a, z = instant(x["start"], f"closures/{i}/start"), instant(x["end"], f"closures/{i}/end")
        if not (start <= a < z <= end) or before is not None and a <= before:
            raise DocumentError(f"closures/{i}: outside the coverage, out of order or not apart")
        before = z
        rows.append((c["id"], a, z, x["reason"]))
    return {k: v for k, v in c.items() if k != "closures"}, rows


def calendar_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(load_calendar(path)[1], "calendar_id string, closure_start timestamp_ntz, closure_end timestamp_ntz, reason string")


def fingerprint(document: object) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def manifest_faults(bars: DataFrame, manifest: dict) -> list[str]:
    """How bars differ from what a manifest states: row_count, start_us, end_us, known_gaps [[start_us, end_us], ...]."""
    from pyspark.sql import functions as F

    from quotemill.operators.bars import gaps

    seen = bars.agg(F.count("*"), F.min("start_us"), F.max("end_us")).first()
    out = [k for k, v in zip(("row_count", "start_us", "end_us"), seen) if manifest[k] != v]
    stated = bars.sparkSession.createDataFrame([tuple(g) for g in manifest["known_gaps"]], "gap_start_us long, gap_end_us long")
    found = gaps(bars).select("gap_start_us", "gap_end_us")
    if not found.exceptAll(stated).isEmpty():
        out.append("undeclared_gap")
    if not stated.exceptAll(found).isEmpty():
        out.append("unobserved_gap")
    return out
