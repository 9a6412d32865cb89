"""An append-only table of run records, and outputs that appear whole or not at all."""

from __future__ import annotations

import fcntl
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def append_runs(spark: SparkSession, path: str, records: DataFrame, lock: str | None = None) -> int:
    """Append records with a new run_id; a known or repeated run_id is an error and nothing is written. Returns how many.

    Writers on one machine exclude each other by a lock file; table formats with transactions need none.
    """
    lock_path = lock or f"{path.removeprefix('file://').rstrip('/')}.lock"
    Path(lock_path).parent.mkdir(parents=True, exist_ok=True)
    with open(lock_path, "w") as handle:
        fcntl.flock(handle, fcntl.LOCK_EX)
        n = records.count()
        if records.select("run_id").distinct().count() != n:
            raise ValueError("repeated or null run_id")
        if os.path.exists(path.removeprefix("file://")):
            known = spark.read.schema(records.schema).json(path)
            if not records.join(known, "run_id", "left_semi").isEmpty():
                raise ValueError("run_id is known")
        records.write.mode("append").json(path)
        return n


def publish(outputs: dict[str, DataFrame], folder: str) -> None:
    """Write several tables as parquet into a new folder that appears whole or not at all. An existing folder is an error."""
    target = Path(folder)
    if target.exists():
        raise FileExistsError(folder)
    stage = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
    try:
        for name, df in outputs.items():
            df.write.parquet(str(stage / name))
        os.rename(stage, target)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
