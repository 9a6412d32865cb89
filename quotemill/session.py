"""Session defaults, table access and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "quotemill") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors must see.

    Where it is unset a temporary folder serves, but only if all executors run on this machine; elsewhere each would write to a
    disk of its own and a reader would see a part of the rows, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quotemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; ``release`` removes it."""
    return os.path.join(shared_dir(spark), "quotemill-" + spark.conf.get("spark.app.id", "app"))


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Results not yet read depend on them: call it when done with them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors. The schema is passed on, so that an empty table can be read too.
    """
    spark = df.sparkSession
    path = os.path.join(own_dir(spark), f"{label}-{uuid.uuid4().hex}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
