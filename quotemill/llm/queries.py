"""Queries p2 and p6 to p8: repeated events, containers, mixes and look-alike texts, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.lookalikes import lookalike_classes, lookalike_pairs, normalise_texts
from quotemill.llm.mixing import mix_documents, mix_faults
from quotemill.llm.packing import pack_documents, packing_faults, packing_report
from quotemill.llm.runs import collapse_runs
from quotemill.llm.statements import SQL  # noqa: F401
from quotemill.session import stored, table


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_runs(table(spark, folder, "bid_ask_ticks"), table(spark, folder, "feeds"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).select("first_tick_id", "last_tick_id")


def p2_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).select("export_id", "first_tick_id", "last_tick_id", "n_ticks", "duration_us")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), table(spark, folder, "container_limits"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(p6_packed(spark, folder))


def p6_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Broken rules of the packing, which should be none, and the documents packed."""
    return packing_faults(stored(p6_packed(spark, folder), "packed"), table(spark, folder, "documents"))


def _mix(spark: SparkSession, folder: str, **how) -> tuple[DataFrame, DataFrame]:
    return mix_documents(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), **how)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p7_stretched(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of a mix half as large again as the targets allow: the exponent is bisected to the repetition limits."""
    return _mix(spark, folder, stretch=1.5)[1]


ENTROPY = 1.8  # of the mix's token shares, in nats; between that of the targets and that of the sources' own shares


def p7_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of a mix whose exponent is bisected to a target entropy."""
    return _mix(spark, folder, target_entropy=ENTROPY)[1]


def p7_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Broken rules of the mix, which should be none, by target source."""
    return mix_faults(p7_mix(spark, folder), table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(table(spark, folder, "documents"))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_classes(table(spark, folder, "documents")).select("doc_id", F.col("class").alias("class_id"), "n_alike")


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_texts(table(spark, folder, "documents")).select("doc_id", "form")


ALL = (p2_found, p2_runs, p6_packed, p6_report, p6_faults, p7_mix, p7_shares, p7_stretched, p7_entropy, p7_faults, p8_found, p8_classes, p8_forms)
QUERIES = {f.__name__: f for f in ALL}
