"""Filling containers of fixed capacity with texts, by balanced attention cost."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.tokens import VOCABULARY, numbered, with_tokens
from quotemill.session import stored

BLOCK_ITEMS = 4096
MAX_KINDS = 1000
QUADRATIC = 1 / 4096  # cost of a text of n tokens: n + QUADRATIC * n * n; at 4,096 tokens both terms are equal
PACKED_DDL = "container_kind string, capacity_tokens int, container_id string, doc_id long, part int, start_token int, n_tokens int"


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each size. In descending order, each goes to the container of lowest cost that still has room.

    There are as many containers as the sizes need at least; one more is opened only when none has room. Ties go to the
    earlier item and the earlier container.
    """
    out = np.zeros(len(sizes), np.int64)
    least = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(2 * len(sizes) + least, capacity, np.int64)
    cost = np.zeros(len(room))
    n = least
    for i in np.argsort(-sizes, kind="stable"):
        s = sizes[i]
        at = int(np.argmin(np.where(room[:n] >= s, cost[:n], np.inf)))
        if room[at] < s:
            at = n
            n += 1
        out[i] = at
        room[at] -= s
        cost[at] += s + QUADRATIC * float(s) * float(s)
    return out


def pack_documents(
    documents: DataFrame, limits: DataFrame, path: str = VOCABULARY, block_items: int = BLOCK_ITEMS, max_kinds: int = MAX_KINDS
) -> DataFrame:
    """Every document in containers of every capacity: container_kind, capacity_tokens, container_id, doc_id, part, start_token, n_tokens.

    A text that alone exceeds the capacity is split into parts of the full capacity, each filling a container, and a rest;
    no other text is split. The remaining items are dealt by hash, the same at every run and partitioning, to blocks of about
    ``block_items``, which are packed independently: the last containers of a block are the only space that blocks cost.
    An empty text takes no room and shares a container; a null text is left out, as is a null or not positive capacity. Rows of one
    doc_id are items of their own. container_id is unique within its kind and capacity: ``block-place``, or ``d`` with document, size,
    number among equals and part for a full part of a long text. More than ``max_kinds`` kinds are done in parts. Extra columns are left out.
    """
    sized = with_tokens(documents, keep=["doc_id"], path=path).where("n_tokens is not null")
    sized = stored(numbered(sized, ["doc_id", "n_tokens"]), "token-sizes")
    wanted = limits.where("capacity_tokens > 0 and container_kind is not null").select("container_kind", "capacity_tokens").distinct()
    n_kinds, n_items = wanted.count(), sized.count()
    parts = 1 if n_kinds <= max_kinds else 2 * -(-n_kinds // max_kinds)
    part = F.pmod(F.xxhash64("container_kind", "capacity_tokens"), F.lit(parts))
    return reduce(DataFrame.unionByName, [_pack(sized, wanted.where(part == k).collect(), n_items, block_items) for k in range(parts)])


def _pack(sized: DataFrame, kinds: list, n_items: int, block_items: int) -> DataFrame:
    """Items packed for a few kinds."""
    if not kinds:
        return sized.sparkSession.createDataFrame([], PACKED_DDL)
    kinds = sorted(kinds)
    each = F.array(*[F.struct(F.lit(k.container_kind).alias("kind"), F.lit(k.capacity_tokens).alias("capacity")) for k in kinds])
    items = sized.withColumn("k", F.explode(each)).select(
        "doc_id", "tie", "n_tokens", F.col("k.kind").alias("container_kind"), F.col("k.capacity").cast("int").alias("capacity_tokens")
    )
    size, capacity = F.col("n_tokens"), F.col("capacity_tokens")
    # full: how many parts fill a container each; the part after them is packed with others
    items = items.withColumn("full", F.floor(size / capacity).cast("int") - F.when((size > 0) & (size % capacity == 0), 1).otherwise(0))
    blocks = max(1, -(-n_items // block_items))
    last = F.col("full")
    rest = items.select(
        "container_kind", "capacity_tokens", "doc_id", "tie", last.alias("part"), (last * capacity).alias("start_token"), (size - last * capacity).alias("n_tokens"),
        F.xxhash64("doc_id", "n_tokens", "tie").alias("dealt"),
    ).withColumn("block", F.pmod("dealt", F.lit(blocks)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dealt", "doc_id", "n_tokens", "tie"])
        own = pack_block(pdf.n_tokens.to_numpy().astype(np.int64), int(pdf.capacity_tokens.iloc[0]))
        block = int(pdf.block.iloc[0])
        pdf["container_id"] = [f"{block}-{i}" for i in own]
        return pdf[["container_kind", "capacity_tokens", "container_id", "doc_id", "part", "start_token", "n_tokens"]]

    packed = rest.groupBy("container_kind", "capacity_tokens", "block").applyInPandas(pack, PACKED_DDL)
    whole = items.where("full > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    name = F.concat(F.lit("d"), F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens", "tie", "part"))
    whole = whole.select(
        "container_kind", "capacity_tokens", name.alias("container_id"), "doc_id", "part", (F.col("part") * capacity).alias("start_token"), capacity.alias("n_tokens")
    )
    return packed.unionByName(whole)


def packing_faults(packed: DataFrame, documents: DataFrame) -> DataFrame:
    """Per kind the documents packed and how often a rule is broken: containers over capacity, texts split though they fit, texts whose
    parts don't cover them, texts packed more or less often than they occur."""
    kind = ["container_kind", "capacity_tokens"]
    over = packed.groupBy(*kind, "container_id").agg(F.sum("n_tokens").alias("used")).groupBy(*kind).agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("n_over_capacity"))
    there = documents.where("text is not null").groupBy("doc_id").agg(F.count("*").alias("copies"))
    per_doc = packed.groupBy(*kind, "doc_id").agg(
        F.sum("n_tokens").alias("size"), F.max("part").alias("last"), F.count("*").alias("parts"), F.count_if(F.col("part") == 0).alias("firsts"),
        F.max(F.col("start_token") + F.col("n_tokens")).alias("end"),
    )
    d = per_doc.join(there, "doc_id", "left")
    one = F.col("copies") == 1
    return (
        d.groupBy(*kind)
        .agg(
            F.sum("firsts").alias("n_documents"),
            F.count_if(one & (F.col("last") > 0) & (F.col("size") <= F.col("capacity_tokens"))).alias("n_split_needlessly"),
            F.count_if(one & ((F.col("end") != F.col("size")) | (F.col("parts") != F.col("last") + 1))).alias("n_not_covered"),
            F.count_if(F.coalesce(F.col("firsts") != F.col("copies"), F.lit(True))).alias("n_wrong_count"),
        )
        .join(over, kind)
    )


def packing_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, filled share of the space, and the largest and mean container cost."""
    each = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"), F.sum(F.col("n_tokens") + QUADRATIC * F.col("n_tokens") * F.col("n_tokens")).alias("cost"))
    return each.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), (F.sum("used") / F.sum("capacity_tokens")).alias("filled_share"), F.max("used").alias("most_used"), F.max("cost").alias("max_cost"), F.avg("cost").alias("mean_cost"))
