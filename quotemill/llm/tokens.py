"""Sizes of texts in tokens of a public tokenizer, read from files that stay outside the repository."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = os.environ.get("QUOTEMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


# Fixed value: how the byte-level vocabulary cuts a text before its merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoding(path: str):
    """The tokenizer of a rank file; a task makes it once."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens, the size of ``text``; null for a null text, 0 for an empty one. The text itself is left behind."""
    keep = keep or []
    rows = df.select(*keep, df[text].alias("_text"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("n_tokens", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for b in batches:
            encoding = encoding or _encoding(path)
            texts = b.column(len(keep))
            sizes = pa.array([None if t is None else len(encoding.encode_ordinary(t)) for t in texts.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), sizes], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, schema)


TIES_A_STEP = 4096


def numbered(sized: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``sized`` with ``tie``, a number that tells rows of equal ``columns`` apart.

    Rows that are equal in all that counts may trade places, so they are counted (before the shuffle, too) and written out
    again with numbers from 0. Unlike a number given by the partitioning this one is the same at every run.
    """
    counted = sized.groupBy(*columns).agg(F.count("*").alias("_n"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / TIES_A_STEP))  # in two steps: no array grows long
    counted = counted.select(*columns, "_n", F.explode(steps).alias("_step"))
    first = F.col("_step") * TIES_A_STEP
    return counted.select(*columns, F.explode(F.sequence(first, F.least(F.col("_n"), first + TIES_A_STEP) - 1)).alias("tie"))


def greedy_subset(sizes: np.ndarray, budget: int) -> np.ndarray:
    """Which of the sizes, in their order, are taken if each is taken that still fits the budget."""
    out = np.zeros(len(sizes), bool)
    for i, s in enumerate(sizes.tolist()):
        if s <= budget:
            out[i] = True
            budget -= s
    return out
