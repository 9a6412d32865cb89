"""Mixing sources to target weights of the total size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.tokens import VOCABULARY, greedy_subset, numbered, with_tokens
from quotemill.operators.joins import salted_join
from quotemill.session import stored

BLOCK_DOCUMENTS = 2048
MAX_SOURCES = 100_000


def tempered(target: np.ndarray, share: np.ndarray, exponent: float) -> np.ndarray:
    """Weights between the targets (exponent 0) and the sources' own token shares (exponent 1), geometrically."""
    w = np.zeros(len(target))
    on = (target > 0) & (share > 0)
    w[on] = np.exp((1 - exponent) * np.log(target[on]) + exponent * np.log(share[on]))
    return w / w.sum() if w.sum() else w


def entropy(w: np.ndarray) -> float:
    return float(-(w[w > 0] * np.log(w[w > 0])).sum())


def bisect(ok, low: float = 0.0, high: float = 1.0, rounds: int = 60) -> float:
    """The least exponent in [low, high] at which ok holds, if ok holds from some exponent on; high if it never does."""
    if ok(low):
        return low
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high


def plan_mix(
    target: np.ndarray, repeats: np.ndarray, tokens: np.ndarray, budget: int | None = None, target_entropy: float | None = None, stretch: float | None = None
) -> tuple[np.ndarray, float, int]:
    """Weights, exponent and total size.

    Without a budget the total is the largest at which every source that has documents can give its target within its
    repeats, and the exponent is 0: the targets hold. With a larger budget (or ``stretch``, a multiple of that total) the exponent is
    raised by bisection until no source needs more repeats than allowed; at 1 the size is cut instead. With a target entropy the
    exponent is bisected to it.
    """
    share = tokens / max(tokens.sum(), 1)
    most = repeats * tokens

    def largest(w: np.ndarray) -> int:
        on = w > 0
        return int(np.floor((most[on] / w[on]).min() + 1e-3)) if on.any() else 0

    if stretch is not None:
        budget = int(stretch * largest(tempered(target, share, 0)))
    exponent = 0.0
    if target_entropy is not None:
        start, end = entropy(tempered(target, share, 0)), entropy(tempered(target, share, 1))
        exponent = bisect(lambda x: (entropy(tempered(target, share, x)) - target_entropy) * (end - start) >= 0)
    if budget is not None:
        exponent = max(exponent, bisect(lambda x: largest(tempered(target, share, x)) >= budget))
    w = tempered(target, share, exponent)
    size = largest(w)
    return w, exponent, size if budget is None else min(budget, size)


def _raw(exponent: float, total: float) -> Column:
    """A source's weight before it is scaled; null where it has none."""
    on = (F.col("target") > 0) & (F.col("tokens") > 0)
    return F.when(on, F.exp((1 - exponent) * F.ln("target") + exponent * F.ln(F.col("tokens") / F.lit(total))))


GRID = 16  # exponents tried in one pass over the sources


def plan_many(plan: DataFrame, budget: int | None, target_entropy: float | None, stretch: float | None) -> tuple[float, int]:
    """Exponent and size as ``plan_mix`` finds them, for more sources than the driver should hold: each pass over the table of
    sources tries GRID exponents at once, so twelve passes stand for the bisection."""
    total = float(plan.agg(F.sum("tokens")).first()[0] or 1)

    def measured(xs: list[float]) -> list[tuple[float, int]]:
        """Entropy and largest size at each exponent."""
        cells = []
        for i, x in enumerate(xs):
            raw = _raw(x, total)
            cells += [F.sum(raw).alias(f"z{i}"), F.sum(raw * F.ln(raw)).alias(f"e{i}"), F.min(F.col("repeats") * F.col("tokens") / raw).alias(f"m{i}")]
        r = plan.agg(*cells).first()
        out = []
        for i in range(len(xs)):
            z, e, m = r[f"z{i}"], r[f"e{i}"], r[f"m{i}"]
            out.append((math.log(z) - e / z, math.floor(m * z + 1e-3)) if z else (0.0, 0))
        return out

    def first(ok) -> float:
        low, high = 0.0, 1.0
        if ok(*measured([low])[0]):
            return low
        for _ in range(12):
            xs = [low + (high - low) * (i + 1) / GRID for i in range(GRID)]
            at = next((i for i, m in enumerate(measured(xs)) if ok(*m)), GRID - 1)
            low, high = (xs[at - 1] if at else low), xs[at]
        return high

    exponent = 0.0
    if stretch is not None:
        budget = int(stretch * measured([0.0])[0][1])
    if target_entropy is not None:
        (start, _), (end, _) = measured([0.0, 1.0])
        exponent = first(lambda e, _: (e - target_entropy) * (end - start) >= 0)
    if budget is not None:
        exponent = max(exponent, first(lambda _, size: size >= budget))
    size = measured([exponent])[0][1]
    return exponent, size if budget is None else min(budget, size)


def mix_documents(
    documents: DataFrame,
    targets: DataFrame,
    budget: int | None = None,
    target_entropy: float | None = None,
    stretch: float | None = None,
    path: str = VOCABULARY,
    block_documents: int = BLOCK_DOCUMENTS,
    max_sources: int = MAX_SOURCES,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: one row per occurrence of a document: doc_id, source, copy (0 first), n_tokens, order_key.

    Each source gets whole passes over all its documents and one last pass over a random, repeatable selection: blocks of about
    ``block_documents``, taken whole in order until the budget's end falls into one, in which each document is taken that
    still fits. Sorted by order_key the mix is shuffled, one pass after the other within a source. The result is the same at
    every run and partitioning.

    report: per target source: target_share, weight (the share aimed at), max_repeats, documents, available_tokens, mixed_tokens,
    actual_share, exponent. A source without documents or with target 0 has weight 0; the other targets are scaled to a sum of
    1. Documents of a null or unlisted source, and null texts, are in no mix; empty texts cost nothing and come with their
    block. Repeated target rows: the first by share counts. Rows of one doc_id are documents of their own. Up to ``max_sources``
    sources are planned on the driver and sent to all tasks, more by passes over their table and a salted join.
    """
    key = ["doc_id", "source", "n_tokens"]
    sized = with_tokens(documents.where("source is not null and text is not null"), keep=["doc_id", "source"], path=path)
    sized = stored(numbered(sized, key).withColumn("order_hash", F.xxhash64(F.lit("mix"), *key, "tie")), "mix-sizes")
    known = lambda c: F.greatest(F.lit(0.0), F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    plan = wanted.join(totals, "source", "left").select(
        "source",
        known("target_share").alias("target_share"),
        known("max_repeats").alias("repeats"),
        known("tokens").alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
    )
    plan = stored(plan.withColumn("target", F.when(F.col("repeats") > 0, F.col("target_share")).otherwise(0.0)), "mix-plan")
    few = plan.count() <= max_sources
    if few:
        p = plan.orderBy("source").toPandas()
        _, exponent, size = plan_mix(p.target.to_numpy(), p.repeats.to_numpy(), p.tokens.to_numpy(), budget, target_entropy, stretch)
    else:
        exponent, size = plan_many(plan, budget, target_entropy, stretch)
    sums = plan.agg(F.sum("tokens")).first()[0] or 1.0
    raw = _raw(exponent, sums)
    norm = plan.agg(F.sum(raw)).first()[0] or 1.0
    plan = plan.withColumn("weight", F.coalesce(raw / F.lit(norm), F.lit(0.0)))
    goal = F.least(F.col("repeats") * F.col("tokens"), F.rint(F.col("weight") * F.lit(size)))
    plan = plan.withColumn("goal", goal.cast("long")).withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens"))).otherwise(0))
    plan = plan.withColumn("rest", (F.col("goal") - F.col("passes") * F.col("tokens")).cast("long"))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("documents") / block_documents)))
    goals = plan.where("goal > 0").select("source", "passes", "rest", "blocks")

    # block: a uniform share of the hash range, so that blocks are equally likely
    dealt = sized.join(F.broadcast(goals), "source") if few else salted_join(sized, goals, ["source"], F.col("order_hash"), "inner")
    dealt = dealt.withColumn("block", F.pmod(F.shiftright("order_hash", 8), F.col("blocks")))
    shape = [*key, "tie"]
    whole = dealt.where("passes > 0").select(*shape, F.explode(F.sequence(F.lit(0), (F.col("passes") - 1).cast("int"))).alias("copy"))
    sums = dealt.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("block_tokens"))
    before = F.coalesce(F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.withColumn("before", before).withColumn("left", F.col("rest") - F.col("before")).where("left > 0")
    ranges = ranges.select("source", "block", "left", (F.col("left") >= F.col("block_tokens")).alias("all_of_it"))
    taken = dealt.where("rest > 0").join(ranges, ["source", "block"])
    copy = F.col("passes").cast("int").alias("copy")
    entire = taken.where("all_of_it").select(*shape, copy)

    def last_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order_hash", *shape])
        return pdf[greedy_subset(pdf.n_tokens.to_numpy(), int(pdf.left.iloc[0]))][[*shape, "copy"]]

    ddl = "doc_id long, source string, n_tokens int, tie long, copy int"
    partial = taken.where("not all_of_it").select(*shape, copy, "order_hash", "left").groupBy("source").applyInPandas(last_block, ddl)
    mix = whole.unionByName(entire).unionByName(partial)
    mix = stored(mix.select("doc_id", "source", "copy", "n_tokens", F.xxhash64(F.lit("order"), "copy", *key, "tie").alias("order_key")), "mix")
    mixed = mix.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    total = mixed.agg(F.sum("mixed_tokens")).first()[0] or 1
    got = F.coalesce("mixed_tokens", F.lit(0))
    report = plan.join(mixed, "source", "left").select(
        "source", "target_share", "weight", F.col("repeats").cast("int").alias("max_repeats"), "documents", F.col("tokens").cast("long").alias("available_tokens"),
        got.alias("mixed_tokens"), (got / F.lit(total)).alias("actual_share"), F.lit(float(exponent)).alias("exponent"),
    )
    return mix, report.orderBy("source")


def mix_faults(mix: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source the documents in its mix that occur too often, and those that are no documents of the source."""
    limit = targets.where("source is not null").groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    there = documents.where("text is not null and source is not null").groupBy("doc_id", "source").agg(F.count("*").alias("rows"))
    used = mix.groupBy("doc_id", "source").agg(F.count("*").alias("n"))
    d = used.join(there, ["doc_id", "source"], "left").join(limit, "source", "left")
    too_often, strange = F.col("n") > F.col("rows") * F.col("max_repeats"), F.col("rows").isNull()
    per = d.groupBy("source").agg(F.count_if(too_often).alias("n_too_often"), F.count_if(strange).alias("n_strange"))
    return limit.join(per, "source", "left").select("source", "max_repeats", F.coalesce("n_too_often", F.lit(0)).alias("n_too_often"), F.coalesce("n_strange", F.lit(0)).alias("n_strange"))
