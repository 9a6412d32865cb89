"""Containers, mixes and look-alikes: rules, round trips and odd rows."""

import numpy as np
import pytest

from quotemill.llm.lookalikes import lookalike_classes, lookalike_pairs, mapping, normalise_texts, one_form
from quotemill.llm.mixing import entropy, mix_documents, plan_mix, tempered
from quotemill.llm.packing import pack_block, pack_documents, packing_faults, packing_report
from quotemill.llm.tokens import with_tokens

DOCS = "doc_id long, source string, text string, n_tokens int, form string, plain string"
LIMITS = "container_kind string, capacity_tokens int, note string"
TARGETS = "source string, target_share double, max_repeats int, goal int"


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, 0, "f", "p") for i, s, t in rows], DOCS)


def test_pack_block_never_overfills():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 400):
        sizes = rng.integers(0, 101, n)
        at = pack_block(sizes, 100)
        used = np.bincount(at, sizes) if n else np.zeros(0)
        assert (used <= 100).all() and used.sum() == sizes.sum()
    assert used.sum() / (100 * len(used)) > 0.95


def test_packing_tables(spark, tiny):
    d, limits = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/container_limits.parquet")
    size = {r.doc_id: r.n_tokens for r in with_tokens(d, keep=["doc_id"]).collect()}
    packed = pack_documents(d, limits, block_items=64).toPandas()
    for (kind, cap), g in packed.groupby(["container_kind", "capacity_tokens"]):
        assert (g.groupby("container_id").n_tokens.sum() <= cap).all()
        per_doc = g.sort_values("part").groupby("doc_id").agg(n=("n_tokens", "sum"), parts=("part", "count"), last=("part", "max"))
        assert per_doc.n.to_dict() == size
        assert ((per_doc.parts == 1) | (per_doc.n > cap)).all() and (per_doc["last"] + 1 == per_doc.parts).all()
        for _, p in g[g.doc_id.isin(per_doc.index[per_doc.parts > 1])].sort_values("part").groupby("doc_id"):
            assert p.start_token.tolist() == [0, *p.n_tokens.cumsum().tolist()[:-1]] and (p.n_tokens[:-1] == cap).all()
    report = packing_report(pack_documents(d, limits)).toPandas()
    assert (report.filled_share > 0.9).all() and report.n_tokens.nunique() == 1


def test_packing_odd_rows(spark):
    rows = [(1, "a", ""), (1, "a", ""), (2, "a", None), (None, "a", "word"), (3, "a", "word " * 5000), (4, "a", " a b c d")]
    limits = spark.createDataFrame([("small", 4, "x"), ("small", 4, "x"), ("none", 0, "x"), (None, 5, "x"), ("nul", None, "x")], LIMITS)
    out = pack_documents(docs(spark, rows), limits).toPandas()
    assert set(out.container_kind) == {"small"} and (out.groupby("container_id").n_tokens.sum() <= 4).all()
    assert (out.doc_id == 1).sum() == 2 and 2 not in set(out.doc_id) and out.doc_id.isna().sum() == 1 and out[out.doc_id == 4].n_tokens.tolist() == [4]
    assert pack_documents(docs(spark, []), limits).collect() == [] and pack_documents(docs(spark, rows), limits.where("false")).collect() == []


def test_packing_does_not_depend_on_the_partitioning(spark):
    """Many partitions: an oversize text in a late one, equal rows, and the same containers as from two partitions."""
    rows = [(i % 40, "a", "word " * (i % 7)) for i in range(60)] + [(99, "a", "word " * 3000)]
    limits = spark.createDataFrame([("small", 16, "x"), ("large", 64, "x")], LIMITS)
    few, many, parts = (pack_documents(docs(spark, rows).repartition(n), limits, block_items=16, max_kinds=k) for n, k in ((2, 9), (40, 9), (3, 1)))
    want = sorted(map(tuple, few.collect()))
    assert sorted(map(tuple, many.collect())) == want and sorted(map(tuple, parts.collect())) == want
    faults = packing_faults(few, docs(spark, rows)).collect()
    assert [(f.n_documents, f.n_over_capacity, f.n_split_needlessly, f.n_not_covered, f.n_wrong_count) for f in faults] == [(61, 0, 0, 0, 0)] * 2


def test_plan():
    target, repeats, tokens = np.array([0.5, 0.3, 0.2, 0.0]), np.array([1, 2, 3, 1]), np.array([100.0, 100, 0, 50])
    w, exponent, size = plan_mix(target, repeats, tokens)
    assert exponent == 0 and np.allclose(w, [0.625, 0.375, 0, 0]) and size == 160
    w, exponent, size = plan_mix(target, repeats, tokens, budget=190)
    assert 0 < exponent < 1 and size == 190 and (w * size <= repeats * tokens + 1e-3).all()
    assert plan_mix(target, repeats, tokens, budget=10**6)[2] <= 300
    share = tokens / tokens.sum()
    goal = (entropy(tempered(target, share, 0)) + entropy(tempered(target, share, 1))) / 2
    assert abs(entropy(plan_mix(target, repeats, tokens, target_entropy=goal)[0]) - goal) < 1e-9
    assert plan_mix(np.zeros(0), np.zeros(0), np.zeros(0))[2] == 0
    assert plan_mix(target, repeats, tokens, stretch=1.1)[2] == 176


def test_many_sources_are_planned_by_passes(spark):
    rows = [(i, "abc"[i % 3], "one two three four " * (i % 5 + 1)) for i in range(90)]
    targets = spark.createDataFrame([("a", 0.7, 2, 1), ("b", 0.2, 2, 1), ("c", 0.1, 3, 1), ("z", 0.4, 1, 1)], TARGETS)
    for how in ({"stretch": 1.3}, {"target_entropy": 0.9}):
        one, many = (mix_documents(docs(spark, rows).repartition(p), targets, max_sources=n, block_documents=8, **how) for p, n in ((1, 9), (5, 1)))
        assert sorted(map(tuple, one[0].collect())) == sorted(map(tuple, many[0].collect())), how
        exponents = {round(r.exponent, 9) for r in [*one[1].collect(), *many[1].collect()]}
        assert len(exponents) == 1 and 0 < exponents.pop() < 1


def test_mix_tables(spark, tiny):
    d, t = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/mix_targets.parquet")
    mix, report = mix_documents(d, t, block_documents=8)
    m, r = mix.toPandas(), report.toPandas().set_index("source")
    limit = {x.source: x.max_repeats for x in t.collect()}
    copies = m.groupby(["source", "doc_id"]).size().reset_index(name="n")
    assert (copies.n <= copies.source.map(limit)).all() and not m.duplicated(["doc_id", "copy"]).any()
    assert abs(r.actual_share.sum() - 1) < 1e-9 and len(r) == len(limit) and r.actual_share["field_memo"] == 0 and r.actual_share["paper_ledger"] == 0
    assert (m.groupby("source").n_tokens.sum() == r.mixed_tokens[r.mixed_tokens > 0]).all()
    again = mix_documents(d, t, block_documents=8)[0].toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, m.values.tolist()))


@pytest.mark.parametrize("budget", [None, 40])
def test_mix_odd_rows(spark, budget):
    rows = [(i, "a", "one two three four") for i in range(30)] + [(100, "b", ""), (101, None, "x"), (102, "b", None), (103, "c", "not listed"), (7, "a", "one two three four")]
    targets = spark.createDataFrame([("a", 0.7, 1, 1), ("b", 0.3, 2, 1), ("a", 0.7, 1, 1), (None, 0.5, 1, 1), ("z", None, None, 1)], TARGETS)
    mix, report = mix_documents(docs(spark, rows), targets, budget=budget)
    m = mix.toPandas()
    assert set(m.source) <= {"a"} and len(m) == (31 if budget is None else 10)
    assert {x.source: round(x.actual_share, 6) for x in report.collect()} == {"a": 1.0, "b": 0.0, "z": 0.0}
    assert mix_documents(docs(spark, []), targets)[0].collect() == []


def test_forms(spark):
    texts = {
        "café": "café", "ＡＢＣ １２": "ABC 12", "a​b­c": "abc", "no gap": "no gap", "раура": "paypa", "ậ": "ậ", "ё": "ë", "が": "が", "x\r\ny": "x\ny", "a‑b": "a-b", "ｶﾞ": "ガ", "ﬁn": "fin",
    }
    for a, b in texts.items():
        assert one_form(a) == one_form(b), a
    apart = ["cafe", "café", "Cafe", "x²", "x2", "a b", "a  b", "a–b", "a-b", "l", "I", "1", "O", "0", "и", "й", "ß", "ss", "．．", "。"]
    assert len({one_form(t) for t in apart}) == len(apart)
    rows = [(i, "s", t) for i, t in enumerate([*texts, *texts.values(), *apart, "", None, "​", "é" * 50_000])]
    plain = spark.createDataFrame([(i, t, 1) for i, _, t in rows], "doc_id long, text string, plain int")
    out = {r.doc_id: (r.text, r.form) for r in normalise_texts(plain).collect()}
    assert len(out) == len(rows) and all(f == (None if t is None else one_form(t)) for t, f in out.values())


def test_pairs(spark):
    rows = [(1, "s", "café"), (2, "s", "café"), (3, "s", "café"), (4, "s", "cafe"), (2, "s", "café"), (None, "s", "café"), (5, "s", None), (6, "s", "plain"), (7, "s", "plain"), (8, "s", "p​lain"), (9, "s", ""), (10, "s", "​")]
    assert sorted(map(tuple, lookalike_pairs(docs(spark, rows)).collect())) == [(1, 2), (2, 3), (6, 8), (7, 8), (9, 10)]
    assert lookalike_pairs(docs(spark, [])).collect() == []
    classes = {(r.doc_id, r.n_alike) for r in lookalike_classes(docs(spark, rows)).collect()}
    assert classes == {(1, 1), (2, 2), (3, 1), (6, 1), (7, 1), (8, 2), (9, 1), (10, 1)}


def test_hot_forms(spark):
    """A copied text holds most rows; its form is repeated for the join, the rows are not."""
    rows = [(i, "s", "é" if i % 3 else f"ａ{i}") for i in range(3000)]
    out = normalise_texts(docs(spark, rows).select("doc_id", "text"))
    assert sorted(map(tuple, out.select("doc_id", "form").collect())) == [(i, one_form(t)) for i, _, t in rows]


def test_mapping_is_closed():
    table = dict(mapping())
    assert len(table) < 20_000
    assert all(table.get(c, c) == c for plain in table.values() for c in plain)
