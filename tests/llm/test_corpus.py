"""Packing and mixing."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwright.llm import mixing, packing
from siftwright.llm.tokens import encoding, VOCABULARY

DOCS = "doc_id long, text string, source string, lang string, n_tokens string, cluster string"


def texts(n=400, seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "of", "the", "Straße"]) for _ in range(r.randint(1, 60))), r.choice(["a", "a", "b", None]), r.choice(["en", "de", None]), "x", "y") for i in range(n)]
    hot = "a hot text that very many have " * 2
    return rows + [(n + i, hot, "a", "en", "x", "y") for i in range(n // 2)] + [(9000, None, "a", "en", None, None), (9001, "", "b", None, None, None), (None, "no id", "a", "en", None, None), (9002, "word " * 5000, "b", "en", None, None)]


def test_best_fit_respects_capacity_and_conflicts():
    r = random.Random(1)
    sizes = [r.randint(0, 100) for _ in range(3000)]
    clusters = [r.choice([None, None, r.randint(0, 20)]) for _ in sizes]
    sources = [r.choice("abc") for _ in sizes]
    put = packing.best_fit(sizes, sources, clusters, 100, [("a", "b")])
    load, cl, so = Counter(), defaultdict(list), defaultdict(set)
    for s, c, x, b in zip(sizes, clusters, sources, put, strict=True):
        load[b] += s
        cl[b] += [c] if c is not None else []
        so[b].add(x)
    assert max(load.values()) <= 100 and all(len(v) == len(set(v)) for v in cl.values()) and not any({"a", "b"} <= v for v in so.values())
    tight = packing.best_fit(sizes, sources, [None] * len(sizes), 100)
    assert max(tight) + 1 <= 1.02 * max(sum(sizes) / 100, sum(s > 50 for s in sizes))
    assert packing.best_fit([], [], [], 10) == [] and packing.best_fit([5] * 50, ["a"] * 50, [1] * 50, 10) == list(range(50))


@pytest.mark.parametrize("shard_tokens", [8_000_000, 3000])
def test_packing_is_whole(spark, shard_tokens):
    rows, one = texts(), encoding(VOCABULARY)
    specs = spark.createDataFrame([(1, 64), (2, 512), (3, None), (4, 0), (1, 64)], "spec_id int, capacity_tokens int")
    got = packing.pack(spark.createDataFrame(rows, DOCS), specs, shard_tokens=shard_tokens).collect()
    size = {i: len(one.encode_ordinary(t)) if t else 0 for i, t, *_ in rows if i is not None}
    text = {i: t for i, t, *_ in rows}
    for spec, cap in ((1, 64), (2, 512)):
        mine = [r for r in got if r.spec_id == spec]
        load, held, pieces = Counter(), defaultdict(list), defaultdict(list)
        for r in mine:
            load[r.container_id] += r.end_token - r.first_token
            held[r.container_id].append(text[r.doc_id])
            pieces[r.doc_id].append((r.first_token, r.end_token))
        assert set(pieces) == set(size) and max(load.values()) <= cap
        assert all(n <= 1 for h in held.values() for t, n in Counter(h).items() if t)
        for i, p in pieces.items():
            p.sort()
            assert p[0][0] == 0 and p[-1][1] == size[i] and all(a[1] == b[0] for a, b in zip(p, p[1:])) and (len(p) == 1) == (size[i] <= cap)
    assert {r.spec_id for r in got} == {1, 2}
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack(empty, specs).count() == 0 and packing.pack(empty, specs.limit(0)).count() == 0


def test_budgets_go_to_siblings_first():
    leaves = {("m", "en", "a"): (0.3, 100.0), ("m", "en", "b"): (0.3, 1000.0), ("n", "en", "c"): (0.4, 1000.0)}
    got = mixing.budgets(leaves, 1000)
    assert got == pytest.approx({("m", "en", "a"): 100, ("m", "en", "b"): 500, ("n", "en", "c"): 400})
    leaves[("m", "en", "b")] = (0.3, 200.0)
    assert mixing.budgets(leaves, 1000) == pytest.approx({("m", "en", "a"): 100, ("m", "en", "b"): 200, ("n", "en", "c"): 700})
    assert mixing.budgets({}, 10) == {} and mixing.spread(10, [(0, 5), (1, 0)]) == [0, 0]


def test_mix_reaches_its_shares(spark):
    rows = [r for r in texts(1200, 5) if r[0] != 9002]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 4), ("gone", 0.1, 2), ("a", 0.5, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs, targets, F.lit("d"), buckets=16).cache()
    rep = {r.source: r for r in mixing.mix_report(mixed, targets.dropDuplicates(["source"])).collect()}
    assert rep["a"].actual_share == pytest.approx(5 / 9, abs=0.02) and rep["b"].actual_share == pytest.approx(4 / 9, abs=0.02) and rep["gone"].tokens == 0
    assert rep["a"].most_uses <= 1 and rep["b"].most_uses <= 4 and mixed.count() == mixed.select("doc_id").distinct().count()
    assert [tuple(r) for r in mixed.orderBy("doc_id").collect()] == [tuple(r) for r in mixing.mix(docs, targets, F.lit("d"), buckets=16).orderBy("doc_id").collect()]
    other = mixing.mix(docs, targets, F.lit("d"), seed=2, total_tokens=4000).agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0]
    assert abs(other - 4000) < 400
    assert mixing.mix(docs.limit(0), targets, F.lit("d")).count() == 0 and mixing.mix(docs, targets.limit(0), F.lit("d")).count() == 0


def test_a_prefix_ends_where_it_is_nearest(spark):
    """One text of 100 tokens at the budget's end is used if that is nearer than leaving it out."""
    word = lambda n: " a" * n
    docs = spark.createDataFrame([(i, word(100)[1:], "a", "en", None, None) for i in range(10)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    for asked, want in ((240, 200), (260, 300), (1000, 1000), (1240, 1200), (1260, 1300)):
        assert mixing.mix(docs, targets, F.lit("d"), total_tokens=asked).agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0] == want


def test_sources_that_must_not_meet(spark):
    rows, specs = texts(), spark.createDataFrame([(1, 300)], "spec_id int, capacity_tokens int")
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.pack(docs, specs, [("a", "b")]).join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("container_id").agg(F.collect_set("source").alias("s")).collect()
    assert not any({"a", "b"} <= set(r.s) for r in got) and any("a" in r.s for r in got)
