"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from siftwright.llm.neardup import NearDuplicates, prefix_candidates, samples, shingles_of, sketch_and_bands


def made(n=40, seed=2):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randint(0, 4000))
    rows, k = [], 0
    for _ in range(n):
        base = [word() for _ in range(r.randint(20, 60))]
        for _ in range(r.randint(1, 5)):
            v = list(base)
            for _ in range(r.randint(0, 4)):
                i = r.randrange(len(v))
                v[i : i + 1] = r.choice([[], [word()], [v[i], word()]])
            text = " ".join(v)
            rows.append((k, r.choice([text, text.upper(), text.replace(" ", "\n")]), "clash", 0))
            k += 1
    return [*rows, (k, None, "x", 1), (k + 1, "", "x", 1), (k + 2, "two words", "x", 1), (k + 3, "same text of more than three words here", "x", 1), (k + 4, "same  text of more than three words HERE", "x", 1), (None, "no id here at all", "x", 1)]


SCHEMA = "rid long, text string, same string, sh int"


def brute(rows, n, least):
    sets = {i: set(shingles_of(t, n)[0].tolist()) for i, t, *_ in rows if i is not None and t}
    sets = {i: s for i, s in sets.items() if s}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_pairs_match_all_pairs(spark):
    rows = made()
    nd = NearDuplicates(spark.createDataFrame([*rows, *rows[:7]], SCHEMA), n=3, jaccard=0.5, bands=40, block=4)
    got = {(r.a, r.b) for r in nd.pairs().collect()}
    want = brute(rows, 3, 0.5)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50


def test_groups_have_one_row_a_record(spark):
    rows = made(10, 4)
    g = NearDuplicates(spark.createDataFrame([*rows, *rows], SCHEMA)).groups().collect()
    assert len(g) == len({r.rid for r in g}) == sum(1 for i, t, *_ in rows if i is not None and len(shingles_of(t, 5)[0]))
    twins = {r.rid: r.group_id for r in g}
    k = len(rows) - 6
    assert twins[k + 3] == twins[k + 4] == k + 3


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "a b", None, None), (2, "", None, None)], [(1, "x " * 200_000, None, None), (2, "x " * 200_000, None, None)]])
def test_edges(spark, rows):
    nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), n=3)
    assert nd.pairs().count() == (1 if len(rows) == 2 and len(rows[0][1]) > 10 else 0)


def test_hot_bucket_is_compared_whole(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :]), None, None) for i in range(60)]
    nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), n=3, jaccard=0.75, bands=30, block=7)
    got = {(r.a, r.b) for r in nd.pairs().collect()}
    assert got == brute(rows, 3, 0.75)


def test_samples_agree_as_often_as_weighted_jaccard():
    r = np.random.default_rng(0)
    h = r.integers(-(2**62), 2**62, 300)
    wa, wb = r.uniform(0.5, 5, 200), r.uniform(0.5, 5, 200)
    a, b = dict(zip(h[:200].tolist(), wa, strict=True)), dict(zip(h[100:].tolist(), wb, strict=True))
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in h.tolist()) / sum(max(a.get(k, 0), b.get(k, 0)) for k in h.tolist())
    s = samples(h[:200], wa, np.array([0]), 3000, 1)[0] == samples(h[100:], wb, np.array([0]), 3000, 1)[0]
    assert abs(s.mean() - true) < 0.03


def test_a_text_pasted_twice_is_like_the_text_once(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, None, None), (2, f"{words} {words}", None, None), (3, "quite another text of seven words here", None, None)]
    nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA))
    assert {(r.a, r.b) for r in nd.pairs().collect()} == brute(rows, 5, 0.8) == {(1, 2)}


def test_pairs_at_the_least_weighted_similarity_are_found(spark):
    """Plain similarity 0.5, all that is shared at the least weight, and all else at the greatest."""
    r = random.Random(5)
    rows = []
    for k in range(300):
        both = [f"c{i}" for i in r.sample(range(150), 40)]
        rows += [(2 * k + side, " ".join(both + [f"x{k}-{side}-{i}" for i in range(20)]), None, None) for side in (0, 1)]
    nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), n=1, jaccard=0.5)
    got, want = {(x.a, x.b) for x in nd.pairs().collect()}, {(2 * k, 2 * k + 1) for k in range(300)}
    assert brute(rows, 1, 0.5) == want and got <= want and len(got) >= 0.98 * len(want)


def test_bands_for_a_recall():
    for sought in (1 / 3, 2 / 3):
        least, bands = sketch_and_bands(sought, 2, 0.99)
        assert bands >= 16 and (1 - sought**2) ** bands < 0.01 and 0 < least < 32 * sought
    assert sketch_and_bands(1 / 3, 2, 0.99, 40)[1] == 40


def test_crowded_buckets_go_by_the_rarest_shingles(spark):
    """Boilerplate that all records share fills buckets; pairs are still all found."""
    r = random.Random(11)
    frame = [f"f{i}" for i in range(25)]
    rows = []
    for k in range(150):
        own = [f"o{r.randint(0, 5000)}" for _ in range(40)]
        for side in range(r.randint(1, 3)):
            words = frame + own[: 40 - side] + [f"e{k}-{side}"]
            rows.append((len(rows), " ".join(words), None, None))
    nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), n=1, jaccard=0.75, crowded=40)
    want = brute(rows, 1, 0.75)
    assert {(x.a, x.b) for x in nd.pairs().collect()} == want and len(want) > 80


def test_prefixes_lose_no_pair(spark):
    rows = made(60, 9)
    frame = spark.createDataFrame([(i, [int(x) for x in shingles_of(t, 3)[0]]) for i, t, *_ in rows if t and len(shingles_of(t, 3)[0])], "rid long, sh array<long>")
    common = np.sort(np.array([x for i, t, *_ in rows[:3] if t for x in shingles_of(t, 3)[0]], np.int64))
    common = np.unique(common)
    tables = spark.sparkContext.broadcast((common, np.linspace(1, 2, len(common)), 3.0))
    got = {(x.a, x.b) for x in prefix_candidates(frame, tables, 0.5).collect()}
    assert brute(rows, 3, 0.5) <= got
