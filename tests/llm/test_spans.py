"""Shared spans against every window."""

import random

import pytest

from siftwright.llm.spans import shared_share, shared_spans

SCHEMA = "doc_id long, text string, doc string, mini int"


def made(k, seed=1, n=60):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 3000)}" for _ in range(80)] for _ in range(4)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 4)):
            b = r.choice(base)
            at = r.randint(0, 60)
            w += b[at : at + r.randint(1, 40)] + [f"u{i}x{r.randint(0, 9)}"] * r.randint(0, 2)
        rows.append((i, "".join(x + r.choice([" ", "  ", "\t", "\r\n", "\n"]) for x in w), "clash", 1))
    return [*rows, (1000, None, None, None), (1001, "", None, None), (None, "a b", None, None), (1002, " ".join(base[0]), None, None), (1003, " ".join(base[0]), None, None)]


def brute(rows, k):
    where = {}
    words = {i: (t or "").split() for i, t, *_ in rows if i is not None}
    for i, w in words.items():
        for j in range(len(w) - k + 1):
            where.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = set()
    for i, w in words.items():
        on = [False] * len(w)
        for j in range(len(w) - k + 1):
            if len(where[tuple(w[j : j + k])]) > 1:
                on[j : j + k] = [True] * k
        j = 0
        while j < len(on):
            if on[j]:
                e = j
                while e < len(on) and on[e]:
                    e += 1
                out.add((i, j, e))
                j = e
            j += 1
    return out


@pytest.mark.parametrize(("k", "m", "hot"), [(5, 2, 2000), (5, 2, 3), (9, 9, 0), (25, 8, 2000), (1, 1, 2)])
def test_matches_every_window(spark, k, m, hot):
    rows = made(k)
    got = shared_spans(spark.createDataFrame([*rows, *rows[:5]], SCHEMA), "doc_id", "text", k, m, hot).collect()
    assert {tuple(r) for r in got} == brute(rows, k) and len(got) == len({tuple(r) for r in got})


def test_share_and_edges(spark):
    rows = [(1, "a b c d e f", None, None), (2, "x b c d e y", None, None), (3, "", None, None), (4, None, None, None), (5, "b c d e b c d e", None, None)]
    got = {r.doc_id: (r.n_words, r.shared_words, r.share) for r in shared_share(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", k=4, m=2).collect()}
    assert got == {1: (6, 4, 0.666667), 2: (6, 4, 0.666667), 3: (0, 0, 0.0), 4: (0, 0, 0.0), 5: (8, 8, 1.0)}
    long = "w " * 300_000
    assert [tuple(r) for r in shared_spans(spark.createDataFrame([(1, long, None, None)], SCHEMA), "doc_id", "text").collect()] == []
    assert shared_spans(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        shared_spans(spark.createDataFrame([], SCHEMA), "doc_id", "text", 3, 4)
