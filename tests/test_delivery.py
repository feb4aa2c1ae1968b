"""Exactly-once deliveries against a plain union-find."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwright.operators import delivery
from siftwright.operators.components import connected_components
from siftwright.operators.delivery import DeliveryLedger, digest_key, ingest, message_key, redeliveries

SCHEMA = "delivery_id long, message_id string, sha256 string, received_at timestamp, _id string, key string"


def keys():
    return [message_key(F.col("message_id")), digest_key(F.col("sha256"))]


def expected(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def norm(m):
        m = (m or "").strip(" \t\r\n<>")
        return m.rpartition("@")[0] + "@" + m.rpartition("@")[2].lower() if "@" in m else None

    for i, m, s, *_ in rows:
        for k in (("m", norm(m)), ("s", (s or "").strip().lower() or None)):
            if k[1]:
                parent[find(k)] = find(("d", i))
    groups = {}
    for i, _, _, at, *_ in rows:
        groups.setdefault(find(("d", i)), []).append((at is None, at or datetime.min, i))
    return {x[2] for g in groups.values() for x in sorted(g)[1:]}


def made(n=300, seed=1):
    r, t = random.Random(seed), datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        m = r.choice([None, "", "<>", "no-at", f"<a{r.randint(0, 60)}@Host.Test>", f" a{r.randint(0, 60)}@host.test ", f"A{r.randint(0, 60)}@host.test"])
        s = r.choice([None, "", f"F{r.randint(0, 150):03x}", f"f{r.randint(0, 150):03x}"])
        rows.append((i, m, s, r.choice([None, t + timedelta(minutes=r.randint(0, 50))]), "clash", None))
    return rows + [(10_000 + i, "<hot@x.test>", None, t, "clash", None) for i in range(200)]


def test_matches_union_find(spark):
    rows = made()
    got = redeliveries(spark.createDataFrame(rows, SCHEMA), "delivery_id", keys(), [F.col("received_at")], shards=4)
    assert {r.delivery_id for r in got.collect()} == expected(rows)


def test_repeated_rows_nulls_and_empty(spark):
    rows = made(40, 3)
    df = spark.createDataFrame([*rows, *rows, (None, "<a1@x.test>", None, None, None, None)], SCHEMA)
    assert {r.delivery_id for r in redeliveries(df, "delivery_id", keys(), [F.col("received_at")], shards=4).collect()} == expected(rows)
    assert redeliveries(df.limit(0), "delivery_id", keys(), [F.col("received_at")], shards=4).count() == 0


def test_batches_keep_one_copy_and_versions_are_atomic(spark, tmp_path):
    ledger = DeliveryLedger(spark, f"file://{tmp_path}/ledger", shards=4)
    t = datetime(2024, 1, 1)
    batch = lambda rows: spark.createDataFrame([(*r, t, None, None) for r in rows], SCHEMA)
    flags = lambda rows: {r.delivery_id: r.redelivery for r in ingest(batch(rows), "delivery_id", keys(), [F.col("received_at")], ledger).collect()}
    assert flags([(1, "<a@x>", "s1"), (2, "<a@x>", "s2")]) == {1: False, 2: True}
    assert flags([(3, None, "s2"), (4, "<b@x>", "s1"), (5, "<c@x>", "s9")]) == {3: True, 4: True, 5: False}
    assert flags([(6, "<b@x>", None), (7, None, None)]) == {6: True, 7: False}
    assert ledger.version() == 3
    with pytest.raises(RuntimeError):  # a writer that began before the last commit
        ledger.commit(ledger.dictionary().limit(0), ledger.seen(), base=2)
    assert ledger.seen().agg(F.sum(F.bitmap_count("bits"))).first()[0] == ledger.dictionary().count() == 6


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(50)} == {1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slices_make_no_difference(spark):
    rows = made(250, 8)
    frame = spark.createDataFrame(rows, SCHEMA)
    for slices, order in ((1, [F.col("received_at")]), (3, [F.col("received_at")]), (2, [F.col("received_at").cast("string")])):
        got = redeliveries(frame, "delivery_id", keys(), order, shards=4, slices=slices)
        assert {r.delivery_id for r in got.collect()} == expected(rows)


def test_many_batches_and_versions_written_whole(spark, tmp_path, monkeypatch):
    """Deltas, and their compaction, against a plain run over the same batches."""
    monkeypatch.setattr(delivery, "COMPACT", 2)
    ledger = DeliveryLedger(spark, f"file://{tmp_path}/ledger", shards=4)
    rows, want, got = made(200, 5)[:230], {}, {}
    parent, seen = {}, set()

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k in range(5):
        batch = rows[46 * k : 46 * (k + 1)]
        of = {}
        for i, m, s, *_ in batch:
            m = (m or "").strip(" <>")
            ids = [("m", m.rpartition("@")[0] + "@" + m.rpartition("@")[2].lower())] if "@" in m else []
            of[i] = ids + ([("s", s.strip().lower())] if (s or "").strip() else [])
            for x in of[i][1:]:
                parent[find(x)] = find(of[i][0])
        known = {find(x) for x in seen}
        for i, _m, _s, at, *_ in sorted(batch, key=lambda r: (r[3] is None, r[3] or datetime.min, r[0])):
            want[i] = bool(of[i]) and find(of[i][0]) in known
            known |= {find(x) for x in of[i][:1]}
        seen |= {x for v in of.values() for x in v}
        got |= {r.delivery_id: r.redelivery for r in ingest(spark.createDataFrame(batch, SCHEMA), "delivery_id", keys(), [F.col("received_at")], ledger).collect()}
    assert got == want and any(want.values()) and ledger.version() == 5
    assert ledger.dictionary().select("key").distinct().count() == ledger.dictionary().count() == len(seen)
