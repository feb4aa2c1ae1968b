"""Cases: a hash-chained log, its verification, and intake of what is new."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
LOG = "seq int, time string, action string, examiner string, details string, prev_hash string, hash string, signature string"


def entry_hash(seq: int, time: str, action: str, examiner: str, details: dict, prev: str) -> str:
    """The digest of an entry: of its canonical JSON, keys in order and without blanks."""
    body = {"seq": seq, "time": time, "action": action, "examiner": examiner, "details": details, "prev_hash": prev}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def append_entries(entries: list[dict], prev: str = GENESIS, start: int = 1) -> list[dict]:
    """Entries with their numbers, links and digests, to be written to the log."""
    out = []
    for i, e in enumerate(entries, start):
        h = entry_hash(i, e["time"], e["action"], e["examiner"], e.get("details", {}), prev)
        out.append({"seq": i, "time": e["time"], "action": e["action"], "examiner": e["examiner"], "details": json.dumps(e.get("details", {}), sort_keys=True), "prev_hash": prev, "hash": h, "signature": None})
        prev = h
    return out


def with_previous(log: DataFrame, seq: str, own: str, width: int = 1_000_000) -> DataFrame:
    """A log with ``_before`` and ``_seq_before``: the digest and the number of the entry before each; nulls for the first.

    Entries are looked at in ranges of ``width`` numbers, each of which hears the last entry before
    it from a table with one row a range: no chain is ever brought together whole.
    """
    ranged = log.withColumn("_range", F.floor(F.col(seq) / width))
    w = Window.partitionBy("_range").orderBy(seq)
    ends = ranged.groupBy("_range").agg(F.max(F.struct(F.col(seq).alias("s"), F.col(own).alias("h"))).alias("_end"))
    carried = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_carry"))
    both = ranged.withColumn("_in", F.lag(F.struct(F.col(seq).alias("s"), F.col(own).alias("h"))).over(w)).join(carried, "_range")
    return both.withColumn("_before", F.coalesce("_in.h", "_carry.h")).withColumn("_seq_before", F.coalesce("_in.s", "_carry.s")).drop("_range", "_in", "_carry")


def broken_links(log: DataFrame, seq: str, prev: str, own: str, expected: Column | None = None, numbered: bool = False) -> DataFrame:
    """(seq, problem) of entries whose link isn't the digest before, whose digest isn't the ``expected``, or, in a ``numbered`` log, that don't follow the number before."""
    step = with_previous(log, seq, own)
    problems = [(F.col(prev) != F.coalesce("_before", F.lit(GENESIS)), "link")]
    problems += [(F.col(own) != expected, "hash")] if expected is not None else []
    problems += [(F.col(seq) != F.coalesce("_seq_before", F.lit(0)) + 1, "number")] if numbered else []
    found = F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in problems]))
    return step.select(F.col(seq).alias("seq"), F.explode(found).alias("problem"))


def verify_log(log: DataFrame) -> DataFrame:
    """(seq, problem) of a custody log: broken links, altered entries, numbers out of order."""

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["_expected"] = [entry_hash(int(r.seq), r.time, r.action, r.examiner, json.loads(r.details or "{}"), r.prev_hash) for r in f.itertuples()]
            yield f

    return broken_links(log.mapInPandas(digests, LOG + ", _expected string"), "seq", "prev_hash", "hash", F.col("_expected"), numbered=True)


def missing_evidence(registered: DataFrame, present: DataFrame) -> DataFrame:
    """(path, problem) of ``registered(path, sha256)`` that ``present(path, sha256)`` lacks or has otherwise."""
    p = present.select("path", F.col("sha256").alias("now"))
    both = registered.join(p, "path", "left")
    return both.filter("now is null or now <> sha256").select("path", F.when(F.col("now").isNull(), "missing").otherwise("altered").alias("problem"))


def only_new(evidence: DataFrame, index: DataFrame, key: str = "sha256") -> DataFrame:
    """Evidence that the index doesn't have yet, each content once."""
    return evidence.dropDuplicates([key]).join(index.select(key).distinct(), key, "left_anti")


def newest(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last entry of each key; found by partial aggregation, so no key's entries come together."""
    rank = F.struct(*order, *[c for c in entries.columns if c not in order])
    return entries.groupBy(key).agg(F.max(rank).alias("_r")).select("_r.*")
