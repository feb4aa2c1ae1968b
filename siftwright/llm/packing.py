"""Filling containers of fixed capacity with texts, by conflict-constrained best-fit.

Texts go in by falling size. Open containers are ordered by what is left in them, and each carries
a bitmap of the sources and one of the duplicate clusters in it. The search starts at the least
room that holds the text and goes on to its successors until the tightest compatible container is
found; where there is none, one is opened.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.tokens import VOCABULARY, with_tokens
from siftwright.session import stage


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, conflicts: Iterable[tuple] = ()) -> list[int]:
    """The container of each item, for items of at most the capacity.

    Two items of one cluster never share a container (null clusters are alone), and neither do items
    of two sources in ``conflicts``. Equal items are taken together, and a container that got one of
    them leaves the search until all of them are placed, so copies don't search through each other.
    """
    often = {c for c, n in Counter(clusters).items() if c is not None and n > 1}
    bit = {c: 1 << i for i, c in enumerate(sorted(often, key=str))}
    source_bit = {s: 1 << i for i, s in enumerate(sorted({str(s) for s in sources}))}
    against: dict[str, int] = defaultdict(int)
    for a, b in conflicts:
        against[str(a)] |= source_bit.get(str(b), 0)
        against[str(b)] |= source_bit.get(str(a), 0)

    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: a container with r left
    bin_sources, bin_clusters, out = [], [], [0] * len(sizes)
    held: list[tuple[int, int]] = []
    before = None
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], str(clusters[i]), i)):
        size, cluster, source = sizes[i], bit.get(clusters[i], 0), str(sources[i])
        if held and (size, clusters[i]) != before:
            for r, b in held:
                rooms[r].append(b)
                filled |= 1 << r
            held = []
        before = (size, clusters[i])
        found, r = -1, size
        ahead = filled >> size
        while ahead and found < 0:
            step = (ahead & -ahead).bit_length() - 1
            r, ahead = r + step, ahead >> step
            bins = rooms[r]
            for k in range(len(bins) - 1, -1, -1):
                if not (bin_clusters[bins[k]] & cluster or bin_sources[bins[k]] & against[source]):
                    found = bins[k]
                    bins[k] = bins[-1]
                    bins.pop()
                    if not bins:
                        filled &= ~(1 << r)
                    break
            else:
                r, ahead = r + 1, ahead >> 1
        if found < 0:
            found, r = len(bin_sources), capacity
            bin_sources.append(0)
            bin_clusters.append(0)
        bin_sources[found] |= source_bit[source]
        bin_clusters[found] |= cluster
        out[i] = found
        if cluster:
            held.append((r - size, found))
        else:
            rooms[r - size].append(found)
            filled |= 1 << (r - size)
    return out


_OUT = "spec_id int, doc_id long, piece int, first_token long, end_token long, container_id long"


def pack(docs: DataFrame, specs: DataFrame, conflicts: Iterable[tuple] = (), shard_tokens: int = 8_000_000, vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_id, doc_id, piece, first_token, end_token, container_id) of ``docs(doc_id, text, source)`` for each of ``specs``.

    A text longer than the capacity is cut into full pieces and a rest; no other is split. Null and
    empty texts have no tokens and fit anywhere. Texts with the same words are one duplicate
    cluster. Specs with a null or non-positive capacity are left out, and so are texts without an id; ids must be unique.

    Texts are spread over shards by a hash of their id, ``shard_tokens`` tokens each on average, and
    each shard is packed by itself: a shard bounds a task's rows, and leaves at most a few of its
    thousands of containers part empty. Texts leave the workers as sizes only.
    """
    spark = docs.sparkSession
    same = F.xxhash64(F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " "))))
    keyed = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(F.length("text") > 0, same).alias("cluster"), "text")
    sized = stage(with_tokens(keyed, "doc_id", "text", ["source", "cluster"], vocabulary), "sizes")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, round(total / shard_tokens))
    # One row for each way to pack; they are few, and become literals.
    wanted = [(r.spec_id, r.capacity_tokens) for r in specs.select("spec_id", "capacity_tokens").filter("capacity_tokens > 0").distinct().collect()]
    if not wanted:
        return spark.createDataFrame([], _OUT)
    each = F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity")) for s, c in wanted])
    rows = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).select("*", F.explode(each).alias("spec")).select("doc_id", "source", "cluster", "n_tokens", "shard", "spec.spec_id", "spec.capacity")
    pairs = [tuple(map(str, p)) for p in conflicts]

    def fill(t: pa.Table) -> pa.Table:
        cap = t.column("capacity")[0].as_py()
        n = t.column("n_tokens").to_numpy()
        whole, rest = n // cap, n % cap
        # A text of a multiple of the capacity leaves no rest; one without tokens still is an item.
        item = np.flatnonzero((rest > 0) | (n == 0))
        where = np.repeat(np.arange(len(n)), whole)
        nth = np.arange(len(where)) - np.repeat(np.cumsum(whole) - whole, whole)
        src, clu = t.column("source").to_pylist(), t.column("cluster").to_pylist()
        put = np.array(best_fit(rest[item].tolist(), [src[i] for i in item], [clu[i] for i in item], cap, pairs), np.int64)
        used = int(put.max()) + 1 if len(put) else 0
        row = np.concatenate([where, item])
        piece = np.concatenate([nth, whole[item]]).astype(np.int32)
        first = piece.astype(np.int64) * cap
        bins = np.concatenate([used + np.arange(len(where)), put])
        base = np.int64(t.column("shard")[0].as_py()) << 32
        spec = np.full(len(row), t.column("spec_id")[0].as_py(), np.int32)
        return pa.table({"spec_id": spec, "doc_id": t.column("doc_id").to_numpy()[row], "piece": piece, "first_token": first, "end_token": np.minimum(first + cap, n[row]), "container_id": base + bins})

    return rows.groupBy("spec_id", "shard").applyInArrow(fill, _OUT)


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, containers, tokens, fill): how full the containers are."""
    bins = packed.groupBy("spec_id", "container_id").agg(F.sum(F.col("end_token") - F.col("first_token")).alias("t"))
    by = bins.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return specs.select("spec_id", "capacity_tokens").join(by, "spec_id").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
