"""Near-duplicate records, by improved consistent weighted sampling over idf-weighted shingles.

A record's shingles are its distinct runs of consecutive words, weighted by their idf: a shingle weighs
the same in all records, however often each repeats it, as the plain similarity that decides counts sets. The
idf counts all records, but a shingle in fewer than ``rare`` of them counts as if in that share: so
only shingles more frequent than that need a table, and there are at most (mean shingles of a
record) / ``rare`` of these whatever the number of records. Consistent weighted samples agree
between two records with the probability of their weighted Jaccard similarity; samples are banded,
records that agree in a band are candidates, and candidates are verified on the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.operators.components import connected_components
from siftwright.session import stage

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Shingles of the records that are counted together in a first pass.
BLOCK = 4_000_000
#: Rows that may be broadcast: 8 MB of ids.
MOST_BROADCAST = 1_000_000
#: Places of a sketch.
SKETCHED = 32
#: One record in so many shows which buckets are crowded.
SHOWN = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles_of(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, times) of the distinct runs of ``n`` words of the lower-cased text, by hash."""
    w = text.lower().split() if text else []
    if len(w) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + n])) for i in range(len(w) - n + 1)], np.uint64)
    return np.unique(h.view(np.int64), return_counts=True)


def samples(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Consistent weighted samples, ``count`` a record, as 64-bit fingerprints.

    Records lie end to end; ``bounds`` are their starts, and none is empty. For each shingle and
    sample r and c are Gamma(2, 1) and b is uniform, all drawn from the shingle's hash;
    t = floor(ln(w) / r + b) and the record's sample is the (shingle, t) least in c / exp(r (t - b) + r).
    """
    h, logw = hashes.view(np.uint64), np.log(weights).astype(np.float32)
    out = np.empty((len(bounds), count), np.uint64)
    lengths = np.diff(np.append(bounds, len(h)))
    unit = np.float32(2.0**-21)
    low = np.uint64((1 << 21) - 1)
    for k in range(count):
        a = _mix(h + np.uint64(int(_GOLD) * (2 * k + 1 + 1_000_003 * seed) % 2**64))
        z = _mix(a + _GOLD)
        u = [((x >> np.uint64(s)) & low).astype(np.float32) * unit + unit / 2 for x in (a, z) for s in (0, 21, 42)]
        r = -np.log(u[0] * u[1])
        t = np.floor(logw / r + u[4])
        key = np.log(-np.log(u[2] * u[3])) - r * (t - u[4] + 1)
        least = np.repeat(np.minimum.reduceat(key, bounds), lengths)
        hit = np.flatnonzero(key == least)
        owner = np.searchsorted(bounds, hit, side="right") - 1
        one, at = np.unique(owner, return_index=True)
        best = hit[at]
        out[one, k] = _mix(h[best] ^ (t[best].astype(np.int64).view(np.uint64) * _GOLD) ^ np.uint64(k))
    return out


def _shingle_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles_of(t, n)[0] for t in b.column("text").to_pylist()]
            cols = [b.column("rid"), b.column("same"), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "same", "sh"])

    return run


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _locally_common(rare: float):
    """Over blocks of records: the shingles in at least that share of a block's records.

    What is common overall is common in some block.
    """

    def block(held: list[np.ndarray], records: int) -> pa.RecordBatch:
        h, c = _counted(held)
        return pa.RecordBatch.from_arrays([pa.array(h[c >= rare * records])], names=["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, records = [], 0
        for b in batches:
            held.append(b.column("sh").flatten().to_numpy())
            records += b.num_rows
            if sum(map(len, held)) > BLOCK:
                yield block(held, records)
                held, records = [], 0
        if records:
            yield block(held, records)

    return run


def _counts_of(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        total = np.zeros(len(known), np.int64)
        for b in batches:
            sh = b.column("sh").flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, sh), len(known) - 1)
            total += np.bincount(at[known[at] == sh], minlength=len(known))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[hit]), pa.array(total[hit])], names=["h", "n"])

    return run


def _all_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, c = _counted([b.column("sh").flatten().to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "n"])


def common_shingles(sets: DataFrame, rare: float, floor: int) -> pa.Table:
    """(h, n), by h: the shingles in at least ``floor`` records, a share of at least ``rare``, with their counts.

    Two passes, of which the first finds what is common in some block of records and the second
    counts just that, over all records. Should the first find more than a broadcast may hold, all
    shingles are counted by one shuffle instead; the result is the same.
    """
    spark = sets.sparkSession
    found = sets.select("sh").mapInArrow(_locally_common(rare), "h long").distinct().limit(MOST_BROADCAST + 1).toArrow().column("h").to_numpy()
    if len(found) > MOST_BROADCAST:
        counts = sets.select("sh").mapInArrow(_all_counts, "h long, n long")
    elif len(found):
        counts = sets.select("sh").mapInArrow(_counts_of(spark.sparkContext.broadcast(np.sort(found))), "h long, n long")
    else:
        return pa.table({"h": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    return counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor).orderBy("h").toArrow()


def small(df: DataFrame) -> DataFrame:
    """A staged table of ids, with the hint to broadcast it where its counted rows allow that."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def weights_of(sh: np.ndarray, common: np.ndarray, idf: np.ndarray, top: float) -> np.ndarray:
    """The idf; ``common`` is sorted and holds the shingles that ``idf`` knows, all others get ``top``."""
    w = np.full(len(sh), top)
    if len(common):
        at = np.minimum(np.searchsorted(common, sh), len(common) - 1)
        known = common[at] == sh
        w[known] = idf[at[known]]
    return w


def _band_batches(tables, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, idf, top = tables.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                sh, size = b.column("sh").flatten().to_numpy(), pc.list_value_length(b.column("sh")).to_numpy()
                s = samples(sh, weights_of(sh, common, idf, top), np.cumsum(size) - size, bands * rows, seed)
                band = np.zeros((len(size), bands), np.uint64)
                for j in range(rows):
                    band = _mix(band * _GOLD + s[:, j::rows])
                band = _mix(band + np.arange(bands, dtype=np.uint64) * _GOLD)
                # Eight bits of 32 samples: enough to leave out most candidates that only chance brought together.
                sketch = np.zeros((len(size), SKETCHED // 8), np.uint64)
                for j in range(SKETCHED):
                    sketch[:, j // 8] |= (s[:, j % s.shape[1]] >> np.uint64(56)) << np.uint64(8 * (j % 8))
                each = lambda x: pa.array(np.repeat(x, bands))
                cols = [pa.array(band.view(np.int64).ravel()), each(b.column("rid").to_numpy()), *(each(np.ascontiguousarray(x).view(np.int64)) for x in sketch.T)]
                yield pa.RecordBatch.from_arrays(cols, names=["band", "rid", *(f"s{i}" for i in range(len(sketch.T)))])

    return run


def _agreeing(a: str, b: str) -> Column:
    """In how many of 8 places two packed sketches agree."""
    x = F.col(a).bitwiseXOR(F.col(b))
    for by in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, by))
    return F.lit(8) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def _verify(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, idf, top = tables.value
        for b in batches:
            plain, weighted = np.empty(b.num_rows), np.empty(b.num_rows)
            cols = [b.column(c) for c in ("sa", "sb")]
            for i in range(b.num_rows):
                sa, sb = (c[i].values.to_numpy() for c in cols)
                wa, wb = weights_of(sa, common, idf, top), weights_of(sb, common, idf, top)
                _, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
                least = np.minimum(wa[ia], wb[ib]).sum()
                weighted[i] = least / (wa.sum() + wb.sum() - least)
                plain[i] = len(ia) / (len(sa) + len(sb) - len(ia))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(plain), pa.array(weighted)], names=["a", "b", "jaccard", "weighted"])

    return run


def _prefix_batches(tables, jaccard: float):
    """Of each record its rarest shingles, as many as a like record must share one of: (h, rid, n), n the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, idf, _ = tables.value
        for b in batches:
            keys, ids, sizes = [], [], []
            for rid, sh in zip(b.column("rid").to_pylist(), b.column("sh"), strict=True):
                own = sh.values.to_numpy()
                least = math.ceil(jaccard * len(own) - 1e-9)
                prefix = own[np.lexsort((own, -weights_of(own, common, idf, np.inf)))][: len(own) - least + 1]
                keys.append(prefix)
                ids.append(np.full(len(prefix), rid))
                sizes.append(np.full(len(prefix), len(own)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, sizes)], names=["h", "rid", "n"])

    return run


def prefix_candidates(sets: DataFrame, tables, jaccard: float) -> DataFrame:
    """(a, b), a < b: every pair of ``sets(rid, sh)`` that may have the similarity, by their rarest shingles and sizes.

    Nothing is left to chance: all records put their shingles in one order, the rarest first, and
    two sets of that similarity share one among the first few. What many records share stands last,
    so that it brings none of them together.
    """
    keys = sets.select("rid", "sh").mapInArrow(_prefix_batches(tables, jaccard), "h long, rid long, n long")
    b = keys.withColumnsRenamed({"rid": "b", "n": "m"})
    return keys.withColumnRenamed("rid", "a").join(b, "h").filter((F.col("a") < F.col("b")) & (F.least("n", "m") >= jaccard * F.greatest("n", "m") - 1e-9)).select("a", "b").distinct()


class NearDuplicates:
    """Classes of equal records, and the links between like ones.

    ``records(rid BIGINT unique, text)``; a row repeated whole counts once in all results. Null texts and texts of fewer than ``n`` words have no
    shingles and are in no class. Records with equal words are one class, whose least id
    represents it; only representatives are sampled, so copies never meet in a bucket. ``links``
    has every pair of representatives found that have at least the plain similarity ``jaccard`` of
    their sets and, where a ``threshold`` is given, at least that weighted one. Without it, pairs are sought
    from what ``jaccard`` is at least worth in weights, and the exact check alone decides.

    Two records of weighted similarity ``threshold`` or more agree in one of ``bands`` bands of
    ``rows`` samples with probability 1 - (1 - s ** rows) ** bands at least; a bucket
    is compared whole, in salted blocks of ``block`` rows. Buckets of more than about ``crowded`` records,
    which one record in ``SHOWN`` shows, aren't compared: what is in one goes by its rarest shingles
    instead (:func:`prefix_candidates`), which finds all pairs. ``even`` bounds the weights: no idf counts
    less than that share of the greatest. Candidates whose sketches (eight bits
    each of 32 samples) agree in too few places are left out: at most a fifth of 1 - ``recall`` of the pairs
    just at the threshold, and next to none of those well above. ``bands`` are by default as many as find the
    share ``recall`` of pairs just at the threshold after that; ``rows`` are 2 where that is under a half, else 3.
    """

    def __init__(self, records: DataFrame, n: int = 5, jaccard: float = 0.8, threshold: float | None = None, bands: int | None = None, rows: int | None = None, rare: float = 1e-3, even: float = 0.5, block: int = 256, seed: int = 1, recall: float = 0.99, crowded: int = 20_000):
        sought = weighted_floor(jaccard, 1 / even) if threshold is None else threshold
        rows = rows or (2 if sought < 0.5 else 3)
        least, bands = sketch_and_bands(sought, rows, recall, bands)
        spark = records.sparkSession
        words = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
        named = records.select("rid", "text").filter("rid is not null and text is not null").withColumn("same", F.unhex(F.md5(words)))
        self.all_sets = stage(named.mapInArrow(_shingle_batches(n), "rid long, same binary, sh array<long>").filter("size(sh) > 0"), "shingles")
        self.classes = self.all_sets.groupBy("same").agg(F.min("rid").alias("rep"))
        copies = stage(self.all_sets.select("rid", "same").join(self.classes, "same").filter("rid <> rep").select("rid"), "copies")
        sets = self.all_sets.select("rid", "sh").join(small(copies), "rid", "left_anti")

        total = sets.count()
        floor = max(2, math.ceil(rare * total))
        common = common_shingles(sets, rare, floor)
        # +1: a shingle that all records have still weighs something.
        top = max(math.log((total + 1) / floor), 1e-3) if total else 1.0
        idf = np.maximum(np.log((total + 1) / np.maximum(common.column("n").to_numpy().astype(float), 1)), max(even * top, 1e-3))
        tables = spark.sparkContext.broadcast((common.column("h").to_numpy(), idf, top))

        parts = range(SKETCHED // 8)
        of_bands = lambda some: some.mapInArrow(_band_batches(tables, bands, rows, seed), "band long, rid long, " + ", ".join(f"s{i} long" for i in parts))
        banded, full = of_bands(sets), None
        # A bucket can't have more records than there are.
        if total > crowded:
            shown = of_bands(sets.filter(F.pmod(F.xxhash64("rid"), F.lit(SHOWN)) == 0)).groupBy("band").agg(F.count("*").alias("n"))
            full = stage(shown.filter(F.col("n") * SHOWN >= crowded).select("band"), "crowded")
            if full.limit(1).count():
                inside = stage(banded.select("band", "rid").join(small(full), "band", "left_semi").select("rid").distinct(), "inside")
                banded = banded.join(small(full), "band", "left_anti")
            else:
                full = None
        size = F.count("*").over(Window.partitionBy("band"))
        met = stage(banded.withColumn("n", size).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "bands")
        left = met.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).drop("blocks")
        right = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = right.withColumnsRenamed({"rid": "b", **{f"s{i}": f"t{i}" for i in parts}})
        pairs = left.withColumnRenamed("rid", "a").join(right, ["band", "block"]).filter("a < b").filter(sum((_agreeing(f"s{i}", f"t{i}") for i in parts), F.lit(0)) >= least)
        pairs = pairs.select("a", "b")
        if full is not None:
            pairs = pairs.unionByName(prefix_candidates(sets.join(small(inside), "rid", "left_semi"), tables, jaccard))
        candidates = stage(pairs.distinct(), "candidates")
        ids = stage(candidates.select(F.col("a").alias("rid")).unionByName(candidates.select(F.col("b").alias("rid"))).distinct(), "ids")
        near = sets.join(small(ids), "rid", "left_semi")
        both = (
            candidates.join(near.select(F.col("rid").alias("a"), F.col("sh").alias("sa")), "a")
            .join(near.select(F.col("rid").alias("b"), F.col("sh").alias("sb")), "b")
        )
        checked = both.mapInArrow(_verify(tables), "a long, b long, jaccard double, weighted double")
        self.links = stage(checked.filter((F.col("weighted") >= (threshold or 0.0)) & (F.col("jaccard") >= jaccard)), "links")

    def members(self) -> DataFrame:
        """(rid, rep): the class of each record that has shingles."""
        return self.all_sets.select("rid", "same").join(self.classes, "same").select("rid", "rep").distinct()

    def groups(self) -> DataFrame:
        """(rid, rep, group_id, links): each record's class, group of linked classes, and its class's links."""
        linked = connected_components(self.links.select("a", "b")).withColumnsRenamed({"node": "rep", "component": "group_id"})
        ends = self.links.select(F.col("a").alias("rep")).unionByName(self.links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
        return self.members().join(linked, "rep", "left").join(ends, "rep", "left").select("rid", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))

    def pairs(self) -> DataFrame:
        """(a, b), a < b: all pairs of records of linked classes, and of copies in one class."""
        m, links = self.members(), self.links
        a, b = m.select(F.col("rid").alias("x"), F.col("rep").alias("a")), m.select(F.col("rid").alias("y"), F.col("rep").alias("b"))
        across = links.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
        within = a.join(b, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
        return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def weighted_floor(jaccard: float, spread: float) -> float:
    """The least weighted similarity of two sets of a plain one, if no weight is over ``spread`` times another."""
    return jaccard / (jaccard + (1 - jaccard) * spread)


def sketch_and_bands(sought: float, rows: int, recall: float, bands: int | None = None) -> tuple[int, int]:
    """(places of a sketch that must agree, bands) that find the share ``recall`` of pairs of weighted similarity ``sought``.

    Of what may be lost, a fifth at most goes to the sketch and the rest to the bands. Bands that are given stay.
    """
    n = SKETCHED if bands is None else min(bands * rows, SKETCHED)
    p = sought + (1 - sought) / 256
    agree, lost = 0, 0.0
    while agree < n and (more := lost + math.comb(n, agree) * p**agree * (1 - p) ** (n - agree)) <= (1 - recall) / 5:
        agree, lost = agree + 1, more
    if bands is None:
        bands = max(math.ceil(SKETCHED / rows), math.ceil(math.log(1 - recall - lost) / math.log1p(-(sought**rows)))) if 0 < sought < 1 else math.ceil(SKETCHED / rows)
    return agree * (SKETCHED // n), bands
