"""Long exact spans that records share, by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the least of the hashes of the runs of ``m``
words in it, the leftmost of equals. Consecutive windows of a document that share one minimiser
occurrence form a super-k-mer, which travels as one packed string (its words) to the bucket of the
minimiser. Equal windows have equal minimisers, so each bucket counts its windows exactly, by
sorting, without hearing of other buckets.

Two measures keep that small. A minimiser that only one document has can't carry a shared window;
such minimisers go in a first pass that ships hashes only. And a minimiser that very many places
share is not brought together: its windows are counted by a partial aggregation and joined back
with salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.session import stage

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000
#: Characters that one step of a worker takes.
STEP_CHARS = 4_000_000


def words_of(text: str) -> list[str]:
    """The words of a text: what space, tab and line ends separate."""
    return text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if text else []


def _split(text: str | None) -> list[str]:
    return [w for w in words_of(text) if w] if text else []


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def minimisers(hashes: np.ndarray, ends: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each super-k-mer of documents laid end to end.

    ``hashes`` are the words' hashes, ``ends`` the documents' ends; windows don't cross these.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    runs = np.zeros(len(hashes) - m + 1, np.uint64)
    for j in range(m):
        runs = runs * _BASE + hashes[j : j + len(runs)]
    runs ^= runs >> np.uint64(30)
    runs *= _MIX[0]
    runs ^= runs >> np.uint64(27)
    runs *= _MIX[1]
    runs ^= runs >> np.uint64(31)
    width = k - m + 1
    where = np.empty(n, np.int64)
    for i in range(0, n, 65536):
        block = np.lib.stride_tricks.sliding_window_view(runs[i : min(i + 65536, n) + width - 1], width)
        where[i : i + len(block)] = block.argmin(axis=1) + np.arange(i, i + len(block))
    start = np.arange(n)
    doc_end = ends[np.searchsorted(ends, start, side="right")]
    whole = start + k <= doc_end
    first = whole.copy()
    first[1:] &= (where[1:] != where[:-1]) | ~whole[:-1] | (doc_end[1:] != doc_end[:-1])
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, np.uint64), at, at
    group = np.cumsum(first) - 1
    size = np.bincount(group[whole], minlength=len(at))
    return runs[where[at]], at, size


def _steps(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded text; a longer text is a piece of its own."""
    size = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, s in enumerate(size):
        if total and total + s > STEP_CHARS:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += s
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _lay_out(texts: list[str | None], cache: _WordHash) -> tuple[list[str], np.ndarray, np.ndarray]:
    words: list[str] = []
    ends = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words += _split(t)
        ends[i] = len(words)
    return words, np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), ends


def _sketch(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for whole in batches:
            for b in _steps(whole, "text"):
                _, hashes, ends = _lay_out(b.column("text").to_pylist(), cache)
                mini, at, _ = minimisers(hashes, ends, k, m)
                ids = b.column("doc").to_numpy()[np.searchsorted(ends, at, side="right")]
                pairs = np.unique(np.rec.fromarrays([mini.view(np.int64), ids], names="m,d"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]["m"]), pa.array(pairs[0]["d"]), pa.array(pairs[1])], names=["mini", "doc", "places"])

    return run


def _pack(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for whole in batches:
            for b in _steps(whole, "text"):
                words, hashes, ends = _lay_out(b.column("text").to_pylist(), cache)
                mini, at, size = minimisers(hashes, ends, k, m)
                doc = np.searchsorted(ends, at, side="right")
                wanted, hot = b.column("wanted").to_pylist(), b.column("hot").to_pylist()
                ids, begin = b.column("doc").to_numpy(), np.concatenate([[0], ends])
                out: tuple[list, ...] = ([], [], [], [], [])
                for r, (cool, warm) in enumerate(zip(wanted, hot, strict=True)):
                    lo, hi = np.searchsorted(doc, [r, r + 1])
                    own = mini[lo:hi].view(np.int64)
                    for keep, apart in ((cool, False), (warm, True)):
                        for j in np.flatnonzero(np.isin(own, np.array(keep, np.int64))) + lo if keep else ():
                            spans = [(at[j] + x, 1) for x in range(size[j])] if apart else [(at[j], size[j])]
                            for s, n in spans:
                                row = (int(own[j - lo]), int(ids[r]), int(s - begin[r]), " ".join(words[s : s + n + k - 1]), apart)
                                for col, v in zip(out, row, strict=True):
                                    col.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["mini", "doc", "start", "packed", "hot"])

    return run


def shared_windows(docs: list[int], starts: list[int], packed: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, window) of each window of the packed strings that two documents have, counted by sorting.

    Words get numbers in this bucket, so that windows are compared word for word.
    """
    number: dict[str, int] = {}
    flat: list[int] = []
    counts = np.empty(len(packed), np.int64)
    for i, p in enumerate(packed):
        w = p.split(" ")
        counts[i] = len(w)
        flat += [number.setdefault(x, len(number)) for x in w]
    codes = np.array(flat, np.int32)
    per = counts - k + 1
    row = np.repeat(np.arange(len(packed)), per)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    at = (np.cumsum(counts) - counts)[row] + inside
    doc, start = np.array(docs)[row], np.array(starts)[row] + inside
    view = np.lib.stride_tricks.sliding_window_view(codes, k)
    key = np.zeros(len(at), np.uint64)
    for j in range(k):
        key = key * _BASE + codes[at + j].astype(np.uint64) + np.uint64(1)
    order = np.lexsort((doc, key))
    same = np.ones(len(order) - 1, bool)
    for i in range(0, len(same), 50_000):
        o = order[i : i + 50_001]
        same[i : i + 50_000] = (view[at[o[1:]]] == view[at[o[:-1]]]).all(axis=1)
    if ((key[order[1:]] == key[order[:-1]]) & ~same).any():
        # Two unlike windows have one hash: sort the windows themselves.
        order = np.lexsort((doc, *[codes[at + j] for j in range(k)]))
        same = (view[at[order[1:]]] == view[at[order[:-1]]]).all(axis=1)
    group = np.concatenate([[0], np.cumsum(~same)])
    d = doc[order]
    lo, hi = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(lo, group, d)
    np.maximum.at(hi, group, d)
    shared = order[(lo != hi)[group]]
    return doc[shared], start[shared]


def _count_buckets(k: int, chunk_chars: int = 8_000_000):
    """Over partitions sorted by minimiser: the shared windows, in chunks of whole buckets."""

    def emit(held: list[tuple[list, list, list]]) -> pa.RecordBatch:
        cols = [sum((h[c] for h in held), []) for c in range(3)]
        doc, start = shared_windows(*cols, k)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64())], names=["doc", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list, list]] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            mini = b.column("mini").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(mini[1:] != mini[:-1]) + 1, [len(mini)]])
            cols = [b.column(c).to_pylist() for c in ("doc", "start", "packed")]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if size > chunk_chars and mini[lo] != last:
                    yield emit(held)
                    held, size = [], 0
                held.append(tuple(c[lo:hi] for c in cols))
                size += sum(map(len, cols[2][lo:hi]))
                last = mini[lo]
        if held:
            yield emit(held)

    return run


def shared_spans(docs: DataFrame, id_col: str, text_col: str, k: int = 25, m: int = 8, hot: int = 2000, salts: int = 16) -> DataFrame:
    """(id, first_word, end_word): the unbroken ranges of words in sequences of ``k`` that another document has.

    Words are what space, tab and line ends separate, compared exactly. Ids must be BIGINT and
    unique. Null and empty texts and texts of fewer than ``k`` words share nothing; a passage that
    only one document repeats isn't shared; documents equal throughout share all. Any other columns
    are ignored; an empty table gives an empty result.

    ``hot``: a minimiser in more places than that is counted by aggregation instead of in a bucket,
    which bounds a bucket's memory and changes no result.
    """
    if not 1 <= m <= k:
        raise ValueError("m must be from 1 to k")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null and length(text) > 0")
    # Two branches read these: as a stage, texts are taken apart for them once.
    hashes = stage(texts.mapInArrow(_sketch(k, m), "mini long, doc long, places long"), "minimisers")
    wide = hashes.groupBy("mini").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum("places").alias("n")).filter("lo <> hi").select("mini", "n")
    shared_minis = hashes.join(wide, "mini")
    by_doc = shared_minis.groupBy("doc").agg(
        F.collect_set(F.when(F.col("n") <= hot, F.col("mini"))).alias("wanted"), F.collect_set(F.when(F.col("n") > hot, F.col("mini"))).alias("hot")
    )
    packed = stage(texts.join(by_doc, "doc").mapInArrow(_pack(k, m), "mini long, doc long, start long, packed string, hot boolean"), "superkmers")

    cool = packed.filter("not hot").select("mini", "doc", "start", "packed").repartition("mini").sortWithinPartitions("mini").mapInArrow(_count_buckets(k), "doc long, start long")

    single = packed.filter("hot").select("doc", "start", "packed")
    both = single.groupBy("packed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo <> hi")
    salted = both.select("packed", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    warm = single.withColumn("salt", F.pmod("doc", F.lit(salts)).cast("int")).join(salted, ["packed", "salt"], "left_semi").select("doc", "start")

    w = Window.partitionBy("doc").orderBy("start")
    marked = cool.unionByName(warm).withColumn("new", (F.col("start") > F.coalesce(F.lag("start").over(w) + k, F.lit(-1))).cast("long"))
    island = marked.withColumn("island", F.sum("new").over(w))
    return island.groupBy("doc", "island").agg(F.min("start").alias("first_word"), (F.max("start") + k).alias("end_word")).select(F.col("doc").alias(id_col), "first_word", "end_word")


def shared_share(docs: DataFrame, id_col: str, text_col: str, k: int = 25, **options) -> DataFrame:
    """(id, n_words, shared_words, share): how much of each document is in spans that others have; 0 for none."""
    spans = shared_spans(docs, id_col, text_col, k, **options).groupBy(id_col).agg(F.sum(F.col("end_word") - F.col("first_word")).alias("shared_words"))
    n = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\r\n]+"), lambda x: x != "")).cast("long")
    return docs.select(id_col, n.alias("n_words")).join(spans, id_col, "left").select(
        id_col, "n_words", F.coalesce("shared_words", F.lit(0)).alias("shared_words"),
        F.when(F.col("n_words") > 0, F.round(F.coalesce("shared_words", F.lit(0)) / F.col("n_words"), 6)).otherwise(F.lit(0.0)).alias("share"),
    )
