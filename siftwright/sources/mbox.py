"""Mailboxes, message by message, from any file system that Spark reads.

A mailbox is read by Spark's own text source with the separator of messages for a line end, so that
large ones are split between tasks. Each task then puts together again what a separator in the
middle of a text had parted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.session import stage

#: Mailboxes of up to so many bytes are read once more for their digest.
HASHED = 2**30
_STAMPED = re.compile(rb"\S.*\d{4}\s*$")
_QUOTED = re.compile(rb"^>(>*From )", re.M)
_SCHEMA = "container string, block long, k long, content binary"


class _Box:
    """The pieces between separators, put together to messages: what begins one, and what only looks so."""

    def __init__(self) -> None:
        self.held: bytes | None = None
        self.torn = False

    def add(self, piece: bytes, first: bool = False, inside: bool = False) -> Iterator[bytes]:
        """A further piece; ``first`` of a mailbox, or the first of a task's share ``inside`` of one."""
        if first:
            if piece.startswith(b"From "):
                self.held = piece[5:].partition(b"\n")[2]
            return
        line, _, rest = piece.partition(b"\n")
        blank = self.held is None or self.held in (b"", b"\r") or self.held.endswith((b"\n", b"\n\r"))
        if inside and not _STAMPED.match(line):
            # No message begins here: the share begins in the middle of one.
            self.held, self.torn = b"\nFrom " + piece, True
        elif inside or self.held is None or blank and _STAMPED.match(line):
            yield from self.end()
            self.held = rest
        else:
            self.held += b"\nFrom " + piece

    def end(self, last: bool = False) -> Iterator[bytes]:
        """The message held; the blank line at its end, which belongs to the mailbox, goes."""
        if self.held is not None:
            whole = self.held.removesuffix(b"\r") if self.held.endswith(b"\n\r") else self.held
            if last:
                whole = re.sub(rb"(\n|\A)\r?\n\Z", rb"\1", whole)
            yield _QUOTED.sub(rb"\1", whole)
        self.held, self.torn = None, False


def split_mailbox(data: bytes) -> Iterator[bytes]:
    """The messages of a mailbox: separators go, quoted ones lose one ``>``."""
    box = _Box()
    for i, piece in enumerate(data.split(b"\nFrom ")):
        yield from box.add(piece, first=not i)
    yield from box.end(last=True)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    box, at, k, ends = _Box(), None, 0, False

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["container", "block", "k", "content"])

    for b in batches:
        rows: list[tuple] = []

        def out(messages: Iterator[bytes]) -> None:
            nonlocal k
            torn = box.torn
            for m in messages:
                rows.append((*at, -1 if torn else k, m))
                k += not torn

        for container, block, last, piece in zip(*(b.column(c).to_pylist() for c in ("container", "block", "last", "piece")), strict=True):
            fresh = (container, block) != at
            if fresh:
                out(box.end(ends))
                at, k, ends = (container, block), 0, last
            out(box.add(piece, first=fresh and not block, inside=fresh and block > 0))
        if rows:
            yield batch(rows)
    if box.held is not None:
        yield batch([(*at, -1 if box.torn else k, m) for m in box.end(ends)])


def _mended(rows: DataFrame) -> DataFrame:
    """Messages with what stands of them at the beginning of later tasks' shares (``k`` is -1 there); next to no mailbox has such."""
    torn, whole = rows.filter("k < 0"), rows.filter("k >= 0")
    if not torn.limit(1).count():
        return whole
    ends = whole.groupBy("container", "block").agg(F.max("k").alias("k")).withColumnsRenamed({"block": "b", "container": "c"})
    owners = torn.select("container", "block").join(ends, (F.col("container") == F.col("c")) & (F.col("b") < F.col("block"))).groupBy("container", "block").agg(F.max(F.struct("b", "k")).alias("owner"))
    more = torn.drop("k").join(owners, ["container", "block"]).groupBy("container", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "content"))).alias("more"))
    more = more.select("container", F.col("owner.b").alias("block"), F.col("owner.k").alias("k"), F.aggregate("more", F.lit(b""), lambda a, x: F.concat(a, x["content"])).alias("more"))
    return whole.join(more, ["container", "block", "k"], "left").select("container", "block", "k", F.concat("content", F.coalesce("more", F.lit(b""))).alias("content"))


def messages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content, msg_format, container, container_sha256) of mailboxes: ``file#n``, and ``file#n@block`` in further blocks of split ones.

    Text before the first separator is left out. Mailboxes over ``HASHED`` bytes have no digest.
    """
    m = F.col("_metadata")
    pieces = spark.read.option("lineSep", "\nFrom ").text(paths).select(
        F.url_decode(F.replace(m["file_path"], F.lit("+"), F.lit("%2B"))).alias("container"), m["file_block_start"].alias("block"), (m["file_block_start"] + m["file_block_length"] >= m["file_size"]).alias("last"), F.col("value").cast("binary").alias("piece")
    )
    key = lambda c: F.regexp_replace(c, "^file:/*", "/")
    rows = _mended(stage(pieces.mapInArrow(_joined, _SCHEMA).withColumn("container", key("container")), "mailboxes"))
    digests = spark.read.format("binaryFile").load(paths).filter(F.col("length") <= HASHED).select(key("path").alias("container"), F.sha2("content", 256).alias("container_sha256"))
    name = F.concat("container", F.lit("#"), F.col("k").cast("string"), F.when(F.col("block") > 0, F.concat(F.lit("@"), F.col("block").cast("string"))).otherwise(""))
    return rows.join(digests, "container", "left").select(name.alias("path"), "content", F.lit("mbox").alias("msg_format"), "container", "container_sha256")
