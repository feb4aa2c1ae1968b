"""Archives looked into within fixed budgets: one row for each member, whatever the nesting."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions.filetype import DOCUMENT, RISKY, detect

MOST_MEMBERS, DEEPEST, MEMBER_BYTES, TOTAL_BYTES = 10_000, 3, 20 * 2**20, 100 * 2**20
BOMB_BYTES, BOMB_RATIO, BOMB_LEAST = 2**30, 100, 50 * 2**20
ZIPS, STREAMS = ("zip", "jar", "apk"), {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}
MEMBERS = "report_id string, part string, seq int, container string, name string, size long, compressed long, is_dir boolean, encrypted boolean, depth int, sha256 string, detected_type string, read boolean, overlapping boolean, error string"


class _Walk:
    """One archive's walk; ``left`` is what may still be unpacked."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.left, self.cut = TOTAL_BYTES, False

    def add(self, container: str | None, name: str, size: int, compressed: int, depth: int, data: bytes | None, **more) -> None:
        if len(self.rows) >= MOST_MEMBERS:
            self.cut = True
            return
        kind = detect(data) if data is not None else None
        self.rows.append({"container": container, "name": name, "size": size, "compressed": compressed, "is_dir": False, "encrypted": False, "depth": depth, "sha256": hashlib.sha256(data).hexdigest() if data is not None else None, "detected_type": kind, "read": data is not None, "overlapping": False, "error": None} | more)
        if data is not None and kind in (*ZIPS, *STREAMS, "tar"):
            if depth < DEEPEST:
                self.walk(data, kind, f"{container}/{name}" if container else name, depth + 1)
            else:
                self.cut = True

    def take(self, stream, size: int) -> bytes | None:
        """At most the budget's bytes of a stream; null if there are more."""
        most = min(MEMBER_BYTES, self.left)
        if size > most:
            self.cut = True
            return None
        data = stream.read(most + 1)
        if len(data) > most:
            self.cut = True
            return None
        self.left -= len(data)
        return data

    def walk(self, data: bytes, kind: str, container: str | None = None, depth: int = 0) -> None:
        try:
            if kind in ZIPS:
                self._zip(data, container, depth)
            elif kind == "tar":
                self._tar(data, container, depth)
            else:
                with STREAMS[kind](io.BytesIO(data)) as f:
                    inner = self.take(f, 0)
                self.add(container, "content", len(inner) if inner is not None else 0, len(data), depth, inner)
        except Exception as e:
            self.rows.append({"container": container, "name": None, "size": 0, "compressed": 0, "is_dir": False, "encrypted": False, "depth": depth, "sha256": None, "detected_type": None, "read": False, "overlapping": False, "error": f"{type(e).__name__}: {e}"[:200]})

    def _zip(self, data: bytes, container: str | None, depth: int) -> None:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            end = 0
            for i in sorted(z.infolist(), key=lambda i: i.header_offset):
                over, end = i.header_offset < end, i.header_offset + 30 + i.compress_size
                locked, body = bool(i.flag_bits & 1), None
                if not locked and not i.is_dir():
                    try:
                        with z.open(i) as f:
                            body = self.take(f, i.file_size)
                    except Exception:
                        body = None
                self.add(container, i.filename, i.file_size, i.compress_size, depth, body, is_dir=i.is_dir(), encrypted=locked, overlapping=over)

    def _tar(self, data: bytes, container: str | None, depth: int) -> None:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                body = None
                if m.isfile() and (f := t.extractfile(m)):
                    body = self.take(f, m.size)
                self.add(container, m.name, m.size, m.size, depth, body, is_dir=m.isdir())


def list_members(data: bytes, kind: str) -> list[dict]:
    """The members of an archive, inner ones after the archive that holds them."""
    walk = _Walk()
    walk.walk(data, kind)
    return [r | {"seq": i} for i, r in enumerate(walk.rows)] + ([{"seq": len(walk.rows), "name": None, "error": "truncated", "depth": 0}] if walk.cut else [])


def members(attachments: DataFrame) -> DataFrame:
    """(report_id, part, seq, container, name, ...) of ``attachments(report_id, part, detected_type, payload)``.

    Only archives that can be listed go to Python. A row with an ``error`` and no name tells of a
    corrupt archive, or of one that was cut at a limit (``truncated``).
    """
    cols = [c.split(" ")[0] for c in MEMBERS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"report_id": r.report_id, "part": r.part, **m} for r in f.itertuples() for m in list_members(bytes(r.payload), r.detected_type)]
            out = pd.DataFrame(rows, columns=cols)
            for c in ("seq", "depth"):
                out[c] = out[c].astype("Int32")
            for c in ("size", "compressed"):
                out[c] = out[c].astype("Int64")
            yield out

    listed = attachments.filter(F.col("detected_type").isin(*ZIPS, *STREAMS, "tar") & F.col("payload").isNotNull())
    return listed.select("report_id", "part", "detected_type", "payload").mapInPandas(run, MEMBERS)


def archives(found: DataFrame, attachments: DataFrame) -> DataFrame:
    """(report_id, part, members, total_bytes, encrypted, nesting, traversal, risky, truncated, corrupt, bomb): one row an archive."""
    name = F.replace("name", F.lit("\\"), F.lit("/"))
    leaf = F.lower(F.substring_index(name, "/", -1))
    labels = F.split(leaf, r"\.")
    ext = F.when(F.size(labels) > 1, F.trim(F.element_at(labels, -1)))
    double = (F.size(labels) >= 3) & F.get(labels, F.size(labels) - 2).isin(sorted(DOCUMENT)) & ext.isin(sorted(RISKY))
    typed = F.col("detected_type").isin("exe", "elf", "macho", "lnk", "iso", "vhd", "vhdx", "onenote", "html", "svg")
    yes = lambda c: F.coalesce(c, F.lit(False))
    per = found.groupBy("report_id", "part").agg(
        F.count("name").alias("members"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count_if(yes(F.col("encrypted"))).alias("encrypted"), F.max("depth").alias("nesting"),
        F.count_if(yes(name.startswith("/") | name.rlike("^[A-Za-z]:") | F.array_contains(F.split(name, "/"), ".."))).alias("traversal"), F.count_if(yes(~F.col("is_dir")) & yes(ext.isin(sorted(RISKY)) | double | typed)).alias("risky"),
        F.bool_or(yes(F.col("error") == "truncated")).alias("truncated"), F.bool_or(F.col("error").isNotNull() & (F.col("error") != "truncated")).alias("corrupt"), F.bool_or(yes(F.col("overlapping"))).alias("overlapping"),
    )
    ratio = F.col("total_bytes") / F.greatest("size", F.lit(1))
    bomb = F.col("overlapping") | (F.col("total_bytes") > BOMB_BYTES) | ((ratio > BOMB_RATIO) & (F.col("total_bytes") > BOMB_LEAST))
    return per.join(attachments.select("report_id", "part", "size"), ["report_id", "part"]).withColumn("bomb", bomb).drop("size", "overlapping")
