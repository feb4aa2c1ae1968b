"""The engine's functions under names for SQL, table functions among them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.functions import filetype, ip, similarity, urls
from siftwright.functions.domains import org_domain, suffix_pattern, suffix_rules


@F.pandas_udf(T.StringType())
def detect_type(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else filetype.detect(bytes(x)))


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity.osa(x, y, max(len(x), len(y))) for x, y in zip(a, b, strict=True)], dtype="Int32")


class MimeParts:
    """mime_parts(raw): the parts of a message."""

    def eval(self, raw: bytes):
        from siftwright.sources import parse

        if raw is not None:
            for p in parse.parse_message("", bytes(raw))[0]["parts"]:
                yield p["part"], p["content_type"], p["filename"], p["size"], p["sha256"]


class ArchiveMembers:
    """archive_members(data): the members of an archive, whatever the nesting."""

    def eval(self, data: bytes):
        from siftwright.operators import archives

        kind = filetype.detect(bytes(data)) if data is not None else None
        if kind in (*archives.ZIPS, *archives.STREAMS, "tar"):
            for m in archives.list_members(bytes(data), kind):
                if m.get("name"):
                    yield m["container"], m["name"], m["size"], m["encrypted"], m["sha256"]


class MboxMessages:
    """mbox_messages(data): the messages of a mailbox."""

    def eval(self, data: bytes):
        from siftwright.sources.mbox import split_mailbox

        for i, m in enumerate(split_mailbox(bytes(data or b""))):
            yield i, m


def register(spark: SparkSession) -> None:
    """Register all of them with a session."""
    if suffix_rules(spark) is None:
        pattern = suffix_pattern().replace("\\", "\\\\")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION org_domain(host STRING) RETURNS STRING RETURN nullif(regexp_extract(regexp_replace(lower(trim(host)), '[.]+$', ''), '{pattern}', 0), '')")
    else:
        spark.udf.register("org_domain", org_domain(spark))
    for name, f in (("skeleton", similarity.skeleton), ("decode_idna", similarity.decode_idna), ("osa_distance", osa_distance), ("detect_type", detect_type), ("split_url", urls.split_url), ("ip_is_private", ip.ip_is_private)):
        spark.udf.register(name, f)
    for name, cls, kind in (
        ("mime_parts", MimeParts, "part string, content_type string, filename string, size long, sha256 string"), ("archive_members", ArchiveMembers, "container string, name string, size long, encrypted boolean, sha256 string"), ("mbox_messages", MboxMessages, "idx int, content binary"),
    ):
        spark.udtf.register(name, F.udtf(cls, returnType=kind))
