"""Stable identifiers and digests, as expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = uuid.UUID("6b1b1e8e-3f6f-4c5e-9d07-6a2f0b9c1d11")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substring(variant, -1, 1), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stix_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}--"), uuid5(F.concat_ws("|", *parts)))


def report_id(content: Column, path: Column) -> Column:
    """The key of a message at a place: its digest, and a short one of the path."""
    return F.concat(F.sha2(content, 256), F.lit("-"), F.substring(F.sha2(F.encode(path, "UTF-8"), 256), 1, 8))
