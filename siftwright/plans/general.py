"""Queries of the general problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.operators.delivery import DeliveryLedger, digest_key, ingest, message_key, redeliveries
from siftwright.operators.timestamps import after_last_semicolon, normalise, source_zones
from siftwright.session import new_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery of a message but its first."""
    m = table(spark, sf_dir, "messages")
    return redeliveries(m, "delivery_id", [message_key(F.col("message_id")), digest_key(F.col("sha256"))], [F.col("received_at")])


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery, taken half-year by half-year into one ledger: whether its message had been seen when it came."""
    m = table(spark, sf_dir, "messages")
    half = F.concat(F.substring("batch_id", 2, 4), F.when(F.substring("batch_id", 6, 2) <= "06", "a").otherwise("b"))
    m = m.withColumn("half", F.coalesce(half, F.lit("")))
    ledger = DeliveryLedger(spark, new_path(spark, "ledger"))
    parts = []
    for r in m.select("half").distinct().orderBy("half").collect():
        one = m.filter(F.col("half") == r.half)
        parts.append(ingest(one, "delivery_id", [message_key(F.col("message_id")), digest_key(F.col("sha256"))], [F.col("received_at")], ledger).withColumn("half", F.lit(r.half)))
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTC instant of every message and hop that states one."""
    zones = source_zones(table(spark, sf_dir, "relays"), "relay_host", "tz_name")
    messages = normalise(table(spark, sf_dir, "messages"), "delivery_id", "submit_host", [F.col("date_hdr")], zones)
    hops = normalise(table(spark, sf_dir, "hops"), "hop_id", "by_host", [F.col("ts"), after_last_semicolon(F.col("raw"))], zones)
    kind = lambda df, name, key: df.select(F.lit(name).alias("record_kind"), F.col(key).alias("row_id"), "utc_us")
    return kind(messages, "message", "delivery_id").unionByName(kind(hops, "hop", "hop_id"))


QUERIES = {"p1_found": p1_found, "p1_batches": p1_batches, "p3_found": p3_found}
SQL: dict[str, str] = {}
