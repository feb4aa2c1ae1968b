"""Recorded lookups: of DNS, and of reputation services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DNS = "resolver string, lookups array<struct<name: string, type: string, answers: array<string>, error: string, at: string>>"
HTTP = "fetcher string, requests array<struct<provider: string, request: string, at: string, response: string, error: string, cached: boolean>>"


def dns(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, answers, error, at): the last answer of each name and type, names in lower case without final dot."""
    rows = spark.read.schema(DNS).json(path, multiLine=True).select(F.explode("lookups").alias("x")).select("x.*")
    rows = rows.withColumn("name", F.lower(F.regexp_replace("name", r"\.$", ""))).withColumn("type", F.upper("type"))
    return rows.groupBy("name", "type").agg(F.max_by(F.struct("answers", "error", "at"), F.coalesce("at", F.lit(""))).alias("x")).select("name", "type", "x.*")


def http(spark: SparkSession, path: str) -> DataFrame:
    """(provider, request, response, error): recorded answers by their request."""
    rows = spark.read.schema(HTTP).json(path, multiLine=True).select(F.explode("requests").alias("x")).select("x.*")
    return rows.groupBy("provider", "request").agg(F.max_by(F.struct("response", "error", "at"), F.coalesce("at", F.lit(""))).alias("x")).select("provider", "request", "x.*")


def save_dns(records: DataFrame, path: str, resolver: str = "recorded") -> None:
    """Write records in the form that :func:`dns` reads; recordings are small, and written as one file."""
    one = records.agg(F.collect_list(F.struct("name", "type", "answers", "error", F.coalesce("at", F.lit("")).alias("at"))).alias("lookups"))
    one.select(F.lit(resolver).alias("resolver"), "lookups").coalesce(1).write.mode("overwrite").json(path)


def answered(queries: DataFrame, records: DataFrame) -> DataFrame:
    """``queries(..., name, type)`` with ``answers`` and ``error`` of ``records``; what wasn't recorded has an error that says so.

    Names meet without regard to letter case and final dot; a join on keys, so neither side need be small.
    """
    key = F.lower(F.regexp_replace("name", r"\.+$", ""))
    held = records.select(F.lower(F.regexp_replace("name", r"\.+$", "")).alias("_n"), F.upper("type").alias("_t"), "answers", F.col("error").alias("_e"), F.lit(True).alias("_found"))
    both = queries.join(held, (key == F.col("_n")) & (F.upper(F.col("type")) == F.col("_t")), "left")
    return both.select(*queries.columns, "answers", F.coalesce("_e", F.when(F.col("_found").isNull(), F.lit("not recorded"))).alias("error"))
