"""Indicators of compromise: taken from the tables, in one long table, and shared between reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions.domains import domain_of
from siftwright.functions.ip import ip_type

#: Types whose values differ by letter case.
CASED = ("url", "filename", "subject")


def _rows(df: DataFrame, seq: int, kind: Column | str, value: Column, role: str, context: Column | None = None) -> DataFrame:
    as_col = F.lit(kind) if isinstance(kind, str) else kind
    return df.select("report_id", F.lit(seq).alias("seq"), as_col.alias("type"), F.trim(value).alias("value"), F.lit(role).alias("role"), F.substring(context if context is not None else F.lit(""), 1, 200).alias("context"))


def extract(messages: DataFrame, hops: DataFrame, urls: DataFrame, attachments: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(report_id, seq, type, value, role, context): each (type, value, role) of a report once, the first that was found.

    Letter case makes no difference but in URLs, file names and subjects. Null and empty values are left out.
    """
    parts: list[DataFrame] = []
    for i, (role, col) in enumerate((("from", "from_address"), ("return-path", "return_path"), ("sender", "sender"))):
        if col in messages.columns:
            parts += [_rows(messages, i, "email-addr", F.col(col), role), _rows(messages, i, "domain", domain_of(F.col(col)), f"{role}-domain")]
    reply = messages.select("report_id", F.explode("reply_to").alias("reply"))
    parts += [_rows(reply, 3, "email-addr", F.col("reply"), "reply-to"), _rows(reply, 3, "domain", domain_of(F.col("reply")), "reply-to-domain")]
    parts += [_rows(messages, 4, "subject", F.col("subject"), "subject"), _rows(messages, 5, "message-id", F.col("message_id"), "message-id")]
    public = hops.filter("from_ip is not null and not ip_is_private")
    parts.append(_rows(public, 6, F.coalesce(ip_type(F.col("from_ip")), F.lit("ipv4")), F.col("from_ip"), "received-ip", F.concat_ws(" ", F.lit("hop"), "idx", F.lit("from"), "from_host")))
    if "x_originating_ip" in messages.columns:
        own = messages.withColumn("_ip", F.trim(F.regexp_replace("x_originating_ip", r"[\[\] ]", ""))).withColumn("_t", ip_type(F.col("_ip"))).filter("_t is not null")
        parts.append(_rows(own, 7, F.col("_t"), F.col("_ip"), "x-originating-ip"))
    followed = urls.filter(F.col("scheme").isin("http", "https", "ftp", ""))
    bare = F.regexp_replace("host", r"^\[|\]$", "")
    parts += [_rows(followed, 8, "url", F.col("url"), "link", F.array_join("sources", ", ")), _rows(urls, 9, F.coalesce(ip_type(bare), F.lit("domain")), bare, "link-host")]
    if attachments is not None:
        ctx = F.concat(F.coalesce("filename", F.concat(F.lit("part "), "part")), F.lit(" ("), F.coalesce("detected_type", "content_type"), F.lit(")"))
        parts += [_rows(attachments, 10, k, F.col(c), "attachment", ctx) for k, c in (("filename", "filename"), ("sha256", "sha256"), ("sha1", "sha1"), ("md5", "md5"))]
    if members is not None:
        inside = members.filter("sha256 is not null")
        name = F.concat_ws("/", "container", "name")
        parts += [_rows(inside, 11, "sha256", F.col("sha256"), "archive-member", name), _rows(inside, 12, "filename", F.substring_index(name, "/", -1), "archive-member")]
    every = reduce(DataFrame.unionByName, parts).filter("value <> ''")
    key = F.when(F.col("type").isin(*CASED), F.col("value")).otherwise(F.lower("value"))
    w = Window.partitionBy("report_id", "type", "_key", "role").orderBy("seq", "value", "context")
    return every.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_key")


def shared(indicators: DataFrame, least: int = 2) -> DataFrame:
    """(type, value, reports, roles) of values that ``least`` reports or more have; subjects and identifiers don't count.

    Counted by partial aggregation over distinct (value, report) pairs, so a value that a third of
    all reports have is never brought together.
    """
    some = indicators.filter(~F.col("type").isin("subject", "message-id")).withColumn("value", F.when(F.col("type").isin(*CASED), F.col("value")).otherwise(F.lower("value")))
    pairs = some.groupBy("type", "value", "report_id").agg(F.collect_set("role").alias("roles"))
    return pairs.groupBy("type", "value").agg(F.count("*").alias("reports"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("roles")).filter(F.col("reports") >= least)


def search(indicators: DataFrame, subjects: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """(report_id, type, value) that contain ``query`` without regard to case; of one type, or of all and the subjects."""
    q = F.lit(query.lower())
    some = indicators.filter(F.contains(F.lower("value"), q))
    if kind:
        return some.filter(F.col("type") == kind).select("report_id", "type", "value").distinct()
    titles = subjects.filter(F.contains(F.lower("subject"), q)).select("report_id", F.lit("subject").alias("type"), F.col("subject").alias("value"))
    return some.select("report_id", "type", "value").unionByName(titles).distinct()


def report_targets(indicators: DataFrame, org) -> DataFrame:
    """(report_id, kind, value): what reputation services are asked about for each report: public addresses, organisational domains, URLs, digests.

    ``org`` is the function of :func:`siftwright.functions.domains.org_domain`.
    """
    t, kind = indicators, F.col("type")
    name = F.when(kind.isin("ipv4", "ipv6"), "ip").when(kind == "domain", "domain").when(kind == "url", "url").when(kind == "sha256", "file")
    value = F.when(kind == "domain", org(F.col("value"))).when(kind == "sha256", F.lower("value")).otherwise(F.col("value"))
    return t.select("report_id", name.alias("kind"), value.alias("value")).filter("kind is not null and value <> ''").distinct()


def targets(indicators: DataFrame, org) -> DataFrame:
    """(kind, value): the distinct ones of all reports."""
    return report_targets(indicators, org).select("kind", "value").distinct()
