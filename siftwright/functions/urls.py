"""URLs: found in text, taken apart, judged one by one, and collected for each report."""

from __future__ import annotations

import ipaddress
from functools import reduce
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short-link hosts, schemes that run code, schemes that aren't links.
SHORTENERS = "bit.ly bitly.com tinyurl.com t.co goo.gl ow.ly is.gd buff.ly rebrand.ly cutt.ly shorturl.at rb.gy t.ly tiny.cc s.id lnkd.in bl.ink short.io v.gd qrco.de tinu.be shorturl.asia u.to x.gd".split()
DANGEROUS = ("javascript", "vbscript", "data", "file")
IGNORED = ("mailto", "tel", "sms", "cid", "about")
FILE_ENDINGS = "pdf doc docx xls xlsx xlsm ppt pptx zip rar 7z txt csv htm html php asp aspx jpg jpeg png gif svg exe msi js iso img eml msg json xml mp3 mp4 wav".split()
MAX_URLS = 5000


def text_urls(text: Column) -> Column:
    """The URLs in a text, without the punctuation after them."""
    found = F.regexp_extract_all(text, F.lit(r"""(?i)(?:\b(?:https?|ftp)://|\bwww\.)[^\s<>"'`]+"""), F.lit(0))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"""[.,;:!?)\]}'">]+$""", "")), lambda u: F.length(u) > 4)


_APART = T.StructType([T.StructField(n, t) for n, t in (("scheme", T.StringType()), ("host", T.StringType()), ("userinfo", T.BooleanType()), ("port", T.IntegerType()), ("encoded", T.BooleanType()), ("ip", T.StringType()), ("parsed", T.BooleanType()))])


def _ip_of(host: str | None) -> str | None:
    """The address that a host is, in digits of any form."""
    if not host:
        return None
    try:
        return str(ipaddress.ip_address(host.strip("[]")))
    except ValueError:
        pass
    try:
        n = int(host, 16) if host.startswith("0x") else int(host) if host.isdecimal() else 0
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(n)) if 0 < n <= 0xFFFFFFFF else None


def take_apart(url: str | None) -> dict:
    """scheme, host, userinfo, port, encoded and ip of a URL; ``parsed`` is false where it can't be read."""
    out = {"scheme": "", "host": None, "userinfo": False, "port": None, "encoded": False, "ip": None, "parsed": False}
    if url is None:
        return out
    u = url.strip()
    if u.lower().startswith("www."):
        u = "http://" + u
    try:
        p = urlsplit(u)
        out |= {"scheme": p.scheme.lower(), "host": p.hostname, "parsed": True, "encoded": "%" in p.netloc, "ip": _ip_of(p.hostname)}
        out |= {"userinfo": p.username is not None, "port": p.port}
    except ValueError:
        if out["parsed"]:
            out["userinfo"] = "@" in u
        else:
            out["scheme"] = u.split(":", 1)[0].lower() if ":" in u else ""
    return out


@F.pandas_udf(_APART)
def split_url(url: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([take_apart(u) for u in url], columns=["scheme", "host", "userinfo", "port", "encoded", "ip", "parsed"])
    return out.astype({"port": "Int32"})


def link_text_host(text: Column) -> Column:
    """The host that a link's text shows, if it shows one; file names aren't hosts."""
    t = F.trim(text)
    host = F.lower(F.regexp_extract(t, r"(?i)^(?:(?:https?|ftp)://)?(?:www\.)?((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z][a-z0-9-]{1,62})(?:[:/?#]\S*)?$", 1))
    said = t.rlike(r"(?i)^(?:(?:https?|ftp)://|www\.)")
    return F.when((host != "") & (said | ~F.substring_index(host, ".", -1).isin(FILE_ENDINGS)), host)


def url_findings(urls: DataFrame) -> DataFrame:
    """(report_id, url, code, severity) of ``urls(report_id, url)``; the first of the early rows ends a URL's checks."""
    u = F.col("u")
    host = u["host"]
    danger, broken = u["scheme"].isin(*DANGEROUS), ~u["parsed"]
    on = lambda cond, code, sev: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
    labels = F.split(host, r"\.")
    with_host = [
        (u["ip"].isNotNull(), "URL_IP_HOST", "medium"),
        (F.exists(labels, lambda x: x.startswith("xn--")) | host.rlike(r"[^\x00-\x7F]"), "URL_IDN_HOST", "medium"),
        (F.regexp_replace(host, r"^www\.", "").isin(SHORTENERS), "URL_SHORTENER", "low"),
        (u["port"].isNotNull() & ~u["port"].isin(80, 443), "URL_NONSTANDARD_PORT", "low"),
        (u["ip"].isNull() & (F.size(labels) >= 5), "URL_DEEP_SUBDOMAIN", "low"),
    ]
    sound = [on(u["userinfo"], "URL_USERINFO", "high"), on(u["encoded"], "URL_ENCODED_HOST", "medium"), *(on(host.isNotNull() & (host != "") & c, code, sev) for c, code, sev in with_host)]
    found = F.when(danger, F.array(on(F.lit(True), "URL_DANGEROUS_SCHEME", "high"))).when(broken, F.array(on(F.lit(True), "URL_MALFORMED", "low"))).otherwise(F.array(*sound))
    each = urls.filter("url is not null").select("report_id", "url", split_url("url").alias("u"))
    return each.select("report_id", "url", F.explode(F.array_compact(found)).alias("f")).select("report_id", "url", "f.code", "f.severity")


def collect_urls(links: DataFrame, most: int = MAX_URLS) -> DataFrame:
    """(report_id, url, first_seq, scheme, host, sources, anchor_texts) of ``links(report_id, seq, part, source, url, text)``.

    One row for each URL of a report, the first ``most`` in their order; sources and texts are
    distinct, in order of appearance. Mail, telephone and inner links and relative ones are left out.
    """
    apart = links.filter("url is not null").withColumn("u", split_url("url"))
    kept = apart.filter(~F.col("u.scheme").isin(*IGNORED) & ((F.col("u.scheme") != "") | F.col("url").startswith("//")))
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull() & (c != ""), F.struct("seq", c.alias("x"))))), lambda s: s["x"]))
    one = kept.groupBy("report_id", "url").agg(
        F.min("seq").alias("first_seq"), F.first("u.scheme").alias("scheme"), F.first("u.host").alias("host"),
        ordered(F.concat_ws(":", "part", "source")).alias("sources"), ordered(F.col("text")).alias("anchor_texts"),
    )
    w = Window.partitionBy("report_id").orderBy("first_seq", "url")
    return one.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
