"""Detectors: tables of evidence to findings (report_id, code, severity, location, evidence).

Each detector is a plan over the tables of :mod:`siftwright.sources.parse` (or tables of the same
columns), and each gives the same five columns, so that a union of them is all the findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions import text as tx
from siftwright.functions.domains import domain_of, org_domain
from siftwright.functions.urls import link_text_host, split_url, url_findings

COLUMNS = ["report_id", "code", "severity", "location", "evidence"]
# Headers that may stand once, severities of authentication results, seconds of tolerance.
SINGLE = "From Sender Reply-To To Cc Subject Date Message-ID".split()
AUTH_SEVERITY = {"fail": "high", "softfail": "medium", "permerror": "low", "temperror": "low", "neutral": "low", "none": "low", "policy": "low"}
TRANSFER_ENCODINGS = ["7bit", "8bit", "binary", "base64", "quoted-printable"]
TOLERANCE_S, LONG_S, SKEW_S = 300, 3600, 3600
# Sending software by pattern, the first that fits; and what its class means.
MAILERS = (
    (r"leaf\s*php\s*mailer", "Leaf PHPMailer", "phishing-kit"), (r"alexus\s*mailer", "ALEXUS Mailer", "phishing-kit"), ("gammadyne", "Gammadyne Mass E-Mailer", "bulk"), (r"atomic\s*mail\s*sender", "Atomic Mail Sender", "bulk"),
    ("sendblaster", "SendBlaster", "bulk"), (r"advanced\s*mass\s*sender", "Advanced Mass Sender", "bulk"), ("epochta", "ePochta Mailer", "bulk"), (r"group\s*mail", "Group Mail", "bulk"), ("phpmailer", "PHPMailer", "script"),
    (r"swift\s*mailer", "SwiftMailer", "script"), (r"symfony\s*mailer", "Symfony Mailer", "script"), ("nodemailer", "Nodemailer", "script"), (r"^php/?\s*\d", "PHP mail()", "script"), ("python|smtplib", "Python", "script"),
    ("perl|mime::lite", "Perl", "script"), ("microsoft cdo", "Microsoft CDO (scripted Windows sending)", "script"), ("outlook express 6", "Outlook Express 6", "outdated"), ("microsoft outlook|microsoft office outlook", "Microsoft Outlook", "client"),
    ("thunderbird", "Mozilla Thunderbird", "client"), ("apple mail|iphone mail|ipad mail", "Apple Mail", "client"), ("roundcube", "Roundcube Webmail", "client"),
)
MAILER_CODES = {"phishing-kit": ("HDR_MAILER_PHISHING_KIT", "high"), "bulk": ("HDR_MAILER_BULK", "low"), "script": ("HDR_MAILER_SCRIPT", "low"), "outdated": ("HDR_MAILER_OUTDATED", "low")}
PROVIDERS = {
    "Google": ("gmail.com googlemail.com", "google.com gmail.com googlemail.com", "mail.gmail.com"),
    "Microsoft": ("outlook.com hotmail.com live.com msn.com", "outlook.com hotmail.com live.com microsoft.com office365.com", "outlook.com"),
    "Yahoo": ("yahoo.com ymail.com aol.com", "yahoo.com yahoodns.net aol.com", "mail.yahoo.com"),
    "Apple": ("icloud.com me.com mac.com", "apple.com icloud.com me.com", ""),
}
PHISH, SPAM = "PHSH HPHSH HPHISH SPOOF GIMP UIMP DIMP MALW AMP".split(), ["SPM", "HSPM"]


def hit(condition: Column, code: Column | str, severity: Column | str, location: Column | None = None, **evidence: Column) -> Column:
    """A finding where a condition holds, else null."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    held = F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()])) if evidence else F.lit(None).cast("string")
    return F.when(condition, F.struct(as_col(code).alias("code"), as_col(severity).alias("severity"), (location if location is not None else F.lit(None).cast("string")).alias("location"), held.alias("evidence")))


def findings_of(df: DataFrame, *hits: Column) -> DataFrame:
    """One row for each hit of each row; rows are read once for all of them."""
    return df.select("report_id", F.explode(F.array_compact(F.array(*hits))).alias("_f")).select("report_id", "_f.*")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def mailer_of(x_mailer: Column) -> Column:
    """STRUCT<name, kind> of the first signature that fits; null where none does."""
    out = None
    for pattern, name, kind in MAILERS:
        here, value = x_mailer.rlike(f"(?i){pattern}"), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))
        out = F.when(here, value) if out is None else out.when(here, value)
    return out


def repeated_headers(headers: DataFrame) -> DataFrame:
    """(report_id, name, n) of what stands more than once in ``headers(report_id, name)`` and may stand once."""
    return headers.filter(F.lower("name").isin([s.lower() for s in SINGLE])).groupBy("report_id", F.lower("name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def header_structure(messages: DataFrame, headers: DataFrame) -> DataFrame:
    """Repeated, missing and unreadable headers, parser defects, invisible characters."""
    repeated = repeated_headers(headers)
    has = headers.groupBy("report_id").agg(F.bool_or(F.lower("name") == "date").alias("has_date"), F.bool_or(F.lower("name") == "from").alias("has_from"))
    m = messages.join(has, "report_id", "left")
    none = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    hidden = lambda c, loc: (
        hit(tx.bidi_count(F.col(c)) > 0, "TEXT_BIDI_CONTROL", "high", F.lit(loc), count=tx.bidi_count(F.col(c))),
        hit(tx.zero_width_count(F.col(c)) > 0, "TEXT_ZERO_WIDTH", "medium", F.lit(loc), count=tx.zero_width_count(F.col(c))),
    )
    return union([
        findings_of(repeated, hit(F.lit(True), "HDR_DUPLICATE", "medium", F.col("name"), header=F.col("name"), times=F.col("n"))),
        findings_of(
            m, hit(none("has_from"), "HDR_MISSING_FROM", "medium"), hit(F.col("date_us").isNull(), F.when(none("has_date"), "HDR_MISSING_DATE").otherwise("HDR_BAD_DATE"), "low"),
            hit(F.coalesce(F.trim("message_id"), F.lit("")) == "", "HDR_MISSING_MESSAGE_ID", "low"), hit(F.size("defects") > 0, "PARSE_DEFECTS", "low", None, defects=F.col("defects")),
            *hidden("subject", "Subject"), *hidden("from_display_name", "From display name"),
        ),
    ])


def sender_identity(messages: DataFrame) -> DataFrame:
    """Addresses of one message that belong to different organisations."""
    org = org_domain(messages.sparkSession)
    shown = tx.email_addresses(F.col("from_display_name"))
    m = messages.withColumn("from_org", org(domain_of(F.col("from_address"))))
    m = m.withColumn("path_org", org(domain_of(F.col("return_path")))).withColumn("sender_org", org(domain_of(F.col("sender")))).withColumn("mid_host", domain_of(F.trim("message_id"))).withColumn("mid_org", org("mid_host"))
    other = lambda c: F.col("from_org").isNotNull() & F.col(c).isNotNull() & (F.col(c) != F.col("from_org"))
    each = m.filter("from_org is not null").select("report_id", "from_address", "from_org", F.explode(F.coalesce("reply_to", F.array().cast("array<string>"))).alias("reply")).withColumn("reply_org", org(domain_of(F.col("reply"))))
    names = m.filter("from_org is not null").select("report_id", "from_address", "from_org", F.posexplode(shown).alias("i", "shown")).withColumn("shown_org", org(domain_of(F.col("shown")))).filter("shown_org <> from_org")
    first = names.groupBy("report_id").agg(F.min_by("shown", "i").alias("shown"), F.first("from_address").alias("from_address"))
    return union([
        findings_of(
            m, hit(F.coalesce(F.col("from_count"), F.lit(1)) > 1, "HDR_MULTIPLE_FROM_ADDRESSES", "medium"), hit(other("path_org"), "HDR_RETURN_PATH_MISMATCH", "low", None, return_path=F.col("return_path")),
            hit(other("sender_org"), "HDR_SENDER_MISMATCH", "low", None, sender=F.col("sender")), hit(other("mid_org"), "HDR_MESSAGE_ID_DOMAIN_MISMATCH", "info", None, message_id_domain=F.col("mid_host")),
        ),
        findings_of(each, hit(other("reply_org"), "HDR_REPLY_TO_MISMATCH", "medium", None, reply_to=F.col("reply"))),
        findings_of(first, hit(F.lit(True), "HDR_DISPLAY_NAME_SPOOF", "high", None, shown=F.col("shown"), sender=F.col("from_address"))),
    ])


def with_delays(hops: DataFrame) -> DataFrame:
    """``hops(report_id, idx, utc_us)`` with the seconds since the last stamped hop before; null without either stamp."""
    w = Window.partitionBy("report_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return hops.withColumn("delay_seconds", (F.col("utc_us") - F.last("utc_us", ignorenulls=True).over(w)) / 1e6)


def origins(hops: DataFrame) -> DataFrame:
    """(report_id, ip, host, hop): the oldest hop that came from a public address."""
    public = hops.filter("from_ip is not null and not ip_is_private")
    return public.groupBy("report_id").agg(F.min_by(F.struct("from_ip", "from_host", "idx"), "idx").alias("o")).select("report_id", F.col("o.from_ip").alias("ip"), F.col("o.from_host").alias("host"), F.col("o.idx").alias("hop"))


def timeline(messages: DataFrame, hops: DataFrame) -> DataFrame:
    """Hops without stamps, back in time or long under way, and dates that don't fit them."""
    d = with_delays(hops)
    span = hops.filter("utc_us is not null").groupBy("report_id").agg(F.min_by("utc_us", "idx").alias("first_us"), F.max_by("utc_us", "idx").alias("last_us"))
    m = messages.select("report_id", "date_us", "x_originating_ip").join(span, "report_id", "left").join(hops.groupBy("report_id").agg(F.count("*").alias("n_hops")), "report_id", "left").join(origins(hops), "report_id", "left")
    late = (F.col("date_us") - F.col("last_us")) / 1e6 > TOLERANCE_S
    skew = F.abs(F.col("first_us") - F.col("date_us")) / 1e6 > SKEW_S
    stamped = F.col("date_us").isNotNull() & F.col("last_us").isNotNull()
    return union([
        findings_of(
            d, hit(F.col("utc_us").isNull(), "RCV_BAD_TIMESTAMP", "low", None, hop=F.col("idx")), hit(F.col("delay_seconds") < -TOLERANCE_S, "RCV_TIME_REVERSAL", "medium", None, hop=F.col("idx"), delay_seconds=F.col("delay_seconds")),
            hit(F.col("delay_seconds") > LONG_S, "RCV_LONG_DELAY", "low", None, hop=F.col("idx"), delay_seconds=F.col("delay_seconds")),
        ),
        findings_of(
            m, hit(F.coalesce("n_hops", F.lit(0)) == 0, "RCV_NO_HOPS", "low"), hit(stamped & late, "HDR_DATE_AFTER_DELIVERY", "medium"), hit(stamped & ~late & skew, "HDR_DATE_SKEW", "low"),
            hit(F.col("ip").isNotNull(), "RCV_ORIGIN_IP", "info", None, ip=F.col("ip"), host=F.col("host"), hop=F.col("hop")), hit(F.coalesce("x_originating_ip", F.lit("")) != "", "HDR_X_ORIGINATING_IP", "info", None, value=F.col("x_originating_ip")),
        ),
    ])


def authentication(messages: DataFrame, results: DataFrame) -> DataFrame:
    """What ``results(report_id, pos, authserv_id, method, result, properties)`` say."""
    org = org_domain(messages.sparkSession)
    severity = F.try_element_at(F.create_map(*[F.lit(x) for kv in AUTH_SEVERITY.items() for x in kv]), F.col("result"))
    each = findings_of(results, hit(severity.isNotNull(), F.concat_ws("_", F.lit("AUTH"), F.upper("method"), F.upper("result")), severity, None, authserv_id=F.col("authserv_id")))
    signer = F.lower(F.try_element_at("properties", F.lit("header.d")))
    passes = results.filter("method = 'dkim' and result = 'pass'").withColumn("signer", signer).filter("signer <> ''")
    aligned = passes.join(messages.select("report_id", org(domain_of(F.col("from_address"))).alias("from_org")), "report_id").filter("from_org is not null")
    aligned = aligned.groupBy("report_id").agg(F.bool_or(org("signer") == F.col("from_org")).alias("any"), F.array_sort(F.collect_set("signer")).alias("signers"))
    servers = results.groupBy("report_id").agg(F.array_sort(F.collect_set("authserv_id")).alias("ids"))
    missing = messages.select("report_id").join(results.select("report_id"), "report_id", "left_anti")
    return union([
        each, findings_of(missing, hit(F.lit(True), "AUTH_RESULTS_MISSING", "info")), findings_of(servers, hit(F.size("ids") > 1, "AUTH_MULTIPLE_SERVERS", "info", None, authserv_ids=F.col("ids"))),
        findings_of(aligned, hit(~F.col("any"), "AUTH_DKIM_NOT_ALIGNED", "low", None, signers=F.col("signers"))),
    ])


def sending_software(messages: DataFrame) -> DataFrame:
    """Mass mailers, kits and scripts by their signature."""
    m = messages.withColumn("_s", mailer_of(F.col("x_mailer")))
    hits = [hit(F.col("_s.kind") == kind, code, severity, None, mailer=F.col("x_mailer"), fingerprint=F.col("_s.name")) for kind, (code, severity) in MAILER_CODES.items()]
    return findings_of(m, *hits, hit(F.coalesce("php_script", F.lit("")) != "", "HDR_PHP_SCRIPT", "medium", None, script=F.col("php_script")))


def provider_path(messages: DataFrame, hops: DataFrame) -> DataFrame:
    """Senders and message identifiers of large providers none of whose servers was on the way."""
    host = F.explode(F.array_compact(F.array(F.regexp_replace(F.lower("from_host"), r"\.+$", ""), F.regexp_replace(F.lower("by_host"), r"\.+$", ""))))
    hosts = hops.select("report_id", host.alias("host"))
    on = lambda infra: reduce(lambda a, b: a | b, [(F.col("host") == s) | F.col("host").endswith(f".{s}") for s in infra.split()])
    seen = hosts.groupBy("report_id").agg(*[F.bool_or(on(infra)).alias(f"_{p}") for p, (_, infra, _) in PROVIDERS.items()])
    m = messages.select("report_id", domain_of(F.col("from_address")).alias("from_domain"), domain_of(F.trim("message_id")).alias("mid_domain")).join(seen, "report_id")
    hits = []
    for p, (senders, _, ids) in PROVIDERS.items():
        hits.append(hit(F.col("from_domain").isin(senders.split()) & ~F.col(f"_{p}"), "HDR_PROVIDER_PATH_MISMATCH", "medium", None, provider=F.lit(p)))
        if ids:
            hits.append(hit(((F.col("mid_domain") == ids) | F.col("mid_domain").endswith(f".{ids}")) & ~F.col(f"_{p}"), "HDR_MESSAGE_ID_PROVIDER_MISMATCH", "medium", None, provider=F.lit(p)))
    return findings_of(m, *hits)


def provider_verdicts(messages: DataFrame) -> DataFrame:
    """What a mail provider's own filter said (``forefront``, ``antispam``, ``scl``, ``auth_as``, ``spam_status``, ``spam_flag``)."""
    org = org_domain(messages.sparkSession)
    get = lambda c, k: F.nullif(F.trim(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), rf"(?i)(?:^|;)\s*{k}\s*:([^;]*)", 1)), F.lit(""))
    recipients = F.transform(F.array_union(F.coalesce("to_addrs", F.array().cast("array<string>")), F.coalesce("cc_addrs", F.array().cast("array<string>"))), lambda x: F.lower(F.substring_index(x, "@", -1)))
    m = messages.withColumn("cat", F.upper(get("forefront", "CAT"))).withColumn("sfv", F.upper(get("forefront", "SFV"))).withColumn("scl_n", F.coalesce(get("forefront", "SCL"), F.trim("scl")).try_cast("int")).withColumn("bcl", get("antispam", "BCL").try_cast("int"))
    m = m.withColumn("from_org", org(domain_of(F.col("from_address")))).withColumn("rcpt", recipients)
    is_in = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False))
    phish = is_in("cat", PHISH)
    spam = ~phish & (is_in("cat", SPAM) | is_in("sfv", ["SPM"]) | F.coalesce(F.col("scl_n") >= 5, F.lit(False)))
    bulk = ~phish & ~spam & (is_in("cat", ["BULK"]) | F.coalesce(F.col("bcl") >= 7, F.lit(False)))
    skipped = is_in("sfv", ["SKN", "SKA", "SKI"]) | F.coalesce(F.col("scl_n") == -1, F.lit(False))
    inside = (F.lower(F.trim("auth_as")) == "anonymous") & F.exists("rcpt", lambda d: (d == F.col("from_org")) | d.endswith(F.concat(F.lit("."), F.col("from_org"))))
    marked = F.lower(F.coalesce("spam_status", F.lit(""))).startswith("yes") | (F.lower(F.trim(F.coalesce("spam_flag", F.lit("")))) == "yes")
    return findings_of(
        m, hit(phish, "PROVIDER_PHISH_VERDICT", "high"), hit(spam, "PROVIDER_SPAM_VERDICT", "medium", None, provider=F.lit("Microsoft 365")), hit(bulk, "PROVIDER_BULK_VERDICT", "low"), hit(skipped, "PROVIDER_FILTER_BYPASSED", "info"),
        hit(F.coalesce(inside, F.lit(False)), "PROVIDER_EXTERNAL_CLAIMS_INTERNAL", "high"), hit(marked, "PROVIDER_SPAM_VERDICT", "medium", None, provider=F.lit("SpamAssassin")),
    )


def links(urls: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Findings of ``urls(report_id, url)``, and of ``shown(report_id, url, text)`` links whose text shows another organisation."""
    found = url_findings(urls).select("report_id", "code", "severity", F.lit("URL").alias("location"), F.to_json(F.struct("url")).alias("evidence"))
    if shown is None:
        return found
    org = org_domain(urls.sparkSession)
    pairs = shown.withColumn("said", link_text_host(F.col("text"))).filter("said is not null").withColumn("host", split_url("url")["host"]).filter("host is not null")
    unlike = pairs.withColumn("said_org", org("said")).withColumn("host_org", org("host")).filter("said_org <> host_org").dropDuplicates(["report_id", "said", "url"])
    return union([found, findings_of(unlike, hit(F.lit(True), "URL_TEXT_MISMATCH", "high", F.lit("URL"), shown=F.col("said"), url=F.col("url")))])


def body(bodies: DataFrame) -> DataFrame:
    """``bodies(report_id, mime_part, content_type, preview[, zero_width, bidi])``: invisible characters, and alternatives that say different things.

    ``zero_width`` and ``bidi`` are counts over the whole text; without them the preview counts.
    """
    b = bodies.withColumn("parent", F.regexp_replace("mime_part", r"\.?[^.]*$", "")).withColumn("words", tx.word_set(F.col("preview")))
    bidi, zero_width = (F.col(c) if c in bodies.columns else count(F.col("preview")) for c, count in (("bidi", tx.bidi_count), ("zero_width", tx.zero_width_count)))
    hidden = findings_of(b, hit(bidi > 0, "TEXT_BIDI_CONTROL", "medium", F.lit("Body")), hit(zero_width > 0, "TEXT_ZERO_WIDTH", "low", F.lit("Body")))
    side = lambda kind, x: b.filter(F.col("content_type") == kind).filter("parent <> ''").select("report_id", "parent", F.col("words").alias(x))
    both = side("text/plain", "p").join(side("text/html", "h"), ["report_id", "parent"]).filter("size(p) >= 15 and size(h) >= 15")
    return union([hidden, findings_of(both, hit(tx.jaccard(F.col("p"), F.col("h")) < 0.2, "BODY_ALTERNATIVES_DIFFER", "medium"))])


def structure(messages: DataFrame, parts: DataFrame, bodies: DataFrame) -> DataFrame:
    """MIME parts that are broken or encoded in no known way, encoded words that can't be read, character sets that don't fit, and messages without text."""
    sound = F.lower("transfer_encoding").isin(TRANSFER_ENCODINGS)
    text = bodies.groupBy("report_id").agg(F.bool_or((F.col("length") > 0) & (F.trim("preview") != "")).alias("readable"))
    images = parts.filter(F.col("content_type").startswith("image/")).groupBy("report_id").agg(F.array_sort(F.collect_set("part")).alias("images"))
    m = messages.filter("error is null").select("report_id").join(text, "report_id", "left").join(images, "report_id", "left")
    silent = ~F.coalesce("readable", F.lit(False)) & F.col("images").isNotNull()
    return union([
        findings_of(parts, hit(F.col("transfer_encoding").isNotNull() & ~sound, "MIME_UNKNOWN_TRANSFER_ENCODING", "low", F.col("part"), encoding=F.col("transfer_encoding")), hit((F.col("depth") > 0) & (F.size("defects") > 0), "MIME_PART_DEFECTS", "low", F.col("part"), defects=F.col("defects"))),
        findings_of(messages.select("report_id", F.explode("encoded_errors").alias("word")), hit(F.lit(True), "HDR_ENCODED_WORD_ERROR", "low", F.substring_index("word", ":", 1), encoded_word=F.col("word"))),
        findings_of(bodies, hit(F.col("problem").isNotNull(), "BODY_CHARSET_PROBLEM", "low", F.col("mime_part"), problem=F.col("problem"))),
        findings_of(m, hit(silent, "BODY_IMAGE_ONLY", "low", None, images=F.col("images")), hit(~silent & F.col("readable").isNull(), "BODY_NO_TEXT", "info")),
    ])


def limits(messages: DataFrame) -> DataFrame:
    """What the parse stage left out of ``messages(report_id, limits)``."""
    return findings_of(messages.select("report_id", F.explode("limits").alias("limit")), hit(F.lit(True), F.col("limit"), "medium"))


def nested(messages: DataFrame, findings: DataFrame) -> DataFrame:
    """What attached messages pass on to the messages that carry them."""
    from siftwright.plans.score import SEVERITIES, severity_rank

    worst = findings.withColumn("rank", severity_rank(F.col("severity"))).groupBy("report_id").agg(F.max("rank").alias("worst"), F.slice(F.array_sort(F.collect_set("code")), 1, 15).alias("codes"))
    inner = messages.filter("parent_report_id is not null").select("report_id", "parent_report_id", "mime_part").join(worst, "report_id", "left")
    up = inner.select(F.col("parent_report_id").alias("report_id"), "mime_part", F.coalesce("worst", F.lit(0).cast("tinyint")).alias("worst"), "codes")
    name = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("worst").cast("int") + 1)
    return findings_of(up, hit(F.col("worst") >= 2, "NESTED_MESSAGE_SUSPICIOUS", name, F.col("mime_part"), codes=F.col("codes")), hit(F.col("worst") < 2, "NESTED_MESSAGE", "info", F.col("mime_part")))
