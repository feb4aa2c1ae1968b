"""Queries of the engine's own operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.functions import domains, filetype, ids, ip, similarity
from siftwright.functions import text as tx
from siftwright.functions import urls as ur
from siftwright.operators import archives, imitation, mailauth
from siftwright.operators.timestamps import after_last_semicolon, normalise, source_zones
from siftwright.plans import case, casefile, detect, detect_files, enrich, indicators, rules, score, sinks
from siftwright.session import new_path, stage, table
from siftwright.sources import parse, recordings
from siftwright.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- windows over hops, timeline -------------------------------------------------------------------------------------


def _chain(s: SparkSession, d: str) -> DataFrame:
    """Events of a user as the hops of a message; every seventh has no stamp."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(s, d, "events").select(F.col("user_id").cast("string").alias("report_id"), F.col("event_id").alias("idx"), F.when(F.col("event_id") % 7 != 0, us).alias("utc_us"))


_CHAIN = "c AS (SELECT CAST(user_id AS VARCHAR) AS report_id, event_id AS idx, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) END AS utc_us FROM events), d AS (SELECT *, (utc_us - lag(utc_us IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY idx)) / 1e6 AS delay_seconds FROM c)"


@query(f"WITH {_CHAIN} SELECT report_id, idx, round(delay_seconds, 6) AS delay_seconds FROM d")
def hop_delay(s, d):
    return detect.with_delays(_chain(s, d)).select("report_id", "idx", F.round("delay_seconds", 6).alias("delay_seconds"))


_TIMED = """m AS (SELECT report_id, max(utc_us) FILTER (idx = last_idx) AS last_us, max(utc_us) FILTER (idx = first_idx) AS first_us, count(*) AS n FROM (SELECT *, max(idx) FILTER (utc_us IS NOT NULL) OVER (PARTITION BY report_id) AS last_idx, min(idx) FILTER (utc_us IS NOT NULL) OVER (PARTITION BY report_id) AS first_idx FROM c) GROUP BY report_id),
 t AS (SELECT *, CASE WHEN CAST(report_id AS BIGINT) % 3 = 0 THEN last_us + 400000000 WHEN CAST(report_id AS BIGINT) % 3 = 1 THEN first_us + 3700000000 ELSE first_us END AS date_us FROM m)"""


@query(f"""WITH {_CHAIN}, {_TIMED} SELECT report_id, idx, CASE WHEN utc_us IS NULL THEN 'RCV_BAD_TIMESTAMP' WHEN delay_seconds < -300 THEN 'RCV_TIME_REVERSAL' ELSE 'RCV_LONG_DELAY' END AS code FROM d WHERE utc_us IS NULL OR delay_seconds < -300 OR delay_seconds > 3600
 UNION ALL SELECT report_id, -1, CASE WHEN (date_us - last_us) / 1e6 > 300 THEN 'HDR_DATE_AFTER_DELIVERY' ELSE 'HDR_DATE_SKEW' END FROM t WHERE (date_us - last_us) / 1e6 > 300 OR abs(first_us - date_us) / 1e6 > 3600
 UNION ALL SELECT report_id, min(idx) FILTER (idx % 5 = 0), 'RCV_ORIGIN_IP' FROM c WHERE idx % 5 = 0 GROUP BY report_id""")
def timeline_findings(s, d):
    """All findings of hops and dates, of events as hops; every fifth came from a public address."""
    hops = _chain(s, d).withColumns({"from_ip": F.when(F.col("idx") % 5 == 0, "8.8.8.8"), "from_host": F.lit("h.test"), "ip_is_private": F.lit(False)})
    ends = hops.filter("utc_us is not null").groupBy("report_id").agg(F.min_by("utc_us", "idx").alias("first"), F.max_by("utc_us", "idx").alias("last"))
    third = F.col("report_id").cast("long") % 3
    messages = ends.select("report_id", F.when(third == 0, F.col("last") + 400_000_000).when(third == 1, F.col("first") + 3_700_000_000).otherwise(F.col("first")).alias("date_us"), F.lit(None).cast("string").alias("x_originating_ip"))
    return detect.timeline(messages, hops).select("report_id", F.coalesce(F.get_json_object("evidence", "$.hop").cast("long"), F.lit(-1)).alias("idx"), "code")


@query("SELECT report_id, arg_min(from_ip, idx) AS ip, min(idx) AS hop FROM hops WHERE from_ip IS NOT NULL AND NOT ip_is_private GROUP BY report_id")
def origin_first(s, d):
    return detect.origins(table(s, d, "hops")).select("report_id", "ip", "hop")


@query("""SELECT DISTINCT from_ip, CASE WHEN regexp_matches(from_ip, '^(10|127)\\.') OR regexp_matches(from_ip, '^192\\.168\\.') OR regexp_matches(from_ip, '^172\\.(1[6-9]|2[0-9]|3[01])\\.')
 OR regexp_matches(from_ip, '^(192\\.0\\.2|198\\.51\\.100|203\\.0\\.113)\\.') OR regexp_matches(from_ip, '^169\\.254\\.') OR regexp_matches(from_ip, '^100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\.') OR regexp_matches(from_ip, '^198\\.1[89]\\.') OR regexp_matches(from_ip, '^(0|24[0-9]|25[0-5])\\.')
 THEN true ELSE false END AS is_private FROM hops WHERE regexp_matches(from_ip, '^\\d+\\.\\d+\\.\\d+\\.\\d+$')""")
def ipv4_private(s, d):
    return table(s, d, "hops").select("from_ip").distinct().withColumn("is_private", ip.ipv4_is_private(F.col("from_ip"))).filter("is_private is not null")


# --- header and identity findings over messages ----------------------------------------------------------------------

_GENERIC = ", ".join(f"'{x}'" for x in domains.SECOND)
_MORE = " ".join(f"WHEN '{cc}' THEN [{', '.join(chr(39) + x + chr(39) for x in more.split())}]" for cc, more in domains.ALSO.items())
_SHARED = ", ".join(f"'{x}'" for x in domains.SHARED)


def _org(x: str) -> str:
    """The organisational domain of a host in SQL, label by label: how many labels its public suffix has decides how many are kept."""
    labels = f"list_reverse(string_split(regexp_replace(lower(trim({x})), '\\.+$', ''), '.'))"
    kept = (
        f"CASE WHEN list_contains([{_SHARED}], l[3] || '.' || l[2] || '.' || l[1]) THEN 4 WHEN list_contains([{_SHARED}], l[2] || '.' || l[1]) THEN 3 WHEN l[2] || '.' || l[1] = 'www.ck' THEN 2 WHEN len(l[1]) = 2 AND l[1] IN ({', '.join(chr(39) + x + chr(39) for x in domains.OPEN)}) THEN 3"
        f" WHEN regexp_full_match(l[1], '[a-z]{{2}}') AND (l[2] IN ({_GENERIC}) OR list_contains(CASE l[1] {_MORE} ELSE [] END, l[2])) THEN 3 ELSE 2 END"
    )
    return f"(SELECT nullif(array_to_string(list_reverse(l[1:{kept}]), '.'), '') FROM (SELECT {labels} AS l))"


_DOM = lambda x: f"lower(rtrim(rtrim(trim(regexp_extract({x}, '@([^@]*)$', 1)), '>'), '.'))"


_ID_SQL = f"""sid AS (SELECT report_id, from_address, {_DOM('from_address')} AS fd, {_DOM('return_path')} AS rd, {_DOM('trim(message_id)')} AS md, reply_to, from_display_name FROM messages), sio AS (SELECT *, {_org('fd')} AS fo FROM sid),
 sender AS (SELECT report_id, 'HDR_RETURN_PATH_MISMATCH' AS code, 'low' AS severity FROM sio WHERE fo IS NOT NULL AND {_org('rd')} <> fo UNION ALL SELECT report_id, 'HDR_MESSAGE_ID_DOMAIN_MISMATCH', 'info' FROM sio WHERE fo IS NOT NULL AND {_org('md')} <> fo
 UNION ALL SELECT report_id, 'HDR_REPLY_TO_MISMATCH', 'medium' FROM (SELECT report_id, fo, {_DOM('x')} AS xd FROM (SELECT report_id, fo, unnest(reply_to) AS x FROM sio)) WHERE fo IS NOT NULL AND {_org('xd')} <> fo
 UNION ALL SELECT DISTINCT report_id, 'HDR_DISPLAY_NAME_SPOOF', 'high' FROM (SELECT report_id, fo, {_DOM('x')} AS xd FROM (SELECT report_id, fo, unnest(list_transform(regexp_extract_all(from_display_name, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+'), lambda y: lower(y))) AS x FROM sio)) WHERE fo IS NOT NULL AND {_org('xd')} <> fo
 UNION ALL SELECT report_id, 'HDR_SENDER_MISMATCH', 'low' FROM sio WHERE false UNION ALL SELECT report_id, 'HDR_MULTIPLE_FROM_ADDRESSES', 'medium' FROM sio WHERE false)"""


@query(f"WITH {_ID_SQL} SELECT report_id, code, severity FROM sender")
def sender_mismatch(s, d):
    """All findings of sender identity; the tables have one From and no Sender."""
    return detect.sender_identity(_whole(table(s, d, "messages"))).select("report_id", "code", "severity")


def _whole(messages: DataFrame) -> DataFrame:
    """Messages with the fields that the given table leaves out, as the parse stage would have them for absent headers."""
    none = F.lit(None).cast("string")
    return messages.withColumns({"sender": none, "from_count": F.lit(1), "x_originating_ip": none, "php_script": none})


_MAILER_SQL = (
    "SELECT report_id, CASE WHEN regexp_matches(x_mailer, '(?i)leaf\\s*php\\s*mailer') THEN 'Leaf PHPMailer' WHEN regexp_matches(x_mailer, '(?i)alexus\\s*mailer') THEN 'ALEXUS Mailer' WHEN regexp_matches(x_mailer, '(?i)gammadyne') THEN 'Gammadyne Mass E-Mailer'"
    " WHEN regexp_matches(x_mailer, '(?i)atomic\\s*mail\\s*sender') THEN 'Atomic Mail Sender' WHEN regexp_matches(x_mailer, '(?i)sendblaster') THEN 'SendBlaster' WHEN regexp_matches(x_mailer, '(?i)advanced\\s*mass\\s*sender') THEN 'Advanced Mass Sender' WHEN regexp_matches(x_mailer, '(?i)epochta') THEN 'ePochta Mailer'"
    " WHEN regexp_matches(x_mailer, '(?i)group\\s*mail') THEN 'Group Mail' WHEN regexp_matches(x_mailer, '(?i)phpmailer') THEN 'PHPMailer' WHEN regexp_matches(x_mailer, '(?i)swift\\s*mailer') THEN 'SwiftMailer' WHEN regexp_matches(x_mailer, '(?i)symfony\\s*mailer') THEN 'Symfony Mailer' WHEN regexp_matches(x_mailer, '(?i)nodemailer') THEN 'Nodemailer'"
    " WHEN regexp_matches(x_mailer, '(?i)^php/?\\s*\\d') THEN 'PHP mail()' WHEN regexp_matches(x_mailer, '(?i)python|smtplib') THEN 'Python' WHEN regexp_matches(x_mailer, '(?i)perl|mime::lite') THEN 'Perl' WHEN regexp_matches(x_mailer, '(?i)microsoft cdo') THEN 'Microsoft CDO (scripted Windows sending)' WHEN regexp_matches(x_mailer, '(?i)outlook express 6') THEN 'Outlook Express 6'"
    " WHEN regexp_matches(x_mailer, '(?i)microsoft outlook|microsoft office outlook') THEN 'Microsoft Outlook' WHEN regexp_matches(x_mailer, '(?i)thunderbird') THEN 'Mozilla Thunderbird' WHEN regexp_matches(x_mailer, '(?i)apple mail|iphone mail|ipad mail') THEN 'Apple Mail' WHEN regexp_matches(x_mailer, '(?i)roundcube') THEN 'Roundcube Webmail' END AS mailer FROM messages WHERE x_mailer IS NOT NULL"
)


@query(_MAILER_SQL)
def mailer_firstmatch(s, d):
    return table(s, d, "messages").filter("x_mailer is not null").select("report_id", detect.mailer_of(F.col("x_mailer"))["name"].alias("mailer"))


_NAMED = {"error": "Subject", "purchase": "X-Mailer", "click": "date", "signup": "Received", "view": "Message-ID"}


@query(f"WITH h AS (SELECT user_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMED.items())} END AS name FROM events) SELECT CAST(user_id AS VARCHAR) AS report_id, lower(name) AS name, count(*) AS n FROM h WHERE lower(name) IN ('subject', 'date', 'message-id') GROUP BY ALL HAVING count(*) > 1")
def dup_header(s, d):
    """Events as headers of their user's message."""
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in _NAMED.items() for x in kv]), F.col("event_type"))
    return detect.repeated_headers(table(s, d, "events").select(F.col("user_id").cast("string").alias("report_id"), name.alias("name")))


@query("""WITH v AS (SELECT delivery_id, unnest([subject, from_display_name]) AS v FROM messages), w AS (SELECT delivery_id, regexp_replace(v, '^﻿', '') AS v FROM v WHERE v IS NOT NULL)
 SELECT delivery_id, CAST(sum(len(v) - len(translate(v, '​‌⁠᠎­﻿', ''))) AS BIGINT) AS zero_width, CAST(sum(len(v) - len(translate(v, '‪‫‬‭‮⁦⁧⁨⁩', ''))) AS BIGINT) AS bidi FROM w GROUP BY delivery_id""")
def invisible_chars(s, d):
    v = table(s, d, "messages").select("delivery_id", F.explode(F.array("subject", "from_display_name")).alias("v")).filter("v is not null")
    return v.groupBy("delivery_id").agg(F.sum(tx.zero_width_count(F.col("v"))).alias("zero_width"), F.sum(tx.bidi_count(F.col("v"))).alias("bidi"))


_MAILED = "mailed AS (SELECT report_id, CASE WHEN regexp_matches(x_mailer, '(?i)leaf\\s*php\\s*mailer|alexus\\s*mailer') THEN 3 WHEN regexp_matches(x_mailer, '(?i)gammadyne|atomic\\s*mail\\s*sender|sendblaster|advanced\\s*mass\\s*sender|epochta|group\\s*mail|phpmailer|swift\\s*mailer|symfony\\s*mailer|nodemailer|^php/?\\s*\\d|python|smtplib|perl|mime::lite|microsoft cdo|outlook express 6') THEN 1 END AS worst FROM messages)"


@query(f"WITH {_MAILED} SELECT parent_report_id AS report_id, mime_part AS location, CASE WHEN coalesce(worst, 0) >= 2 THEN 'NESTED_MESSAGE_SUSPICIOUS' ELSE 'NESTED_MESSAGE' END AS code, CASE WHEN coalesce(worst, 0) >= 2 THEN 'high' ELSE 'info' END AS severity FROM messages LEFT JOIN mailed USING (report_id) WHERE parent_report_id IS NOT NULL")
def nested_children(s, d):
    """What the findings of attached messages' software come to in their carriers."""
    m = _whole(table(s, d, "messages"))
    return detect.nested(m, detect.sending_software(m)).select("report_id", "location", "code", "severity")


# --- URLs, domains ---------------------------------------------------------------------------------------------------


_URL_SQL = """un AS (SELECT report_id, url, lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme, regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS n FROM urls WHERE url IS NOT NULL), uh AS (SELECT report_id, url, n, lower(regexp_replace(regexp_replace(n, '^.*@', ''), ':\\d*$', '')) AS host FROM un WHERE scheme NOT IN ('javascript', 'vbscript', 'data', 'file')),
 linked AS (SELECT report_id, url, 'URL_DANGEROUS_SCHEME' AS code, 'high' AS severity FROM un WHERE scheme IN ('javascript', 'vbscript', 'data', 'file') UNION ALL SELECT report_id, url, 'URL_USERINFO', 'high' FROM uh WHERE contains(n, '@') UNION ALL SELECT report_id, url, 'URL_IP_HOST', 'medium' FROM uh WHERE regexp_matches(host, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') UNION ALL SELECT report_id, url, 'URL_NONSTANDARD_PORT', 'low' FROM uh WHERE regexp_matches(n, ':\\d+$') AND NOT regexp_matches(n, ':(80|443)$')
 UNION ALL SELECT report_id, url, 'URL_IDN_HOST', 'medium' FROM uh WHERE regexp_matches(host, '(^|\\.)xn--') OR regexp_matches(host, '[^\\x00-\\x7F]') UNION ALL SELECT report_id, url, 'URL_DEEP_SUBDOMAIN', 'low' FROM uh WHERE len(string_split(host, '.')) >= 5 AND NOT regexp_matches(host, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') UNION ALL SELECT report_id, url, 'URL_ENCODED_HOST', 'medium' FROM uh WHERE contains(n, '%')
 UNION ALL SELECT report_id, url, 'URL_SHORTENER', 'low' FROM uh WHERE regexp_replace(host, '^www\\.', '') IN (""" + ", ".join(f"'{x}'" for x in ur.SHORTENERS) + "))"


@query(f"WITH {_URL_SQL} SELECT report_id, url, code, severity FROM linked")
def url_predicates(s, d):
    """Every finding of every URL: hosts in other scripts, schemes that run code, and what can't be read, too."""
    return ur.url_findings(table(s, d, "urls").select("report_id", "url"))


@query("""WITH x AS (SELECT report_id, first_seq, url, unnest(sources) AS source, generate_subscripts(sources, 1) AS i FROM urls WHERE NOT regexp_matches(url, '(?i)^(mailto|tel|sms|cid|about):')), f AS (SELECT report_id, url, source, min(first_seq * 1000 + i) AS pos FROM x GROUP BY ALL)
 SELECT report_id, url, CAST(min(pos) // 1000 AS BIGINT) AS first_seq, array_to_string(list(source ORDER BY pos, source), '|') AS sources FROM f GROUP BY report_id, url""")
def url_collect(s, d):
    u = table(s, d, "urls").select("report_id", "first_seq", "url", F.posexplode("sources").alias("i", "source"))
    at = (F.col("first_seq") * 1000 + F.col("i") + 1).alias("seq")
    links = u.select("report_id", at, F.regexp_extract("source", r"^([^:]*):", 1).alias("part"), F.regexp_extract("source", r"^[^:]*:(.*)$", 1).alias("source"), "url", F.lit(None).cast("string").alias("text"))
    return ur.collect_urls(links, 2**31 - 1).select("report_id", "url", F.floor(F.col("first_seq") / 1000).cast("long").alias("first_seq"), F.array_join("sources", "|").alias("sources"))


@query(f"SELECT url_id, {_org('host')} AS org FROM urls")
def org_domain(s, d):
    """The organisational domain of every URL's host, whatever letters it has; null where there is no host."""
    return domains.with_org_domain(table(s, d, "urls").select("url_id", "host"), "host", "org").select("url_id", "org")


_SUFFIXES = [("example", 1), ("co.example", 1), ("test", 2), ("www.test", 4)]


@query("""WITH h AS (SELECT DISTINCT host, string_split(regexp_replace(lower(trim(host)), '\\.+$', ''), '.') AS l FROM urls), c AS (SELECT host, len(l) AS n, l, l[-1] AS tld, l[-2] AS two, l[-3] AS three FROM h)
 SELECT host, CASE WHEN n = 1 THEN l[1] WHEN tld = 'example' AND two = 'co' THEN CASE WHEN n = 2 THEN 'co.example' ELSE array_to_string(l[-3:], '.') END WHEN tld = 'test' AND two = 'www' THEN array_to_string(l[-2:], '.')
 WHEN tld = 'test' THEN CASE WHEN n = 2 THEN array_to_string(l, '.') ELSE array_to_string(l[-3:], '.') END ELSE array_to_string(l[-2:], '.') END AS org FROM c""")
def org_domain_join(s, d):
    """The same for a list of four suffixes, in joins, of every distinct host."""
    rules_ = s.createDataFrame(_SUFFIXES, "suffix string, bits int")
    return domains.org_domain_by_join(table(s, d, "urls").select("host").distinct(), "host", rules_, "org")


@query("SELECT body_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(preview, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+'), lambda x: lower(x)))), ' ') AS addresses FROM text_bodies WHERE regexp_matches(preview, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+')")
def ioc_email_extract(s, d):
    out = table(s, d, "text_bodies").select("body_id", F.array_sort(F.array_distinct(tx.email_addresses(F.col("preview")))).alias("a"))
    return out.filter("size(a) > 0").select("body_id", F.array_join("a", " ").alias("addresses"))


# --- text ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, octet_length(encode(text)) AS size_bytes FROM documents WHERE text IS NOT NULL")
def hashes(s, d):
    """The digests that the parse stage takes of evidence, of all texts as files."""
    got = parse.parsed(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content")))
    return got.filter("parent_report_id is null").select(F.col("path").cast("long").alias("doc_id"), "sha256", "md5", "size_bytes")


@query("""WITH w AS (SELECT body_id, list_distinct(regexp_extract_all(lower(coalesce(preview, '')), '\\pL{3,}')) AS a, list_distinct(regexp_extract_all(lower(coalesce(subject, '')), '\\pL{3,}')) AS b FROM text_bodies JOIN messages USING (report_id)),
 n AS (SELECT body_id, len(list_intersect(a, b)) AS i, len(a) AS x, len(b) AS y FROM w) SELECT body_id, round(i / nullif(x + y - i, 0)::DOUBLE, 6) AS similarity FROM n""")
def alternatives_jaccard(s, d):
    both = table(s, d, "text_bodies").select("report_id", "body_id", "preview").join(table(s, d, "messages").select("report_id", "subject"), "report_id")
    return both.select("body_id", F.round(tx.jaccard(tx.word_set(F.col("preview")), tx.word_set(F.col("subject"))), 6).alias("similarity"))


@query(r"SELECT body_id, regexp_matches(preview, '(?i)\b(pass(word|wd|code|phrase)?|pwd|kennwort|passwort|mot de passe|senha|parola|wachtwoord)\b|(?i)contrase(ñ|n)a([^\pL0-9_]|$)') AS hint FROM text_bodies WHERE preview IS NOT NULL")
def password_hint(s, d):
    return table(s, d, "text_bodies").filter("preview is not null").select("body_id", F.col("preview").rlike(detect_files.PASSWORD).alias("hint"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(v, '^[=+@\\t\\r-]') THEN '''' || v ELSE v END AS safe FROM (SELECT c_custkey, substr('=+-@ab', CAST(c_custkey % 6 AS INT) + 1, 1) || c_name AS v FROM customer)")
def csv_safe(s, d):
    v = F.concat(F.substring(F.lit("=+-@ab"), (F.col("c_custkey") % 6 + 1).cast("int"), F.lit(1)), F.col("c_name"))
    return table(s, d, "customer").select("c_custkey", tx.csv_safe(v).alias("safe"))


@query("SELECT url_id, replace(replace(regexp_replace(regexp_replace(url, '(?i)\\bhttp(s?)://', 'hxxp\\1://', 'g'), '(?i)\\bftp://', 'fxp://', 'g'), '.', '[.]'), '@', '[@]') AS shown FROM urls WHERE url IS NOT NULL")
def defang(s, d):
    return table(s, d, "urls").filter("url is not null").select("url_id", tx.defang(F.col("url")).alias("shown"))


@query("SELECT url_id, 'indicator--' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id"
       " FROM (SELECT url_id, sha1(unhex('6b1b1e8e3f6f4c5e9d076a2f0b9c1d11') || encode('url|' || url)) AS h FROM urls WHERE url IS NOT NULL)")  # fmt: skip
def stix_uuid5(s, d):
    return table(s, d, "urls").filter("url is not null").select("url_id", ids.stix_id("indicator", F.lit("url"), F.col("url")).alias("id"))


@query("SELECT report_id, CASE WHEN contains(path, '.') THEN lower(regexp_extract(path, '([^.]*)$', 1)) END AS ext FROM messages")
def ext_classify(s, d):
    return table(s, d, "messages").select("report_id", filetype.extension(F.col("path")).alias("ext"))


# --- similarity joins ------------------------------------------------------------------------------------------------

_WORDS_SQL = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS label FROM part)"


def _part_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("label")).distinct()


_PROTECTED = [("widget", "brand"), ("w1dget", "brand"), ("re0", "brand"), ("gadg3t", "org"), ("bolts", "org"), ("b1ue", "brand")]


@query(f"WITH {_WORDS_SQL}, p AS (SELECT unnest(['widget', 'w1dget', 're0', 'gadg3t', 'bolts', 'b1ue']) AS name), k AS (SELECT label, replace(replace(translate(translate(lower(label), '01i|35$@', 'olllessa'), '-_', ''), 'rn', 'm'), 'vv', 'w') AS form FROM w),"
       " q AS (SELECT name, replace(replace(translate(translate(lower(name), '01i|35$@', 'olllessa'), '-_', ''), 'rn', 'm'), 'vv', 'w') AS form FROM p) SELECT label, name FROM k JOIN q USING (form) WHERE label <> name")  # fmt: skip
def skeleton_join(s, d):
    form = lambda c: similarity.ascii_skeleton(F.col(c)).alias("form")
    p = s.createDataFrame([(n,) for n, _ in _PROTECTED], "name string")
    return _part_words(s, d).select("label", form("label")).join(p.select("name", form("name")), "form").filter("label <> name").select("label", "name")


@query(f"WITH {_WORDS_SQL} SELECT a.label AS a, b.label AS b FROM w a JOIN (SELECT unnest(['widgte', 'gadget', 'bolt', 'rde', 'blu']) AS label UNION SELECT label || 's' FROM w UNION SELECT substr(label, 2) FROM w) b ON abs(len(a.label) - len(b.label)) <= 1 AND damerau_levenshtein(a.label, b.label) = 1")
def typo_le1(s, d):
    words = _part_words(s, d)
    names = s.createDataFrame([(x,) for x in ("widgte", "gadget", "bolt", "rde", "blu")], "name string").unionByName(words.select(F.concat("label", F.lit("s")).alias("name"))).unionByName(words.select(F.substring("label", 2, 99).alias("name")))
    return imitation.slip_matches(words, names, 1).select(F.col("label").alias("a"), F.col("name").alias("b"))


@query("WITH h AS (SELECT DISTINCT replace(p_name, ' ', '-') AS label FROM part), p AS (SELECT unnest(['widget', 'green', 'bolt']) AS name) SELECT label || '.test' AS host, name || '.example' AS imitates FROM h JOIN p ON list_contains(string_split(label, '-'), name) AND label <> name AND damerau_levenshtein(label, name) > 1")
def combo_tokens(s, d):
    """Names of parts as hosts, beside three organisations of one word."""
    hosts = table(s, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".test")).alias("host"))
    names = s.createDataFrame([(f"{x}.example", "org") for x in ("widget", "green", "bolt")], "domain string, kind string")
    return imitation.imitations(hosts, names).filter("code = 'LOOKALIKE_COMBO'").select("host", "imitates")


# --- scoring: line items as the findings of orders ---------------------------------------------------------------------

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_F_SQL = """f AS (SELECT CAST(l_orderkey AS VARCHAR) AS report_id, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS severity, CASE l_linestatus WHEN 'F' THEN 'authentication' ELSE 'attachments' END AS category, l_returnflag || l_linestatus AS code, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem),
 p AS (SELECT *, CASE severity WHEN 'high' THEN 25::DOUBLE WHEN 'medium' THEN 10::DOUBLE ELSE 3::DOUBLE END AS pts FROM f),
 r AS (SELECT *, pts * pow(0.6::DOUBLE, row_number() OVER (PARTITION BY report_id, category ORDER BY pts DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1) AS raw FROM p),
 c AS (SELECT report_id, category, round(least(60::DOUBLE, sum(raw ORDER BY raw DESC)), 1) AS points FROM r GROUP BY ALL)"""
_S_SQL = _F_SQL + ", s AS (SELECT report_id, CAST(round_even(100 * (1 - exp(-sum(points ORDER BY category) / 50::DOUBLE)), 0) AS INT) AS score FROM c GROUP BY report_id), v AS (SELECT report_id, score, CASE WHEN score >= 70 THEN 'malicious' WHEN score >= 35 THEN 'suspicious' WHEN score >= 12 THEN 'caution' ELSE 'clean' END AS verdict FROM s)"


def _findings(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    sev = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    cat = F.when(F.col("l_linestatus") == "F", "authentication").otherwise("attachments")
    return li.select(F.col("l_orderkey").cast("string").alias("report_id"), sev.alias("severity"), cat.alias("category"), F.concat("l_returnflag", "l_linestatus").alias("code"), *_ORDER)


@query(f"WITH {_F_SQL} SELECT report_id, category, points FROM c")
def diminishing_points(s, d):
    return score.category_points(score.ranked_points(_findings(s, d), _ORDER))


def _coded(s: SparkSession, d: str) -> DataFrame:
    """The findings with codes of their category and a place in the report."""
    f = _findings(s, d).withColumn("code", F.concat(F.when(F.col("category") == "authentication", "AUTH_").otherwise("ATT_"), F.col("code"))).withColumn("location", F.lit(None).cast("string"))
    return f.withColumn("seq", F.row_number().over(Window.partitionBy("report_id").orderBy(*_ORDER))).drop("category")


def _scores(s: SparkSession, d: str) -> DataFrame:
    f = _coded(s, d)
    return score.assess(f.select("report_id").distinct(), f)


@query(f"WITH {_S_SQL} SELECT report_id, score, verdict FROM v")
def score_verdict(s, d):
    return _scores(s, d).select("report_id", "score", "verdict")


@query(f"WITH {_F_SQL}, g AS (SELECT *, sum(raw) OVER w AS upto, coalesce(sum(raw) OVER (PARTITION BY report_id, category ORDER BY raw DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WINDOW w AS (PARTITION BY report_id, category ORDER BY raw DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),"
       " k AS (SELECT *, round(least(60, upto) - least(60, before), 1) AS points FROM g WHERE least(60, upto) - least(60, before) > 0), t AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY points DESC, category, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rank FROM k) SELECT report_id, CAST(rank AS INT) AS rank, severity, category, points FROM t WHERE rank <= 3")  # fmt: skip
def top_reasons(s, d):
    return score.reasons(score.ranked_points(_findings(s, d), _ORDER), _ORDER, 3).drop("code")


@query(f"WITH {_F_SQL}, x AS (SELECT report_id, code, CASE code WHEN 'AF' THEN 85 WHEN 'AO' THEN 75 WHEN 'NF' THEN 75 END AS floor FROM f) SELECT report_id, max(floor) AS floor_score, min(code) FILTER (floor = m) AS floor FROM (SELECT *, max(floor) OVER (PARTITION BY report_id) AS m FROM x WHERE floor IS NOT NULL) GROUP BY report_id")
def floor_max_by(s, d):
    names = F.create_map(*[F.lit(x) for kv in {"AF": "MACRO_STOMPED", "AO": "MACRO_XLM", "NF": "HDR_MAILER_PHISHING_KIT"}.items() for x in kv])
    back = F.create_map(*[F.lit(x) for kv in {"MACRO_STOMPED": "AF", "MACRO_XLM": "AO", "HDR_MAILER_PHISHING_KIT": "NF"}.items() for x in kv])
    f = _findings(s, d).withColumn("seq", F.when(F.col("code") == "AF", 1).when(F.col("code") == "AO", 2).otherwise(3)).withColumn("code", F.try_element_at(names, F.col("code"))).filter("code is not null")
    return score.floors(f).select("report_id", "floor_score", F.try_element_at(back, F.col("floor")).alias("floor"))


@query(f"WITH {_S_SQL}, o AS (SELECT CAST(o_orderkey AS VARCHAR) AS report_id, o_custkey FROM orders), k AS (SELECT 'c' || o_custkey AS report_id, max(score) AS nested_score FROM v JOIN o USING (report_id) GROUP BY o_custkey) SELECT report_id, nested_score, CASE WHEN nested_score >= 70 THEN 'malicious' WHEN nested_score >= 35 THEN 'suspicious' WHEN nested_score >= 12 THEN 'caution' ELSE 'clean' END AS verdict FROM k")
def nested_score(s, d):
    """Customers as messages that carry their orders' messages, and are as bad as the worst of these."""
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("report_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parent_report_id"))
    carriers = o.select(F.col("parent_report_id").alias("report_id"), F.lit(None).cast("string").alias("parent_report_id")).distinct()
    return score.assess_nested(o.unionByName(carriers), _coded(s, d), depth=1).filter("nested_score is not null").select("report_id", "nested_score", "verdict")


@query(f"WITH {_S_SQL}, n AS (SELECT report_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, coalesce(array_to_string(list_sort(list_distinct(list(CASE category WHEN 'authentication' THEN 'AUTH_' ELSE 'ATT_' END || code) FILTER (severity = 'high'))), '|'), '') AS top_codes FROM f GROUP BY report_id) SELECT report_id, score, verdict, high, medium, low, top_codes FROM v JOIN n USING (report_id)")
def severity_pivot(s, d):
    """The summary rows: score, verdict, counts by severity and the worst codes."""
    return score.summary(_scores(s, d), _coded(s, d)).select("report_id", "score", "verdict", "high", "medium", "low", F.array_join("top_codes", "|").alias("top_codes"))


@query(f"WITH {_S_SQL} SELECT verdict, CAST(score // 10 AS VARCHAR) AS tens, count(*) AS reports FROM v GROUP BY ROLLUP (verdict, CAST(score // 10 AS VARCHAR))")
def verdict_rollup(s, d):
    return score.tally(_scores(s, d))


@query(f"WITH {_F_SQL} SELECT report_id, severity, code, CAST(n AS INT) AS n FROM (SELECT report_id, severity, code, row_number() OVER (PARTITION BY report_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, code) AS n FROM f)")
def findings_sort_topk(s, d):
    """Every finding with its place in its report."""
    none = F.lit(None).cast("string")
    return score.placed(_findings(s, d).withColumns({"location": none, "evidence": none})).select("report_id", "severity", "code", F.col("seq").alias("n"))


@query(f"""WITH {_ID_SQL}, {_URL_SQL}, {_MAILED} SELECT report_id, code, severity FROM sender UNION ALL SELECT report_id, code, severity FROM linked
 UNION ALL SELECT parent_report_id, CASE WHEN coalesce(worst, 0) >= 2 THEN 'NESTED_MESSAGE_SUSPICIOUS' ELSE 'NESTED_MESSAGE' END, CASE WHEN coalesce(worst, 0) >= 2 THEN 'high' ELSE 'info' END FROM messages LEFT JOIN mailed USING (report_id) WHERE parent_report_id IS NOT NULL""")
def union_detectors(s, d):
    """Findings of several detectors in one table."""
    m = _whole(table(s, d, "messages"))
    return detect.union([detect.sender_identity(m), detect.links(table(s, d, "urls")), detect.nested(m, detect.sending_software(m))]).select("report_id", "code", "severity")


# --- indicators, cases, rules, outputs ---------------------------------------------------------------------------------

_IOC_SQL = f"""i AS (SELECT report_id, 'email-addr' AS type, lower(trim(from_address)) AS value FROM messages UNION SELECT report_id, 'domain', {_DOM('from_address')} FROM messages WHERE contains(from_address, '@') UNION SELECT report_id, 'email-addr', lower(trim(return_path)) FROM messages
 UNION SELECT report_id, 'domain', {_DOM('return_path')} FROM messages WHERE contains(return_path, '@') UNION SELECT report_id, 'email-addr', lower(trim(x)) FROM (SELECT report_id, unnest(reply_to) AS x FROM messages) UNION SELECT report_id, 'domain', {_DOM('x')} FROM (SELECT report_id, unnest(reply_to) AS x FROM messages) WHERE contains(x, '@')
 UNION SELECT report_id, 'ipv4', from_ip FROM hops WHERE NOT ip_is_private UNION SELECT report_id, 'url', trim(url) FROM urls WHERE scheme IN ('http', 'https', 'ftp', '') UNION SELECT report_id, CASE WHEN regexp_matches(host, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') THEN 'ipv4' ELSE 'domain' END, lower(trim(host)) FROM urls)"""


def _indicators(s: SparkSession, d: str) -> DataFrame:
    return indicators.extract(table(s, d, "messages"), table(s, d, "hops"), table(s, d, "urls"))


@query(f"WITH {_IOC_SQL} SELECT type, value, count(DISTINCT report_id) AS reports FROM i WHERE value <> '' GROUP BY ALL HAVING count(DISTINCT report_id) > 1")
def shared_indicators(s, d):
    return indicators.shared(_indicators(s, d)).select("type", "value", "reports")


@query(f"WITH {_IOC_SQL} SELECT DISTINCT report_id, type, value FROM i WHERE contains(lower(value), 'desk.test') OR (contains(lower(value), 'helpcentral') AND type = 'domain') EXCEPT SELECT report_id, type, value FROM i WHERE contains(lower(value), 'desk.test') AND NOT contains(lower(value), 'helpcentral')")
def case_search(s, d):
    found = indicators.search(_indicators(s, d), table(s, d, "messages"), "helpcentral", "domain")
    return found.select("report_id", "type", F.lower("value").alias("value")).distinct()


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def only_new_anti(s, d):
    old = table(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return case.only_new(table(s, d, "orders").select("o_custkey"), old, "o_custkey")


@query("SELECT user_id, epoch_us(max(ts)) AS ts_us, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def newest_entry(s, d):
    """The last event of each user."""
    e = table(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id")
    return case.newest(e, "user_id", ["ts_us", "event_id"])


@query("SELECT DISTINCT lower(sha256) AS sha256 FROM messages WHERE sha256 IS NOT NULL AND lower(sha256) NOT IN (SELECT lower(sha256) FROM messages WHERE sha256 IS NOT NULL AND batch_id < 'b2023-06')")
def case_intake(s, d):
    """What a case takes in of all evidence after the first batches are in its index, each content once."""
    m = table(s, d, "messages").filter("sha256 is not null").select(F.lower("sha256").alias("sha256"), "delivery_id", "batch_id")
    return case.only_new(m, m.filter("batch_id < 'b2023-06'")).select("sha256")


@query("""WITH o AS (SELECT o_orderkey AS seq, sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus) AS hash FROM orders), l AS (SELECT seq, hash, CASE WHEN seq % 1000 = 7 THEN repeat('f', 64) ELSE coalesce(lag(hash) OVER (ORDER BY seq), repeat('0', 64)) END AS prev FROM o)
 SELECT seq, 'link' AS problem FROM (SELECT *, coalesce(lag(hash) OVER (ORDER BY seq), repeat('0', 64)) AS want FROM l) WHERE prev <> want""")
def custody_chain(s, d):
    """Orders as the entries of a log, linked in ranges; one link of each thousand is broken."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("seq"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("hash"))
    linked = case.with_previous(o, "seq", "hash")
    prev = F.when(F.col("seq") % 1000 == 7, F.lit("f" * 64)).otherwise(F.coalesce("_before", F.lit(case.GENESIS)))
    return case.broken_links(linked.select("seq", "hash", prev.alias("prev")), "seq", "prev", "hash")


_RULES = rules.parse_rules([
    {"id": "urgent", "severity": "high", "all": [{"field": "subject", "contains": "invoice"}], "any": [{"field": "from_domain", "endswith": ".example"}, {"field": "mailer", "exists": True}], "none": [{"field": "to", "equals": "nobody@desk.test"}]},
    {"id": "boxed", "severity": "low", "all": [{"field": "format", "in": ["mbox"]}, {"field": "message_id", "exists": False}]},
])


@query(f"""WITH m AS (SELECT report_id, contains(lower(coalesce(subject, '')), 'invoice') AND (coalesce({_DOM('from_address')}, '') LIKE '%.example' OR x_mailer IS NOT NULL) AND NOT coalesce(list_contains(list_transform(to_addrs, lambda x: lower(x)), 'nobody@desk.test'), false) AS a, coalesce(lower(msg_format) = 'mbox', false) AND message_id IS NULL AS b FROM messages)
 SELECT report_id, CASE WHEN a AND b THEN 'URGENT,BOXED' WHEN a THEN 'URGENT' ELSE 'BOXED' END AS rules FROM m WHERE a OR b""")
def rule_eval(s, d):
    m = table(s, d, "messages").withColumn("findings", F.array().cast("array<struct<code:string,severity:string>>"))
    out = rules.apply_rules(m, _RULES, rules.message_fields())
    return out.filter("size(matched) > 0").select("report_id", F.regexp_replace(F.array_join("matched", ","), "RULE_", "").alias("rules"))


_FOLD = rules.parse_rules([
    {"id": "first", "action": "suppress", "suppress": ["AF"], "all": [{"finding": "NO"}]}, {"id": "second", "action": "suppress", "suppress": ["NO", "RF"], "all": [{"finding": "AF", "min_severity": "high"}]}, {"id": "third", "severity": "high", "all": [{"finding_prefix": "N"}]},
])


@query(f"""WITH {_F_SQL}, g AS (SELECT report_id, list(code) AS c FROM f GROUP BY report_id), a AS (SELECT report_id, CASE WHEN list_contains(c, 'NO') THEN list_filter(c, lambda x: x <> 'AF') ELSE c END AS c, CASE WHEN list_contains(c, 'NO') THEN len(list_filter(c, lambda x: x = 'AF')) ELSE 0 END AS s FROM g),
 b AS (SELECT report_id, CASE WHEN list_contains(c, 'AF') THEN list_filter(c, lambda x: x NOT IN ('NO', 'RF')) ELSE c END AS c, s + CASE WHEN list_contains(c, 'AF') THEN len(list_filter(c, lambda x: x IN ('NO', 'RF'))) ELSE 0 END AS s FROM a)
 SELECT report_id, CAST(len(c) AS BIGINT) AS kept, CAST(s AS BIGINT) AS suppressed, len(list_filter(c, lambda x: x LIKE 'N%')) > 0 AS flagged FROM b""")
def suppress_fold(s, d):
    g = _findings(s, d).groupBy("report_id").agg(F.collect_list(F.struct("code", "severity")).alias("findings"))
    out = rules.apply_rules(g, _FOLD, {})
    return out.select("report_id", (F.size("findings") - F.size("matched")).cast("long").alias("kept"), F.size("suppressed").cast("long").alias("suppressed"), (F.size("matched") > 0).alias("flagged"))


_RATED = "rated AS (SELECT report_id, CAST(size_bytes % 101 AS INT) AS score FROM messages), ratedv AS (SELECT *, CASE WHEN score >= 70 THEN 'malicious' WHEN score >= 35 THEN 'suspicious' WHEN score >= 12 THEN 'caution' ELSE 'clean' END AS verdict FROM rated)"


def _rated(s: SparkSession, d: str) -> DataFrame:
    """A score and verdict for each message, by its size."""
    points = (F.col("size_bytes") % 101).cast("int")
    return table(s, d, "messages").select("report_id", points.alias("score"), score.verdict_of(points).alias("verdict"))


@query(f"""WITH {_RATED}, {_MAILED} SELECT report_id, 'siftwright.analysis' AS event_type, sha256, msg_format AS format, parent_report_id AS parent, verdict, CAST(score AS VARCHAR) AS score, subject, from_address AS sender, to_addrs[1] AS recipient, CASE WHEN worst = 3 THEN 'HDR_MAILER_PHISHING_KIT' END AS kit
 FROM messages JOIN ratedv USING (report_id) JOIN mailed USING (report_id)""")
def siem_event_json(s, d):
    """The JSON lines of all messages, read again field by field."""
    m = _whole(table(s, d, "messages")).withColumn("container_sha256", F.lit(None).cast("string"))
    none = s.createDataFrame([], "report_id string, rank int, code string, points double")
    e = sinks.events(m, _rated(s, d), detect.sending_software(m), none, "2025-01-01T00:00:00Z")
    at = lambda path: F.get_json_object("event", path)
    fields = {"event_type": "$.event_type", "sha256": "$.evidence.sha256", "format": "$.evidence.format", "parent": "$.evidence.parent", "verdict": "$.verdict", "score": "$.score", "subject": "$.email.subject", "sender": "$.email.from", "recipient": "$.email.to[0]"}
    kit = F.when(F.contains(at("$.findings"), F.lit("HDR_MAILER_PHISHING_KIT")), "HDR_MAILER_PHISHING_KIT")
    return e.select("report_id", *[at(p).alias(k) for k, p in fields.items()], kit.alias("kit"))


_ESC = lambda x: f"regexp_replace(replace(replace(coalesce({x}, ''), '\\', '\\\\'), '=', '\\='), '[\\r\\n]', ' ', 'g')"


@query(f"""WITH {_RATED} SELECT report_id, 'CEF:0|siftwright|siftwright|{sinks.VERSION}|' || verdict || '|' || replace(regexp_replace(replace(substr(upper(verdict) || ' email: ' || coalesce(nullif(subject, ''), '(no subject)'), 1, 200), '\\', '\\\\'), '[\\r\\n]', ' ', 'g'), '|', '\\|') || '|' || CAST(least(10, CAST(round_even(score / 10, 0) AS INT)) AS VARCHAR)
 || '|rt=0 fname=' || {_ESC('path')} || ' fileHash=' || {_ESC('sha256')} || ' suser=' || {_ESC('from_address')} || ' duser=' || {_ESC("substr(array_to_string(to_addrs, ','), 1, 1000)")} || ' msg=' || {_ESC('subject')} || ' cs1Label=verdict cs1=' || verdict || ' cs2Label=findings cs2= cs3Label=reply_to cs3=' || {_ESC("array_to_string(reply_to, ',')")} || ' cn1Label=score cn1=' || score AS line
 FROM messages JOIN ratedv USING (report_id)""")
def cef_line(s, d):
    """The CEF lines of all messages, without findings."""
    none = s.createDataFrame([], "report_id string, code string")
    return sinks.cef(table(s, d, "messages"), _rated(s, d), none, 0)


@query("""WITH q AS (SELECT url_id, host AS name FROM urls WHERE host IS NOT NULL), r AS (SELECT * FROM (VALUES ('helpcentral.example', '192.0.2.7', NULL), ('login.kestrelpay.example', NULL, 'NXDOMAIN')) t(n, answer, error))
 SELECT url_id, name, answer, coalesce(error, CASE WHEN r.n IS NULL THEN 'not recorded' END) AS error FROM q LEFT JOIN r ON lower(rtrim(name, '.')) = n""")
def dns_replay_join(s, d):
    """Recorded answers about the hosts of URLs."""
    rec = s.createDataFrame([("HelpCentral.example.", "a", ["192.0.2.7"], None), ("login.kestrelpay.example", "A", None, "NXDOMAIN")], "name string, type string, answers array<string>, error string")
    asked = table(s, d, "urls").filter("host is not null").select("url_id", F.col("host").alias("name"), F.lit("A").alias("type"))
    return recordings.answered(asked, rec).select("url_id", "name", F.get("answers", F.lit(0)).alias("answer"), "error")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS report_id, CASE WHEN a < 30 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS a FROM orders) WHERE a < 180")
def domain_age(s, d):
    """Order dates as the answers of a registry about one domain each."""
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("report_id"), F.lit("domain").alias("kind"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".example")).alias("value"), F.col("o_orderdate").cast("date").alias("day"))
    said = F.concat(F.lit('{"events": [{"eventAction": "last changed", "eventDate": "1999-01-01"}, {"eventAction": "registration", "eventDate": "'), F.date_format("day", "yyyy-MM-dd"), F.lit('T00:00:00Z"}]}'))
    answers = enrich.summaries(o.select(F.lit("rdap").alias("provider"), "kind", "value", said.alias("response"), F.lit(None).cast("string").alias("error")))
    sent = o.select("report_id", F.unix_micros(F.lit("1998-08-02").cast("timestamp")).alias("date_us"))
    return enrich.findings(o.select("report_id", "kind", "value"), answers, sent).filter("code = 'ENRICH_NEW_DOMAIN'").select("report_id", "severity")


@query("""WITH g AS (SELECT event_type, user_id, event_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS k FROM g)
 SELECT event_type AS type, CAST(user_id AS VARCHAR) AS value, min(t) AS start_us, max(t) AS end_us, count(*) AS seen FROM n GROUP BY event_type, user_id, k""")
def session_campaign(s, d):
    """Runs of an indicator's appearances."""
    e = table(s, d, "events").select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("at"))
    return watch.campaign_sessions(e, "at", "30 minutes 1 microsecond").select("type", "value", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "seen")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type AS type, CAST(user_id % 7 AS VARCHAR) AS value, count(DISTINCT user_id) AS reports FROM events GROUP BY ALL")
def campaign_windows(s, d):
    """How many reports had an indicator in each hour."""
    e = table(s, d, "events").select(F.col("event_type").alias("type"), (F.col("user_id") % 7).cast("string").alias("value"), F.col("user_id").cast("string").alias("report_id"), F.col("ts").cast("timestamp").alias("at"))
    return watch.campaign_windows(e, "at").select(F.unix_micros("start").alias("start_us"), "type", "value", "reports")


@query(f"WITH {_RATED} SELECT verdict, count(*) AS reports FROM ratedv WHERE score >= 35 GROUP BY verdict")
def case_counts(s, d):
    """How many reports of a case are suspicious or worse."""
    return score.tally(casefile.as_bad_as(_rated(s, d), "suspicious")).filter("verdict is not null and tens is null").select("verdict", "reports")


_LEAVES = ["exe", "pdf.exe", "docm", "html", "iso", "one", "pdf", "txt", "tar.gz", "csv.js", "png", "svg"]
_LEAF_SQL = "n AS (SELECT p_partkey, replace(p_name, ' ', '_') || '.' || ([" + ", ".join(f"'{x}'" for x in _LEAVES) + "])[p_partkey % 12 + 1] AS name, ([" + ", ".join(f"'{x}'" for x in _LEAVES) + "])[p_partkey % 12 + 1] AS leaf FROM part)"


@query(f"""WITH {_LEAF_SQL} SELECT p_partkey, unnest(CASE leaf WHEN 'exe' THEN ['ATT_EXECUTABLE'] WHEN 'pdf.exe' THEN ['ATT_EXECUTABLE', 'ATT_DOUBLE_EXTENSION'] WHEN 'docm' THEN ['ATT_MACRO_EXTENSION'] WHEN 'html' THEN ['ATT_HTML'] WHEN 'svg' THEN ['ATT_HTML'] WHEN 'iso' THEN ['ATT_DISK_IMAGE'] WHEN 'one' THEN ['ATT_ONENOTE']
 WHEN 'csv.js' THEN ['ATT_EXECUTABLE', 'ATT_DOUBLE_EXTENSION'] ELSE [] END) AS code FROM n""")
def risky_names(s, d):
    """Names of parts as those of attachments, with endings of many kinds."""
    leaf = F.element_at(F.array(*map(F.lit, _LEAVES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), leaf)
    none = F.lit(None).cast("string")
    a = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("report_id"), F.lit("1").alias("part"), name.alias("filename"), none.alias("type_name"), F.lit("application/octet-stream").alias("content_type"), filetype.extension(name).alias("extension"), none.alias("detected_type"), F.lit(None).cast("binary").alias("payload"))
    return detect_files.attachments(a).select(F.col("report_id").cast("long").alias("p_partkey"), "code")


_ROLES_SQL = f"""ri AS (SELECT report_id, 0 AS seq, 'email-addr' AS type, trim(from_address) AS value, 'from' AS role, '' AS context FROM messages UNION ALL SELECT report_id, 0, 'domain', CASE WHEN contains(from_address, '@') THEN {_DOM('from_address')} END, 'from-domain', '' FROM messages
 UNION ALL SELECT report_id, 1, 'email-addr', trim(return_path), 'return-path', '' FROM messages UNION ALL SELECT report_id, 1, 'domain', CASE WHEN contains(return_path, '@') THEN {_DOM('return_path')} END, 'return-path-domain', '' FROM messages
 UNION ALL SELECT report_id, 3, 'email-addr', trim(x), 'reply-to', '' FROM (SELECT report_id, unnest(reply_to) AS x FROM messages) UNION ALL SELECT report_id, 3, 'domain', CASE WHEN contains(x, '@') THEN {_DOM('x')} END, 'reply-to-domain', '' FROM (SELECT report_id, unnest(reply_to) AS x FROM messages)
 UNION ALL SELECT report_id, 4, 'subject', trim(subject), 'subject', '' FROM messages UNION ALL SELECT report_id, 5, 'message-id', trim(message_id), 'message-id', '' FROM messages
 UNION ALL SELECT report_id, 6, CASE WHEN contains(from_ip, ':') THEN 'ipv6' ELSE 'ipv4' END, trim(from_ip), 'received-ip', substr(concat_ws(' ', 'hop', idx, 'from', from_host), 1, 200) FROM hops WHERE from_ip IS NOT NULL AND NOT ip_is_private
 UNION ALL SELECT report_id, 8, 'url', trim(url), 'link', substr(array_to_string(sources, ', '), 1, 200) FROM urls WHERE scheme IN ('http', 'https', 'ftp', '')
 UNION ALL SELECT report_id, 9, CASE WHEN regexp_matches(host, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') THEN 'ipv4' ELSE 'domain' END, trim(regexp_replace(host, '^\\[|\\]$', '', 'g')), 'link-host', '' FROM urls),
 rf AS (SELECT *, row_number() OVER (PARTITION BY report_id, type, CASE WHEN type IN ('url', 'subject') THEN value ELSE lower(value) END, role ORDER BY seq, value, context) AS n FROM ri WHERE value <> ''), roles AS (SELECT report_id, seq, type, value, role, context FROM rf WHERE n = 1)"""
_SAFE = lambda x: f"CASE WHEN regexp_matches({x}, '^[=+@\\t\\r-]') THEN '''' || {x} ELSE {x} END"


@query(f"WITH {_ROLES_SQL} SELECT {_SAFE('report_id')} AS report_id, seq, {_SAFE('type')} AS type, {_SAFE('value')} AS value, {_SAFE('role')} AS role, {_SAFE('context')} AS context FROM roles")
def ioc_table(s, d):
    """All indicators, in the form that is written as CSV."""
    return sinks.csv_rows(_indicators(s, d))


_TEXT = "type || ' seen as ' || role || ' in a message assessed as suspicious' || CASE WHEN context <> '' THEN ' (' || context || ')' ELSE '' END"
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_PATHS = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in sinks.STIX_PATHS.items()) + " END"


@query(f"""WITH {_ROLES_SQL}, st AS (SELECT *, split_part(report_id, '-', 1) AS sha, {_PATHS} AS path FROM roles), sh AS (SELECT *, sha1(unhex('6b1b1e8e3f6f4c5e9d076a2f0b9c1d11') || encode(type || '|' || value || '|' || role || '|' || sha)) AS h FROM st WHERE path IS NOT NULL)
 SELECT report_id, 'indicator--' || {_UUID} AS id, substr(role || ': ' || value, 1, 250) AS name, {_TEXT} AS description, '[' || path || ' = ''' || replace(replace(value, '\\', '\\\\'), '''', '\\''') || ''']' AS pattern, sha AS evidence FROM sh""")
def stix_objects(s, d):
    """A STIX object for each indicator, read again field by field."""
    i = _indicators(s, d).withColumn("verdict", F.lit("suspicious")).withColumn("evidence_sha256", F.substring_index("report_id", "-", 1))
    o = sinks.stix_objects(i, "2025-01-01T00:00:00.000Z")
    at = lambda path: F.get_json_object("object", path)
    return o.select("report_id", "id", at("$.name").alias("name"), at("$.description").alias("description"), at("$.pattern").alias("pattern"), at("$.external_references[0].external_id").alias("evidence"))


@query(f"""WITH {_ROLES_SQL}, mk AS (SELECT *, CASE WHEN type IN ('ipv4', 'ipv6') AND role LIKE '%-host' THEN 'ip-dst' WHEN type IN ('ipv4', 'ipv6') THEN 'ip-src' WHEN type = 'email-addr' AND role IN ('from', 'return-path') THEN 'email-src' WHEN type = 'email-addr' AND role = 'reply-to' THEN 'email-reply-to' WHEN type = 'subject' THEN 'email-subject'
 WHEN type = 'message-id' THEN 'email-message-id' WHEN type IN ('url', 'domain') THEN type END AS kind FROM roles) SELECT report_id, kind AS type, CASE WHEN kind IN ('url', 'domain', 'ip-src', 'ip-dst') THEN 'Network activity' ELSE 'Payload delivery' END AS category, value, type NOT IN ('subject', 'message-id') AS to_ids,
 role || '; message suspicious' || CASE WHEN context <> '' THEN '; ' || context ELSE '' END AS comment, '5' AS distribution FROM mk WHERE kind IS NOT NULL""")
def misp_attributes(s, d):
    """A MISP attribute for each indicator."""
    return sinks.misp_attributes(_indicators(s, d).withColumn("verdict", F.lit("suspicious")))


# --- sender authentication, over recordings made from the tables --------------------------------------------------------

_DM_SQL = f"""dm AS (SELECT report_id, delivery_id, {_DOM('from_address')} AS fd, {_DOM('return_path')} AS rd FROM messages), do_ AS (SELECT *, {_org('fd')} AS fo FROM dm), rec AS (SELECT DISTINCT fo AS name, len(fo) % 5 AS k FROM do_ WHERE fo IS NOT NULL),
 pol AS (SELECT name, CASE k WHEN 1 THEN ['v=DMARC1; p=reject; sp=quarantine'] WHEN 2 THEN ['v=DMARC1; p=none; adkim=s'] WHEN 3 THEN ['v=DMARC1; p=reject', 'v=DMARC1; p=none'] WHEN 4 THEN [] END AS a, CASE k WHEN 1 THEN 'reject' WHEN 2 THEN 'none' WHEN 3 THEN 'reject' END AS p, k FROM rec WHERE k > 0)"""


@query(f"""WITH {_DM_SQL}, j AS (SELECT d.*, own.a AS oa, own.name IS NOT NULL AS seen, CASE WHEN len(own.a) > 0 THEN own.name WHEN len(o.a) > 0 THEN o.name END AS pd, CASE WHEN len(own.a) > 0 THEN own.k WHEN len(o.a) > 0 THEN o.k END AS k, CASE WHEN len(own.a) > 0 THEN own.p WHEN len(o.a) > 0 THEN o.p END AS p FROM do_ d LEFT JOIN pol own ON own.name = fd LEFT JOIN pol o ON o.name = fo),
 al AS (SELECT *, (delivery_id % 2 = 0 AND coalesce(CASE WHEN k = 2 THEN rd = fd ELSE {_org('rd')} = fo END, false)) OR (delivery_id % 3 = 0 AND coalesce('mail.' || fo IS NOT NULL, false)) AS aligned FROM j)
 SELECT report_id, CASE WHEN fd IS NULL OR fd = '' THEN 'permerror' WHEN pd IS NULL AND NOT seen THEN 'temperror' WHEN pd IS NULL THEN 'none' WHEN k = 3 THEN 'permerror' WHEN aligned THEN 'pass' ELSE 'fail' END AS result, CASE WHEN pd IS NOT NULL THEN CASE WHEN k = 1 AND pd <> fd THEN 'quarantine' ELSE p END END AS policy, pd AS policy_domain FROM al""")
def dmarc(s, d):
    """Policies by the length of a domain's name; every second message is signed by its return path's domain, every third sent by a host of its sender's organisation."""
    m = table(s, d, "messages").withColumn("fd", domains.domain_of(F.col("from_address")))
    org = domains.org_domain(s)
    names = m.select(org(F.col("fd")).alias("name")).filter("name is not null").distinct().withColumn("k", F.length("name") % 5).filter("k > 0")
    texts = [("v=DMARC1; p=reject; sp=quarantine",), ("v=DMARC1; p=none; adkim=s",), ("v=DMARC1; p=reject", "v=DMARC1; p=none"), ()]
    answers = F.get(F.array(*[F.array(*map(F.lit, t)).cast("array<string>") for t in texts]), F.col("k") - 1)
    dns = names.select(F.concat(F.lit("_DMARC."), "name").alias("name"), F.lit("TXT").alias("type"), answers.alias("answers"), F.lit(None).cast("string").alias("error"))
    signed = m.filter("delivery_id % 2 = 0").select("report_id", domains.domain_of(F.col("return_path")).alias("domain"), F.lit("pass").alias("result")).filter("domain is not null")
    sent = m.filter("delivery_id % 3 = 0").select("report_id", F.concat(F.lit("mail."), org(F.col("fd"))).alias("domain"), F.lit("pass").alias("result")).filter("domain is not null")
    return mailauth.dmarc(m, signed, sent, dns)


@query(f"""WITH o AS (SELECT report_id, arg_min(from_ip, idx) AS ip FROM hops WHERE from_ip IS NOT NULL AND NOT ip_is_private GROUP BY report_id), i AS (SELECT report_id, ip, CASE WHEN contains(return_path, '@') THEN lower(regexp_extract(return_path, '@([^@]*)$', 1)) END AS domain FROM messages JOIN o USING (report_id))
 SELECT report_id, ip, domain, CASE WHEN domain IS NULL THEN 'none' WHEN len(domain) % 3 = 0 THEN 'temperror' WHEN regexp_matches(ip, '^8\\.|^9\\.|^1[0-9]\\.') THEN 'pass' WHEN len(domain) % 3 = 1 THEN 'fail' ELSE 'softfail' END AS result FROM i""")
def spf(s, d):
    """Policies by the length of a domain's name, of which a third wasn't recorded; networks are 8.0.0.0 to 19.255.255.255, by way of an include."""
    inputs = detect.origins(table(s, d, "hops")).select("report_id", "ip").join(table(s, d, "messages").select("report_id", F.col("return_path").alias("mail_from")), "report_id").withColumn("helo", F.lit(None).cast("string"))
    domain = F.lower(F.substring_index("mail_from", "@", -1))
    names = inputs.filter(F.contains("mail_from", F.lit("@"))).select(domain.alias("name")).distinct().withColumn("k", F.length("name") % 3).filter("k > 0")
    text = F.concat(F.lit("v=spf1 ip4:8.0.0.0/7 include:nets.test "), F.when(F.col("k") == 1, "-all").otherwise("~all"))
    dns = names.select("name", F.lit("TXT").alias("type"), F.array(text).alias("answers"), F.lit(None).cast("string").alias("error"))
    nets = s.createDataFrame([("nets.test", "TXT", ["v=spf1 ip4:10.0.0.0/7 ip4:12.0.0.0/6 ip4:16.0.0.0/6 -all"], None)], "name string, type string, answers array<string>, error string")
    return mailauth.spf(inputs, dns.unionByName(nets)).select("report_id", "ip", "domain", "result")


# --- the parse stage, streams and archives, on bytes made from the tables -----------------------------------------------

_PLAIN = r"^[\x21-\x7E][\x20-\x7E]*[\x21-\x7E]$"


def _round_trip(s: SparkSession, d: str, messages: DataFrame) -> DataFrame:
    stamps = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("idx")).alias("i"), F.col("hop_id").alias("k"), "raw"))), lambda x: F.concat(F.lit("Received: "), F.regexp_replace(x["raw"], r"[\r\n]+[ \t]*", " ")))
    hops = table(s, d, "hops").filter("raw is not null").groupBy("report_id").agg(F.array_join(stamps, "\r\n").alias("received"))
    m = messages.select("delivery_id", "report_id", "subject", "from_address").join(hops, "report_id", "left")
    word = F.concat(F.lit("=?utf-8?B?"), F.regexp_replace(F.base64(F.encode("subject", "UTF-8")), r"\s", ""), F.lit("?="))
    subject = F.when((F.col("subject") == "") | (F.col("subject").rlike(_PLAIN) & ~F.contains("subject", F.lit("=?"))), F.col("subject")).otherwise(word)
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    raw = F.concat(F.coalesce(F.concat("received", F.lit("\r\n")), F.lit("")), header("From", F.regexp_replace("from_address", r"[\r\n]+", " ")), header("Subject", subject), F.lit("\r\nbody\r\n"))
    got = parse.parsed(m.select(F.col("delivery_id").cast("string").alias("path"), F.encode(raw, "UTF-8").alias("content")))
    return got.select(F.col("path").cast("long").alias("delivery_id"), "subject", F.col("from_address").alias("sender"), F.size("hops").cast("long").alias("hops"))


@query("""WITH h AS (SELECT report_id, count(*) AS hops FROM hops WHERE raw IS NOT NULL GROUP BY report_id) SELECT delivery_id, subject, nullif(lower(from_address), '') AS sender, coalesce(hops, 0) AS hops FROM messages LEFT JOIN h USING (report_id)""")
def parse_round_trip(s, d):
    """All messages written as bytes and parsed again: subjects that aren't plain go as encoded words, absent fields have no header."""
    return _round_trip(s, d, table(s, d, "messages"))


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text <> '' AND doc_id % 11 <> 3 AND doc_id % 11 <> 5")
def watch_dedupe(s, d):
    """Texts that come in as files of a watched folder, each content once, until nothing more is there; some names are skipped."""
    kind = F.col("doc_id") % 11
    name = F.concat(F.lit("in/"), F.when(kind == 3, ".part").when(kind == 5, "x.tmp").when(kind == 7, "noending").otherwise("x.EML"))
    files = stage(table(s, d, "documents").filter("text <> ''").select(F.regexp_replace(name, "x", F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")).repartition(3), "stream-in")
    place = files.inputFiles()[0].rpartition("/")[0]
    stream = watch.new_contents(s.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(place)).select("sha256")
    out = new_path(s, "stream")
    stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).format("parquet").start(f"{out}/rows").awaitTermination()
    return s.read.schema("sha256 string").parquet(f"{out}/rows")


@query("SELECT delivery_id, CASE WHEN delivery_id % 3 = 0 THEN 'content' ELSE 'a.txt' END AS name, octet_length(encode(subject)) AS size, sha256(subject) AS sha256 FROM messages WHERE subject <> ''")
def archive_members(s, d):
    """Subjects put into ZIP, tar and gzip archives in turn, and taken out again."""

    def packed(batches):
        import gzip
        import io
        import tarfile
        import zipfile

        import pandas as pd

        for b in batches:
            out = []
            for key, text in zip(b["delivery_id"], b["subject"], strict=True):
                data, held = text.encode(), io.BytesIO()
                if key % 3 == 0:
                    held.write(gzip.compress(data))
                elif key % 3 == 1:
                    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr("a.txt", data)
                else:
                    with tarfile.open(fileobj=held, mode="w") as t:
                        info = tarfile.TarInfo("a.txt")
                        info.size = len(data)
                        t.addfile(info, io.BytesIO(data))
                out.append((str(key), "1", ("gzip", "zip", "tar")[key % 3], held.getvalue()))
            yield pd.DataFrame(out, columns=["report_id", "part", "detected_type", "payload"])

    m = table(s, d, "messages").filter("subject <> ''").select("delivery_id", "subject").mapInPandas(packed, "report_id string, part string, detected_type string, payload binary")
    return archives.members(m).select(F.col("report_id").cast("long").alias("delivery_id"), "name", "size", "sha256")


@query()
def imitated_hosts(s, d):
    """Hosts of URLs that imitate a watched one (tested against a comparison of each with each)."""
    watched = table(s, d, "watch_names").filter("field_name = 'host'").select(F.col("canonical").alias("domain"), F.lit("org").alias("kind"))
    return imitation.imitations(table(s, d, "urls").select("host"), watched)


_KINDS = ", ".join(f"('{name}', '{kind}')" for _, name, kind in detect.MAILERS)
_NAMED_SQL = _MAILER_SQL.partition(" FROM messages")[0]
_SOFT_SQL = f"""soft AS (SELECT report_id, CASE kind WHEN 'phishing-kit' THEN 'HDR_MAILER_PHISHING_KIT' WHEN 'bulk' THEN 'HDR_MAILER_BULK' WHEN 'script' THEN 'HDR_MAILER_SCRIPT' ELSE 'HDR_MAILER_OUTDATED' END AS code, CASE kind WHEN 'phishing-kit' THEN 'high' ELSE 'low' END AS severity
 FROM ({_NAMED_SQL} FROM messages) JOIN (SELECT * FROM (VALUES {_KINDS}) t(mailer, kind)) USING (mailer) WHERE kind <> 'client')"""
_PATH_ROWS = ", ".join(f"('{p}', {[*senders.split()]}, {[*infra.split()]}, '{ids_}')" for p, (senders, infra, ids_) in detect.PROVIDERS.items())
_PATH_SQL = f"""ph AS (SELECT report_id, lower(rtrim(from_host, '.')) AS host FROM hops WHERE from_host IS NOT NULL UNION ALL SELECT report_id, lower(rtrim(by_host, '.')) FROM hops WHERE by_host IS NOT NULL), pr AS (SELECT * FROM (VALUES {_PATH_ROWS}) t(provider, senders, infra, ids)),
 pm AS (SELECT report_id, {_DOM('from_address')} AS fd, {_DOM('trim(message_id)')} AS md FROM messages WHERE report_id IN (SELECT report_id FROM ph)), pf AS (SELECT report_id, fd, md, senders, ids FROM pm, pr WHERE NOT EXISTS (SELECT 1 FROM ph, (SELECT unnest(pr.infra) AS i) WHERE ph.report_id = pm.report_id AND (host = i OR ends_with(host, '.' || i)))),
 provided AS (SELECT report_id, 'HDR_PROVIDER_PATH_MISMATCH' AS code, 'medium' AS severity FROM pf WHERE list_contains(senders, fd) UNION ALL SELECT report_id, 'HDR_MESSAGE_ID_PROVIDER_MISMATCH', 'medium' FROM pf WHERE ids <> '' AND (md = ids OR ends_with(md, '.' || ids)))"""
_BODY_SQL = """bw AS (SELECT report_id, content_type, regexp_replace(mime_part, '\\.?[^.]*$', '') AS parent, list_distinct(regexp_extract_all(lower(coalesce(preview, '')), '\\pL{3,}')) AS w, regexp_replace(coalesce(preview, ''), '^\ufeff', '') AS p FROM text_bodies),
 bodied AS (SELECT report_id, 'TEXT_BIDI_CONTROL' AS code, 'medium' AS severity FROM bw WHERE regexp_matches(p, '[\u202a-\u202e\u2066-\u2069]') UNION ALL SELECT report_id, 'TEXT_ZERO_WIDTH', 'low' FROM bw WHERE regexp_matches(p, '[\u200b\u200c\u2060\u180e\u00ad\ufeff]')
 UNION ALL SELECT x.report_id, 'BODY_ALTERNATIVES_DIFFER', 'medium' FROM bw x JOIN bw y ON x.report_id = y.report_id AND x.parent = y.parent AND x.parent <> '' AND x.content_type = 'text/plain' AND y.content_type = 'text/html' AND len(x.w) >= 15 AND len(y.w) >= 15 WHERE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) < 0.2)"""
_ALL_SQL = f"{_ID_SQL}, {_URL_SQL}, {_SOFT_SQL}, {_PATH_SQL}, {_BODY_SQL}, every AS (SELECT report_id, code, severity FROM sender UNION ALL SELECT report_id, code, severity FROM linked UNION ALL FROM soft UNION ALL FROM provided UNION ALL FROM bodied)"


def _message_findings(s: SparkSession, d: str) -> DataFrame:
    m, hops, urls, bodies = (table(s, d, n) for n in ("messages", "hops", "urls", "text_bodies"))
    m = _whole(m)
    return detect.union([detect.sender_identity(m), detect.sending_software(m), detect.provider_path(m, hops), detect.links(urls), detect.body(bodies)])


@query(f"WITH {_ALL_SQL} SELECT report_id, code, severity FROM every")
def message_findings(s, d):
    """Findings of all detectors that the given tables allow, but those of times, in one table."""
    return _message_findings(s, d).select("report_id", "code", "severity")


@query()
def message_timeline(s, d):
    """The findings of times, which the timestamp operator reads first."""
    zones = source_zones(table(s, d, "relays"), "relay_host", "tz_name")
    messages, hops = table(s, d, "messages"), table(s, d, "hops")
    dates = normalise(messages, "delivery_id", "submit_host", [F.col("date_hdr")], zones).withColumnRenamed("utc_us", "date_us")
    stamps = normalise(hops, "hop_id", "by_host", [F.col("ts"), after_last_semicolon(F.col("raw"))], zones)
    return detect.timeline(_whole(messages.join(dates, "delivery_id", "left")), hops.join(stamps, "hop_id", "left"))


@query(f"""WITH {_ALL_SQL}, pts AS (SELECT report_id, code, CASE severity WHEN 'high' THEN 25.0::DOUBLE WHEN 'medium' THEN 10.0::DOUBLE WHEN 'low' THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS pts,
 CASE WHEN regexp_matches(code, '^HDR_(DISPLAY_NAME|REPLY_TO|RETURN_PATH|SENDER|MULTIPLE_FROM|PROVIDER_PATH|MESSAGE_ID)') THEN 'sender identity' WHEN code LIKE 'URL\\_%' ESCAPE '\\' THEN 'links and content' WHEN code LIKE 'HDR\\_MAILER%' ESCAPE '\\' THEN 'sending software' ELSE 'structure and evasion' END AS category FROM every),
 rk AS (SELECT *, pts * pow(0.6::DOUBLE, row_number() OVER (PARTITION BY report_id, category ORDER BY pts DESC) - 1) AS raw FROM pts), ct AS (SELECT report_id, category, round(least(60::DOUBLE, sum(raw ORDER BY raw DESC)), 1) AS points FROM rk GROUP BY ALL),
 ow AS (SELECT m.report_id, parent_report_id, CAST(round_even(100 * (1 - exp(-coalesce(raw, 0) / 50::DOUBLE)), 0) AS INT) AS own, kit FROM messages m LEFT JOIN (SELECT report_id, sum(points ORDER BY category) AS raw FROM ct GROUP BY report_id) USING (report_id) LEFT JOIN (SELECT DISTINCT report_id, true AS kit FROM every WHERE code = 'HDR_MAILER_PHISHING_KIT') USING (report_id)),
 s0 AS (SELECT report_id, parent_report_id, own, kit, greatest(own, CASE WHEN kit THEN 75 ELSE 0 END) AS score FROM ow), s1 AS (SELECT a.*, greatest(a.score, coalesce((SELECT max(b.score) FROM s0 b WHERE b.parent_report_id = a.report_id), 0)) AS t1 FROM s0 a),
 s2 AS (SELECT a.*, greatest(a.score, coalesce((SELECT max(b.t1) FROM s1 b WHERE b.parent_report_id = a.report_id), 0)) AS t2 FROM s1 a), s3 AS (SELECT a.*, (SELECT max(b.t2) FROM s2 b WHERE b.parent_report_id = a.report_id) AS nested_score FROM s2 a), v AS (SELECT *, greatest(score, coalesce(nested_score, 0)) AS total FROM s3)
 SELECT report_id, total AS score, CASE WHEN total >= 70 THEN 'malicious' WHEN total >= 35 THEN 'suspicious' WHEN total >= 12 THEN 'caution' ELSE 'clean' END AS verdict, CASE WHEN kit AND 75 > own THEN 'HDR_MAILER_PHISHING_KIT' ELSE '' END AS floor, coalesce(nested_score, -1) AS nested_score FROM v""")
def message_scores(s, d):
    """Scores and verdicts of all messages by these findings; without a floor or attached messages, '' and -1."""
    own = score.assess_nested(table(s, d, "messages").select("report_id", "parent_report_id"), score.placed(_message_findings(s, d)))
    return own.select("report_id", "score", "verdict", F.coalesce("floor", F.lit("")).alias("floor"), F.coalesce("nested_score", F.lit(-1)).alias("nested_score"))
