"""Reputation of indicators, from recorded answers: asked once for each distinct target, joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.plans.detect import findings_of, hit, union
from siftwright.sources import recordings

MOST_LOOKUPS, TTL_S, YOUNG_DAYS, NEW_DAYS = 50, 86_400, 180, 30
#: Parts that the targets of a provider are looked through in.
PARTS = 1024
# What each provider can be asked about.
PROVIDERS = {"cymru": ["ip"], "rdap": ["domain"], "virustotal": ["ip", "domain", "url", "file"], "urlhaus": ["url", "domain", "file"], "malwarebazaar": ["file"], "abuseipdb": ["ip"]}


def wanted(targets: DataFrame, cache: DataFrame | None = None, now_s: int = 0, most: int = MOST_LOOKUPS) -> DataFrame:
    """(provider, kind, value) to ask for: the first ``most`` of each provider by value, without what ``cache(provider, kind, value, stored_s)`` still holds."""
    kinds = F.explode(F.from_json(F.lit(str([{"p": p, "k": k} for p, ks in PROVIDERS.items() for k in ks]).replace("'", '"')), "array<struct<p:string,k:string>>"))
    pairs = targets.distinct().select("kind", "value", kinds.alias("x")).filter("kind = x.k").select(F.col("x.p").alias("provider"), "kind", "value")
    if cache is not None:
        pairs = pairs.join(cache.filter(F.col("stored_s") > now_s - TTL_S).select("provider", "kind", "value"), ["provider", "kind", "value"], "left_anti")
    # The least of each of many parts first, so that no task has more than a bounded number of one provider's.
    part = F.pmod(F.xxhash64("value"), F.lit(PARTS))
    few = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("provider", part).orderBy("kind", "value"))).filter(F.col("_n") <= most)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy("provider").orderBy("kind", "value"))).filter(F.col("_n") <= most).drop("_n")


def requests(targets: DataFrame) -> DataFrame:
    """(provider, kind, value, request): how each provider is asked, as recordings name it."""
    v, kind = F.col("value"), F.col("kind")
    quoted = F.replace(F.url_encode(v), F.lit("+"), F.lit("%20"))
    plain = F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode(v, "UTF-8")), r"\s", ""), "+/", "-_"), "=+$", "")
    path = F.when(kind == "file", F.concat(F.lit("files/"), v)).when(kind == "domain", F.concat(F.lit("domains/"), v)).when(kind == "ip", F.concat(F.lit("ip_addresses/"), v)).when(kind == "url", F.concat(F.lit("urls/"), plain))
    form = lambda place, field: F.concat(F.lit(f'POST https://urlhaus-api.abuse.ch/v1/{place}/ {{"{field}": '), F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", ""), F.lit("}"))
    asked = {
        "rdap": F.when(kind == "domain", F.concat(F.lit("GET https://rdap.org/domain/"), quoted)), "virustotal": F.concat(F.lit("GET https://www.virustotal.com/api/v3/"), path),
        "urlhaus": F.when(kind == "url", form("url", "url")).when(kind == "domain", form("host", "host")).when(kind == "file", form("payload", "sha256_hash")),
        "malwarebazaar": F.when(kind == "file", F.concat(F.lit('POST https://mb-api.abuse.ch/api/v1/ {"hash": "'), v, F.lit('", "query": "get_info"}'))),
        "abuseipdb": F.when(kind == "ip", F.concat(F.lit("GET https://api.abuseipdb.com/api/v2/check?ipAddress="), F.url_encode(v), F.lit("&maxAgeInDays=90"))),
    }
    each = F.array_compact(F.array(*[F.when(r.isNotNull(), F.struct(F.lit(p).alias("provider"), r.alias("request"))) for p, r in asked.items()]))
    return targets.select("kind", "value").distinct().select("kind", "value", F.explode(each).alias("x")).select("x.provider", "kind", "value", "x.request")


def recorded_answers(targets: DataFrame, recording: DataFrame) -> DataFrame:
    """(provider, kind, value, response, error) of ``targets`` that ``recording(provider, request, response, error)`` has; a join on the request."""
    return requests(targets).join(recording.select("provider", "request", "response", "error"), ["provider", "request"]).select("provider", "kind", "value", "response", "error")


def routed_answers(targets: DataFrame, dns: DataFrame) -> DataFrame:
    """The same of the networks that addresses are routed by, from recorded DNS answers; addresses of version 4."""
    name = F.concat(F.array_join(F.reverse(F.split("value", r"\.")), "."), F.lit(".origin.asn.cymru.com"))
    asked = targets.filter("kind = 'ip'").filter(F.col("value").rlike(r"^\d+\.\d+\.\d+\.\d+$")).select("kind", "value").distinct().withColumn("name", name).withColumn("type", F.lit("TXT"))
    said = recordings.answered(asked, dns).filter("answers is not null and size(answers) > 0")
    asn = F.trim(F.split(F.get("answers", F.lit(0)), r"\|")[0])
    return said.select(F.lit("cymru").alias("provider"), "kind", "value", F.to_json(F.struct(asn.alias("asn"))).alias("response"), F.lit(None).cast("string").alias("error"))


def summaries(answers: DataFrame) -> DataFrame:
    """``answers(provider, kind, value, response STRING, error)`` with what each provider's JSON comes to."""
    v = lambda path: F.get_json_object("response", path)
    event = F.regexp_extract("response", r'"eventAction"\s*:\s*"registration"\s*,\s*"eventDate"\s*:\s*"([^"]+)"', 1)
    swapped = F.regexp_extract("response", r'"eventDate"\s*:\s*"([^"]+)"\s*,\s*"eventAction"\s*:\s*"registration"', 1)
    stats = "$.data.attributes.last_analysis_stats"
    return answers.select(
        "provider", "kind", "value", "error", F.when(F.col("provider") == "rdap", F.to_timestamp(F.substring(F.coalesce(F.nullif(event, F.lit("")), F.nullif(swapped, F.lit(""))), 1, 10))).alias("registered"),
        v(f"{stats}.malicious").try_cast("int").alias("malicious"), v(f"{stats}.suspicious").try_cast("int").alias("suspicious"), ((F.col("provider") == "urlhaus") & (v("$.query_status") == "ok")).alias("listed"),
        ((F.col("provider") == "malwarebazaar") & (v("$.query_status") == "ok")).alias("known"), v("$.data.abuseConfidenceScore").try_cast("int").alias("confidence"), F.when(F.col("provider") == "cymru", v("$.asn")).alias("asn"),
    )


def findings(asked: DataFrame, summary: DataFrame, messages: DataFrame) -> DataFrame:
    """Findings of ``asked(report_id, kind, value)`` targets by their ``summary``; ages are at the message's date."""
    r = asked.distinct().join(summary, ["kind", "value"]).join(messages.select("report_id", F.timestamp_micros("date_us").alias("sent")), "report_id", "left")
    ok, of = F.col("error").isNull(), lambda p: F.col("provider") == p
    age = (F.unix_timestamp(F.coalesce("sent", F.current_timestamp())) - F.unix_timestamp("registered")) / 86_400
    bad = F.coalesce("malicious", F.lit(0))
    many = (F.col("kind") == "file") & (bad >= 5)
    failed = r.filter("error is not null").groupBy("report_id").agg(F.count("*").alias("n"))
    return union([
        findings_of(
            r, hit(ok & of("rdap") & (age < YOUNG_DAYS), "ENRICH_NEW_DOMAIN", F.when(age < NEW_DAYS, "high").otherwise("medium"), None, value=F.col("value")),
            hit(ok & of("virustotal") & (bad + F.coalesce("suspicious", F.lit(0)) > 0), F.when(many, "ENRICH_KNOWN_MALWARE").otherwise("ENRICH_VT_DETECTIONS"), F.when(bad >= 3, "high").otherwise("medium"), None, value=F.col("value")),
            hit(ok & F.coalesce("listed", F.lit(False)), "ENRICH_URLHAUS_LISTED", "high", None, value=F.col("value")), hit(ok & F.coalesce("known", F.lit(False)), "ENRICH_KNOWN_MALWARE", "high", None, value=F.col("value")),
            hit(ok & of("abuseipdb") & (F.col("confidence") >= 25), "ENRICH_ABUSIVE_IP", F.when(F.col("confidence") >= 75, "high").otherwise("medium"), None, value=F.col("value")), hit(ok & F.col("asn").isNotNull(), "ENRICH_IP_ASN", "info", None, asn=F.col("asn")),
        ),
        findings_of(failed, hit(F.lit(True), "ENRICH_ERRORS", "info", None, count=F.col("n"))),
    ])
