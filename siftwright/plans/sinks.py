"""Output forms: CSV, STIX 2.1, MISP, JSON lines and CEF, as tables of texts to write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions.ids import stix_id
from siftwright.functions.text import cef_escape, csv_safe, stix_escape
from siftwright.session import stage

TOOL, VERSION = "siftwright", "0.1.0"
# Pattern paths by type; MISP types by type and role, else by type.
STIX_PATHS = {"url": "url:value", "domain": "domain-name:value", "ipv4": "ipv4-addr:value", "ipv6": "ipv6-addr:value", "email-addr": "email-addr:value", "sha256": "file:hashes.'SHA-256'", "sha1": "file:hashes.'SHA-1'", "md5": "file:hashes.MD5", "filename": "file:name", "subject": "email-message:subject"}
MISP_TYPES = {
    "email-addr/from": "email-src", "email-addr/return-path": "email-src", "email-addr/sender": "email-src", "email-addr/reply-to": "email-reply-to", "subject/subject": "email-subject", "message-id/message-id": "email-message-id",
    "filename": "email-attachment", "url": "url", "domain": "domain", "ipv4": "ip-src", "ipv6": "ip-src", "sha256": "sha256", "sha1": "sha1", "md5": "md5",
}
NETWORK = ("url", "domain", "ip-src", "ip-dst")


def csv_rows(indicators: DataFrame) -> DataFrame:
    """Indicators in which no value is a formula to a spreadsheet."""
    return indicators.select(*[csv_safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in indicators.schema.fields])


def _map(values: dict):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def stix_objects(indicators: DataFrame, at: str) -> DataFrame:
    """(report_id, id, object): a STIX indicator object for each of ``indicators(report_id, type, value, role, context, evidence_sha256, verdict)``."""
    path = F.try_element_at(_map(STIX_PATHS), F.col("type"))
    ident = stix_id("indicator", F.col("type"), F.col("value"), F.col("role"), F.col("evidence_sha256"))
    bad = F.col("verdict").isin("malicious", "suspicious")
    text = F.concat(F.col("type"), F.lit(" seen as "), F.col("role"), F.lit(" in a message assessed as "), F.col("verdict"), F.when(F.col("context") != "", F.concat(F.lit(" ("), F.col("context"), F.lit(")"))).otherwise(""))
    obj = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.col("id"), F.lit(at).alias("created"), F.lit(at).alias("modified"), stix_id("identity", F.lit(TOOL)).alias("created_by_ref"),
        F.substring(F.concat("role", F.lit(": "), "value"), 1, 250).alias("name"), text.alias("description"), F.array(F.when(bad, "malicious-activity").otherwise("anomalous-activity")).alias("indicator_types"),
        F.concat(F.lit("["), path, F.lit(" = '"), stix_escape(F.col("value")), F.lit("']")).alias("pattern"), F.lit("stix").alias("pattern_type"), F.lit(at).alias("valid_from"), F.array("verdict", "role").alias("labels"),
        F.array(F.struct(F.lit("evidence-sha256").alias("source_name"), F.col("evidence_sha256").alias("external_id"))).alias("external_references"),
    )
    return indicators.filter(path.isNotNull()).withColumn("id", ident).select("report_id", "id", F.to_json(obj).alias("object"))


def stix_bundles(objects: DataFrame, at: str) -> DataFrame:
    """(report_id, bundle): a bundle for each report, with its identity and report objects."""
    who = F.to_json(F.struct(F.lit("identity").alias("type"), F.lit("2.1").alias("spec_version"), stix_id("identity", F.lit(TOOL)).alias("id"), F.lit(at).alias("created"), F.lit(at).alias("modified"), F.lit(f"{TOOL} {VERSION}").alias("name"), F.lit("system").alias("identity_class")))
    per = objects.groupBy("report_id").agg(F.sort_array(F.collect_list("object")).alias("objects"))
    return per.select("report_id", F.concat(F.lit('{"type":"bundle","id":"'), stix_id("bundle", F.col("report_id")), F.lit('","objects":['), F.array_join(F.concat(F.array(who), F.col("objects")), ","), F.lit("]}")).alias("bundle"))


def misp_attributes(indicators: DataFrame) -> DataFrame:
    """(report_id, type, category, value, to_ids, comment, distribution): exact type and role first, then the type alone."""
    table = _map(MISP_TYPES)
    kind = F.coalesce(F.try_element_at(table, F.concat_ws("/", "type", "role")), F.try_element_at(table, F.col("type")))
    kind = F.when(F.col("type").isin("ipv4", "ipv6") & F.col("role").endswith("-host"), "ip-dst").otherwise(kind)
    ids = F.col("verdict").isin("malicious", "suspicious") & ~F.col("type").isin("subject", "message-id", "filename")
    comment = F.concat("role", F.lit("; message "), "verdict", F.when(F.col("context") != "", F.concat(F.lit("; "), F.col("context"))).otherwise(""))
    out = indicators.withColumn("_k", kind).filter("_k is not null")
    return out.select("report_id", F.col("_k").alias("type"), F.when(F.col("_k").isin(*NETWORK), "Network activity").otherwise("Payload delivery").alias("category"), "value", ids.alias("to_ids"), comment.alias("comment"), F.lit("5").alias("distribution"))


def misp_threat_level(assessments: DataFrame) -> DataFrame:
    worst = F.coalesce(F.max("score"), F.lit(0))
    return assessments.agg(F.when(worst >= 70, "1").when(worst >= 35, "2").otherwise("3").alias("threat_level_id"))


def events(messages: DataFrame, assessments: DataFrame, findings: DataFrame, reasons: DataFrame, analyzed_at: str) -> DataFrame:
    """(report_id, event): one JSON line for each message, attached ones with their carrier's key."""
    codes = findings.groupBy("report_id").agg(F.array_sort(F.collect_set("code")).alias("findings"))
    top = reasons.filter("rank <= 5").groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "points"))), lambda r: F.struct(r["code"].alias("code"), r["points"].alias("points"))).alias("reasons"))
    e = messages.join(assessments.select("report_id", "score", "verdict"), "report_id", "left").join(codes, "report_id", "left").join(top, "report_id", "left")
    body = F.struct(
        F.lit("siftwright.analysis").alias("event_type"), F.lit(f"{TOOL}/{VERSION}").alias("tool"), F.lit(analyzed_at).alias("analyzed_at"),
        F.struct("path", "sha256", F.col("msg_format").alias("format"), "container_sha256", F.col("parent_report_id").alias("parent")).alias("evidence"), "verdict", "score", "reasons",
        F.struct("subject", F.col("from_address").alias("from"), "from_display_name", "reply_to", "return_path", F.col("to_addrs").alias("to"), F.col("cc_addrs").alias("cc"), "message_id").alias("email"), F.coalesce("findings", F.array().cast("array<string>")).alias("findings"),
    )
    return e.select("report_id", F.to_json(body).alias("event"))


def cef(messages: DataFrame, assessments: DataFrame, findings: DataFrame, rt_ms: int) -> DataFrame:
    """(report_id, line): one CEF line for each message."""
    codes = findings.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    e = messages.join(assessments.select("report_id", "score", "verdict"), "report_id", "left").join(codes, "report_id", "left")
    verdict, score = F.coalesce("verdict", F.lit("unknown")), F.coalesce("score", F.lit(0))
    name = F.substring(F.concat(F.upper(verdict), F.lit(" email: "), F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)"))), 1, 200)
    fields = [("rt", F.lit(str(rt_ms))), ("fname", F.col("path")), ("fileHash", F.col("sha256")), ("suser", F.col("from_address")), ("duser", F.substring(F.array_join("to_addrs", ","), 1, 1000)), ("msg", F.col("subject")), ("cs1Label", F.lit("verdict")), ("cs1", F.col("verdict"))]
    fields += [("cs2Label", F.lit("findings")), ("cs2", F.substring(F.coalesce("codes", F.lit("")), 1, 2000)), ("cs3Label", F.lit("reply_to")), ("cs3", F.array_join("reply_to", ",")), ("cn1Label", F.lit("score")), ("cn1", score.cast("string"))]
    ext = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), cef_escape(v)) for k, v in fields])
    head = F.concat_ws("|", F.lit("CEF:0"), F.lit(TOOL), F.lit(TOOL), F.lit(VERSION), cef_escape(verdict, True), cef_escape(name, True), F.least(F.lit(10), F.bround(score / 10).cast("int")).cast("string"), ext)
    return e.select("report_id", head.alias("line"))


def extract_attachments(attachments: DataFrame, folder: str) -> DataFrame:
    """Write each distinct payload as ``<sha256>.bin`` to a folder that all executors share; the manifest of what was written, which also is beside it.

    ``folder`` is a path or the address of a file system that pyarrow knows (file, hdfs, s3, gs). Files are
    moved into place whole, so a task that runs twice does no harm.
    """
    once = attachments.filter("payload is not null").select("sha256", "payload").dropDuplicates(["sha256"])
    uri = folder if "://" in folder else "file://" + folder

    def write(batches):
        import uuid

        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(uri)
        place.create_dir(root, recursive=True)
        for b in batches:
            for sha, payload in zip(b.column("sha256").to_pylist(), b.column("payload").to_pylist(), strict=True):
                target = f"{root}/{sha}.bin"
                if place.get_file_info(target).type == fs.FileType.NotFound:
                    part = f"{root}/.part-{uuid.uuid4().hex}"
                    with place.open_output_stream(part) as f:
                        f.write(payload)
                    place.move(part, target)
            yield b.select(["sha256"])

    written = once.mapInArrow(write, "sha256 string")
    manifest = attachments.join(stage(written, "extracted"), "sha256", "left_semi").select("report_id", "part", "filename", "sha256", "size", "detected_type", F.concat("sha256", F.lit(".bin")).alias("file"))
    manifest.write.mode("overwrite").json(f"{uri}-manifest")
    return manifest
