"""The engine over a folder, Outlook files, display names and reputation."""

import struct

from pyspark.sql import functions as F

from siftwright.engine import Engine, Options
from siftwright.plans import enrich, names, rules, score
from siftwright.sources import outlook
from tests.test_engine import BEC, CLEAN
from tests.test_payloads import compound


def msg_file(subject="Größe", headers=None):
    text = lambda s: s.encode("utf-16-le")
    fixed = lambda *rows: b"".join(struct.pack("<II8s", t, 6, v) for t, v in rows)
    s = {
        ("__properties_version1.0",): bytes(32) + fixed((0x00390040, struct.pack("<Q", 133_177_564_860_000_000))), ("__substg1.0_0037001F",): text(subject), ("__substg1.0_0C1A001F",): text("Ä Person"), ("__substg1.0_5D01001F",): text("a@x.test"), ("__substg1.0_1000001F",): text("plain body http://u.test/"),
        ("__recip_version1.0_#00000000", "__properties_version1.0"): bytes(8) + fixed((0x0C150003, struct.pack("<i4x", 1))), ("__recip_version1.0_#00000000", "__substg1.0_39FE001F"): text("b@y.test"),
        ("__attach_version1.0_#00000000", "__properties_version1.0"): bytes(8) + fixed((0x37050003, struct.pack("<i4x", 1))), ("__attach_version1.0_#00000000", "__substg1.0_37010102"): b"MZ" + bytes(100), ("__attach_version1.0_#00000000", "__substg1.0_3707001F"): text("x.pdf.exe"),
    }
    if headers:
        s[("__substg1.0_007D001F",)] = text(headers)
    return compound(s)


def test_outlook():
    from email import message_from_bytes

    m = message_from_bytes(outlook.to_internet(msg_file()))
    assert m["To"] == "b@y.test" and m["Date"].startswith("Mon, 09 Jan 2023") and "a@x.test" in m["From"] and m["Subject"].startswith("=?utf-8?")
    assert [p.get_filename() for p in m.walk() if p.get_filename()] == ["x.pdf.exe"]
    kept = message_from_bytes(outlook.to_internet(msg_file(headers="Received: by h;\r\n Mon\r\nFrom: q@z.test\r\nContent-Type: text/x\r\n")))
    assert kept["From"] == "q@z.test" and "Mon" in kept["Received"] and kept.get_content_type() == "multipart/mixed"


def test_folder(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(BEC)
    (tmp_path / "b.eml").write_bytes(CLEAN)
    (tmp_path / "c.msg").write_bytes(msg_file())
    (tmp_path / "d.msg").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1broken")
    (tmp_path / "e.mbox").write_bytes(b"From x@y Mon Jan  9 10:00:00 2023\n" + CLEAN.replace(b"\r\n", b"\n") + b"\nFrom x@y Mon Jan  9 10:00:00 2023\n" + CLEAN.replace(b"hello", b"PayPal invoice").replace(b"\r\n", b"\n").replace(b"From: A <", b"From: PayPal Service <"))
    made = rules.parse_rules([{"id": "inv", "severity": "high", "all": [{"field": "subject", "contains": "invoice"}]}, {"id": "off", "action": "suppress", "suppress": ["HDR_MAILER_SCRIPT"], "all": [{"field": "score", "gte": 50}]}])
    e = Engine.of_folder(spark, str(tmp_path), Options(protected=("corp.test",), rules=tuple(made), timeout=20, min_severity="low"))
    got = {r.path.rsplit("/", 1)[1]: (r.verdict, r.score) for r in e.assessments.join(e.tables.messages, "report_id").collect()}
    assert set(got) == {"a.eml", "a.eml!2", "b.eml", "c.msg", "d.msg", "e.mbox#0", "e.mbox#1"} and got["a.eml"][0] == "malicious" and got["b.eml"] == ("clean", 0)
    codes = {(r.path.rsplit("/", 1)[1], r.code) for r in e.findings.join(e.tables.messages, "report_id").collect()}
    assert {("c.msg", "MSG_SOURCE"), ("c.msg", "ATT_DOUBLE_EXTENSION"), ("e.mbox#1", "RULE_INV"), ("e.mbox#1", "HDR_DISPLAY_NAME_BRAND"), ("a.eml", "NESTED_MESSAGE_SUSPICIOUS")} <= codes and ("a.eml", "HDR_MAILER_SCRIPT") not in codes
    assert {c for p, c in codes if p == "d.msg"} == {"ANALYZER_ERROR", "MSG_SOURCE"}  # it can't be read, and isn't left out
    assert e.shown.filter("severity = 'info'").count() == 0 and e.fails("malicious") and e.events("2025-01-01").count() == 7
    assert e.indicators.filter("type = 'domain' and value = 'u.test'").count() == 1 and e.reasons.groupBy("report_id").count().filter("count > 10").count() == 0
    s = {r.report_id: r for r in score.summary(e.assessments, e.findings).collect()}
    assert len(s) == 7 and all(r.high >= len(r.top_codes) for r in s.values())


def test_display_names(spark):
    rows = [("1", "PayPal Service", "x@evil.test"), ("2", "PayPal", "x@paypal.de"), ("3", "Google", "me@gmail.com"), ("4", "the ups and downs", "x@y.test"), ("5", "UPS", "x@y.test"), ("6", "Acme Pay", "x@y.test"), ("7", None, "x@y.test"), ("8", "Acme", "x@acme.test"), ("9", "PayPal", None)]
    m = spark.createDataFrame(rows, "report_id string, from_display_name string, from_address string")
    got = {(r.report_id, r.code, r.severity) for r in names.impersonation(m, spark.createDataFrame([("acme.test",)], "domain string")).collect()}
    assert got == {("1", "HDR_DISPLAY_NAME_BRAND", "medium"), ("3", "HDR_DISPLAY_NAME_BRAND", "high"), ("5", "HDR_DISPLAY_NAME_BRAND", "medium"), ("6", "HDR_DISPLAY_NAME_ORG", "medium")}


def test_reputation(spark):
    targets = spark.createDataFrame([("ip", "8.8.8.8"), ("domain", "new.test"), ("url", "http://u.test/"), ("file", "ab"), ("domain", "old.test"), ("domain", "new.test")], "kind string, value string")
    cache = spark.createDataFrame([("rdap", "domain", "old.test", 1000), ("cymru", "ip", "8.8.8.8", 0)], "provider string, kind string, value string, stored_s long")
    asked = {tuple(r) for r in enrich.wanted(targets, cache, 86_500).select("provider", "kind", "value").collect()}
    assert ("rdap", "domain", "new.test") in asked and ("rdap", "domain", "old.test") not in asked and ("cymru", "ip", "8.8.8.8") in asked and ("urlhaus", "file", "ab") in asked and len(asked) == 1 + 1 + 5 + 4 + 1 + 1
    assert enrich.wanted(targets, None, 0, most=1).groupBy("provider").count().filter("count > 1").count() == 0
    answers = spark.createDataFrame([("rdap", "domain", "new.test", '{"events":[{"eventAction":"registration","eventDate":"2023-01-01T00:00:00Z"}]}', None), ("virustotal", "file", "ab", '{"data":{"attributes":{"last_analysis_stats":{"malicious":9,"suspicious":0}}}}', None), ("urlhaus", "url", "http://u.test/", '{"query_status":"ok"}', None), ("abuseipdb", "ip", "8.8.8.8", '{"data":{"abuseConfidenceScore":80}}', None), ("cymru", "ip", "8.8.8.8", None, "timeout")], "provider string, kind string, value string, response string, error string")
    m = spark.createDataFrame([("r", 1673265600000000)], "report_id string, date_us long")
    got = {(r.code, r.severity) for r in enrich.findings(targets.withColumn("report_id", F.lit("r")), enrich.summaries(answers), m).collect()}
    assert got == {("ENRICH_NEW_DOMAIN", "high"), ("ENRICH_KNOWN_MALWARE", "high"), ("ENRICH_URLHAUS_LISTED", "high"), ("ENRICH_ABUSIVE_IP", "high"), ("ENRICH_ERRORS", "info")}
