"""The engine with recorded answers: signatures of senders, policies, reputation, content signatures, and findings of structure."""

import base64
import hashlib

import pytest

from siftwright.engine import Engine, Options
from siftwright.operators import mailauth
from siftwright.plans import enrich
from siftwright.sources import mbox, parse

DNS = "name string, type string, answers array<string>, error string"
# A small key is enough: n and e of a key of two known primes, made for this test.
_P, _Q = 2**521 - 1, 2**607 - 1
N, E = _P * _Q, 65537
_D = pow(E, -1, (_P - 1) * (_Q - 1))


def _der(tag: int, body: bytes) -> bytes:
    size = len(body)
    return bytes([tag]) + (bytes([size]) if size < 128 else bytes([0x82]) + size.to_bytes(2)) + body


def _integer(x: int) -> bytes:
    return _der(2, x.to_bytes(x.bit_length() // 8 + 1))


KEY = "v=DKIM1; p=" + base64.b64encode(_der(0x30, _integer(N) + _integer(E))).decode()


def signed(text: bytes, domain: str, selector: str = "s1") -> bytes:
    """A message with a DKIM signature over its From and Subject."""
    head, _, body = text.partition(b"\r\n\r\n")
    bh = base64.b64encode(hashlib.sha256(mailauth.canonical_body(body, "relaxed")).digest()).decode()
    bare = f"DKIM-Signature: v=1; a=rsa-sha256; c=relaxed/relaxed; d={domain}; s={selector}; h=from:subject; bh={bh}; b="
    fields, _ = mailauth.fields_and_body(text)
    data = b"".join(mailauth.canonical_field(f, "relaxed") for f in mailauth.chosen_fields(fields, ["from", "subject"])) + mailauth.canonical_field(bare.encode() + b"\r\n", "relaxed").rstrip(b"\r\n")
    size = (N.bit_length() + 7) // 8
    info = bytes.fromhex("3031300d060960864801650304020105000420") + hashlib.sha256(data).digest()
    padded = b"\x00\x01" + b"\xff" * (size - len(info) - 3) + b"\x00" + info
    b = base64.b64encode(pow(int.from_bytes(padded), _D, N).to_bytes(size)).decode()
    return bare.encode() + b.encode() + b"\r\n" + text


GOOD = b"Received: from mail.shop.test (mail.shop.test [203.1.1.9]) by mx.desk.test; Mon, 09 Jan 2023 08:00:00 +0000\r\nReturn-Path: <a@shop.test>\r\nFrom: Shop <a@shop.test>\r\nTo: b@desk.test\r\nSubject: hello\r\nDate: Mon, 09 Jan 2023 08:00:00 +0000\r\nMessage-ID: <1@shop.test>\r\n\r\nSee http://young.test/x\r\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("in")
    good = signed(GOOD, "shop.test")
    (place / "good.eml").write_bytes(good)
    (place / "changed.eml").write_bytes(good.replace(b"Subject: hello", b"Subject: hullo"))
    (place / "body.eml").write_bytes(good.replace(b"See http", b"See also http"))
    (place / "plain.eml").write_bytes(GOOD.replace(b"203.1.1.9", b"198.41.0.4"))
    (place / "carrier.eml").write_bytes(
        b"From: c@other.test\r\nSubject: =?utf-8?B?!!!?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: message/rfc822\r\n\r\n" + good.replace(b"hello", b"xx") + b"\r\n--q\r\nContent-Type: image/png\r\nContent-Transfer-Encoding: odd\r\n\r\nx\r\n"
        b"--q\r\nContent-Type: text/html; name=p.html\r\nContent-Disposition: attachment; filename=p.html\r\n\r\n<input type=password><a href=http://in.page.test/>x</a>\r\n--q--\r\n"
    )
    dns = [
        ("s1._domainkey.Shop.test", "TXT", [KEY], None), ("_dmarc.shop.test", "txt", ["v=DMARC1; p=reject"], None), ("shop.test", "TXT", ["v=spf1 ip4:203.1.1.0/24 -all"], None),
        ("9.1.1.203.origin.asn.cymru.com", "TXT", ["64500 | 203.1.1.0/24 | ZZ"], None),
    ]
    targets = spark.createDataFrame([("domain", "young.test")], "kind string, value string")
    key = enrich.requests(targets).filter("provider = 'rdap'").first().request
    answers = spark.createDataFrame([("rdap", key, '{"events":[{"eventAction":"registration","eventDate":"2023-01-01T00:00:00Z"}]}', None)], "provider string, request string, response string, error string")
    return Engine.of_folder(spark, str(place), Options(dns=spark.createDataFrame(dns, DNS), answers=answers, signatures='rule seen { meta: severity = "high" strings: $a = "young.test" condition: $a }', now=1.7e9))


def test_codes_of_each(engine):
    rows = engine.findings.join(engine.tables.messages.select("report_id", "path"), "report_id").select("path", "code", "severity").collect()
    codes: dict = {}
    for r in rows:
        codes.setdefault(r.path.rsplit("/", 1)[1], {})[r.code] = r.severity
    assert {"AUTHV_DKIM_PASS", "AUTHV_SPF_PASS", "AUTHV_DMARC_PASS", "ENRICH_NEW_DOMAIN", "ENRICH_IP_ASN", "YARA_MATCH", "AUTHV_DKIM_WEAK_KEY"} <= set(codes["good.eml"]) and not any(c.endswith("FAIL") for c in codes["good.eml"])
    assert codes["changed.eml"]["AUTHV_DKIM_FAIL"] == "high" and "AUTHV_DMARC_PASS" in codes["changed.eml"]
    assert codes["body.eml"]["AUTHV_DKIM_BODY_MODIFIED"] == "high"
    assert {"AUTHV_NO_DKIM", "AUTHV_SPF_FAIL", "AUTHV_DMARC_FAIL"} <= set(codes["plain.eml"]) and codes["plain.eml"]["AUTHV_DMARC_FAIL"] == "high"
    carrier = codes["carrier.eml"]
    assert {"HDR_ENCODED_WORD_ERROR", "MIME_UNKNOWN_TRANSFER_ENCODING", "BODY_IMAGE_ONLY", "HTML_CREDENTIAL_FORM"} <= set(carrier)
    assert "AUTHV_DKIM_UNVERIFIABLE" in codes["carrier.eml!1"] and "AUTHV_DKIM_FAIL" not in codes["carrier.eml!1"]
    assert engine.urls.filter("host = 'in.page.test'").count() == 1
    scores = {r.path.rsplit("/", 1)[1]: r.score for r in engine.assessments.join(engine.tables.messages.select("report_id", "path"), "report_id").collect()}
    assert scores["plain.eml"] > 0 and engine.findings.filter("code = 'AUTHV_OFFLINE'").count() == 0


def test_without_answers(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(signed(GOOD, "shop.test"))
    e = Engine.of_folder(spark, str(tmp_path), Options(now=1.7e9))
    codes = {r.code for r in e.findings.collect()}
    assert "AUTHV_OFFLINE" in codes and not codes & {"AUTHV_DKIM_PASS", "AUTHV_DKIM_FAIL", "AUTHV_DNS_ERRORS", "AUTHV_SPF_NO_IP"}


def test_requests_are_named_as_recorded(spark):
    t = spark.createDataFrame([("url", "http://u.test/a?b=1"), ("ip", "8.8.8.8"), ("file", "ab" * 32), ("domain", "x.test"), ("domain", None)], "kind string, value string")
    got = {(r.provider, r.kind): r.request for r in enrich.requests(t).collect()}
    assert got["virustotal", "url"] == "GET https://www.virustotal.com/api/v3/urls/" + base64.urlsafe_b64encode(b"http://u.test/a?b=1").decode().rstrip("=")
    assert got["urlhaus", "url"] == 'POST https://urlhaus-api.abuse.ch/v1/url/ {"url": "http://u.test/a?b=1"}' and got["abuseipdb", "ip"] == "GET https://api.abuseipdb.com/api/v2/check?ipAddress=8.8.8.8&maxAgeInDays=90"
    assert got["malwarebazaar", "file"].endswith('"query": "get_info"}') and got["rdap", "domain"] == "GET https://rdap.org/domain/x.test"


def test_split_mailboxes(spark, tmp_path):
    """Read in small splits, a mailbox gives the same messages."""
    text = b"".join(b"From a@b Mon Jan  9 10:00:00 2023\nSubject: m%d\n\n%s\nFrom here on\n>From there\n\n" % (i, b"word " * (i % 50)) for i in range(300))
    (tmp_path / "b o+x.mbox").write_bytes(text)
    whole = sorted(mbox.split_mailbox(text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = mbox.messages(spark, [str(tmp_path / "b o+x.mbox")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 300 == len(whole) and len({r.path for r in rows}) == 300 and {r.container_sha256 for r in rows} == {hashlib.sha256(text).hexdigest()}
    assert sorted(bytes(r.content) for r in rows) == whole
    assert {r.subject for r in parse.parsed(spark.createDataFrame([(r.path, r.content) for r in rows[:3]], "path string, content binary")).collect()} <= {f"m{i}" for i in range(300)}
