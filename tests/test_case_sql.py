"""Cases, SQL functions, recordings and extraction."""

import io
import zipfile

from pyspark.sql import functions as F

from siftwright.functions import sql
from siftwright.operators import mailauth
from siftwright.plans import casefile, sinks
from siftwright.sources import parse, recordings
from tests.test_engine import BEC, CLEAN


def test_case(spark, tmp_path):
    c = casefile.Case(spark, f"file://{tmp_path}/case", "e")
    files = lambda *xs: spark.createDataFrame([(f"f{i}.eml", bytearray(x)) for i, x in enumerate(xs)], "path string, content binary")
    assert c.add(files(BEC, CLEAN, CLEAN)) == 2 and c.add(files(CLEAN)) == 0 and c.analyze() == 3 and c.analyze() == 0
    assert c.add(files(CLEAN.replace(b"lunch", b"supper"))) == 1 and c.analyze() == 1
    assert {r.verdict for r in c.tally().collect()} >= {"malicious", "clean"} and c.worst().first().verdict == "malicious" and casefile.as_bad_as(c.index, "malicious").count() == 1
    assert c.search("other.test", "domain").count() == 1 and c.search("HELLO").filter("type = 'subject'").count() == 2 and c.shared().filter("value = 'a@x.test'").first().reports == 2
    assert c.verify().count() == 0 and [r.action for r in c.log.orderBy("seq").collect()] == ["add", "analyze", "add", "analyze"]
    spark.createDataFrame([("x" * 64, "evil", bytearray(b"z"), "eml", "t")], "sha256 string, path string, content binary, msg_format string, added string").write.mode("append").parquet(f"file://{tmp_path}/case/evidence")
    assert {r.kind for r in c.verify().collect()} == {"evidence"} and c.verify().count() == 2


def test_sql(spark):
    sql.register(spark)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "x")
    spark.createDataFrame([(bytearray(BEC), bytearray(b.getvalue()), bytearray(b"From a@b Mon Jan 9 10:00:00 2023\nSubject: x\n\nbody\n"))], "m binary, z binary, b binary").createOrReplaceTempView("t")
    assert spark.sql("select org_domain('a.b.co.uk'), skeleton('paypa1'), osa_distance('ab', 'ba'), detect_type(z), split_url('http://x:81/').port, ip_is_private('10.0.0.1'), decode_idna('xn--mnchen-3ya.de') from t").first()[:] == ("b.co.uk", "paypal", 1, "zip", 81, True, "münchen.de")
    assert [r.filename for r in spark.sql("select p.* from t, lateral mime_parts(m) p").collect()] == [None, None, "invoice.pdf.exe"]
    assert [tuple(r)[:2] for r in spark.sql("select a.name, a.size from t, lateral archive_members(z) a").collect()] == [("a.txt", 1)]
    assert [bytes(r.content) for r in spark.sql("select x.content from t, lateral mbox_messages(b) x").collect()] == [b"Subject: x\n\nbody\n"]


def test_recordings_and_extraction(spark, tmp_path):
    rec = spark.createDataFrame([("A.Test.", "txt", ["v=spf1 -all"], None, "1"), ("a.test", "TXT", ["v=spf1 +all"], None, "2")], "name string, type string, answers array<string>, error string, at string")
    recordings.save_dns(rec, f"{tmp_path}/dns")
    assert [(r.name, r.type, r.answers) for r in recordings.dns(spark, f"{tmp_path}/dns").collect()] == [("a.test", "TXT", ["v=spf1 +all"])]
    (tmp_path / "http.json").write_text('{"requests": [{"provider": "p", "request": "GET u", "at": "1", "response": "{}"}]}')
    assert recordings.http(spark, str(tmp_path / "http.json")).first().request == "GET u"
    ev = parse.Evidence(parse.parsed(spark.createDataFrame([("a", bytearray(BEC)), ("b", bytearray(BEC))], "path string, content binary")).cache())
    out = sinks.extract_attachments(ev.attachments, f"{tmp_path}/files")
    assert out.count() == 4 and len(list((tmp_path / "files").iterdir())) == 2  # the file and the attached message, of two equal messages
    inputs = {r.report_id[:2]: r for r in mailauth.spf_inputs(ev.messages, ev.headers, ev.hops, ev.auth_results).filter(F.col("ip").isNotNull()).collect()}
    assert {(r.ip, r.ip_source, r.mail_from) for r in inputs.values()} == {("8.8.4.4", "Received", "postmaster@mailer.invalid")}
