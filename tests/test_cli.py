"""Commands, reports and signatures."""

import json

import pytest

from siftwright import cli
from siftwright.operators import signatures as sg
from siftwright.plans import case
from tests.test_engine import BEC, CLEAN

RULES = """
// one
rule one : tag { meta: severity = "high" strings: $a = "evil" nocase fullword $b = { 4D 5A ?? 0? [1-2] (AA | BB) } $c = /https?:\\/\\/[a-z]+/ condition: ($a and $c) or $b }
rule two { strings: $x1 = "p" wide $x2 = "q" condition: 2 of ($x*) and not filesize > 1KB }
rule three { condition: filesize < 3 }
"""


def test_signatures(spark):
    by = lambda d: [s.name for s in sg.compile_signatures(RULES) if s.matches(d)]
    assert by(b"an EVIL http://x") == ["one"] and by(b"evilish http://x") == [] and by(b"MZ\x11\x07zz\xbb") == ["one"] and by(b"p\0 q") == ["two"] and by(b"p\0 q" + bytes(2000)) == [] and by(b"") == ["three"]
    for bad in ("", "rule a { condition: }", "rule a { condition: $x }", "rule a { strings: $a = /(/ condition: $a }", "rule a { condition: true true }", "rule a { condition: true } rule a { condition: true }", 'rule a { strings: $a = { ZZ } condition: $a }'):
        with pytest.raises(sg.SignatureError):
            sg.compile_signatures(bad)
    t = spark.createDataFrame([("r", "1", bytearray(b"evil http://x")), ("r", "2", None), ("r", "3", bytearray(b"none"))], "report_id string, part string, data binary")
    assert [(r.code, r.severity, r.location) for r in sg.findings(sg.scan(t, RULES)).collect()] == [("YARA_MATCH", "high", "1")]


def test_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.eml").write_bytes(BEC.replace(b"Subject: pay now", b"Subject: <script>x</script>"))
    (tmp_path / "in/b.eml").write_bytes(CLEAN)
    out = str(tmp_path / "out")
    assert cli.main(["analyze", str(tmp_path / "in"), "--output", out, "--format", "html", "--ioc-format", "stix", "--fail-on", "malicious"]) == 1
    pages = [r.report for r in spark.read.json(f"{out}/reports").collect()]
    assert len(pages) == 3 and all(p.startswith("<!doctype html>") and "<script>" not in p and "http://" not in p for p in pages)
    assert all(json.loads(r.bundle)["type"] == "bundle" for r in spark.read.json(f"{out}/iocs").collect())
    for form, ioc in (("text", "csv"), ("json", "misp"), ("summary", None)):
        assert cli.main(["analyze", str(tmp_path / "in"), "--output", out, "--format", form, *(["--ioc-format", ioc] if ioc else [])]) == 0
        assert spark.read.json(f"{out}/reports").count() == 3
    assert cli.main(["search", f"{out}/indicators", "other.test"]) == 0
    assert cli.main(["watch", str(tmp_path / "in"), "--output", str(tmp_path / "w"), "--once"]) == 0
    assert spark.read.json(str(tmp_path / "w/reports")).filter("event is not null").count() == 3
    log = case.append_entries([{"time": "t", "action": "a", "examiner": "e"}])
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in log))
    assert cli.main(["verify", str(tmp_path / "log.jsonl")]) == 0
    (tmp_path / "log.jsonl").write_text(json.dumps(log[0] | {"action": "b"}))
    assert cli.main(["verify", str(tmp_path / "log.jsonl")]) == 1
