"""Commands that keep a case, watched folders of mixed files, extracted attachments, and digests of intakes."""

import json

import pytest

from siftwright import cli, session
from siftwright.plans import casefile, sinks
from siftwright.sources import parse
from siftwright.streaming import watch
from tests.test_engine import BEC, CLEAN
from tests.test_engine_whole import msg_file


def test_case_from_beginning_to_end(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.eml").write_bytes(BEC)
    (tmp_path / "in/b.eml").write_bytes(CLEAN)
    (tmp_path / "in/again.eml").write_bytes(CLEAN)
    (tmp_path / "suffixes").write_text("example\nco.example\n")
    c = f"file://{tmp_path}/case"
    run = lambda *a: cli.main(["case", *a, "--examiner", "e"])
    assert run("init", c) == run("init", c) == 0
    assert run("add", c, str(tmp_path / "in")) == 0 and run("add", c, str(tmp_path / "in")) == 0
    assert [x for x in capsys.readouterr().out.split() if x.isdecimal()] == ["2", "0"]
    assert run("analyze", c, "--protected", "corp.test") == 0 and run("search", c, "other.test") == 0
    out = capsys.readouterr().out
    assert "other.test" in out
    assert run("report", c, "--output", f"{tmp_path}/report") == 0 and run("verify", c) == 0 and run("log", c) == 0
    log = [json.loads(x)["action"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert log == ["init", "add", "analyze", "report"]
    page = "".join(r.value for r in spark.read.text(f"{tmp_path}/report/page", wholetext=False).collect())
    assert "<h2>Custody</h2>" in page and "http://" not in page and spark.read.option("header", True).csv(f"{tmp_path}/report/iocs").count() > 3
    case = casefile.Case(spark, c, "e")
    case._log("add", {"files": 1})
    assert run("verify", c) == 1


def test_watched_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.msg").write_bytes(msg_file())
    (tmp_path / "in/b.mbox").write_bytes(b"From x@y Mon Jan  9 10:00:00 2023\nSubject: one\n\nx\n\nFrom x@y Mon Jan  9 10:00:00 2023\nSubject: two\n\nx\n")
    (tmp_path / "in/c.eml").write_bytes(CLEAN)
    (tmp_path / "in/d.msg").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1broken")
    analyse = lambda batch: parse.parsed(watch.evidence_of(batch)).select("path", "subject", "error")
    watch.run(watch.watched(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint"), watch.to_folder(analyse, str(tmp_path / "out"))).awaitTermination()
    rows = spark.read.schema("path string, subject string, error string").json(str(tmp_path / "out/*")).collect()
    assert {r.path.rsplit("/", 1)[1]: bool(r.error) for r in rows} == {"a.msg": False, "b.mbox#0": False, "b.mbox#1": False, "c.eml": False, "d.msg": True}


def test_a_batch_that_fails_is_told(spark, tmp_path):
    def analyse(batch):
        raise ValueError("no")

    watch.to_folder(analyse, f"{tmp_path}/out")(spark.createDataFrame([("x", b"1")], "path string, content binary"), 3)
    assert [r.error for r in spark.read.json(f"{tmp_path}/out-errors/batch=3").collect()] == ["ValueError: no"]


def test_extracted_once_with_a_manifest(spark, tmp_path):
    rows = [("r", "1", "a", "aa", 1, "exe", b"x"), ("r", "2", "b", "aa", 1, "exe", b"x"), ("r", "3", None, "bb", 0, None, None)]
    a = spark.createDataFrame(rows, "report_id string, part string, filename string, sha256 string, size long, detected_type string, payload binary")
    for _ in range(2):
        assert sinks.extract_attachments(a, f"{tmp_path}/files").count() == 2
    assert (tmp_path / "files/aa.bin").read_bytes() == b"x" and spark.read.json(f"{tmp_path}/files-manifest").count() == 2


def test_digest_of_a_set(spark):
    shas = [f"{i:064x}" for i in range(40)] + ["f" * 64]
    one = casefile.set_digest(spark.createDataFrame([(x,) for x in shas], "sha256 string"))
    two = casefile.set_digest(spark.createDataFrame([(x,) for x in reversed(shas)], "sha256 string").repartition(3))
    assert one == two and one.startswith("41:") and one != casefile.set_digest(spark.createDataFrame([(x,) for x in shas[1:]], "sha256 string"))
    assert casefile.set_digest(spark.createDataFrame([], "sha256 string")) == "0:" + "0" * 64


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        applicationId, master = "other", "spark://x:7077"

    class Session:
        conf, sparkContext = spark.conf, Context

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="shared|share"):
            session.shared_dir(Session)
