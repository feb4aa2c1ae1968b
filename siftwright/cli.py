"""Commands: analyse a folder, watch one, keep a case, search and verify.

``python -m siftwright analyze FOLDER --format jsonl --output OUT``
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.engine import Engine, Options
from siftwright.functions import domains
from siftwright.plans import case, indicators, report, rules, score, sinks
from siftwright.plans.casefile import Case
from siftwright.session import builder
from siftwright.sources import recordings

FORMATS = ("json", "text", "html", "jsonl", "cef", "summary")
IOC_FORMATS = ("csv", "stix", "misp")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwright", description=__doc__.splitlines()[0])
    p.add_argument("--master", help="where to run; the environment's choice if left out")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "watch"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--output", required=True, help="folder of the results")
        c.add_argument("--format", choices=FORMATS, default="jsonl")
        c.add_argument("--rules", nargs="*", default=[], help="files of rules")
        c.add_argument("--protected", nargs="*", default=[], help="domains of one's own")
        c.add_argument("--timeout", type=float, help="seconds for a message")
        c.add_argument("--min-severity", choices=score.SEVERITIES, default="info")
        _analysis(c)
        if name == "analyze":
            c.add_argument("--ioc-format", choices=IOC_FORMATS)
            c.add_argument("--extract-dir", help="a folder that all machines share, for attachments")
            c.add_argument("--fail-on", choices=[v for _, v in score.VERDICTS if v != "clean"], help="exit with 1 if a report is as bad")
        else:
            c.add_argument("--once", action="store_true")
            c.add_argument("--interval", default="5 seconds")
            c.add_argument("--all-files", action="store_true")
    k = sub.add_parser("case", help="evidence, index, indicators and custody log in a folder").add_subparsers(dest="act", required=True)
    for act in ("init", "add", "analyze", "report", "search", "verify", "log"):
        c = k.add_parser(act)
        c.add_argument("case")
        c.add_argument("--examiner", default="unknown")
        if act == "add":
            c.add_argument("folder")
        elif act == "report":
            c.add_argument("--output", required=True)
        elif act == "search":
            c.add_argument("query")
            c.add_argument("--type")
        elif act == "analyze":
            for name in ("--rules", "--protected"):
                c.add_argument(name, nargs="*", default=[])
            c.add_argument("--timeout", type=float)
            c.set_defaults(min_severity="info")
            _analysis(c)
    s = sub.add_parser("search", help="indicators of an analysis that contain a text")
    s.add_argument("indicators")
    s.add_argument("query")
    s.add_argument("--type")
    v = sub.add_parser("verify", help="a custody log, as JSON lines")
    v.add_argument("log")
    return p


def _analysis(c: argparse.ArgumentParser) -> None:
    c.add_argument("--protected-file", help="a file with such domains, one a line")
    c.add_argument("--suffix-list", help="a public suffix list to go by")
    c.add_argument("--max-nesting", type=int, default=Options().nesting, help="levels of attached messages")
    c.add_argument("--dns-replay", help="recorded DNS answers, for signatures and policies of senders")
    c.add_argument("--spf-ip", help="the address that sent the messages")
    c.add_argument("--enrich-replay", help="recorded answers of reputation services")
    c.add_argument("--yara", nargs="*", default=[], help="files of content signatures")


def _shown(rows: DataFrame) -> int:
    """Print all rows as JSON lines, one partition at a time; how many these were."""
    n = 0
    for (line,) in rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator():
        print(line)
        n += 1
    return n


def rendered(e: Engine, form: str) -> DataFrame:
    """(report_id, one text) of each report in a format."""
    now = datetime.now(timezone.utc)
    if form == "jsonl":
        return e.events(now.isoformat())
    if form == "cef":
        return sinks.cef(e.tables.messages, e.assessments, e.findings, int(now.timestamp() * 1000))
    if form == "summary":
        s = score.summary(e.assessments, e.findings)
        return s.select("report_id", F.to_json(F.struct(*s.columns)).alias("summary"))
    rows = report.nested_rows(e.tables.messages, e.assessments, e.shown, e.reasons, e.indicators)
    return {"json": report.as_json, "text": report.as_text, "html": report.as_page}[form](rows)


def _options(spark: SparkSession, a: argparse.Namespace) -> Options:
    if a.suffix_list:
        spark.conf.set(domains.LIST_CONF, a.suffix_list)
    protected = [*a.protected, *(r.value.strip().lower() for r in spark.read.text(a.protected_file).filter("trim(value) <> ''").collect())] if a.protected_file else a.protected
    signatures = "\n".join(r.value for f in a.yara for r in spark.read.text(f, wholetext=True).collect()) or None
    return Options(
        tuple(protected), a.timeout, tuple(r for f in a.rules for r in rules.load_rules(f)), a.min_severity, a.max_nesting, recordings.dns(spark, a.dns_replay) if a.dns_replay else None, a.spf_ip,
        recordings.http(spark, a.enrich_replay) if a.enrich_replay else None, signatures,
    )


def _case(spark: SparkSession, a: argparse.Namespace) -> int:
    c = Case(spark, a.case, a.examiner)
    if a.act == "init":
        c.init()
    elif a.act == "add":
        print(c.add(Engine.of_folder(spark, a.folder).evidence.filter("content is not null")))
    elif a.act == "analyze":
        print(c.analyze(_options(spark, a)))
    elif a.act == "report":
        c.report(a.output)
    elif a.act == "search":
        _shown(c.search(a.query, a.type))
    elif a.act == "log":
        _shown(c.log.orderBy("seq"))
    else:
        return int(_shown(c.verify()) > 0)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = builder(master=a.master).getOrCreate()
    if a.command == "case":
        return _case(spark, a)
    if a.command == "search":
        _shown(indicators.search(spark.read.parquet(a.indicators), spark.createDataFrame([], "report_id string, subject string"), a.query, a.type))
        return 0
    if a.command == "verify":
        return int(_shown(case.verify_log(spark.read.schema(case.LOG).json(a.log))) > 0)
    options = _options(spark, a)
    if a.command == "watch":
        from siftwright.streaming import watch

        analyse = lambda batch: rendered(Engine(spark, watch.evidence_of(batch), options), a.format)
        watch.run(watch.watched(spark, a.folder, a.all_files), f"{a.output}/_checkpoint", watch.to_folder(analyse, f"{a.output}/reports"), a.once, a.interval).awaitTermination()
        return 0
    e = Engine.of_folder(spark, a.folder, options)
    rendered(e, a.format).write.mode("overwrite").json(f"{a.output}/reports")
    e.indicators.write.mode("overwrite").parquet(f"{a.output}/indicators")
    if a.extract_dir:
        sinks.extract_attachments(e.tables.attachments, a.extract_dir)
    if a.ioc_format == "csv":
        sinks.csv_rows(e.indicators).write.mode("overwrite").option("header", True).csv(f"{a.output}/iocs")
    elif a.ioc_format == "stix":
        at = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        sinks.stix_bundles(sinks.stix_objects(e.indicators, at), at).write.mode("overwrite").json(f"{a.output}/iocs")
    elif a.ioc_format == "misp":
        sinks.misp_attributes(e.indicators).write.mode("overwrite").json(f"{a.output}/iocs")
    return int(bool(a.fail_on) and e.fails(a.fail_on))


if __name__ == "__main__":
    sys.exit(main())
