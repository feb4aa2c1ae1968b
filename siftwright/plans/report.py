"""Reports of messages: as JSON, as text and as a page, each a column of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.text import defang, html_escape, safe_display
from siftwright.plans.score import severity_rank

_PAGE = (
    '<!doctype html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src \'none\'; style-src \'unsafe-inline\'"><title>{title}</title>'
    "<style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:2px 8px;text-align:left;vertical-align:top}}.high{{color:#b00}}.medium{{color:#a60}}</style></head><body>"
)


def nested_rows(messages: DataFrame, assessments: DataFrame, findings: DataFrame, reasons: DataFrame, indicators: DataFrame | None = None) -> DataFrame:
    """One row a report: scalars of the message, its assessment, and arrays of findings, reasons and indicators in order."""
    f = findings.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code", "severity", "location", "evidence"))), lambda x: x.dropFields("seq")).alias("findings"))
    r = reasons.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "severity", "category", "points"))).alias("reasons"))
    out = messages.join(assessments, "report_id", "left").join(f, "report_id", "left").join(r, "report_id", "left")
    if indicators is None:
        return out.withColumn("indicators", F.array().cast("array<struct<type:string,value:string,role:string>>"))
    return out.join(indicators.groupBy("report_id").agg(F.array_sort(F.collect_set(F.struct("type", "value", "role"))).alias("indicators")), "report_id", "left")


def as_json(rows: DataFrame) -> DataFrame:
    """(report_id, report): the whole row as JSON."""
    return rows.select("report_id", F.to_json(F.struct(*rows.columns)).alias("report"))


def _lines(values: Column, one) -> Column:
    """The rows of an array as lines; none for null."""
    return F.array_join(F.transform(F.coalesce(values, F.array().cast(one.kind)), one.build), "\n")


class _Finding:
    kind = "array<struct<code:string,severity:string,location:string,evidence:string>>"

    @staticmethod
    def build(f: Column) -> Column:
        return F.concat(F.lit("  ["), F.upper(f["severity"]), F.lit("] "), f["code"], F.coalesce(F.concat(F.lit(" at "), safe_display(f["location"])), F.lit("")), F.coalesce(F.concat(F.lit(": "), safe_display(f["evidence"])), F.lit("")))


class _Reason:
    kind = "array<struct<rank:int,code:string,severity:string,category:string,points:double>>"

    @staticmethod
    def build(r: Column) -> Column:
        return F.concat(F.lit("  "), r["points"].cast("string"), F.lit("  "), r["code"], F.lit(" ("), r["category"], F.lit(")"))


def as_text(rows: DataFrame) -> DataFrame:
    """(report_id, report): a text for people; nothing hidden in a message changes how it shows."""
    field = lambda name, c: F.concat(F.lit(f"{name:<12}"), safe_display(F.coalesce(F.col(c).cast("string"), F.lit("-"))))
    head = [field(n, c) for n, c in (("Path", "path"), ("SHA-256", "sha256"), ("Subject", "subject"), ("From", "from_address"), ("Name", "from_display_name"), ("Message-ID", "message_id"), ("Verdict", "verdict"), ("Score", "score"))]
    return rows.select("report_id", F.concat_ws("\n", *head, F.lit("Reasons"), _lines(F.col("reasons"), _Reason), F.lit("Findings"), _lines(F.col("findings"), _Finding)).alias("report"))


def as_page(rows: DataFrame) -> DataFrame:
    """(report_id, report): a page without scripts or remote loads; addresses in it can't be followed."""
    cell = lambda c, tag="td": F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    show = lambda c: html_escape(defang(F.coalesce(c.cast("string"), F.lit("-"))))
    head = F.concat(*[F.concat(F.lit("<tr>"), cell(F.lit(n), "th"), cell(show(F.col(c))), F.lit("</tr>")) for n, c in (("Path", "path"), ("SHA-256", "sha256"), ("Subject", "subject"), ("From", "from_address"), ("Verdict", "verdict"), ("Score", "score"))])
    found = F.transform(F.coalesce("findings", F.array().cast(_Finding.kind)), lambda f: F.concat(F.lit('<tr class="'), f["severity"], F.lit('">'), cell(f["severity"]), cell(f["code"]), cell(show(f["location"])), cell(show(f["evidence"])), F.lit("</tr>")))
    return rows.select("report_id", F.concat(F.lit(_PAGE.format(title="Report")), F.lit("<table>"), head, F.lit("</table><h2>Findings</h2><table>"), F.array_join(found, ""), F.lit("</table></body></html>")).alias("report"))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """The findings of a severity or a worse one."""
    return findings.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(severity)))


def case_page(tally: DataFrame, index: DataFrame, shared: DataFrame, log: DataFrame) -> DataFrame:
    """(value): the lines of a case's page in order: verdicts, its reports from the worst on, indicators that reports share, and its log."""
    show = lambda c: html_escape(defang(F.coalesce(c.cast("string"), F.lit("-"))))
    row = lambda *cols: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), show(F.col(c)), F.lit("</td>")) for c in cols], F.lit("</tr>"))
    spark = tally.sparkSession
    fixed = [(0, _PAGE.format(title="Case") + "<h1>Case</h1><h2>Verdicts</h2><table>"), (2, "</table><h2>Reports</h2><table>"), (4, "</table><h2>Shared indicators</h2><table>"), (6, "</table><h2>Custody</h2><table>"), (8, "</table></body></html>")]
    parts = [
        spark.createDataFrame(fixed, "section int, value string").select("section", F.lit(0.0).alias("at"), F.lit("").alias("then"), "value"), tally.select(F.lit(1).alias("section"), (-F.col("reports")).cast("double").alias("at"), F.col("verdict").alias("then"), row("verdict", "reports").alias("value")),
        index.select(F.lit(3).alias("section"), (-F.coalesce("score", F.lit(0))).cast("double").alias("at"), F.col("report_id").alias("then"), row("score", "verdict", "from_address", "subject", "sha256").alias("value")),
        shared.select(F.lit(5).alias("section"), (-F.col("reports")).cast("double").alias("at"), F.concat_ws("|", "type", "value").alias("then"), row("type", "value", "reports").alias("value")),
        log.select(F.lit(7).alias("section"), F.col("seq").cast("double").alias("at"), F.lit("").alias("then"), row("seq", "time", "action", "examiner", "hash").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("section", "at", "then").select("value")
