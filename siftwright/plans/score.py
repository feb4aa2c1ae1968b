"""Scores: findings to points, categories, a score from 0 to 100, a verdict and the reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.session import stage

# Points by severity, verdicts by least score, scores that some findings set at least, categories by the
# beginning of a code (the first that fits).
POINTS = {"high": 25.0, "medium": 10.0, "low": 3.0, "info": 0.0}
SEVERITIES = ("info", "low", "medium", "high")
VERDICTS = ((70, "malicious"), (35, "suspicious"), (12, "caution"), (0, "clean"))
FLOORS = {
    "MACRO_MALICIOUS_PATTERN": 85, "MACRO_STOMPED": 85, "MACRO_XLM": 75, "DOC_DDE": 80, "DOC_EXTERNAL_OBJECT": 75, "RTF_EXPLOIT_CLASS": 85, "PDF_LAUNCH": 80,
    "LNK_RUNS_COMMAND": 90, "SCRIPT_DOWNLOADER": 85, "SCRIPT_ENCODED_COMMAND": 80, "SCRIPT_RANSOMWARE": 90, "ATT_HTML_SMUGGLING": 85, "HTML_CREDENTIAL_FORM": 75,
    "ATT_DOUBLE_EXTENSION": 75, "HDR_MAILER_PHISHING_KIT": 75, "PROVIDER_PHISH_VERDICT": 75, "PROVIDER_EXTERNAL_CLAIMS_INTERNAL": 75, "ATT_ZIP_BOMB": 70,
    "ENRICH_KNOWN_MALWARE": 90, "ENRICH_URLHAUS_LISTED": 80,
}
CATEGORIES = (
    ("HDR_DISPLAY_NAME HDR_REPLY_TO HDR_RETURN_PATH HDR_SENDER HDR_MULTIPLE_FROM HDR_PROVIDER_PATH HDR_MESSAGE_ID", "sender identity"),
    ("AUTH_ AUTHV_ PROVIDER_", "authentication"), ("URL_ HTML_", "links and content"), ("ATT_", "attachments"),
    ("MACRO_ DOC_ PDF_ LNK_ SCRIPT_ ONENOTE_ RTF_", "payload"), ("HDR_MAILER HDR_PHP", "sending software"), ("NESTED_", "attached messages"),
    ("ENRICH_", "reputation"), ("YARA_", "signatures"), ("RULE_", "custom rules"),
    ("RCV_ HDR_ PARSE_ MIME_ BODY_ TEXT_", "structure and evasion"), ("MSG_", "context"), ("ANALYSIS_ ANALYZER_", "analysis"),
)
DIMINISH, CAP, SCALE, REASONS = 0.6, 60.0, 50.0, 10


def category_of(code: Column, location: Column | None = None) -> Column:
    """The category of a finding; look-alikes count where they were seen."""
    seen_in_url = (location == "URL") if location is not None else F.lit(False)
    out = F.when(code.startswith("LOOKALIKE_"), F.when(F.coalesce(seen_in_url, F.lit(False)), "links and content").otherwise("sender identity"))
    for prefixes, name in CATEGORIES:
        out = out.when(reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes.split()]), name)
    return out.otherwise("other")


def severity_rank(severity: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("tinyint")


def placed(findings: DataFrame) -> DataFrame:
    """Findings with ``seq``, their place in the report: the worst first, then by code, location and evidence."""
    w = Window.partitionBy("report_id").orderBy(F.desc(severity_rank(F.col("severity"))), "code", "location", "evidence")
    return findings.withColumn("seq", F.row_number().over(w))


def tally(assessments: DataFrame) -> DataFrame:
    """(verdict, tens, reports): how many reports came to each verdict and ten of scores, with totals where these are null."""
    return assessments.select("verdict", F.floor(F.col("score") / 10).cast("string").alias("tens")).rollup("verdict", "tens").agg(F.count("*").alias("reports"))


def points_of(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv]), severity), F.lit(0.0))


def verdict_of(score: Column) -> Column:
    out = F.when(score >= VERDICTS[0][0], VERDICTS[0][1])
    for least, name in VERDICTS[1:]:
        out = out.when(score >= least, name)
    return out


def ranked_points(findings: DataFrame, order: list[str]) -> DataFrame:
    """``findings(report_id, code, severity, category, ...)`` with ``raw`` points: each further one in a category counts less.

    ``order`` breaks ties among equal points. Nested findings are represented by nested scores and left out.
    """
    w = Window.partitionBy("report_id", "category").orderBy(F.desc("_p"), *order)
    kept = findings.filter(~F.col("code").startswith("NESTED_")).withColumn("_p", points_of(F.col("severity")))
    return kept.withColumn("raw", F.col("_p") * F.pow(F.lit(DIMINISH), F.row_number().over(w) - 1)).drop("_p")


def category_points(ranked: DataFrame) -> DataFrame:
    """(report_id, category, points): capped and rounded to one decimal; categories without points are left out."""
    return ranked.groupBy("report_id", "category").agg(F.round(F.least(F.lit(CAP), F.sum("raw")), 1).alias("points")).filter("points > 0")


def reasons(ranked: DataFrame, order: list[str], most: int = REASONS) -> DataFrame:
    """(report_id, rank, code, severity, category, points): the findings that gave most, within their category's cap."""
    w = Window.partitionBy("report_id", "category").orderBy(F.desc("raw"), *order)
    before = F.coalesce(F.sum("raw").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    upto = F.sum("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))
    given = ranked.withColumn("points", F.least(F.lit(CAP), upto) - F.least(F.lit(CAP), before)).filter("points > 0").withColumn("points", F.round("points", 1))
    top = Window.partitionBy("report_id").orderBy(F.desc("points"), "category", *order)
    return given.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= most).select("report_id", "rank", "code", "severity", "category", "points")


def floors(findings: DataFrame) -> DataFrame:
    """(report_id, floor_score, floor): the greatest least score and the first finding in order of ``seq`` that sets it."""
    table = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])
    set_by = findings.withColumn("f", F.try_element_at(table, F.col("code"))).filter("f is not null")
    return set_by.groupBy("report_id").agg(F.max("f").alias("floor_score"), F.max_by("code", F.struct("f", -F.col("seq"))).alias("floor"))


def assess(reports: DataFrame, findings: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """(report_id, score, verdict, categories, floor, nested_score) of every report.

    ``findings(report_id, seq, code, severity, location)``; ``nested(report_id, nested_score)``, one
    row a report, is the greatest score of its attached messages. Scoring is by expressions and
    windows over a report's findings, which are few; reports without findings are clean.
    """
    named = findings.withColumn("category", category_of(F.col("code"), F.col("location")))
    cats = category_points(ranked_points(named, ["seq"]))
    by = cats.groupBy("report_id").agg(F.sum("points").alias("raw"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "points")))).alias("categories"))
    base = reports.select("report_id").join(by, "report_id", "left").join(floors(findings), "report_id", "left")
    base = base.join(nested, "report_id", "left") if nested is not None else base.withColumn("nested_score", F.lit(None).cast("int"))
    own = F.bround(100 * (1 - F.exp(-F.coalesce("raw", F.lit(0.0)) / SCALE))).cast("int")
    raised = F.greatest(F.col("_own"), F.coalesce("floor_score", F.lit(0)))
    return base.withColumn("_own", own).select(
        "report_id", F.greatest(raised, F.coalesce("nested_score", F.lit(0))).cast("int").alias("score"),
        verdict_of(F.greatest(raised, F.coalesce("nested_score", F.lit(0)))).alias("verdict"), "categories",
        F.when(F.col("floor_score") > F.col("_own"), F.col("floor")).alias("floor"), F.col("nested_score").cast("int").alias("nested_score"),
    )


def assess_nested(reports: DataFrame, findings: DataFrame, depth: int = 3) -> DataFrame:
    """:func:`assess` bottom-up over ``reports(report_id, parent_report_id)``: a parent is at least as bad as what it carries.

    Each report is assessed once, into a stage; only scores go up, one join a level.
    """
    own = stage(assess(reports, findings), "assessed")
    kin = reports.filter("parent_report_id is not null").select("report_id", "parent_report_id")
    total = own.select("report_id", "score")
    for _ in range(depth):
        worst = kin.join(total, "report_id").groupBy(F.col("parent_report_id").alias("report_id")).agg(F.max("score").alias("nested_score"))
        total = own.select("report_id", "score").join(worst, "report_id", "left").select("report_id", F.greatest("score", F.coalesce("nested_score", F.lit(0))).alias("score"))
    raised = F.greatest("score", F.coalesce("nested_score", F.lit(0)))
    out = own.drop("nested_score").join(worst, "report_id", "left")
    return out.select("report_id", raised.alias("score"), verdict_of(raised).alias("verdict"), "categories", "floor", F.col("nested_score").cast("int").alias("nested_score"))


def summary(assessments: DataFrame, findings: DataFrame) -> DataFrame:
    """(report_id, score, verdict, high, medium, low, info, top_codes): one row a report."""
    n = {s: F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES}
    codes = F.slice(F.array_sort(F.collect_set(F.when(F.col("severity") == "high", F.col("code")))), 1, 5).alias("top_codes")
    per = findings.groupBy("report_id").agg(*n.values(), codes)
    zero = [F.coalesce(s, F.lit(0)).alias(s) for s in reversed(SEVERITIES)]
    return assessments.select("report_id", "score", "verdict").join(per, "report_id", "left").select("report_id", "score", "verdict", *zero, F.coalesce("top_codes", F.array().cast("array<string>")).alias("top_codes"))
