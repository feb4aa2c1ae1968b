"""Declarative rules over reports, compiled to column expressions.

A rule flags reports, or takes findings away from them, where all its ``all`` conditions hold, any
of ``any`` and none of ``none``. Rules apply in order: what one suppresses, later ones don't see.
"""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.domains import domain_of
from siftwright.plans.score import SEVERITIES

OPERATORS = ("equals", "contains", "matches", "in", "exists", "gt", "gte", "lt", "lte", "startswith", "endswith")
FIELDS = (
    "subject from from_domain from_org_domain from_display_name reply_to reply_to_domain return_path return_path_domain sender to cc recipient_domains message_id mailer body url url_host "
    "attachment_name attachment_ext attachment_type attachment_sha256 origin_ip received_ip score verdict findings format"
).split()


class RuleError(ValueError):
    """A rule that can't be compiled."""


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    action: str
    suppress: tuple[str, ...]
    all: tuple[dict, ...]
    any: tuple[dict, ...]
    none: tuple[dict, ...]
    description: str = ""


def parse_rules(items: list[dict]) -> list[Rule]:
    """Rules of plain dicts, checked; identifiers are unique without regard to case."""
    out = []
    for i, x in enumerate(items, 1):
        if not isinstance(x, dict) or not re.fullmatch(r"[A-Za-z0-9_]{1,60}", str(x.get("id", ""))):
            raise RuleError(f"rule {i}: an id of letters, digits and underscores is needed")
        r = Rule(str(x["id"]).upper(), str(x.get("severity", "medium")).lower(), x.get("action", "flag"), tuple(x.get("suppress", ())), tuple(x.get("all", ())), tuple(x.get("any", ())), tuple(x.get("none", ())), str(x.get("description", "")))
        if r.severity not in SEVERITIES:
            raise RuleError(f"{r.id}: unknown severity {r.severity!r}")
        if r.action not in ("flag", "suppress") or r.action == "suppress" and not r.suppress:
            raise RuleError(f"{r.id}: the action is flag, or suppress with codes")
        if not (r.all or r.any):
            raise RuleError(f"{r.id}: conditions are needed in all or any")
        for c in (*r.all, *r.any, *r.none):
            _check(r.id, c)
        out.append(r)
    if len({r.id for r in out}) < len(out):
        raise RuleError("two rules have one id")
    return out


def _check(rule: str, c: dict) -> None:
    if not isinstance(c, dict):
        raise RuleError(f"{rule}: a condition is a table")
    if "finding" in c or "finding_prefix" in c:
        return
    name, ops = str(c.get("field", "")), [o for o in OPERATORS if o in c]
    if name not in FIELDS and not name.startswith(("header:", "auth:")):
        raise RuleError(f"{rule}: unknown field {name!r}")
    if len(ops) != 1:
        raise RuleError(f"{rule}: one operator is needed for {name!r}")
    if ops == ["matches"]:
        try:
            re.compile(c["matches"])
        except re.error as e:
            raise RuleError(f"{rule}: {e}") from e


def load_rules(path: str) -> list[Rule]:
    """Rules of a JSON or TOML file: a list, or a table with ``rule`` or ``rules``."""
    text = Path(path).read_text(encoding="utf-8")
    data = tomllib.loads(text) if path.lower().endswith(".toml") else json.loads(text)
    items = data if isinstance(data, list) else data.get("rule") or data.get("rules") or []
    if not isinstance(items, list):
        raise RuleError(f"{path}: a list of rules is needed")
    return parse_rules(items)


def test(value: Column, op: str, expected) -> Column:
    """Whether one value passes; texts without regard to case, numbers where both are."""
    low = F.lower(value)
    if op in ("gt", "gte", "lt", "lte"):
        n = value.try_cast("double")
        try:
            e = float(expected)
        except (TypeError, ValueError):
            return F.lit(False)
        return {"gt": n > e, "gte": n >= e, "lt": n < e, "lte": n <= e}[op]
    if op == "in":
        return low.isin([str(x).lower() for x in expected])
    if op == "matches":
        # Java's classes are ASCII only unless told; its named groups are written otherwise.
        return value.rlike("(?U)" + re.sub(r"\(\?P<", "(?<", expected))
    e = F.lit(str(expected).lower())
    return {"equals": low == e, "contains": F.contains(low, e), "startswith": F.startswith(low, e), "endswith": F.endswith(low, e)}[op]


def condition(c: dict, fields: dict[str, Column], findings: Column) -> Column:
    """Whether a report meets a condition. ``fields`` are arrays of texts; ``findings`` an array of (code, severity)."""
    if "finding" in c or "finding_prefix" in c:
        least = SEVERITIES.index(c.get("min_severity", "info"))
        ranks = F.array(*map(F.lit, SEVERITIES))
        here = lambda f: (F.array_position(ranks, f["severity"]) - 1 >= least) & ((f["code"] == c["finding"]) if "finding" in c else f["code"].startswith(c["finding_prefix"]))
        return F.exists(findings, here)
    op = next(o for o in OPERATORS if o in c)
    values = F.array_compact(fields[c["field"]])
    if op == "exists":
        return (F.size(values) > 0) == F.lit(bool(c["exists"]))
    return F.coalesce(F.exists(values, lambda v: test(v, op, c[op])), F.lit(False))


def holds(rule: Rule, fields: dict[str, Column], findings: Column) -> Column:
    each = lambda cs: [condition(c, fields, findings) for c in cs]
    out = reduce(lambda a, b: a & b, each(rule.all), F.lit(True))
    if rule.any:
        out &= reduce(lambda a, b: a | b, each(rule.any))
    return out & ~reduce(lambda a, b: a | b, each(rule.none), F.lit(False))


def _split(r: Rule) -> tuple[Column, Column]:
    """What a rule takes from the findings, named with the rule, and what it leaves."""
    taken = F.filter("_found", lambda f: f["code"].isin(list(r.suppress)))
    return F.transform(taken, lambda f: F.struct(f["code"].alias("code"), F.lit(r.id).alias("rule"))), F.filter("_found", lambda f: ~f["code"].isin(list(r.suppress)))


def apply_rules(reports: DataFrame, rules: list[Rule], fields: dict[str, Column]) -> DataFrame:
    """``reports(report_id, findings ARRAY<STRUCT<code, severity>>, ...)`` with rules applied in order.

    (report_id, findings, matched ARRAY<rule>, suppressed ARRAY<STRUCT<code, rule>>): findings lose
    what was suppressed and gain ``RULE_<id>`` at the end; no rule sees those of another.
    """
    none = F.array().cast("array<struct<code:string,rule:string>>")
    df = reports.withColumn("_found", F.col("findings")).withColumn("suppressed", none).withColumn("matched", F.array().cast("array<struct<code:string,severity:string>>"))
    for r in rules:
        df = df.withColumn("_hit", holds(r, fields, F.col("_found")))
        if r.action == "suppress":
            gone, kept = _split(r)
            df = df.withColumn("suppressed", F.when(F.col("_hit"), F.concat("suppressed", gone)).otherwise(F.col("suppressed")))
            df = df.withColumn("_found", F.when(F.col("_hit"), kept).otherwise(F.col("_found")))
        else:
            df = df.withColumn("matched", F.when(F.col("_hit"), F.concat("matched", F.array(F.struct(F.lit(f"RULE_{r.id}").alias("code"), F.lit(r.severity).alias("severity"))))).otherwise(F.col("matched")))
    return df.select("report_id", F.concat("_found", "matched").alias("findings"), F.transform("matched", lambda m: m["code"]).alias("matched"), "suppressed")


def message_fields(org: Column | None = None) -> dict[str, Column]:
    """Field expressions over message columns; those of other tables must be joined in as arrays of their field's name."""
    one = lambda c: F.array(F.col(c).cast("string"))
    out = {"subject": one("subject"), "from": one("from_address"), "from_domain": F.array(domain_of(F.col("from_address"))), "from_display_name": one("from_display_name"), "reply_to": F.col("reply_to"), "return_path": one("return_path"), "to": F.col("to_addrs"), "cc": F.col("cc_addrs"), "message_id": one("message_id"), "mailer": one("x_mailer"), "format": one("msg_format")}
    out |= {"reply_to_domain": F.transform(F.col("reply_to"), domain_of), "return_path_domain": F.array(domain_of(F.col("return_path")))}
    if org is not None:
        out["from_org_domain"] = F.array(org)
    return out
