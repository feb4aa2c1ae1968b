"""Content signatures: a subset of YARA's language (text, hexadecimal and pattern strings, counted conditions)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.plans.detect import findings_of, hit

MOST_TARGET = 20 * 2**20
MATCHES = "report_id string, part string, rule string, severity string, strings array<string>"


class SignatureError(ValueError):
    """A rule outside the subset, or a broken one."""


@dataclass(frozen=True)
class Signature:
    name: str
    meta: dict
    strings: dict
    condition: str

    def matches(self, data: bytes) -> list[str]:
        """The names of the strings that were found, if the condition holds; else none."""
        found = {n: p.search(data) is not None for n, p in self.strings.items()}
        return [n for n, f in found.items() if f] or [""] if _holds(self.condition, found, len(data)) else []


def _hex(body: str) -> re.Pattern:
    out = []
    for t in re.findall(r"\[\d+(?:-\d*)?\]|\[-\]|[0-9A-Fa-f?]{2}|[()|]|\S", body):
        if m := re.fullmatch(r"\[(\d+)(?:(-)(\d*))?\]", t):
            out.append(f"[\\x00-\\xff]{{{m[1]}{',' + m[3] if m[2] else ''}}}".replace("{", "{", 1))
        elif t in "()|":
            out.append({"(": "(?:", ")": ")", "|": "|"}[t])
        elif re.fullmatch(r"[0-9A-Fa-f?]{2}", t):
            if t == "??":
                out.append("[\\x00-\\xff]")
            elif "?" in t:
                out.append("[" + "".join(f"\\x{int(t.replace('?', d), 16):02x}" for d in "0123456789abcdef") + "]")
            else:
                out.append(f"\\x{t.lower()}")
        else:
            raise SignatureError(f"bad hexadecimal string at {t!r}")
    return re.compile("".join(out).encode(), re.S)


def _text(value: str, flags: set[str]) -> re.Pattern:
    raw = re.sub(r'\\(x[0-9A-Fa-f]{2}|[nrt"\\])', lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "x" else {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), value).encode("latin-1", "replace")
    forms = [re.escape(raw)] if "wide" not in flags or "ascii" in flags else []
    if "wide" in flags:
        forms.append(re.escape(b"".join(bytes([c, 0]) for c in raw)))
    body = b"(?:" + b"|".join(forms) + b")"
    if "fullword" in flags:
        body = rb"(?<![A-Za-z0-9])" + body + rb"(?![A-Za-z0-9])"
    return re.compile(body, re.S | (re.I if "nocase" in flags else 0))


def compile_signatures(text: str) -> list[Signature]:
    """The rules of a source text; names are unique."""
    text = re.sub(r'("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    out = []
    for m in re.finditer(r"\brule\s+(\w+)[^{]*\{(.*?)\bcondition\s*:(.*?)\n?\s*\}\s*(?=(?:private\s+|global\s+)*rule\b|\Z)", text, re.S):
        name, head, condition = m[1], m[2], " ".join(m[3].split())
        meta = {k: v.strip('"') for k, v in re.findall(r'(\w+)\s*=\s*("(?:[^"\\]|\\.)*"|\d+|true|false)', head.partition("strings:")[0].partition("meta:")[2])}
        strings: dict[str, re.Pattern] = {}
        for s in re.finditer(r'\$(\w*)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|\{([^}]*)\}|/((?:[^/\\\n]|\\.)+)/([is]*))((?:\s+(?:nocase|wide|ascii|fullword|private))*)', head.partition("strings:")[2]):
            flags = set(s[6].split())
            try:
                strings[s[1] or f"_{len(strings)}"] = _text(s[2], flags) if s[2] is not None else _hex(s[3]) if s[3] is not None else re.compile(s[4].encode(), (re.I if "i" in s[5] or "nocase" in flags else 0) | (re.S if "s" in s[5] else 0))
            except re.error as e:
                raise SignatureError(f"{name}: {e}") from e
        _holds(condition, dict.fromkeys(strings, False), 0)
        out.append(Signature(name, meta, strings, condition))
    if len({s.name for s in out}) < len(out) or not out:
        raise SignatureError("no rules, or two of one name")
    return out


def _holds(condition: str, found: dict[str, bool], size: int) -> bool:
    """A condition of and, or, not, parentheses, $names, counted sets and filesize."""
    units = {"KB": 1024, "MB": 2**20, "": 1}
    tokens = re.findall(r"\$\w*\*?|\w+|[(),]|[<>]=?|==|\S", condition)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        t = peek()
        if not t or want and t != want:
            raise SignatureError(f"condition {condition!r}: {want or 'more'} expected")
        at += 1
        return t

    def members() -> list[bool]:
        if peek() == "them":
            take()
            return list(found.values())
        take("(")
        out: list[bool] = []
        while True:
            t = take()
            names = [n for n in found if n == t[1:] or t.endswith("*") and n.startswith(t[1:-1])]
            if not t.startswith("$") or not names:
                raise SignatureError(f"condition {condition!r}: {t}")
            out += [found[n] for n in names]
            if take() == ")":
                return out

    def one() -> bool:
        t = take()
        if t == "not":
            return not one()
        if t == "(":
            value = either()
            take(")")
            return value
        if t in ("true", "false"):
            return t == "true"
        if t == "filesize":
            op, n = take(), re.fullmatch(r"(\d+)(KB|MB|)", take())
            if not n or op not in ("<", "<=", ">", ">=", "=="):
                raise SignatureError(f"condition {condition!r}: size")
            limit = int(n[1]) * units[n[2]]
            return {"<": size < limit, "<=": size <= limit, ">": size > limit, ">=": size >= limit, "==": size == limit}[op]
        if t in ("any", "all", "none") or t.isdecimal():
            take("of")
            some = members()
            return any(some) if t == "any" else all(some) if t == "all" else not any(some) if t == "none" else sum(some) >= int(t)
        if t.startswith("$") and t[1:] in found:
            return found[t[1:]]
        raise SignatureError(f"condition {condition!r}: {t}")

    def both() -> bool:
        value = one()
        while peek() == "and":
            take()
            value = one() and value
        return value

    def either() -> bool:
        value = both()
        while peek() == "or":
            take()
            value = both() or value
        return value

    result = either()
    if at < len(tokens):
        raise SignatureError(f"condition {condition!r}: {peek()}")
    return result


def scan(targets: DataFrame, source: str) -> DataFrame:
    """:data:`MATCHES` of ``targets(report_id, part, data)``; the rules' text goes with the plan, and each worker compiles it once."""
    compile_signatures(source)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signatures = compile_signatures(source)
        for f in frames:
            rows = [(r.report_id, r.part, s.name, s.meta.get("severity", "medium"), found) for r in f.itertuples() for s in signatures if (found := s.matches(bytes(r.data)))]
            yield pd.DataFrame(rows, columns=["report_id", "part", "rule", "severity", "strings"])

    return targets.filter(F.length("data") <= MOST_TARGET).select("report_id", "part", "data").mapInPandas(run, MATCHES)


def unscanned(targets: DataFrame) -> DataFrame:
    """The finding of each report with targets that are too large to be scanned."""
    big = targets.filter(F.length("data") > MOST_TARGET).groupBy("report_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("part")).alias("parts"))
    return findings_of(big, hit(F.lit(True), "YARA_ERRORS", "low", None, count=F.col("n"), too_large=F.col("parts")))


def findings(matches: DataFrame) -> DataFrame:
    severity = F.when(F.lower("severity").isin("info", "low", "medium", "high"), F.lower("severity")).otherwise("medium")
    return findings_of(matches, hit(F.lit(True), "YARA_MATCH", severity, F.col("part"), rule=F.col("rule"), strings=F.col("strings")))
