"""Personal information in free text, by a semi-Markov conditional random field.

A text is cut into segments: personal ones, each of one of five types, and single characters of
all else, which score nothing. Candidate segments are spans of bounded length that have the bare
form of their type. A candidate is scored as a whole, by features of its form, its control digits,
the listed names in it and the words around it. One dynamic program over the text's boundaries
chooses those segments jointly: which spans, where they begin and end, and which type they have.

The weights maximise the conditional likelihood of labelled sentences, which are made from rules
(``pii_corpus``); :class:`Model` trains in seconds and is the same for the same name list.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.pii_corpus import STREET_AFTER, STREET_BEFORE, STREET_TAIL, Maker, dni_letter, ean_digit, nir_key, tax_digit
from siftwright.llm.tokens import VOCABULARY, common_words

KINDS = ("email", "phone", "id_number", "street", "person")
#: Names of a list that may go to the workers; longer lists are refused.
MOST_NAMES = 2_000_000
#: Words whose kind a worker remembers.
REMEMBERED = 100_000

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮİĶŁŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽȘȚ"
_CAP = rf"[{_UP}][\w’']*"
_GAP = r"[   ]"
_DOT = r" ?[\[({<] ?(?:dot|\.|punkt|point|punto) ?[\])}>] ?"
# An address is found from the sign in its middle: what stands before it, the sign, and the host after it.
_SIGN = re.compile(r" ?[\[({<] ?(?:at|@|arroba) ?[\])}>] ?|＠| at | @ |@", re.I)
#: What may stand in an address before its sign: by whether that sign is written plainly.
_LOCAL = {True: frozenset(".+%&'=~!#$*/?^`{|}-_"), False: frozenset(".+-_")}
_HOSTS = {
    "@": re.compile(r"\w[\w-]*(?:\.\w[\w-]*)+"), "at": re.compile(r"\w[\w-]*(?: dot \w[\w-]*)+", re.I), "apart": re.compile(r"\w[\w-]*(?: ?\. ?\w[\w-]*)+"),
    "signed": re.compile(rf"\w[\w-]*(?:(?:{_DOT}|\.)\w[\w-]*)+", re.I), "dots": re.compile(rf"\w[\w-]*(?:{_DOT}\w[\w-]*)+", re.I),
}
# These begin with a class of characters, which the search skips to, and look back after it.
_NUMBERS = re.compile(r"[+(\d](?<![\w.,:].)(?:(?<=\d)\d*|\(?\d+)(?:\)?[ \xa0.\-/‐‑–()]{0,3}\d+)*")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_GROUP = re.compile(r"[+(]*\d+")
_IDS = (
    ("ssn", re.compile(r"(?<![\w.,/-])\d{3}([- ]?)\d{2}\1\d{4}(?![\w/]|[-.,]\d)")),
    ("nino", re.compile(r"(?<![\w-])[A-Z]{2}([- ]?)\d{2}\1\d{2}\1\d{2}\1[A-D](?![\w]|-\w)", re.I)),
    ("dni", re.compile(r"(?<![\w.,/-])(?:\d{8}|[XYZ][- ]?\d{7})[- ]?[A-Z](?![\w]|-\w)")),
    ("tax", re.compile(r"(?<![\w.,/-])[1-9]\d( ?)\d{3}\1\d{3}\1\d{3}(?![\w/]|[-.,]\d)")),
    ("ahv", re.compile(r"(?<![\w.,/-])756(\.?)\d{4}\1\d{4}\1\d\d(?![\w/]|[-.,]\d)")),
    ("cf", re.compile(r"(?<![\w-])[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z](?![\w]|-\w)", re.I)),
    ("nir", re.compile(r"(?<![\w.,/-])[12]([ .-]?)\d{2}\1\d{2}\1\d[\dAB]\1\d{3}\1\d{3}[ .-]?\d{2}(?![\w]|[-.,]\d)")),
)
_NO = r"\d{1,4}(?: ?[a-hA-H](?!\w)| (?:bis|ter|quater)(?!\w))?"
_AFTER = "|".join(sorted(map(re.escape, STREET_AFTER), key=len, reverse=True))
_TAIL = "|".join(sorted((re.escape(t) for t in STREET_TAIL), key=len, reverse=True))
_WAYS = sorted({w.split()[0] for w in STREET_BEFORE if w not in ("Zum", "Am", "An der", "Im")} | {"av.", "bd", "pl.", "route", "cours", "Av.", "Avda.", "Carrera", "Travesía", "Glorieta", "sentier", "passage", "square", "Rue", "Place", "Quai", "Chemin", "Impasse", "Allée", "Boulevard", "Avenue"}, key=len, reverse=True)
_WAY = "|".join(map(re.escape, _WAYS))
_OF = r"(?:(?:de|du|des|del|de la|de los|de las|de l['’]|d['’]|la|las|los|les|le|l['’]|aux|au|à)\b ?)"
_NAME = rf"(?:{_OF}{{0,2}}(?:d['’]|l['’])?[{_UP}][\w’'-]*)"
_STREETS = (
    ("after", re.compile(rf"(?<![\w.,:/-])(?P<no>{_NO}),?{_GAP}(?:[{_UP}\d][\w’'-]*{_GAP}){{1,4}}?(?:{_AFTER})(?!\w)")),
    ("way", re.compile(rf"(?<![\w.:/-])(?P<no>{_NO}),?{_GAP}(?:{_WAY}){_GAP}{_NAME}(?:{_GAP}{_NAME}){{0,3}}")),
    ("tail", re.compile(rf"(?<!\w)(?:[{_UP}][\w’'-]*{_GAP})?[{_UP}](?i:[\w’'-]*(?<=[\w’'-]{{2}})(?:{_TAIL}))(?:,?{_GAP})(?:Nr\.? ?)?(?P<no>{_NO})(?![\w:]|[.,]\d)")),
    ("before", re.compile(rf"(?<!\w)(?:{_WAY}){_GAP}?{_NAME}(?:{_GAP}{_NAME}){{0,3}}(?:,?{_GAP})(?:n\.?[º°o]?\.? ?|núm\. ?|no\. ?)?(?P<no>{_NO})(?![\w:]|[.,]\d)")),
    ("lead", re.compile(rf"(?<!\w)(?:Zum|Zur|Am|An der|An den|Auf der|Auf dem|Im|In der|Hinter der|Unter den|Vor dem){_GAP}(?:[{_UP}][\w’'-]*{_GAP}){{1,3}}(?:Nr\.? ?)?(?P<no>{_NO})(?![\w:]|[.,]\d)")),
)
_INITIAL = rf"[{_UP}]\."
_SUR = rf"(?:(?:de|van|von|del|della|di|la|der|den|zu|ter|O['’]|Mc|Mac){_GAP}){{0,2}}{_CAP}(?:-{_CAP})?"
_PERSONS = (
    ("given", re.compile(rf"(?<![\w@.-])(?P<g>{_CAP}(?:-{_CAP})?)(?P<m>){_GAP}(?P<f>{_SUR})(?![\w@]|\.\w)")),
    ("middle", re.compile(rf"(?<![\w@.-])(?P<g>{_CAP}(?:-{_CAP})?)(?P<m>{_GAP}(?:{_INITIAL}|{_CAP})){_GAP}?(?P<f>{_SUR})(?![\w@]|\.\w)")),
    ("initial", re.compile(rf"(?<![\w@.-])(?P<g>{_INITIAL})(?P<m>(?:{_GAP}?{_INITIAL})?){_GAP}?(?P<f>{_SUR})(?![\w@]|\.\w)")),
    ("comma", re.compile(rf"(?<![\w@.-])(?P<f>{_SUR}),{_GAP}(?P<g>{_INITIAL}|{_CAP}(?:-{_CAP})?)(?P<m>(?:{_GAP}{_INITIAL})?)(?![\w@]|\.\w)")),
)
#: What a text must hold for a pattern to match anywhere in it; and house numbers after a capitalised word.
_GATES = {"comma": re.compile(rf"\w,{_GAP}[{_UP}]"), **dict.fromkeys(("nino", "cf"), re.compile(r"\d[- ]?[A-Za-z](?!\w)"))}
_HOUSED, _CAPITAL_WORD = ("tail", "before", "lead"), re.compile(rf"[{_UP}][\w’'-]*\.?,?{_GAP}(?:n\.?[º°o]?\.? ?|núm\. ?|no\. ?|Nr\.? ?)?\d")
_BEFORE, _NEXT = re.compile(r"[\w’'º]+|[^\w\s]"), re.compile(r"[\w’']+|[^\w\s]")
# Words around numbers that aren't personal, around telephone numbers, and around identity numbers.
NOT_MINE = frozenset("order invoice tracking ticket batch section build relay hop rfc parcel case betrag code checksum rule score quota version factura facture rechnung commande pedido bestellung sendung colis paquete auftrag dossier expediente importe montant gate port size".split())
CALLED = frozenset("tel phone ring call number fax mobile mob reach under unter au al telefon téléphone teléfono joindre llame rückfragen consultas questions contact anrufen is".split())
TITLES = frozenset("dr mr mrs ms miss mx prof professor sir frau herr herrn mme mlle monsieur madame señor señora señorita sr sra srta don doña dear dott signor signora".split())
IDENTITY = frozenset("steuer tax fiscale codice ahv avs social insee identity document documento ausweis ausweisnummer numéro número dni nif nie nino ssn passport need id identité identidad personalausweis insurance security".split())
UNITS = frozenset("kb mb gb € $ bytes open recipients tickets copies campaigns more minutes boxes ko mo % users messages".split())


def _near(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The three words or signs before, nearest first, and the two after."""
    before = _BEFORE.findall(text[max(0, start - 40) : start].lower())[::-1][:3]
    return before, _NEXT.findall(text[end : end + 24].lower())[:2]


class Names:
    """What a list of names tells about a word: whether it is listed, begins like many that are, or is in common use otherwise."""

    def __init__(self, given: list[str], family: list[str], common: frozenset[str] = frozenset()):
        self.given, self.family, self.common = {g.lower() for g in given}, {f.lower() for f in family}, common
        count: dict[str, int] = {}
        for f in self.family:
            for k in range(3, min(len(f), 6)):
                count[f[:k]] = count.get(f[:k], 0) + 1
        self.beginnings = {p for p, n in count.items() if n >= 4}
        self.known: dict[tuple[str, str], str] = {}

    def _kept(self, what: str, word: str, value: str) -> str:
        """A word's answer, remembered for as long as the table is small."""
        if len(self.known) < REMEMBERED:
            self.known[what, word] = value
        return value

    def is_family(self, word: str) -> str:
        if got := self.known.get(("family", word)):
            return got
        parts = word.lower().split("-")
        if all(p in self.family for p in parts):
            kind = "listed"
        elif all(p in self.family or any(p[:k] in self.beginnings for k in (3, 4, 5)) and len(p) > 5 for p in parts):
            kind = "alike"
        else:
            kind = "given" if word.lower() in self.given else "other"
        return self._kept("family", word, kind)

    def is_common(self, word: str) -> bool:
        return all(p in self.common for p in word.lower().split("-"))

    def is_given(self, word: str) -> str:
        if got := self.known.get(("given", word)):
            return got
        w = word.lower()
        if w.endswith(".") and len(w) == 2:
            kind = "initial"
        else:
            kind = "listed" if all(p in self.given for p in w.split("-")) else "family" if self.is_family(word) != "other" else "other"
        return self._kept("given", word, kind)


def _around(kind: str, near: tuple[list[str], list[str]]) -> list[str]:
    before, after = near
    f = [f"{kind}|b1={before[0]}" if before else f"{kind}|b1=^", f"{kind}|a1={after[0]}" if after else f"{kind}|a1=$"]
    if len(before) > 1:
        f.append(f"{kind}|b2={before[1]}")
    return f


#: Where spans that begin with a capital or with a digit may begin.
_PERSON = re.compile(rf"[{_UP}](?<![\w@.-].)(?:\.{_GAP}?|[\w’'-]*,?{_GAP})(?=[{_UP}]|(?:de|van|von|del|della|di|la|der|den|zu|ter){_GAP})")
_CAPITAL, _NUMERAL = re.compile(rf"[{_UP}](?<!\w.)"), re.compile(r"[\dXYZ](?<!\w.)(?:(?<=\d)\d*|[- ]?\d)")
_BY_CAPITAL, _BY_NAME = ("tail", "lead"), ("given", "middle", "initial")
#: The lengths that the first run of digits of a form can have; 0 stands for a letter before it.
_BY_NUMERAL = {"after": (1, 2, 3, 4), "way": (1, 2, 3, 4), "ssn": (3, 9), "dni": (0, 8), "nir": (1, 6, 13, 15), "tax": (2, 11), "ahv": (3, 13)}


def _numerals(text: str, starts: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    if "numeral" not in starts:
        starts["numeral"] = [(m.start(), 0 if m[0][0] in "XYZ" else m.end() - m.start()) for m in _NUMERAL.finditer(text)]
    return starts["numeral"]


def _matches(name: str, pattern: re.Pattern, text: str, starts: dict[str, list[tuple[int, int]]]) -> Iterator[re.Match]:
    """The matches of a pattern at each place where one may begin, overlapping ones too."""
    if name in _BY_NAME:
        if "name" not in starts:
            starts["name"] = [(m.start(), 0) for m in _PERSON.finditer(text)]
        for at, _ in starts["name"]:
            if m := pattern.match(text, at):
                yield m
        return
    if name in _GATES:
        gate = _GATES[name]
        if gate.pattern not in starts:
            starts[gate.pattern] = [m.span() for m in [gate.search(text)] if m]
        if not starts[gate.pattern]:
            return
    if name in _HOUSED:
        if "housed" not in starts:
            starts["housed"] = [m.span() for m in [_CAPITAL_WORD.search(text)] if m]
        if not starts["housed"]:
            return
    if name in _BY_CAPITAL:
        if "capital" not in starts:
            starts["capital"] = [(m.start(), 0) for m in _CAPITAL.finditer(text)]
        for at, _ in starts["capital"]:
            if m := pattern.match(text, at):
                yield m
        return
    if name in _BY_NUMERAL:
        lengths = _BY_NUMERAL[name]
        for at, n in _numerals(text, starts):
            if n in lengths and (m := pattern.match(text, at)):
                yield m
        return
    at = 0
    while m := pattern.search(text, at):
        at = m.start() + 1
        while at < len(text) and (text[at].isalnum() or text[at] in "’'-"):
            at += 1
        yield m


def _emails(text: str) -> Iterator[tuple[int, int, str, list[str]]]:
    links: list[int] | None = None
    for m in _SIGN.finditer(text):
        sign = m[0].lower()
        plain = sign == "@"
        forms = ("@", "dots") if plain else ("at",) if sign == " at " else ("apart",) if sign == " @ " else ("signed",)
        ends: dict[bool, int] = {}
        for form in forms:
            right = _HOSTS[form].match(text, m.end())
            if not right:
                continue
            wide = form == "@"
            if wide not in ends:
                a = m.start()
                while a and (text[a - 1].isalnum() or text[a - 1] in _LOCAL[wide]):
                    a -= 1
                while a < m.start() and not (text[a].isalnum() or text[a] == "_"):
                    a += 1
                ends[wide] = a if a < m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_") else m.start()
            a, b = ends[wide], right.end()
            if a == m.start():
                continue
            if links is None:
                links = [x.start() for x in re.finditer("://", text)]
            before = text[max(0, a - 28) : a].lower()
            local = text[a : m.start()]
            at = bisect(links, b) - 1
            linked = at >= 0 and " " not in text[links[at] : a]
            f = [f"email|form={form}", "email|url" if linked or text[a - 1 : a] in ("/", ":") or "/" in local else "email|no-url"]
            f.append("email|id-header" if re.search(r"message-id|in-reply-to|references|content-id|\bcid:|\bid\s*[:=<]", before) else "email|no-header")
            if re.fullmatch(r"[0-9a-f]{6,}\.[0-9a-f]+|[0-9a-f]{12,}", local.lower()):
                f.append("email|hex")
            if text[a - 1 : a] == "<":
                f.append("email|angle")
            yield a, b, "email", f


def _phones(text: str) -> Iterator[tuple[int, int, str, list[str]]]:
    for m in _NUMBERS.finditer(text):
        if len(m[0]) < 7 or sum(map(str.isdigit, m[0])) < 7 or _IP.fullmatch(m[0]):
            continue
        groups = [(g.start() + m.start(), g.end() + m.start(), len(g[0].lstrip("+("))) for g in _GROUP.finditer(m[0])]
        for i in range(len(groups)):
            n = 0
            for j in range(i, min(i + 7, len(groups))):
                n += groups[j][2]
                if n > 15:
                    break
                a, b = groups[i][0], groups[j][1]
                if n < 7 or (span := text[a:b]).count("(") != span.count(")") or _IP.fullmatch(span):
                    continue
                before, after = _near(text, a, b)
                whole = i == 0 and j == len(groups) - 1
                shape = re.sub(r"\d", "9", span)
                f = [f"phone|n={n}", f"phone|whole={whole}", f"phone|groups={j - i + 1}"]
                f.append("phone|start=" + ("+" if span.lstrip("(")[0] == "+" else "00" if span.startswith("00") else "0" if span.startswith("0") else "(" if span[0] == "(" else "1" if span[0] == "1" else "9"))
                if re.fullmatch(r"(?:\+?1[-. ]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}", span):
                    f.append("phone|nanp")
                if re.fullmatch(r"\d{3}[- ]?\d{2}[- ]?\d{4}", span):
                    f.append("phone|ssn-shape")
                if re.fullmatch(r"(?:19|20)\d\d-\d+-\d+", span):
                    f.append("phone|date")
                f.append(f"phone|shape={shape}" if len(shape) < 20 else "phone|long")
                f.append("phone|mine=" + ("not" if any(w in NOT_MINE for w in before) else "identity" if any(w in IDENTITY for w in before) else "called" if any(w in CALLED for w in before) else "open"))
                f.append("phone|unit" if after and after[0] in UNITS else "phone|no-unit")
                if text[b : b + 1].isalnum() or re.match(r"[-.:/]\w", text[b : b + 2]):
                    f.append("phone|goes-on")
                line = text.rfind("\n", 0, a) + 1
                if not text[line:a].strip() and not text[b : b + 1].strip():
                    f.append("phone|line")
                yield a, b, "phone", f + _around("phone", (before, after))


def _ids(text: str, starts: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int, str, list[str]]]:
    for name, pattern in _IDS:
        for m in _matches(name, pattern, text, starts):
            s = re.sub(r"[^0-9A-Za-z]", "", m[0]).upper()
            f = [f"id|{name}", f"id|{name}|sep={m[0].count(' ') > 0}{m[0].count('-') > 0}"]
            if name == "dni":
                f.append(f"id|dni={dni_letter(str('XYZ'.find(s[0])) + s[1:8] if s[0] in 'XYZ' else s[:8]) == s[8]}")
            if name == "nir":
                n = s[:13].replace("2A", "19").replace("2B", "18")
                f.append(f"id|nir={nir_key(n) == int(s[13:])}")
            if name == "ssn":
                area = "open" if s[0] == "9" else "never" if s[:3] in ("000", "666") or s[3:5] == "00" or s[5:] == "0000" else "given"
                f += [f"id|ssn={area}", f"id|ssn={area}|bare={s == m[0]}"]
            if name == "nino":
                f.append(f"id|nino={not set(s[0]) & set('DFIQUV') and s[1] not in 'DFIOQUV' and s[:2] not in ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ')}")
            if name in ("tax", "ahv"):
                f.append(f"id|{name}={(tax_digit if name == 'tax' else ean_digit)(s[:-1]) == int(s[-1])}|apart={s != m[0]}|one={s[0] == '1'}")
            before, after = _near(text, m.start(), m.end())
            f.append("id|mine=" + ("not" if any(w in NOT_MINE for w in before) else "identity" if any(w in IDENTITY for w in before) else "open"))
            yield m.start(), m.end(), "id_number", f + _around("id", (before, after))


def _streets(text: str, starts: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int, str, list[str]]]:
    for name, pattern in _STREETS:
        for m in _matches(name, pattern, text, starts):
            ends = {m.end()}
            if name == "way":
                # Any number of the words may be the name.
                ends |= {m.start() + x.start() for x in re.finditer(rf"{_GAP}{_NAME}", m[0]) if x.start() > m.end("no") - m.start() + 2 and re.search(rf"{_NAME}$", m[0][: x.start()])}
            if name in ("tail", "before", "lead") and (x := re.search(r" [a-hA-H]$", m[0])):
                ends.add(m.end() - len(x[0]))
            for b in ends:
                words = len(text[m.start() : b].split())
                last = text[m.start() : b].split()[-1].lower()
                f = [f"street|{name}", f"street|{name}|words={min(words, 7)}", f"street|cut={b != m.end()}", f"street|no={min(len(m['no']), 5)}"]
                if name == "after":
                    f.append(f"street|last={last}")
                if name == "tail":
                    head = m[0].split()[0].lower()
                    f.append(f"street|two={not re.search(rf'(?:{_TAIL})', head)}")
                yield m.start(), b, "street", f + _around("street", _near(text, m.start(), b))
                lead = re.match(rf"[{_UP}][\w’'-]*{_GAP}", m[0])
                if name == "tail" and lead and not re.match(r"\d", m[0][lead.end() :]):
                    yield m.start() + lead.end(), b, "street", [f"street|{name}", "street|inner", *_around("street", _near(text, m.start() + lead.end(), b))]


def _persons(text: str, names: Names, starts: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int, str, list[str]]]:
    for name, pattern in _PERSONS:
        for m in _matches(name, pattern, text, starts):
            g, f_, mid = m["g"], m["f"], m["m"].strip()
            gk, fk = names.is_given(g), names.is_family(f_.split()[-1])
            upper = g.isupper() == f_.isupper() or len(g) == 2
            f = [f"person|{name}", f"person|{gk}+{fk}", f"person|g={gk}", f"person|f={fk}", f"person|case={upper}", f"person|{name}|{gk}+{fk}"]
            f.append(f"person|mid={'no' if not mid else 'initial' if len(mid) == 2 else names.is_given(mid)}")
            if " " in f_:
                f.append("person|particle")
            if gk == "other" or fk == "other":
                used = (names.is_common(g), names.is_common(f_.split()[-1]))
                f += [f"person|used={used}", f"person|used={used}|{gk}+{fk}"]
            near = _near(text, m.start(), m.end())
            f.append(f"person|title={any(w in TITLES for w in near[0][:2])}")
            follow = near[1]
            if follow and follow[0].capitalize() in STREET_AFTER:
                f.append("person|street-follows")
            if f_.split()[-1] in STREET_AFTER:
                f.append("person|is-street")
            f.append(f"person|gw={g.lower()}" if gk == "other" else "person|gw")
            f.append(f"person|fw={f_.lower()}" if fk == "other" else "person|fw")
            yield m.start(), m.end(), "person", f + _around("person", near)


def candidates(text: str, names: Names) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of the spans that have the bare form of a kind, by start and end."""
    starts: dict[str, list[tuple[int, int]]] = {}
    found = [*_emails(text), *_persons(text, names, starts)]
    if any(c.isdigit() for c in text):
        found += [*_phones(text), *_ids(text, starts), *_streets(text, starts)]
    one: dict[tuple[int, int, str], list[str]] = {}
    for a, b, k, f in found:
        one.setdefault((a, b, k), f)
    return sorted((a, b, k, f) for (a, b, k), f in one.items())


class Model:
    """Weights of features, trained on made sentences; ``samples`` bounds the training texts.

    ``common`` are words in everyday use, in lower case: capitalised, they may be names but seldom are.
    """

    def __init__(self, given: list[str], family: list[str], samples: int = 4000, epochs: int = 6, seed: int = 7, common: frozenset[str] = frozenset()):
        self.names, self.weights = Names(given, family, common), {}
        maker = Maker(sorted(given), sorted(family), seed, tuple(sorted(common - self.names.given - self.names.family)))
        data = []
        for _ in range(samples):
            text, spans = maker.text()
            truth = {(a, b, k) for k, a, b in spans}
            data.append([((a, b, k) in truth, a, b, f) for a, b, k, f in candidates(text, self.names)])
        seen: dict[str, int] = {}
        for c in data:
            for *_, f in c:
                for x in f:
                    seen[x] = seen.get(x, 0) + 1
        # A feature that few texts have would be learnt by heart.
        data = [[(y, a, b, [x for x in f if seen[x] >= 12]) for y, a, b, f in c] for c in data if c]
        total: dict[str, float] = {}
        for _ in range(epochs):
            for c in data:
                for (y, _a, _b, f), p in zip(c, self._marginals(c), strict=True):
                    d = y - p
                    if abs(d) > 1e-4:
                        for x in f:
                            total[x] = total.get(x, 0.0) + d * d
                            self.weights[x] = self.weights.get(x, 0.0) * (1 - 1e-5) + 0.25 * d / math.sqrt(total[x] + 1e-8)

    def score(self, features: list[str]) -> float:
        w = self.weights
        return sum(w.get(x, 0.0) for x in features) - 1.0

    def _marginals(self, c: list[tuple]) -> list[float]:
        """The probability of each candidate segment, by forward and backward sums over the boundaries."""
        points = sorted({0, *(x for _, a, b, _ in c for x in (a, b))})
        place = {p: i for i, p in enumerate(points)}
        arcs = [(place[a], place[b], max(-30.0, min(30.0, self.score(f)))) for _, a, b, f in c]
        into: list[list[int]] = [[] for _ in points]
        out: list[list[int]] = [[] for _ in points]
        for i, (a, b, _) in enumerate(arcs):
            into[b].append(i)
            out[a].append(i)
        fore, back = [0.0] * len(points), [0.0] * len(points)
        for p in range(1, len(points)):
            fore[p] = _logsum([fore[p - 1], *(fore[arcs[i][0]] + arcs[i][2] for i in into[p])])
        for p in range(len(points) - 2, -1, -1):
            back[p] = _logsum([back[p + 1], *(back[arcs[i][1]] + arcs[i][2] for i in out[p])])
        return [math.exp(fore[a] + s + back[b] - fore[-1]) for a, b, s in arcs]

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the best segmentation's personal segments, in order."""
        if not text:
            return []
        scored = [(b, a, k, s) for a, b, k, f in candidates(text, self.names) if (s := self.score(f)) > 0]
        scored.sort()
        best: list[tuple[int, float, int]] = [(0, 0.0, -1)]  # boundary, score so far, candidate
        back: list[int] = [0]
        for i, (b, a, _, s) in enumerate(scored):
            lo, hi = 0, len(best)
            while lo + 1 < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if best[mid][0] <= a else (lo, mid)
            if best[lo][1] + s > best[-1][1]:
                best.append((b, best[lo][1] + s, i))
                back.append(lo)
        out, at = [], len(best) - 1
        while at > 0:
            b, a, k, _ = scored[best[at][2]]
            out.append((k, a, b))
            at = back[at]
        return out[::-1]


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def model_of(names: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """A model for ``names(name, kind)``, kind ``given`` or ``family``; null and empty names are left out.

    Words in everyday use are the whole words of a public tokenizer's ``vocabulary``, whose file the driver reads.
    """
    rows = names.filter("length(name) > 0 and kind in ('given', 'family')").select("name", "kind").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return Model([r.name for r in rows if r.kind == "given"], [r.name for r in rows if r.kind == "family"], common=common_words(vocabulary))


def found(texts: DataFrame, model: Model) -> DataFrame:
    """(id, pii_kind, start_pos, end_pos) of ``texts(id, text)``: characters from 0, end exclusive.

    Null and empty texts have none. Rows are independent: nothing is shuffled; repeated rows give
    repeated results. The model, of bounded size, is broadcast.
    """
    held = texts.sparkSession.sparkContext.broadcast((model.weights, model.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Model.__new__(Model)
        one.weights, one.names = held.value
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True) for x in one.find(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "pii_kind", "start_pos", "end_pos"])

    return texts.select(F.col("id").cast("long").alias("id"), "text").filter("length(text) > 0").mapInArrow(run, "id long, pii_kind string, start_pos int, end_pos int")


def replaced(texts: DataFrame, model: Model) -> DataFrame:
    """(id, text) with typed placeholders, such as ``[PERSON]``, in the place of personal information.

    All else stays as it is, character for character; null texts stay null, empty ones empty.
    """
    held = texts.sparkSession.sparkContext.broadcast((model.weights, model.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Model.__new__(Model)
        one.weights, one.names = held.value
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                at, parts = 0, []
                for k, s, e in one.find(t):
                    parts += [t[at:s], f"[{k.upper()}]"]
                    at = e
                out.append(None if t is None else "".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["id", "text"])

    return texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, text string")
