"""Garbled text from wrong character encoding: found, and restored where possible.

A garbled text is bytes of one encoding shown by another. Its characters are mapped back to the
bytes that a legacy encoding (a view) shows as them; over these bytes an automaton, the byte
structure of UTF-8 or of an East Asian encoding, finds the maximal well-formed multibyte spans, and
only those are decoded. The view that explains most of a text goes first; rounds repeat until
nothing more is explained, so text garbled twice comes back too. Encodings of one byte have no
structure: there the same map gives whole words, and letter pairs (``letters``) decide whether
these, taken together, are far more likely words of the other encoding's languages than what they
show now.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm import letters

#: Encodings of one byte that a text may have been decoded with. ``latin`` is Windows-1252 with ISO 8859-1 where that has no character.
VIEWS = ("latin", "cp1251", "cp437", "mac_roman", "cp850", "cp1250", "koi8_r", "cp866", "cp1253", "cp1254", "iso8859_2")
#: Those of two bytes.
WIDE_VIEWS = ("gbk", "cp932", "big5", "cp949")
#: Views with a script of their own.
OF_SCRIPTS = ("cp1251", "koi8_r", "cp866", "cp1253")
#: Encodings of two bytes that a text shown as ``latin`` may have: their lead bytes, trail bytes, and the signs they write.
PAIRED = {
    "gb18030": (((0x81, 0xFE),), ((0x40, 0x7E), (0x80, 0xFE)), "chinese"), "big5": (((0xA1, 0xF9),), ((0x40, 0x7E), (0xA1, 0xFE)), "traditional"), "cp932": (((0x81, 0x9F), (0xE0, 0xEF)), ((0x40, 0x7E), (0x80, 0xFC)), "japanese"),
    "euc_jp": (((0xA1, 0xF4),), ((0xA1, 0xFE),), "japanese"), "cp949": (((0xA1, 0xC8),), ((0xA1, 0xFE),), "korean"),
}
#: (view, encoding, group of languages) of texts of one byte a character; the first three groups have scripts of their own.
SINGLE = (
    ("latin", "cp1251", "cyrillic"), ("latin", "koi8_r", "cyrillic"), ("latin", "iso8859_5", "cyrillic"), ("latin", "cp866", "cyrillic"), ("latin", "cp1253", "greek"), ("latin", "iso8859_7", "greek"), ("cp1251", "koi8_r", "cyrillic"), ("koi8_r", "cp1251", "cyrillic"), ("cp866", "cp1251", "cyrillic"), ("cp1251", "cp866", "cyrillic"),
    ("latin", "iso8859_2", "central"), ("latin", "cp1250", "central"), ("latin", "iso8859_9", "turkish"),
)
ROUNDS = 4
#: What whole words must gain in log chance: together, and for each letter that changes, where these become another script,
#: where words keep plain letters, and where they stay in one script (whose odd case tells).
GAIN, GAIN_WHOLE, GAIN_PART, GAIN_SAME = 10.0, 3.5, 3.0, 2.0
#: Letters that must change: in words of three letters or more of a script of its own, or in words with plain letters.
LEAST_LETTERS, LEAST_CHANGED = 5, 2
#: The least signs of an East Asian text, and the share of them that must be everyday ones.
LEAST_SIGNS, EVERYDAY = 3, 0.5


def _char(view: str, byte: int) -> str | None:
    try:
        return bytes([byte]).decode("cp1252" if view == "latin" else view)
    except UnicodeDecodeError:
        return None


@cache
def _bytes_of(view: str) -> dict[str, int]:
    """The byte of each character; ISO 8859-1's controls stand for their bytes under any encoding of that family."""
    table = {c: b for b in range(0x80, 0x100) if (c := _char(view, b))}
    if view.startswith(("latin", "cp125", "iso")):
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


def _class(table: dict[str, int], *ranges: tuple[int, int]) -> str:
    return "[" + "".join(re.escape(c) for c, b in table.items() if any(lo <= b <= hi for lo, hi in ranges)) + "]"


@cache
def _utf8(view: str) -> re.Pattern:
    """The well-formed multibyte sequences of UTF-8 over a view's characters, as many as stand together."""
    of = lambda lo, hi: _class(_bytes_of(view), (lo, hi))
    tail = of(0x80, 0xBF)
    rows = [(of(0xC2, 0xDF), tail)]
    rows += [(of(0xE0, 0xE0), of(0xA0, 0xBF), tail), (of(0xE1, 0xEC), tail, tail), (of(0xED, 0xED), of(0x80, 0x9F), tail), (of(0xEE, 0xEF), tail, tail)]
    rows += [(of(0xF0, 0xF0), of(0x90, 0xBF), tail, tail), (of(0xF1, 0xF3), tail, tail, tail)]
    # A second byte that is a no-break space often became a plain one; the last group takes these.
    return re.compile("(?:" + "|".join("".join(r) for r in rows if "[]" not in r) + ")+|(" + _class(_bytes_of(view), (0xC3, 0xC3), (0xD0, 0xD0)) + " )")


@cache
def _ends(view: str) -> tuple[frozenset[str], frozenset[str]]:
    """The characters that first and further bytes show as: a text without both has no sequence."""
    table = _bytes_of(view)
    return frozenset(c for c, b in table.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in table.items() if b <= 0xBF)


@cache
def _letters_of(view: str) -> re.Pattern:
    """A view's own characters; of one with a script of its own, that script's letters."""
    return re.compile("[" + "".join(re.escape(c) for c in _bytes_of(view) if view not in OF_SCRIPTS or "\u0370" <= c <= "\u052f") + "]")


_UTF8_BYTES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")
#: Characters that text is likely to hold: letters of European scripts and their marks, punctuation, what
#: prints nothing, full-width forms; further scripts count where two characters stand together.
_LIKELY = re.compile("[\u0080-\u00a7\u00a9-\u00ae\u00b0-\u00b3\u00b5-\u00b7\u00b9-\u017f\u0192\u0218-\u021b\u02c6\u02dc\u0300-\u036f\u0386-\u03ce\u0401-\u045f\u1e00-\u1fff\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u2190-\u2212\u3000\ufb00-\ufb06\ufeff\uff01-\uff5e\ufffd]+")
_RUNS = re.compile("[\u0590-\u06ff\u0900-\u0dff\u0e00-\u0e7f]{2,}|[\u3001-\u30ff\u3400-\u9fff\uac00-\ud7a3]{2,}|[\U0001f300-\U0001faff]+")
#: Marks that stand alone; only text that went through Windows-1252 twice has them in between.
_MARKS = re.compile("[\u00a8\u00af\u00b4\u00b8]+")
_WIDE, _EAST = re.compile(r"[^\x00-\x7f]+"), re.compile("[\u2e80-\u9fff\uac00-\ud7a3\uff61-\uff9f]")
# What no text of whole words in another script, nor of East Asian signs, is without.
_CLOSE = re.compile(r"[^\x00-\x7f]{3}")
_C1 = re.compile("[\u0080-\u0084\u0086-\u009f]")


def _likely(text: str, marks: bool) -> bool:
    rest = _RUNS.sub("", _LIKELY.sub("", text))
    return not (_MARKS.sub("", rest) if marks else rest)


def _pass(text: str, view: str) -> tuple[str, int]:
    """The text with the spans decoded that are UTF-8 under a view, and the characters that these took.

    A view with a script of its own must explain half of that script's letters: these stand beside
    no-break spaces and quotation marks in correct text.
    """
    table, taken, sure = _bytes_of(view), 0, False

    def decoded(m: re.Match) -> str:
        nonlocal taken
        out = bytes(0xA0 if c == " " else table[c] for c in m[0]).decode("utf-8")
        if m[1] and not sure:
            return m[0]
        if view in OF_SCRIPTS and len(m[0]) == 2 and m[0][1] in " \xa0":
            # A letter and a blank: in the middle of a Latin word, or an accented letter by itself, or beside other spans.
            alone = view != "cp1251" or not (sure or "À" <= out <= "ÿ" or re.match("[A-Za-z]", text[max(m.start() - 1, 0) :]))
            if alone:
                return m[0]
        if not _likely(out, view == "latin"):
            return m[0]
        taken += len(m[0])
        return out

    out = _utf8(view).sub(decoded, text)
    if not taken or view in OF_SCRIPTS and 2 * taken < len(_letters_of(view).findall(text)):
        return text, 0
    # Where other spans show the view, what ends in a blank belongs to it too.
    sure, taken = True, 0
    return _utf8(view).sub(decoded, text), taken


def _wide_pass(text: str, view: str) -> tuple[str, int]:
    """The same under a view of two bytes: runs of three signs or more, or signs between small Latin letters that become such letters."""
    taken = 0

    def decoded(m: re.Match) -> str:
        nonlocal taken
        try:
            raw = m[0].encode(view)
        except UnicodeEncodeError:
            return m[0]
        span = _UTF8_BYTES.match(raw)
        if span is None:
            return m[0]
        out, rest = span[0].decode("utf-8"), raw[span.end() :]
        beside = text[max(m.start() - 1, 0) : m.start()] + text[m.end() : m.end() + 1]
        inside = len(m[0]) < LEAST_SIGNS and not rest and re.search("[a-z]", beside) and re.fullmatch("[ß-öø-ÿāăąćčďđēęěğīıłńňōőœřśşšťūůűźżž]+", out)
        if not inside and (len(span[0]) < 2 * LEAST_SIGNS or len(rest) > 2 or not _likely(out, False) or len(out) * 3 > len(span[0]) * 2):
            return m[0]
        taken += len(m[0])
        return out + (rest.decode(view, "replace") if rest else "")

    return _WIDE.sub(decoded, text), taken


@cache
def _pairs(encoding: str) -> re.Pattern:
    """Maximal runs of an encoding's two-byte sequences over the ``latin`` view, not in the middle of a plain word."""
    leads, trails, _ = PAIRED[encoding]
    table = _bytes_of("latin") | {chr(b): b for b in range(0x40, 0x7F)}
    lead, trail = _class(_bytes_of("latin"), *leads), _class(table, *trails)
    return re.compile(f"(?<![A-Za-z])(?:{lead}{trail})+")


def _paired_pass(text: str) -> tuple[str, int]:
    """The text with the spans decoded of the East Asian encoding that explains it best, if one does, and the characters that these took."""
    best, found, taken = 0.0, text, 0
    table = _bytes_of("latin")
    for encoding, (_, _, group) in PAIRED.items() if _CLOSE.search(text) else ():
        chance, never = letters.signs(group)
        signs, spans = "", []
        for m in _pairs(encoding).finditer(text):
            try:
                out = bytes(table.get(c, ord(c) & 0xFF) for c in m[0]).decode(encoding)
            except UnicodeDecodeError:
                continue
            if len(out) > 1:
                spans.append((m.start(), m.end(), out))
                signs += out
        # Marks of punctuation say little: they count for neither side.
        told = [c for c in signs if c.isalpha()]
        known = sum(c in chance for c in told)
        gain = sum(chance.get(c, never) for c in told) / max(len(told), 1) + len(told) / 1000
        if len(told) >= LEAST_SIGNS and known >= EVERYDAY * len(told) and len(told) * 2 >= len(signs) and (found is text or gain > best):
            at, parts = 0, []
            for a, b, out in spans:
                parts += [text[at:a], out]
                at = b
            best, found, taken = gain, "".join(parts) + text[at:], sum(b - a for a, b, _ in spans)
    return found, taken


#: Signs that stand at words' edges in correct text.
_EDGES = "¿¡«»®©²³¹ªº´¨¸·°"


@cache
def _words(view: str, encoding: str, whole: bool) -> tuple[re.Pattern, dict[int, str]]:
    """Words of a view that another encoding's letters may be, and what each character then is."""
    table, turned = _bytes_of(view), {}
    for c, b in table.items():
        d = _char(encoding, b)
        if d and d.isalpha() and not (whole and d.isascii()):
            turned[ord(c)] = d
    inside = "".join(re.escape(chr(c)) for c in turned)
    return re.compile(f"(?<![A-Za-z])[{inside}]+(?![A-Za-z])" if whole else f"[A-Za-z{inside}]*[{inside}][A-Za-z{inside}]*"), turned


def _single_pass(text: str) -> tuple[str, int]:
    """The text with the words turned of the encoding of one byte whose languages explain them best, if by enough, and the letters that changed."""
    best, found, taken = 0.0, text, 0
    close = _CLOSE.search(text)
    for view, encoding, group in SINGLE:
        whole = group in ("cyrillic", "greek")
        if whole and not close:
            continue
        pattern, turned = _words(view, encoding, whole)
        now = ("western", "central", "turkish") if view == "latin" else ("cyrillic",)
        total, changed = 0.0, 0
        for word in dict.fromkeys(pattern.findall(text)):
            other, bare = word.translate(turned), word.strip(_EDGES)
            if other == word or whole and len(word) < 3 or not whole and bare.translate(turned) == bare and word[0] != "¿":
                continue
            total += letters.score(group, other) - max(letters.score(g, bare or word) for g in now)
            changed += sum(a != b for a, b in zip(word, other, strict=True))
        if changed >= (LEAST_LETTERS if whole else LEAST_CHANGED) and total > best and total >= GAIN and total >= changed * (GAIN_PART if not whole else GAIN_WHOLE if view == "latin" else GAIN_SAME):
            best, found, taken = total, pattern.sub(lambda m, turned=turned: m[0].translate(turned), text), changed
    return found, taken


def restore(text: str | None) -> tuple[str | None, bool]:
    """(restored text, affected). Null and plain ASCII text is returned as it is.

    Affected is what changes, what holds a replacement character (which can't be restored), and
    what holds C1 controls (which text has none of; shown by Windows-1252 where that has them).
    """
    if not text or text.isascii():
        return text, False
    out = text
    for _ in range(ROUNDS):
        held = set(out)
        tried = [(*_pass(out, v), -i) for i, v in enumerate(VIEWS) if not any(map(held.isdisjoint, _ends(v)))] or [(out, 0, 0)]
        if _EAST.search(out):
            tried += [(*_wide_pass(out, v), -len(VIEWS) - i) for i, v in enumerate(WIDE_VIEWS)]
        shown, taken, view = max(tried, key=lambda x: x[1:])
        if not taken or -view < len(VIEWS) and 2 * taken < len(_letters_of(VIEWS[-view]).findall(out)):
            # What UTF-8 explains little of may be text of another encoding, in which its sequences stand by chance.
            other, changed = max(_paired_pass(out), _single_pass(out), key=lambda x: x[1])
            shown, taken = (other, changed) if changed > 2 * taken else (shown, taken)
        if not taken:
            break
        out = shown
    out = _C1.sub(lambda m: _char("latin", ord(m[0])) or m[0], out)
    return out, out != text or "�" in out or bool(_C1.search(out))


def _batches(run: Callable[[str | None], tuple[str | None, bool]]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [run(t) for t in b.column("value").to_pylist()]
            cols = [b.column("field_name"), b.column("row_id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["field_name", "row_id", "restored", "affected"])

    return each


def restored(values: DataFrame) -> DataFrame:
    """(field_name, row_id, restored, affected) of ``values(field_name, row_id BIGINT, value)``.

    Rows are independent: nothing is shuffled. ASCII values don't leave the JVM; null values give
    null and are not affected; repeated rows give repeated results.
    """
    schema = "field_name string, row_id long, restored string, affected boolean"
    plain = F.coalesce(~F.col("value").rlike(r"[^\x00-\x7F]"), F.lit(True))
    kept = values.select("field_name", F.col("row_id").cast("long").alias("row_id"), "value")
    return kept.filter(~plain).mapInArrow(_batches(restore), schema).unionByName(kept.filter(plain).select("field_name", "row_id", F.col("value").alias("restored"), F.lit(False).alias("affected")))


def long_form(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field_name, row_id, value): one row for each field of each row that has a value."""
    each: list[Column] = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]
    return df.select(F.col(key).alias("row_id"), F.explode(F.array(*each)).alias("v")).select("v.field_name", "row_id", "v.value").filter("value is not null")
