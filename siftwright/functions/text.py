"""Column expressions over text: what is invisible in it, and escapes for outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that split keywords unseen (the joiner of emoji is not among them), and direction controls.
ZERO_WIDTH = "​‌⁠᠎­﻿"
BIDI = "‪‫‬‭‮⁦⁧⁨⁩"
_HIDDEN = rf"[{ZERO_WIDTH}{BIDI}‍\x00-\x08\x0a-\x1f\x7f-\x9f]"


def _count(col: Column, chars: str) -> Column:
    return (F.length(col) - F.length(F.translate(col, chars, ""))).cast("int")


def zero_width_count(col: Column) -> Column:
    """How many zero-width characters a text holds; a leading byte order mark is none of them; 0 for null."""
    return F.coalesce(_count(F.regexp_replace(col, "^﻿", ""), ZERO_WIDTH), F.lit(0))


def bidi_count(col: Column) -> Column:
    """How many direction controls a text holds; 0 for null."""
    return F.coalesce(_count(F.regexp_replace(col, "^﻿", ""), BIDI), F.lit(0))


def safe_display(col: Column) -> Column:
    r"""A text in which what is hidden shows as ``\uXXXX``; empty for null."""
    shown = F.transform(F.split(col, ""), lambda c: F.when(c.rlike(_HIDDEN), F.concat(F.lit("\\u"), F.lower(F.hex(F.encode(c, "UTF-16BE"))))).otherwise(c))
    return F.coalesce(F.when(col.rlike(_HIDDEN), F.array_join(shown, "")).otherwise(col), F.lit(""))


def csv_safe(col: Column) -> Column:
    """A value that no spreadsheet takes for a formula."""
    return F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)


def cef_escape(col: Column, header: bool = False) -> Column:
    """A value of a CEF extension, or of its header."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), r"\\", r"\\\\"), r"[\r\n]", " ")
    return F.regexp_replace(flat, r"\|", r"\\|") if header else F.regexp_replace(flat, "=", r"\\=")


def stix_escape(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"\\", r"\\\\"), "'", r"\\'")


def html_escape(col: Column) -> Column:
    out = safe_display(col)
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def defang(col: Column) -> Column:
    """An address or URL that nobody follows by accident."""
    out = F.regexp_replace(col, r"(?i)\bhttp(s?)://", "hxxp$1://")
    out = F.regexp_replace(out, r"(?i)\bftp://", "fxp://")
    return F.replace(F.replace(out, F.lit("."), F.lit("[.]")), F.lit("@"), F.lit("[@]"))


def email_addresses(col: Column) -> Column:
    """The addresses in a text, in lower case and in their order; an empty array for none, null for null."""
    return F.transform(F.regexp_extract_all(col, F.lit(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), F.lit(0)), lambda x: F.lower(x))


def word_set(col: Column) -> Column:
    """The distinct words of three letters or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"\p{L}{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """The similarity of two arrays of distinct values; null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def visible_text(html: Column) -> Column:
    """A quick text of HTML: without scripts, styles, comments and tags, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))
