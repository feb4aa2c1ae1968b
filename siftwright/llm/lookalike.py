"""Visually identical text with different characters, brought to one form.

Compatibility normalisation takes width, ligatures and kinds of blank away; what prints nothing is
deleted. Letters of other scripts that are drawn like Latin ones stay open: each token is a lattice
of its letters' readings, and the best path is found by Viterbi under character n-gram scores of
each script, which are counted over all values, with a price for a change of script.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters drawn like Latin ones, with those Latin letters.
CYRILLIC = ("аеорсухіјѕһԁԛԝѵӏукАВЕКМНОРСТУХІЈЅԀԚԜѴҮӀԌ", "aeopcyxijshdqwvlykABEKMHOPCTYXIJSDQWVYIG")
GREEK = ("ονραικυγηϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿͿ", "ovpaikuyncjABEZHIKMNOPTYXCCJ")
ARMENIAN = ("օսհոցզՕՍՏԼ", "ouhngqOUSL")
CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHiJKLMPRSTVWZ")
LOOKALIKES: dict[str, str] = {}
for _from, _to in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE):
    LOOKALIKES |= dict(zip(_from, _to, strict=True))
# Hyphens and dashes, blanks that compatibility normalisation leaves, apostrophes.
FLAT = str.maketrans({**dict.fromkeys("‐‑‒–−˗⁃﹘", "-"), **dict.fromkeys("   \t", " "), "ʼ": "’"})
_SCRIPTS = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "ARMENIAN": "A", "CHEROKEE": "K"}
#: Price of reading a letter as another, of a change of script inside a token, and the score of an n-gram never seen.
READ, SWITCH, UNSEEN = 0.5, 6.0, -9.0


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    """L, C, G, A, K for the scripts of the lattice, else empty."""
    return _SCRIPTS.get(unicodedata.name(c, "").split(" ")[0], "") if c.isalpha() else ""


@lru_cache(maxsize=65536)
def _silent(c: str) -> bool:
    """Whether a character prints nothing: controls, format characters, variation selectors and fillers."""
    kind = unicodedata.category(c)
    return kind in ("Cf", "Cc") and c not in "\t\n\r" or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️" or "᠋" <= c <= "᠏" or "\U000e0100" <= c <= "\U000e01ef"


def shown(host: str) -> str:
    """A host as a reader sees it: labels in their ASCII form are decoded; those that can't be stay."""
    out = []
    for label in host.split("."):
        if label[:4].lower() == "xn--":
            try:
                label = label[4:].encode("ascii").decode("punycode")
            except UnicodeError:
                pass
        out.append(label)
    return ".".join(out)


def compatible(text: str) -> str:
    """Without what prints nothing, with compatibility forms, kinds of blank and of hyphen made one; accents apart."""
    if text.isascii() and text.isprintable():
        return text
    flat = "".join(c for c in unicodedata.normalize("NFKD", "".join(c for c in text if not _silent(c))) if not _silent(c))
    return flat.translate(FLAT)


def pairs_of(text: str) -> Iterator[tuple[str, str, str]]:
    """(script, letter, next letter) of neighbouring letters of one script; a blank marks a token's ends."""
    before = " "
    for c in compatible(text) + " ":
        if unicodedata.combining(c):
            continue
        s = script(c)
        if s and (before == " " or script(before) == s):
            yield s, before, c
        elif not s and before != " ":
            yield script(before), before, " "
        before = c if s else " "


class Reader:
    """The best reading of a value, under a model of log scores by (script, letter, next letter)."""

    def __init__(self, scores: dict[tuple[str, str, str], float]):
        self.scores = scores

    def _step(self, a: str, b: str) -> float:
        sa, sb = script(a), script(b)
        if not sa and not sb:
            return 0.0
        if sa and sb and sa != sb:
            return UNSEEN - SWITCH
        s = sa or sb
        return self.scores.get((s, a if sa else " ", b if sb else " "), UNSEEN)

    def token(self, letters: list[str], latin: bool = False) -> tuple[float, list[str]]:
        """Viterbi over the lattice of a token's letters, of Latin readings only if so asked; of equal paths the first."""
        layer = {" ": (0.0, [])}
        for c in letters:
            options = [(c, 0.0)] * (not latin or script(c) == "L") + ([(LOOKALIKES[c], READ)] if c in LOOKALIKES else [])
            layer = {o: max(((v + self._step(p, o) - price, path + [o]) for p, (v, path) in layer.items()), key=lambda x: x[0]) for o, price in options}
        return max(((v + self._step(p, " "), path) for p, (v, path) in layer.items()), key=lambda x: x[0])

    def read(self, text: str) -> str:
        """The consistent form of a text: accents composed, tokens read, all else as :func:`compatible` has it.

        A token that can be Latin throughout is read so beside Latin tokens, unless its own script
        scores better by more than the price of a change.
        """
        flat = compatible(text)
        if flat.isascii():
            return flat
        chars, marks, begin = list(flat), [i for i, c in enumerate(flat) if not unicodedata.combining(c)], 0
        other: list[tuple[list[int], float, list[str]]] = []
        beside = False
        while begin < len(marks):
            end = begin
            while end < len(marks) and script(chars[marks[end]]):
                end += 1
            at = marks[begin:end]
            if any(chars[i] in LOOKALIKES for i in at):
                letters = [chars[i] for i in at]
                score, path = self.token(letters)
                if all(script(c) != "L" for c in path) and all(c in LOOKALIKES for c in letters):
                    other.append((at, score, letters))
                else:
                    beside |= all(script(c) == "L" for c in path)
                    for i, c in zip(at, path, strict=True):
                        chars[i] = c
            else:
                beside |= any(script(chars[i]) == "L" for i in at)
            begin = max(end, begin + 1)
        for at, score, letters in other if beside else ():
            latin, path = self.token(letters, latin=True)
            if latin + SWITCH * 2 >= score:
                for i, c in zip(at, path, strict=True):
                    chars[i] = c
        return unicodedata.normalize("NFC", "".join(chars))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: dict[tuple[str, str, str], int] = {}
        for v, n in zip(b.column("value").to_pylist(), b.column("n").to_pylist(), strict=True):
            for p in pairs_of(v):
                found[p] = found.get(p, 0) + n
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(found.values(), pa.int64())], names=["s", "a", "b", "n"])


def letter_model(values: DataFrame, names: DataFrame, weight: int = 20) -> dict[tuple[str, str, str], float]:
    """Log scores of letter pairs of each script, over all of ``values(value, n)`` and the watched ``names(value)``.

    Only pairs of letters of five scripts count, so the table is bounded by the squares of their
    alphabets. Watched names count ``weight`` times: readings that spell one are preferred.
    """
    counted = values.select("value", "n").unionByName(names.select("value", F.lit(weight).cast("long").alias("n")))
    rows = counted.mapInArrow(_pairs, "s string, a string, b string, n long").groupBy("s", "a", "b").agg(F.sum("n").alias("n")).collect()
    before: dict[tuple[str, str], int] = {}
    for r in rows:
        before[r.s, r.a] = before.get((r.s, r.a), 0) + r.n
    return {(r.s, r.a, r.b): math.log((r.n + 0.1) / (before[r.s, r.a] + 10)) for r in rows}


def consistent(values: DataFrame, names: DataFrame) -> tuple[DataFrame, Reader]:
    """((field_name, value, form), reader) of the distinct values of ``values(field_name, value)``.

    ``names(value)`` are spellings under watch. Hosts (field ``host``) are taken as shown to a reader.
    """
    distinct = values.filter("value is not null").groupBy("field_name", "value").agg(F.count("*").alias("n"))
    reader = Reader(letter_model(distinct, names))
    return _formed(distinct, reader), reader


def _formed(values: DataFrame, reader: Reader) -> DataFrame:
    """``values(field_name, value, ...)`` as (field_name, value, form), in Arrow batches; the scores, of bounded size, are broadcast."""
    held = values.sparkSession.sparkContext.broadcast(reader.scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Reader(held.value)
        for b in batches:
            kinds, texts = b.column("field_name").to_pylist(), b.column("value").to_pylist()
            forms = [one.read(shown(t) if k == "host" else t) for k, t in zip(kinds, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("field_name"), b.column("value"), pa.array(forms, pa.string())], names=["field_name", "value", "form"])

    return values.select("field_name", "value").mapInArrow(run, "field_name string, value string, form string")


def look_alikes(values: DataFrame, watch: DataFrame) -> DataFrame:
    """(field_name, row_id, watch_id): values that look like a watched name but are another string.

    ``values(field_name, row_id, value)``, ``watch(watch_id, field_name, canonical)``. Null and
    empty values look like nothing; letter case, accents and other ASCII characters are visible. A
    value that looks like several watched names gives a row for each. Each distinct value is read
    once; the join back is on the distinct values, of which only those that look like a watched
    name remain.
    """
    watch = watch.filter("canonical is not null and canonical <> ''")
    forms, reader = consistent(values, watch.select(F.col("canonical").alias("value")))
    spelt = _formed(watch.select("field_name", F.col("canonical").alias("value")).distinct(), reader).withColumnRenamed("value", "canonical")
    spelt = watch.select("watch_id", "field_name", "canonical").join(spelt, ["field_name", "canonical"])
    hits = forms.join(spelt, ["field_name", "form"]).filter("value <> canonical").select("field_name", "value", "watch_id")
    return values.join(hits, ["field_name", "value"]).select("field_name", "row_id", "watch_id")
