"""Domains: of addresses, and organisational ones by public suffixes.

Which suffixes are public is settled by rules in this module (generic second labels under country
codes, shared hosting) or, where the session's ``spark.siftwright.suffixList`` names a file in the
form of the public suffix list (https://publicsuffix.org), by that file. Nothing depends on what an
installation of Spark happens to hold.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting that names a list of one's own, on any file system that Spark reads.
LIST_CONF = "spark.siftwright.suffixList"
#: Rules that a list may have; a longer file isn't one.
MOST_RULES = 100_000
# Second labels that are public under any country code; further ones, by country code; country codes that
# give out every second label to anybody; names under these that nobody else's are under; hosts that people share.
SECOND = "ac co com edu go gob gouv gov govt gv mil ne net nom or org".split()
ALSO = {
    "uk": "ltd me nhs plc police sch", "jp": "ad ed gr lg", "au": "asn id", "nz": "cri geek gen health iwi kiwi maori parliament school", "za": "law school web", "in": "firm gen ind nic res", "kr": "es hs kg ms pe re sc",
    "br": "adv art blog eco ind inf jus leg tv", "id": "biz desa my sch web", "il": "idf k12 muni", "th": "in mi", "tr": "bel gen info k12 name pol web", "tw": "club game idv", "hk": "idv", "sg": "per", "pl": "biz info waw", "hu": "info", "fr": "asso prd tm", "at": "priv",
}
OPEN = "bd ck er fk jm kh mm np pg".split()
KEPT = ("www.ck",)
SHARED = (
    "appspot.com azurewebsites.net blob.core.windows.net blogspot.com cloudapp.net cloudfront.net firebaseapp.com fly.dev github.io gitlab.io glitch.me herokuapp.com myshopify.com netlify.app ngrok.io onrender.com pages.dev r2.dev "
    "repl.co s3.amazonaws.com surge.sh trycloudflare.com vercel.app web.app weebly.com wixsite.com wordpress.com workers.dev uk.com us.com eu.com de.com"
).split()


def suffix_pattern() -> str:
    """What a host ends in: its public suffix by the rules of this module, and one label more if there is one."""
    dots = lambda names: "|".join(n.replace(".", r"\.") for n in names)
    rules = [dots(SHARED), rf"(?:{dots(sorted(set(SECOND)))})\.[a-z]{{2}}", *(rf"(?:{dots(more.split())})\.{cc}" for cc, more in ALSO.items()), rf"(?!(?:{dots(KEPT)})$)[^.]+\.(?:{dots(OPEN)})"]
    return rf"(?:[^.]+\.)?(?:{'|'.join(rules)}|[^.]+)$"


def domain_of(address: Column) -> Column:
    """What follows the last ``@``, in lower case, without closing bracket and final dot; null where there is none."""
    tail = F.regexp_replace(F.trim(F.substring_index(address, "@", -1)), r"[>]+$", "")
    return F.when(F.contains(address, F.lit("@")), F.nullif(F.lower(F.regexp_replace(tail, r"\.+$", "")), F.lit("")))


def _clean(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r"\.+$", "")


def _ascii(rule: str) -> str:
    return ".".join(x if x == "*" or x.isascii() else "xn--" + x.encode("punycode").decode() for x in rule.split("."))


def parse_suffix_list(text: str) -> dict[str, int]:
    """Rules of a public suffix list: 1 exact, 2 wildcard, 4 exception; a name under several kinds adds these up.

    Rules count in their Unicode and their ASCII form; comments and blank lines count for nothing.
    """
    rules: dict[str, int] = {}
    for line in text.splitlines():
        rule = line.strip().split(" ")[0].lower()
        if rule and not rule.startswith("//"):
            bit, body = (4, rule[1:]) if rule[0] == "!" else (2, rule[2:]) if rule.startswith("*.") else (1, rule)
            for form in {body, _ascii(body)}:
                rules[form] = rules.get(form, 0) | bit
    return rules


_LISTS: dict[tuple[str, str], object] = {}


def suffix_rules(spark: SparkSession) -> dict[str, int] | None:
    """The rules of the list that the session names; null where it names none."""
    held = _list(spark)
    return held.value if held else None


def _list(spark: SparkSession):
    path, app = spark.conf.get(LIST_CONF, None), spark.sparkContext.applicationId
    if not path:
        return None
    if (app, path) not in _LISTS:
        lines = spark.read.text(path).limit(MOST_RULES + 1).collect()
        if len(lines) > MOST_RULES:
            raise ValueError(f"{path} has over {MOST_RULES} lines: no list of public suffixes")
        _LISTS[app, path] = spark.sparkContext.broadcast(parse_suffix_list("\n".join(r.value for r in lines)))
    return _LISTS[app, path]


@cache
def _built_in() -> re.Pattern:
    return re.compile(suffix_pattern())


def registrable(host: str | None, rules: dict[str, int] | None = None) -> str | None:
    """The public suffix of a host and one label more; the host itself where it is a suffix or one label."""
    host = (host or "").lower().strip().rstrip(".")
    if not host:
        return None
    if rules is None:
        found = _built_in().search(host)
        return found[0] if found else host
    labels = host.split(".")
    cut = len(labels) - 1
    for i in range(len(labels)):
        here, above = rules.get(".".join(labels[i:]), 0), rules.get(".".join(labels[i + 1 :]), 0)
        if here & 4:
            cut = i + 1
            break
        if here & 1 or above & 2:
            cut = i
            break
    return ".".join(labels[max(cut - 1, 0) :])


def org_domain(spark: SparkSession):
    """A function of a host column: one built-in expression, or an Arrow function over the list that the session names."""
    held = _list(spark)
    if held is None:
        pattern = suffix_pattern()

        def built_in(host: Column | str) -> Column:
            clean = _clean(F.col(host) if isinstance(host, str) else host)
            return F.nullif(F.regexp_extract(clean, pattern, 0), F.lit(""))

        return built_in

    @F.pandas_udf("string")
    def listed(host: pd.Series) -> pd.Series:
        rules, seen = held.value, {}
        return host.map(lambda h: seen[h] if h in seen else seen.setdefault(h, registrable(h, rules)))

    return listed


def with_org_domain(df: DataFrame, host: str, out: str) -> DataFrame:
    return df.withColumn(out, org_domain(df.sparkSession)(F.col(host)))


def org_domain_by_join(df: DataFrame, host: str, rules: DataFrame, out: str) -> DataFrame:
    """The same by a join with ``rules(suffix, bits)``: the longest matching suffix of each distinct host wins.

    For rule tables of one's own; all of it stays in the JVM.
    """
    hosts = df.select(F.col(host).alias("_h"), _clean(F.col(host)).alias("_host")).filter("_host <> ''").distinct()
    labels = F.split("_host", r"\.")
    tails = hosts.select("_h", "_host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("i", "suffix"))
    bits = tails.join(rules.withColumnRenamed("bits", "own"), "suffix", "left")
    bits = bits.withColumn("above", F.regexp_extract("suffix", r"^[^.]*\.(.*)$", 1)).join(rules.select(F.col("suffix").alias("above"), F.col("bits").alias("over")), "above", "left")
    cut = F.when(F.col("own").bitwiseAND(F.lit(4)) > 0, F.col("i") + 1).when((F.col("own").bitwiseAND(F.lit(1)) > 0) | (F.col("over").bitwiseAND(F.lit(2)) > 0), F.col("i"))
    best = bits.groupBy("_h", "_host").agg(F.min_by(cut, F.when(cut.isNotNull(), F.col("i"))).alias("cut"))
    at = F.greatest(F.coalesce("cut", F.size(labels) - 1) - 1, F.lit(0))
    named = best.select(F.col("_h").alias(host), F.array_join(F.slice(labels, at + 1, F.size(labels)), ".").alias(out))
    return df.join(named, host, "left")
