"""Queries of the text problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import encoding, lookalike, mixing, neardup, packing, pii, spans
from siftwright.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, text): the subject of the body's report, a blank and the preview."""
    bodies = table(spark, sf_dir, "text_bodies").select("body_id", "report_id", "preview").filter("length(preview) > 0")
    subjects = table(spark, sf_dir, "messages").select("report_id", "subject")
    return bodies.join(subjects, "report_id", "left").select(F.col("body_id").alias("rid"), F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.col("preview")).alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of bodies whose records share at least half of their three-word sequences."""
    return neardup.NearDuplicates(_records(spark, sf_dir), n=3, jaccard=0.5).pairs().select(F.col("a").alias("body_a"), F.col("b").alias("body_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body's group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return neardup.NearDuplicates(_records(spark, sf_dir)).groups().withColumnRenamed("rid", "body_id")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = encoding.long_form(table(spark, sf_dir, "messages"), "delivery_id", ["from_display_name", "subject"])
    return messages.unionByName(encoding.long_form(table(spark, sf_dir, "urls"), "url_id", ["host"]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that look like a name under watch but are another string."""
    return lookalike.look_alikes(_names(spark, sf_dir), table(spark, sf_dir, "watch_names"))


def p4_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every distinct display name, subject and host."""
    watch = table(spark, sf_dir, "watch_names").select(F.col("canonical").alias("value"))
    return lookalike.consistent(_names(spark, sf_dir), watch)[0]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = encoding.long_form(table(spark, sf_dir, "messages"), "delivery_id", ["subject", "from_display_name"])
    return messages.unionByName(encoding.long_form(table(spark, sf_dir, "text_bodies"), "body_id", ["preview"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of which at least a part was decoded with the wrong encoding."""
    return encoding.restored(_texts(spark, sf_dir)).filter("affected").select("field_name", "row_id")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected values with their original text, as far as it can be restored."""
    return encoding.restored(_texts(spark, sf_dir)).filter("affected").select("field_name", "row_id", "restored")


def _previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_bodies").select(F.col("body_id").alias("id"), F.col("preview").alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of personal information in the previews."""
    return pii.found(_previews(spark, sf_dir), pii.model_of(table(spark, sf_dir, "person_names"))).withColumnRenamed("id", "body_id")


def p6_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The previews with typed placeholders in the place of personal information."""
    return pii.replaced(_previews(spark, sf_dir), pii.model_of(table(spark, sf_dir, "person_names"))).withColumnsRenamed({"id": "body_id", "text": "preview"})


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text, or piece of a text, for each capacity."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, for each capacity."""
    return packing.packing_report(p7_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


#: Sources whose texts don't share a container in p7_apart: what is under suspicion, and what goes outside.
_APART = [(a, b) for a in ("quarantine", "sandbox_logs") for b in ("partner_feed", "press_digest", "closed_cases")]


def p7_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with sources that never share a container."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"), _APART)


def p7_apart_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are then, and how many hold two sources that mustn't meet (none)."""
    packed, specs = p7_apart(spark, sf_dir), table(spark, sf_dir, "pack_specs")
    held = packed.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("spec_id", "container_id")
    met = [F.bool_or(F.col("source") == a) & F.bool_or(F.col("source") == b) for a, b in _APART]
    wrong = held.agg(F.coalesce(sum(m.cast("int") for m in met), F.lit(0)).alias("n")).groupBy("spec_id").agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)).alias("conflicts"))
    return packing.packing_report(packed, specs).join(wrong, "spec_id")


# Where the sources of the test tables belong in the tree of weights.
_DOMAINS = {
    "quarantine": "mail", "user_reports": "mail", "mailing_lists": "mail", "analyst_notes": "desk", "sandbox_logs": "desk",
    "custody_journal": "desk", "closed_cases": "desk", "partner_feed": "outside", "press_digest": "outside", "legacy_archive": "outside",
}


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _DOMAINS.items() for x in kv]), F.col("source")), F.lit("other"))
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), domain)


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each text is used for each source to hold its target share of the tokens."""
    return _mixed(spark, sf_dir)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that were reached."""
    return mixing.mix_report(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of words in sequences of 25 that another document has too."""
    return spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    return spans.shared_share(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p4_found, p4_consistent, p5_found, p5_restored, p6_found, p6_replaced, p7_packed, p7_report, p7_apart, p7_apart_report, p8_mixed, p8_report, p9_found, p9_share)}

_WORDS = r"list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '')"
SQL = {
    "p2_found": """
WITH r AS (
  SELECT body_id, list_filter(string_split_regex(lower(coalesce(subject, '') || ' ' || preview), '\\s+'), lambda x: x <> '') AS w
  FROM text_bodies LEFT JOIN messages USING (report_id) WHERE length(preview) > 0
), s AS (
  SELECT DISTINCT body_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT body_id, w, unnest(range(1, len(w) - 1)) AS i FROM r)
), n AS (SELECT body_id, count(*) AS n FROM s GROUP BY body_id)
SELECT body_a, body_b FROM (
  SELECT a.body_id AS body_a, b.body_id AS body_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.body_id < b.body_id GROUP BY 1, 2
) JOIN n x ON x.body_id = body_a JOIN n y ON y.body_id = body_b WHERE 2 * c >= x.n + y.n - c
""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 25], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 24)) AS i FROM d)),
h AS (SELECT g FROM k GROUP BY g HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER o + 25 THEN 1 ELSE 0 END AS fresh FROM k JOIN h USING (g) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m)
SELECT doc_id, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) + 25 AS BIGINT) AS end_word FROM g GROUP BY doc_id, island
""",
}
