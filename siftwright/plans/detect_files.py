"""Detectors over pages, attachments, archives and scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions import text as tx
from siftwright.functions.filetype import DISK_IMAGE, DOCUMENT, EXECUTABLE, MACRO, NOTEBOOK, PAGE, RISKY, TYPES
from siftwright.operators import scripts
from siftwright.plans.detect import findings_of, hit, union

# Types that a declared type may have; marks of pages that build files in the browser; words for passwords.
_ZIPPED = "zip docx xlsx pptx odf jar apk"
DECLARED = {
    "application/pdf": "pdf", "application/zip": _ZIPPED, "application/x-zip-compressed": _ZIPPED, "application/msword": "ole rtf docx", "application/vnd.ms-excel": "ole xlsx", "application/vnd.ms-powerpoint": "ole pptx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx zip", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx zip", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx zip",
    "application/rtf": "rtf", "text/rtf": "rtf",
}
SMUGGLING = r"(?i)atob\s*\(|new\s+Blob\s*\(|msSaveOrOpenBlob|createObjectURL|\.download\s*=|fromCharCode|unescape\s*\(|document\.write\s*\("
PASSWORD = r"(?iu)(?<!\w)(?:pass(?:word|wd|code|phrase)?|pwd|kennwort|passwort|contrase(?:ñ|n)a|mot de passe|senha|parola|wachtwoord|hasło|haslo)(?!\w)|пароль|密码|密碼|パスワード"


def pages(found: DataFrame) -> DataFrame:
    """Scripts, forms, frames, redirections, hidden text and remote loads of ``found`` pages."""
    p = found.withColumnRenamed("hidden_words", "words")
    at = F.col("part")
    each = found.select("report_id", "part", F.explode("forms").alias("form"))
    secret = F.array_contains("form.input_types", "password")
    return union([
        findings_of(
            p, hit(F.col("scripts") > 0, "HTML_SCRIPT", "medium", at, count=F.col("scripts")), hit(F.size("handlers") > 0, "HTML_EVENT_HANDLERS", "medium", at, handlers=F.col("handlers")), hit(F.size("frames") > 0, "HTML_EMBEDDED_FRAME", "medium", at, sources=F.col("frames")),
            hit(F.col("refresh").isNotNull(), "HTML_META_REFRESH", "medium", at, url=F.col("refresh")), hit(F.col("base").isNotNull(), "HTML_BASE_HREF", "low", at, base=F.col("base")),
            hit(F.size("hidden") > 0, "HTML_HIDDEN_TEXT", F.when(F.col("words") >= 20, "medium").otherwise("low"), at, words=F.col("words")), hit(F.size("pixels") > 0, "HTML_TRACKING_PIXEL", "info", at, sources=F.col("pixels")),
            hit(F.col("remote") > 0, "HTML_REMOTE_RESOURCES", "info", at, count=F.col("remote")), hit(F.col("truncated"), "HTML_TRUNCATED", "low", at),
        ),
        findings_of(each, hit(secret, "HTML_CREDENTIAL_FORM", "high", at, action=F.col("form.action")), hit(~secret & ((F.size("form.input_types") > 0) | F.col("form.action").isNotNull()), "HTML_FORM", "medium", at, action=F.col("form.action"))),
    ])


def attachments(found: DataFrame) -> DataFrame:
    """Names and types of ``found`` attachments; payloads are only read where a type asks for it."""
    kinds = F.create_map(*[F.lit(x) for k, (c, _) in TYPES.items() for x in (k, c)])
    endings = F.create_map(*[F.lit(x) for k, (_, e) in TYPES.items() for x in (k, e)])
    expected = F.create_map(*[F.lit(x) for kv in DECLARED.items() for x in kv])
    a = found.withColumn("kind", F.try_element_at(kinds, F.col("detected_type"))).withColumn("fits", F.split(F.try_element_at(endings, F.col("detected_type")), " ")).withColumn("expected", F.split(F.try_element_at(expected, F.col("content_type")), " "))
    a = a.withColumn("labels", F.transform(F.split(F.lower("filename"), r"\."), lambda x: F.trim(x))).withColumn("whole", F.decode("payload", "ISO-8859-1"))
    ext, kind, name, at = F.col("extension"), F.col("kind"), F.col("filename"), F.col("part")
    one = lambda values: F.coalesce(ext.isin(sorted(values)), F.lit(False))
    is_kind = lambda k: F.coalesce(kind == k, F.lit(False))
    double = (F.size("labels") >= 3) & F.get("labels", F.size("labels") - 2).isin(sorted(DOCUMENT)) & F.element_at("labels", -1).isin(sorted(RISKY))
    image_name = ext.isin("png jpg jpeg jpe jfif gif bmp dib webp tif tiff ico cur".split())
    unlike = ext.isNotNull() & kind.isNotNull() & ~F.array_contains("fits", ext) & ~((kind == "image") & image_name)
    declared = F.col("detected_type").isNotNull() & ((F.col("expected").isNotNull() & ~F.array_contains("expected", F.col("detected_type"))) | (F.col("content_type").startswith("image/") & (kind != "image") & (F.col("detected_type") != "svg")))
    page = one(PAGE) | is_kind("html")
    marks = F.size(F.array_distinct(F.transform(F.regexp_extract_all("whole", F.lit(SMUGGLING), F.lit(0)), lambda x: F.lower(F.trim(x)))))
    smuggles = page & F.col("whole").rlike(r"(?i)<script[\s>]") & (F.col("whole").rlike(r"[A-Za-z0-9+/]{4000,}") | (marks >= 2))
    macro = F.col("detected_type").isin("docx", "xlsx", "pptx") & F.lower("whole").contains("vbaproject.bin") | ((F.col("detected_type") == "ole") & (F.contains(F.hex(F.col("payload")), F.lit("5F005600420041005F00500052004F004A00450043005400")) | F.contains(F.col("whole"), F.lit("_VBA_PROJECT"))))
    ev = {"filename": name}
    return findings_of(
        a, hit(one(EXECUTABLE) | is_kind("executable"), "ATT_EXECUTABLE", "high", at, **ev), hit(one(DISK_IMAGE) | is_kind("disk-image"), "ATT_DISK_IMAGE", "high", at, **ev), hit(one(NOTEBOOK) | F.coalesce(F.col("detected_type") == "onenote", F.lit(False)), "ATT_ONENOTE", "high", at, **ev),
        hit(page, "ATT_HTML", "medium", at, **ev), hit(smuggles, "ATT_HTML_SMUGGLING", "high", at, **ev), hit(one(MACRO), "ATT_MACRO_EXTENSION", "medium", at, **ev), hit(F.coalesce(macro, F.lit(False)), "ATT_OFFICE_MACRO", "high", at, **ev),
        hit((F.col("detected_type") == "rtf") & F.col("whole").rlike(r"\\objdata|\\objupdate|\\objocx"), "ATT_RTF_OBJECT", "high", at, **ev), hit(name.rlike(r"[/\\]|^\.\."), "ATT_FILENAME_PATH", "medium", at, **ev), hit(double, "ATT_DOUBLE_EXTENSION", "high", at, **ev),
        hit(name.rlike(r"(?:\s{3,}|_{5,})\.\w+$"), "ATT_FILENAME_PADDING", "medium", at, **ev), hit(F.col("type_name").isNotNull() & name.isNotNull() & (F.col("type_name") != name), "ATT_FILENAME_CONFLICT", "medium", at, **ev),
        hit(unlike, "ATT_TYPE_MISMATCH", F.when(kind.isin("executable", "disk-image", "html"), "high").otherwise("medium"), at, extension=ext, detected=F.col("detected_type")), hit(declared, "ATT_DECLARED_TYPE_MISMATCH", "medium", at, declared=F.col("content_type"), detected=F.col("detected_type")),
        hit(kind.isin("archive") & F.col("detected_type").isin("rar", "7z", "cab", "ace"), "ATT_ARCHIVE_UNINSPECTED", "low", at, **ev), hit(tx.bidi_count(name) > 0, "TEXT_BIDI_CONTROL", "high", at), hit(tx.zero_width_count(name) > 0, "TEXT_ZERO_WIDTH", "medium", at),
    )


def archives(found: DataFrame, bodies: DataFrame) -> DataFrame:
    """Findings of ``found`` archives; one that is locked counts more where a body speaks of a password."""
    hints = bodies.filter(F.col("preview").rlike(PASSWORD)).select("report_id").distinct().withColumn("hint", F.lit(True))
    a = found.join(hints, "report_id", "left")
    at = F.col("part")
    return findings_of(
        a, hit(F.col("corrupt"), "ATT_ARCHIVE_CORRUPT", "low", at), hit(F.col("bomb"), "ATT_ZIP_BOMB", "high", at, total_bytes=F.col("total_bytes")),
        hit(F.col("encrypted") > 0, "ATT_ENCRYPTED_ARCHIVE", F.when(F.coalesce("hint", F.lit(False)), "high").otherwise("medium"), at, encrypted=F.col("encrypted")), hit(F.col("nesting") >= 2, "ATT_ARCHIVE_NESTED", "low", at), hit(F.col("traversal") > 0, "ATT_ARCHIVE_PATH_TRAVERSAL", "medium", at),
        hit(F.col("risky") > 0, "ATT_ARCHIVE_RISKY_MEMBER", "high", at, risky=F.col("risky")), hit(F.col("truncated"), "ATT_ARCHIVE_TRUNCATED", "low", at),
    )


def script_files(found: DataFrame) -> DataFrame:
    """Findings of ``found(report_id, part, text)`` scripts."""
    # Exploded, so that long texts are searched once and not by each condition again.
    s = found.withColumn("commands", scripts.commands("text")).withColumn("ind", F.explode(F.array(scripts.indicators(F.concat_ws("\n", "text", F.array_join("commands", "\n"))))))
    has = lambda k: F.map_contains_key("ind", k)
    both, at = has("downloader") & has("execution"), F.col("part")
    return findings_of(
        s, hit(both, "SCRIPT_DOWNLOADER", "high", at), hit(~both & (has("downloader") | has("execution")), "SCRIPT_EXECUTION", "medium", at), hit(has("obfuscation") | F.col("text").rlike(r"#@~\^|[A-Za-z0-9+/]{200,}={0,2}"), "SCRIPT_OBFUSCATED", "medium", at),
        hit(has("persistence"), "SCRIPT_PERSISTENCE", "high", at), hit(has("defense evasion"), "SCRIPT_DEFENSE_EVASION", "high", at), hit(has("ransomware"), "SCRIPT_RANSOMWARE", "high", at), hit(F.size("commands") > 0, "SCRIPT_ENCODED_COMMAND", "high", at, commands=F.col("commands")),
    )
