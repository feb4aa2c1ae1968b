"""The parse stage: bytes of messages to one nested row each, attached messages as rows of their own.

This is the one Python boundary of the default plan. Everything after it is DataFrame plans over
the tables that :class:`Evidence` takes from the parsed rows. What can't be read is kept as far as
it goes: no message stops a batch.
"""

from __future__ import annotations

import binascii
import hashlib
import ipaddress
import quopri
import re
import signal
import threading
import time
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.generator import BytesGenerator
from email.header import decode_header, make_header
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.filetype import PAGE, TYPES, detect, extension_of
from siftwright.functions.text import BIDI, ZERO_WIDTH
from siftwright.operators import mailauth
from siftwright.sources import outlook
from siftwright.sources.html import read_page, urls_in

LARGEST, PREVIEW, MOST_PARTS, DEEPEST, NESTING, MOST_NESTED = 100 * 2**20, 4000, 1000, 20, 3, 20
SCHEMA = (
    "report_id string, path string, msg_format string, sha256 string, md5 string, size_bytes long, container string, container_sha256 string, parent_report_id string, mime_part string, depth int, "
    "subject string, date_hdr string, date_us long, date_offset_s int, message_id string, from_address string, from_display_name string, from_count int, return_path string, sender string, "
    "reply_to array<string>, to_addrs array<string>, cc_addrs array<string>, x_mailer string, x_originating_ip string, php_script string, forefront string, antispam string, scl string, auth_as string, "
    "spam_status string, spam_flag string, header_count int, defects array<string>, error string, limits array<string>, modified_by string, encoded_errors array<string>, "
    f"dkim {mailauth.SIGNATURES}, arc {mailauth.CHAIN}, "
    "headers array<struct<pos: int, name: string, raw: string, decoded: string>>, "
    "hops array<struct<idx: int, raw: string, from_host: string, from_ip: string, by_host: string, protocol: string, id: string, for_address: string, utc_us: bigint, offset_s: int, ip_is_private: boolean>>, "
    "auth_results array<struct<pos: int, authserv_id: string, method: string, result: string, properties: map<string, string>>>, "
    "parts array<struct<part: string, depth: int, content_type: string, charset: string, transfer_encoding: string, disposition: string, filename: string, size: bigint, sha256: string, is_attachment: boolean, defects: array<string>>>, "
    "bodies array<struct<mime_part: string, content_type: string, length: bigint, preview: string, problem: string, zero_width: int, bidi: int>>, "
    "links array<struct<seq: int, part: string, source: string, url: string, text: string>>, "
    "pages array<struct<part: string, text: string, hidden: array<string>, hidden_words: int, forms: array<struct<action: string, method: string, input_types: array<string>>>, handlers: array<string>, scripts: int, frames: array<string>, refresh: string, base: string, pixels: array<string>, remote: int, images: int, truncated: boolean>>, "
    "attachments array<struct<part: string, filename: string, type_name: string, content_type: string, extension: string, detected_type: string, size: bigint, sha256: string, sha1: string, md5: string, payload: binary>>"
)
_WORD = re.compile(r"=\?([^?\s]+)\?([bq])\?([^?\s]*)\?=", re.I)
#: Headers whose encoded words are checked.
ENCODED = ("subject", "from", "to", "cc", "reply-to", "sender")


def clean(text: str | None) -> str | None:
    """A text that any table can hold: bytes that weren't characters show as escapes."""
    return None if text is None else text.encode("utf-8", "backslashreplace").decode("utf-8")


def count_of(text: str, chars: str) -> int:
    """How many of some characters a text holds; a leading byte order mark is none of them."""
    text = text.removeprefix("\ufeff")
    return sum(map(text.count, chars))


def decoded(value: str) -> str:
    try:
        return str(make_header(decode_header(value)))
    except Exception:
        return value


def word_problem(charset: str, how: str, text: str) -> str | None:
    """What is wrong with an encoded word; null for a sound one."""
    try:
        data = binascii.a2b_base64(text + "=" * (-len(text) % 4), strict_mode=True) if how in "bB" else quopri.decodestring(text.replace("_", " "))
        data.decode(charset.partition("*")[0])
    except LookupError:
        return "unknown charset"
    except UnicodeDecodeError:
        return "bytes of another charset"
    except ValueError:
        return "broken base64"
    return None


def unfolded(value: str) -> str:
    return re.sub(r"\r?\n[ \t]+", " ", value).strip()


def addresses(values: list[str]) -> list[tuple[str, str]]:
    """(name, address) pairs; addresses are read before words are decoded, so a name can't bring in one."""
    try:
        pairs = getaddresses([", ".join(values)]) if values else []
    except Exception:
        return []
    return [(decoded(n), a.lower()) for n, a in pairs if n or a]


def stamp(value: str | None) -> tuple[int | None, int | None]:
    """(microseconds since 1970 UTC, offset in seconds) of a mail date; nulls without a zone or if unreadable."""
    try:
        at = parsedate_to_datetime((value or "").strip())
        return (int(at.timestamp()) * 1_000_000, int(at.utcoffset().total_seconds())) if at.tzinfo else (None, None)
    except Exception:
        return None, None


def without_comments(value: str) -> str:
    while (shorter := re.sub(r"\([^()]*\)", " ", value)) != value:
        value = shorter
    return value


def _address_or_none(text: str) -> str | None:
    try:
        return str(ipaddress.ip_address(text))
    except ValueError:
        return None


def received(raw: str, idx: int) -> dict:
    """A hop, of one ``Received`` header."""
    body, sep, tail = raw.rpartition(";")
    body = body if sep else raw
    flat = without_comments(body)
    take = lambda pattern: (re.search(pattern, flat, re.I) or [None, None])[1]
    clause = (re.search(r"\bfrom\b(.*?)(?:\bby\b|;|$)", body, re.I | re.S) or ["", ""])[1]
    tried = re.findall(r"\[(?:IPv6:)?([0-9A-Fa-f:.]+)\]", clause) + re.findall(r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d.])", clause)
    ip = next((a for t in tried if (a := _address_or_none(t))), None)
    us, offset = stamp(tail) if sep else (None, None)
    return {
        "idx": idx, "raw": raw, "from_host": take(r"\bfrom\s+([^\s;()]+)"), "from_ip": ip, "by_host": take(r"\bby\s+([^\s;()]+)"), "protocol": take(r"\bwith\s+([^\s;()]+)"), "id": take(r"\bid\s+<?([^\s;<>()]+)>?"),
        "for_address": take(r"\bfor\s+<?([^\s;<>()]+@[^\s;<>()]+)>?"), "utc_us": us, "offset_s": offset, "ip_is_private": not ipaddress.ip_address(ip).is_global if ip else None,
    }


def authentication_results(value: str, pos: int) -> list[dict]:
    """The methods' results of one ``Authentication-Results`` header."""
    server, *parts = (p.split() for p in without_comments(value).split(";"))
    out = []
    for tokens in parts if server else ():
        if tokens and "=" in tokens[0]:
            method, _, result = tokens[0].partition("=")
            props = {k.lower(): v.strip('"') for k, s, v in (t.partition("=") for t in tokens[1:]) if s}
            out.append({"pos": pos, "authserv_id": server[0], "method": method.split("/")[0].lower(), "result": result.lower(), "properties": props})
    return out


def text_of(data: bytes, charset: str | None) -> tuple[str, str | None]:
    """(text, problem): an unknown or wrong character set falls back to UTF-8 with replacements."""
    try:
        return data.decode(charset or "utf-8"), None
    except (LookupError, UnicodeDecodeError, ValueError) as e:
        problem = f"unknown charset {charset}" if isinstance(e, LookupError) else f"not {charset or 'utf-8'}"
        return data.decode("utf-8", "replace"), problem


def _bytes_of(msg: Message) -> bytes:
    out = BytesIO()
    BytesGenerator(out, mangle_from_=False, policy=policy.compat32).flatten(msg)
    return out.getvalue()


def leaves(msg: Message, part: str = "", depth: int = 0) -> Iterator[tuple[str, int, Message]]:
    """(path, depth, part) of a message's parts without parts of their own; an attached message is one."""
    if msg.get_content_maintype() == "multipart" and isinstance(msg.get_payload(), list) and depth < DEEPEST:
        for i, p in enumerate(msg.get_payload(), 1):
            yield from leaves(p, f"{part}.{i}" if part else str(i), depth + 1)
    else:
        yield part or "1", depth, msg


def parse_message(
    path: str, data: bytes, fmt: str = "eml", container: str | None = None, container_sha256: str | None = None, parent: str | None = None, mime_part: str | None = None, depth: int = 0, nesting: int = NESTING, modified_by: str | None = None, now: float | None = None
) -> list[dict]:
    """The row of a message, and after it those of the messages attached to it."""
    sha = hashlib.sha256(data).hexdigest()
    row: dict = {"report_id": f"{sha}-{hashlib.sha256(path.encode('utf-8', 'backslashreplace')).hexdigest()[:8]}", "path": path, "msg_format": fmt, "sha256": sha, "md5": hashlib.md5(data).hexdigest(), "size_bytes": len(data)}
    row |= {"container": container, "container_sha256": container_sha256, "parent_report_id": parent, "mime_part": mime_part, "depth": depth, "modified_by": modified_by}
    for k in ("headers", "hops", "auth_results", "parts", "bodies", "links", "pages", "attachments", "reply_to", "to_addrs", "cc_addrs", "defects", "limits", "encoded_errors", "dkim"):
        row[k] = []
    more: list[dict] = []
    try:
        msg = message_from_bytes(data, policy=policy.compat32)
        _headers(row, msg)
        _parts(row, msg, more, path, depth, nesting)
        row["dkim"], row["arc"] = mailauth.facts(data, time.time() if now is None else now)
    except Exception as e:
        row["error"] = f"{type(e).__name__}: {e}"[:300]
    return [row, *more]


def _headers(row: dict, msg: Message) -> None:
    items = [(n, unfolded(clean(str(v)))) for n, v in msg.raw_items()]
    every = lambda name: [v for n, v in items if n.lower() == name]
    first = lambda name: decoded(every(name)[0]) if every(name) else None
    row["headers"] = [{"pos": i, "name": clean(n), "raw": v, "decoded": clean(decoded(v))} for i, (n, v) in enumerate(items)]
    row["encoded_errors"] = [f"{name}: {m[0][:200]} ({wrong})" for name in ENCODED for v in every(name) for m in _WORD.finditer(v) if (wrong := word_problem(*m.groups()))]
    senders = addresses(every("from")[:1])
    row |= {"subject": first("subject"), "date_hdr": first("date"), "message_id": first("message-id"), "x_mailer": first("x-mailer") or first("user-agent"), "x_originating_ip": first("x-originating-ip")}
    row |= {"php_script": first("x-php-originating-script") or first("x-php-script"), "forefront": first("x-forefront-antispam-report"), "antispam": first("x-microsoft-antispam"), "scl": first("x-ms-exchange-organization-scl")}
    row |= {"auth_as": first("x-ms-exchange-organization-authas"), "spam_status": first("x-spam-status"), "spam_flag": first("x-spam-flag"), "header_count": len(items), "defects": [type(d).__name__ for d in msg.defects]}
    row["date_us"], row["date_offset_s"] = stamp(row["date_hdr"])
    row |= {"from_display_name": (senders[0][0] or None) if senders else None, "from_address": (senders[0][1] or None) if senders else None, "from_count": len(senders)}
    for k, name in (("return_path", "return-path"), ("sender", "sender")):
        row[k] = next((a for _, a in addresses(every(name)[:1]) if a), None)
    for k, name in (("reply_to", "reply-to"), ("to_addrs", "to"), ("cc_addrs", "cc")):
        row[k] = [a for _, a in addresses(every(name)) if a]
    row["hops"] = [received(v, i) for i, v in enumerate(reversed(every("received")), 1)]
    row["auth_results"] = [r for i, v in enumerate(every("authentication-results")) for r in authentication_results(v, i)]


def _carried(data: bytes, name: str | None) -> tuple[bytes, str] | None:
    """(bytes, format) of a message that is attached as a file: an internet message, or an Outlook file by its name and content."""
    ending = extension_of(name)
    if ending == "eml":
        return data, "file"
    if ending == "msg" and data.startswith(b"\xd0\xcf\x11\xe0"):
        try:
            return outlook.to_internet(data), "msg"
        except Exception:
            return None
    return None


def _parts(row: dict, msg: Message, more: list[dict], path: str, depth: int, nesting: int) -> None:
    links, seq = [], 0

    def link(part: str, source: str, url: str, text: str | None) -> None:
        nonlocal seq
        links.append({"seq": seq, "part": part, "source": source, "url": clean(url), "text": clean(text)})
        seq += 1

    for n, (part, at, leaf) in enumerate(leaves(msg)):
        if n >= MOST_PARTS:
            row["limits"].append("MIME_TOO_MANY_PARTS")
            break
        kind = leaf.get_content_type()
        inner = leaf.get_payload()
        if leaf.get_content_maintype() == "multipart" and isinstance(inner, list) and "MIME_TOO_DEEP" not in row["limits"]:
            row["limits"].append("MIME_TOO_DEEP")
        name = clean(decoded(str(leaf.get_filename()))) if leaf.get_filename() else None
        whole = kind in ("message/rfc822", "message/global") and isinstance(inner, list) and bool(inner)
        if whole:
            data = _bytes_of(inner[0])
        else:
            try:
                data = leaf.get_payload(decode=True) or b""
            except Exception:
                data = str(inner).encode("utf-8", "backslashreplace")
        carried = _carried(data, name) if not whole else (data, "attached")
        if carried is not None and data:
            if depth < nesting and len(more) < MOST_NESTED:
                more += parse_message(f"{path}!{part}", carried[0], carried[1], None, None, row["report_id"], part, depth + 1, nesting)
            elif "NESTED_MESSAGE_SKIPPED" not in row["limits"]:
                row["limits"].append("NESTED_MESSAGE_SKIPPED")
        disposition = leaf.get_content_disposition()
        apart = disposition == "attachment" or kind not in ("text/plain", "text/html") or (name is not None and disposition != "inline")
        digest = hashlib.sha256(data).hexdigest()
        row["parts"].append({"part": part, "depth": at, "content_type": kind, "charset": leaf.get_content_charset(), "transfer_encoding": str(leaf.get("content-transfer-encoding", "")).lower() or None, "disposition": disposition, "filename": name, "size": len(data), "sha256": digest, "is_attachment": apart, "defects": [type(d).__name__ for d in leaf.defects]})
        if apart:
            named = leaf.get_param("name")
            row["attachments"].append({"part": part, "filename": name, "type_name": clean(str(named if not isinstance(named, tuple) else named[2])) if named else None, "content_type": kind, "extension": extension_of(name), "detected_type": detect(data), "size": len(data), "sha256": digest, "sha1": hashlib.sha1(data).hexdigest(), "md5": hashlib.md5(data).hexdigest(), "payload": data})
            if extension_of(name) in PAGE or TYPES.get(detect(data), ("",))[0] == "html":
                page = read_page(clean(text_of(data, "utf-8")[0]))
                for source, url, t in page["links"]:
                    link(part, source, url, t)
                row["pages"].append({"part": part, **{k: v for k, v in page.items() if k != "links"}})
            continue
        text, problem = text_of(data, leaf.get_content_charset())
        text = clean(text)
        if kind == "text/html":
            page = read_page(text)
            said = {t for _, _, t in page["links"] if t}
            for source, url, t in page["links"]:
                link(part, source, url, t)
            row["pages"].append({"part": part, **{k: v for k, v in page.items() if k != "links"}})
            text = page["text"]
            for u in urls_in(text):
                if u not in said:
                    link(part, "text", u, None)
        else:
            for u in urls_in(text):
                link(part, "text", u, None)
        row["bodies"].append({"mime_part": part, "content_type": kind, "length": len(data), "preview": text[:PREVIEW], "problem": problem, "zero_width": count_of(text, ZERO_WIDTH), "bidi": count_of(text, BIDI)})
    row["links"] = links


class _Timeout(Exception):
    pass


def _in_time(seconds: float | None, path: str, data: bytes, **kw) -> list[dict]:
    """:func:`parse_message` within a time; after it, a row with the digests and an error only."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        return parse_message(path, data, **kw)

    def stop(*_):
        raise _Timeout

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return parse_message(path, data, **kw)
    except _Timeout:
        return [parse_message(path, b"")[0] | {"sha256": hashlib.sha256(data).hexdigest(), "size_bytes": len(data), "error": "ANALYSIS_TIMEOUT"}]
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parsed(evidence: DataFrame, timeout: float | None = None, nesting: int = NESTING, now: float | None = None) -> DataFrame:
    """Rows of :data:`SCHEMA` for ``evidence(path, content[, msg_format, container, container_sha256, modified_by, unread])``.

    Messages attached to messages are followed ``nesting`` levels down. Evidence without content is left out, unless ``unread`` says why it has none.
    """
    given = [c for c in ("msg_format", "container", "container_sha256", "modified_by") if c in evidence.columns]
    unread = F.col("unread") if "unread" in evidence.columns else F.lit(None).cast("string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                kw = {("fmt" if k == "msg_format" else k): r[k] for k in given if r[k] is not None}
                if r["unread"] is not None:
                    out.append(parse_message(r["path"], b"", **kw)[0] | {"sha256": None, "md5": None, "size_bytes": None, "error": r["unread"], "header_count": None})
                elif r["_size"] > largest:
                    out.append(parse_message(r["path"], b"", **kw)[0] | {"sha256": r["_sha"], "md5": None, "size_bytes": r["_size"], "error": f"too large: {r['_size']} bytes", "header_count": None})
                else:
                    out += _in_time(timeout, r["path"], bytes(r["content"]), nesting=nesting, now=now, **kw)
            full = [{k: r.get(k) for k in TOP} for r in out]
            yield pd.DataFrame(full, columns=TOP)

    size, largest = F.length("content"), LARGEST
    whole = F.when(size <= largest, F.col("content")).alias("content")
    return evidence.withColumn("unread", unread).filter("content is not null or unread is not null").select("path", whole, *given, "unread", size.alias("_size"), F.when(size > LARGEST, F.sha2("content", 256)).alias("_sha")).mapInPandas(run, SCHEMA)


def _top_level(ddl: str) -> list[str]:
    depth, out, word = 0, [], ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip().split(" ")[0])
            word = ""
        else:
            word += c
    return out


TOP = _top_level(SCHEMA)


class Evidence:
    """The tables of parsed messages; ``rows`` should be cached or staged, as each table reads it."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.messages = rows.drop("headers", "hops", "auth_results", "parts", "bodies", "links", "pages", "attachments", "dkim", "arc")

    def _each(self, column: str) -> DataFrame:
        return self.rows.select("report_id", F.explode(column).alias("_x")).select("report_id", "_x.*")

    headers = property(lambda self: self._each("headers"))
    hops = property(lambda self: self._each("hops"))
    auth_results = property(lambda self: self._each("auth_results"))
    parts = property(lambda self: self._each("parts"))
    bodies = property(lambda self: self._each("bodies"))
    links = property(lambda self: self._each("links"))
    pages = property(lambda self: self._each("pages"))
    attachments = property(lambda self: self._each("attachments"))


def sniffed(files: DataFrame) -> DataFrame:
    """``binaryFile`` rows with their ``msg_format``: msg, mbox or eml."""
    head = F.substring("content", 1, 65536)
    ole = F.hex(F.substring("content", 1, 8)) == "D0CF11E0A1B11AE1"
    line = F.split(F.decode(head, "ISO-8859-1"), r"\r?\n")[0]
    box = line.startswith("From ") & (line.rlike(r"\d{4}\s*$") | F.lower("path").rlike(r"\.(mbox|mbx)$"))
    return files.withColumn("msg_format", F.when(ole, "msg").when(box, "mbox").otherwise("eml"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Message files of a folder, sniffed; the size guard is pushed to the scan."""
    return sniffed(spark.read.format("binaryFile").load(path).filter(F.col("length") <= LARGEST))


def large_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, is_box) of the files over that size, by their listing only: those with a mailbox's ending are read as such."""
    big = spark.read.format("binaryFile").load(path).filter(F.col("length") > LARGEST).select("path", "length")
    return big.withColumn("is_box", F.lower("path").rlike(r"\.(mbox|mbx)$"))
