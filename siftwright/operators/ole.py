"""Compound files (MS-CFB), VBA projects in them (MS-OVBA), and compressed RTF (MS-OXRTFCP), within fixed budgets."""

from __future__ import annotations

import struct
from dataclasses import dataclass

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
STREAM_BYTES, MOST_ENTRIES, MOST_MODULES, SOURCE_BYTES, RTF_BYTES = 64 * 2**20, 100_000, 500, 2_000_000, 32 * 2**20
_NONE = 0xFFFFFFF0  # sector numbers from here on are marks


class Broken(ValueError):
    """A file that its own structure contradicts."""


@dataclass
class Entry:
    path: tuple[str, ...]
    start: int
    size: int
    is_stream: bool


class Compound:
    """The streams of a compound file, by their path without regard to case."""

    def __init__(self, data: bytes):
        if not data.startswith(MAGIC) or len(data) < 512:
            raise Broken("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift > shift:
            raise Broken("sector size")
        self.sector, self.mini_sector = 1 << shift, 1 << mini_shift
        n_fat, first_dir, _, self.cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<I I I I I I I I", data, 44)
        fat_sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < _NONE]
        at, seen = first_difat, set()
        while at < _NONE and at not in seen and len(seen) <= n_difat:
            seen.add(at)
            words = self._words(at)
            fat_sectors += [s for s in words[:-1] if s < _NONE]
            at = words[-1]
        self.fat = [w for s in fat_sectors[: max(n_fat, 1)] for w in self._words(s)]
        self.mini_fat = [w for s in self._chain(first_mini, self.fat)[:n_mini] for w in self._words(s)] if n_mini else []
        self.entries: dict[tuple[str, ...], Entry] = {}
        self._directory(first_dir)

    def _at(self, sector: int) -> int:
        return (sector + 1) * self.sector

    def _words(self, sector: int) -> list[int]:
        raw = self.data[self._at(sector) : self._at(sector) + self.sector]
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    @staticmethod
    def _chain(start: int, fat: list[int]) -> list[int]:
        out, seen = [], set()
        while start < _NONE:
            if start in seen or start >= len(fat):
                raise Broken("sectors go round or end nowhere")
            seen.add(start)
            out.append(start)
            start = fat[start]
        return out

    def _directory(self, first: int) -> None:
        raw = b"".join(self.data[self._at(s) : self._at(s) + self.sector] for s in self._chain(first, self.fat))
        rows = []
        for i in range(0, min(len(raw), MOST_ENTRIES * 128) - 127, 128):
            size = struct.unpack_from("<H", raw, i + 64)[0]
            name = raw[i : i + max(0, min(size, 64) - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", raw, i + 68)
            start, length = struct.unpack_from("<IQ", raw, i + 116)
            rows.append((name, raw[i + 66], left, right, child, start, length & 0xFFFFFFFF if self.sector == 512 else length))
        if not rows:
            raise Broken("no directory")
        self.root = rows[0]
        self.mini = self._read_chain(rows[0][5], min(rows[0][6], STREAM_BYTES * 4))
        todo, seen = [(rows[0][4], ())], set()
        while todo:
            i, above = todo.pop()
            if i >= len(rows) or i in seen:
                continue
            seen.add(i)
            name, kind, left, right, child, start, length = rows[i]
            path = (*above, name)
            self.entries[tuple(p.lower() for p in path)] = Entry(path, start, length, kind == 2)
            todo += [(left, above), (right, above)]
            if kind == 1:
                todo.append((child, path))

    def _read_chain(self, start: int, size: int) -> bytes:
        try:
            return b"".join(self.data[self._at(s) : self._at(s) + self.sector] for s in self._chain(start, self.fat))[:size]
        except Broken:
            return b""

    def streams(self) -> list[Entry]:
        return [e for e in self.entries.values() if e.is_stream]

    def read(self, *path: str) -> bytes | None:
        """A stream's bytes; null where there is none or it is too long."""
        e = self.entries.get(tuple(p.lower() for p in path))
        if e is None or not e.is_stream or e.size > STREAM_BYTES:
            return None
        if e.size >= self.cutoff:
            return self._read_chain(e.start, e.size)
        try:
            return b"".join(self.mini[s * self.mini_sector : (s + 1) * self.mini_sector] for s in self._chain(e.start, self.mini_fat))[: e.size]
        except Broken:
            return b""


def ovba(data: bytes) -> bytes:
    """A compressed container of MS-OVBA 2.4.1, unpacked."""
    if not data or data[0] != 1:
        raise Broken("not a container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        head = struct.unpack_from("<H", data, at)[0]
        end = min(at + (head & 0xFFF) + 3, len(data))
        at += 2
        base = len(out)
        if not head & 0x8000:
            out += data[at : at + 4096]
            at = at + 4096
            continue
        while at < end:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > len(data):
                    raise Broken("a token is cut")
                token = struct.unpack_from("<H", data, at)[0]
                at += 2
                bits = max((len(out) - base - 1).bit_length(), 4)
                length, back = (token & (0xFFFF >> bits)) + 3, (token >> (16 - bits)) + 1
                if back > len(out) - base:
                    raise Broken("a token points before its chunk")
                for _ in range(length):
                    out.append(out[-back])
        if len(out) > SOURCE_BYTES:
            raise Broken("too long")
    return bytes(out)


@dataclass
class Module:
    name: str
    source: str
    stomped: bool


def _codec(page: int) -> str:
    name = {65001: "utf-8", 1200: "utf-16-le", 10000: "mac_roman"}.get(page, f"cp{page}")
    try:
        "".encode(name)
    except LookupError:
        return "cp1252"
    return name


def modules(cf: Compound) -> list[Module]:
    """The source of each VBA module; stomped ones have compiled code and hardly any source."""
    out: list[Module] = []
    for key in [k for k in cf.entries if len(k) >= 2 and k[-2:] == ("vba", "dir")]:
        try:
            d = ovba(cf.read(*key) or b"")
        except Broken:
            continue
        page, at, named = 1252, 0, []
        now: dict = {}
        while at + 6 <= len(d) and len(named) < MOST_MODULES:
            record, size = struct.unpack_from("<HI", d, at)
            size = 6 if record == 9 else size
            value = d[at + 6 : at + 6 + size]
            at += 6 + size
            if record == 3 and len(value) >= 2:
                page = struct.unpack_from("<H", value)[0]
            elif record == 0x19:
                now = {"name": value, "stream": value, "offset": 0}
            elif record == 0x1A and now:
                now["stream"] = value
            elif record == 0x31 and now and len(value) >= 4:
                now["offset"] = struct.unpack_from("<I", value)[0]
            elif record == 0x2B and now:
                named.append(now)
                now = {}
            elif record == 0x10:
                break
        codec = _codec(page)
        for m in named:
            raw = cf.read(*key[:-1], m["stream"].decode(codec, "replace")) or b""
            try:
                text = ovba(raw[m["offset"] :]).decode(codec, "replace") if m["offset"] < len(raw) else ""
            except Broken:
                text = ""
            body = "\n".join(x for x in text.splitlines() if not x.startswith("Attribute VB_")).strip()
            out.append(Module(m["name"].decode(codec, "replace"), text, bool(raw) and m["offset"] > 2048 and len(body) < 20))
    return out


_RTF_START = (
    b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier"
    b"{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
)  # the window's first bytes, as MS-OXRTFCP gives them


def unpack_rtf(data: bytes) -> bytes:
    """RTF as mail stores keep it, unpacked."""
    if len(data) < 16:
        raise Broken("too short")
    _, size, kind, _ = struct.unpack_from("<IIII", data)
    if kind == 0x414C454D:
        return data[16 : 16 + size]
    if kind != 0x75465A4C or size > RTF_BYTES:
        raise Broken("not compressed RTF")
    window, write, out, at = bytearray(_RTF_START.ljust(4096, b"\0")), len(_RTF_START), bytearray(), 16
    while at < len(data) and len(out) < size:
        flags = data[at]
        at += 1
        for bit in range(8):
            if at >= len(data) or len(out) >= size:
                break
            if flags >> bit & 1:
                if at + 2 > len(data):
                    return bytes(out)
                token = data[at] << 8 | data[at + 1]
                at += 2
                read = token >> 4
                if read == write % 4096:
                    return bytes(out)
                piece = (token & 15) + 2
                for _ in range(piece):
                    c = window[read % 4096]
                    read += 1
                    window[write % 4096] = c
                    write += 1
                    out.append(c)
            else:
                window[write % 4096] = data[at]
                out.append(data[at])
                at, write = at + 1, write + 1
    return bytes(out[:size])
