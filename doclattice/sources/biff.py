"""Strings and sheet names of legacy spreadsheets (BIFF), for checking an intermediate conversion."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from doclattice.model import Unreadable
from doclattice.sources.cfb import Compound

SST, CONTINUE, BOUNDSHEET, LABEL, RSTRING, BOF = 0xFC, 0x3C, 0x85, 0x204, 0xD6, 0x809
MOST = 200_000


def workbook(content: bytes) -> bytes:
    streams = Compound(content).streams
    for name in ("Workbook", "Book"):
        if name in streams:
            return streams[name]
    raise Unreadable("no workbook stream")


def records(stream: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


class _Blocks:
    """Reads across CONTINUE records; characters that go on there start with a new width flag."""

    def __init__(self, blocks: list[bytes]) -> None:
        self.blocks, self.k, self.at = blocks, 0, 0

    def _room(self) -> int:
        return len(self.blocks[self.k]) - self.at

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.blocks):
            if not self._room():
                self.k, self.at = self.k + 1, 0
                continue
            part = self.blocks[self.k][self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out += part
        return out

    def chars(self, n: int, wide: bool) -> str:
        out = ""
        while n and self.k < len(self.blocks):
            if not self._room():
                self.k, self.at = self.k + 1, 0
                if self.k < len(self.blocks):
                    wide = bool(self.take(1)[0] & 1)
                continue
            m = min(n, self._room() // (2 if wide else 1))
            if not m:
                break
            raw = self.take(m * (2 if wide else 1))
            out += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            n -= m
        return out


def strings(content: bytes) -> list[str]:
    """Shared strings; of older files the labels of cells. Blank ones are left out."""
    recs = list(records(workbook(content)))
    out: list[str] = []
    for k, (kind, data) in enumerate(recs):
        if kind == SST:
            blocks = [data]
            for later, more in recs[k + 1 :]:
                if later != CONTINUE:
                    break
                blocks.append(more)
            b = _Blocks(blocks)
            total = struct.unpack("<II", b.take(8))[1]
            if total > MOST:
                raise ValueError(f"{total} strings; {MOST} are allowed")
            for _ in range(total):
                head = b.take(3)
                if len(head) < 3:
                    break
                n, flags = struct.unpack("<HB", head)
                rich = struct.unpack("<H", b.take(2))[0] if flags & 8 else 0
                extra = struct.unpack("<I", b.take(4))[0] if flags & 4 else 0
                out.append(b.chars(n, bool(flags & 1)))
                b.take(4 * rich + extra)
        elif kind in (LABEL, RSTRING) and len(data) >= 8:
            n = struct.unpack_from("<H", data, 6)[0]
            out.append(data[8 : 8 + n].decode("cp949", "replace"))
    return [s for s in out if s.strip()]


def sheet_names(content: bytes) -> list[str]:
    out = []
    for kind, data in records(workbook(content)):
        if kind == BOUNDSHEET and len(data) > 8:
            n, flags = data[6], data[7]
            out.append(data[8 : 8 + 2 * n].decode("utf-16-le") if flags & 1 else data[8 : 8 + n].decode("latin-1"))
    return out
