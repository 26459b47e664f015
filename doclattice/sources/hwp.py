"""HWP 5.x documents by their published record layout."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from doclattice.model import Element, Limits, Unreadable, event
from doclattice.sources.cfb import Compound
from doclattice.sources.grid import Cell, inline, render

# Record tags, from the published format.
BIN_DATA, STYLE, PARA_HEADER, PARA_TEXT, CTRL_HEADER, LIST_HEADER, TABLE, PICTURE, EQUATION = 18, 26, 66, 67, 71, 72, 77, 85, 88
#: Control characters of eight code units; those in ANCHORED own a control record.
_WIDE = frozenset(range(1, 24)) - {10, 13}
ANCHORED = frozenset({2, 3, 11, 12, 15, 16, 17, 18, 21, 22, 23})
_SINGLE = {24: "-", 30: "\xa0", 31: "　", 10: "\n"}
_LEVEL = re.compile(r"(?:개요|제목)\s*(\d+)")
_PROTECTED = (0x2, 0x4, 0x10, 0x100, 0x200)


@dataclass
class Node:
    tag: int
    level: int
    data: bytes
    below: list[Node] = field(default_factory=list)


def records(stream: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, payload); a size of 0xFFF is followed by the real one."""
    at = 0
    while at + 4 <= len(stream):
        head = struct.unpack_from("<I", stream, at)[0]
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(stream):
                raise Unreadable("a record is cut off")
            size = struct.unpack_from("<I", stream, at)[0]
            at += 4
        if at + size > len(stream):
            raise Unreadable("a record is cut off")
        yield head & 0x3FF, head >> 10 & 0x3FF, stream[at : at + size]
        at += size


def tree(stream: bytes) -> list[Node]:
    top: list[Node] = []
    path: list[Node] = []
    for tag, level, data in records(stream):
        node = Node(tag, level, data)
        while path and path[-1].level >= level:
            path.pop()
        (path[-1].below if path else top).append(node)
        path.append(node)
    return top


def tokens(data: bytes) -> Iterator[tuple[str, str | int]]:
    """Text and control characters of a paragraph."""
    units = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])
    held: list[int] = []
    k = 0
    while k < len(units):
        u = units[k]
        if u >= 32:
            held.append(u)
            k += 1
            continue
        if u in _SINGLE:
            held.append(ord(_SINGLE[u]))
            k += 1
            continue
        if held:
            yield "text", struct.pack(f"<{len(held)}H", *held).decode("utf-16-le", "replace")
            held = []
        if u == 9:
            yield "text", "\t"
        elif u in _WIDE:
            yield ("ctrl" if u in ANCHORED else "inline"), u
        k += 8 if u in _WIDE else 1
    if held:
        yield "text", struct.pack(f"<{len(held)}H", *held).decode("utf-16-le", "replace")


def _wide(data: bytes, at: int) -> str:
    if at + 2 > len(data):
        return ""
    n = struct.unpack_from("<H", data, at)[0]
    return data[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace")


class Hwp:
    def __init__(self, content: bytes, limits: Limits) -> None:
        self.file = Compound(content).streams
        head = self.file.get("FileHeader", b"")
        if len(head) < 40 or not head.startswith(b"HWP Document File"):
            raise Unreadable("FileHeader is missing")
        version, self.flags = struct.unpack_from("<II", head, 32)
        if version >> 24 != 5:
            raise Unreadable(f"version {version >> 24} isn't supported", "unsupported")
        if any(self.flags & bit for bit in _PROTECTED):
            raise Unreadable("the document is protected", "unsupported")
        self.limits = limits
        info = list(records(self._open("DocInfo")))
        self.styles = [_wide(d, 0) for t, _, d in info if t == STYLE]
        self.bins = [d for t, _, d in info if t == BIN_DATA]
        self.side: list[Element] = []
        self.notes: list[str] = []
        self.placed: set[str] = set()

    def _open(self, name: str) -> bytes:
        data = self.file.get(name, b"")
        if self.flags & 1 and data:
            try:
                return inflated(data, self.limits.xml_bytes)
            except (zlib.error, ValueError) as e:
                raise Unreadable(f"{name}: {e}") from None
        return data

    def _picture(self, node: Node) -> str:
        pic = next((n for n in _all(node) if n.tag == PICTURE), None)
        if pic is None or len(pic.data) < 73:
            return ""
        k = struct.unpack_from("<H", pic.data, 71)[0]
        if not 1 <= k <= len(self.bins):
            self.side.append(event("partial", f"그림 번호를 찾을 수 없음: {k}"))
            return ""
        item = self.bins[k - 1]
        kind = struct.unpack_from("<H", item, 0)[0] & 0xF
        if kind == 0:
            self.side.append(event("unverified", "외부 그림"))
            return f"![연결 그림]({_wide(item, 2)})"
        number = struct.unpack_from("<H", item, 2)[0]
        stem = f"BinData/BIN{number:04X}."
        name = next((s for s in self.file if s.upper().startswith(stem.upper())), None)
        if name is None:
            self.side.append(event("partial", f"그림 파일을 찾을 수 없음: {stem}"))
            return ""
        if name not in self.placed:
            self.placed.add(name)
            self.side.append(self._asset(name))
        return f"![그림: 내용 해석 안 됨](media/{name.rpartition('/')[2]})"

    def _asset(self, name: str) -> Element:
        data = self.file[name]
        return Element("asset", "media/" + name.rpartition("/")[2], 0, name, {"sha256": hashlib.sha256(data).hexdigest(), "bytes": str(len(data))}, data)

    def _lists(self, node: Node) -> Iterator[tuple[bytes, list[Node]]]:
        """Each list header with the paragraphs that follow it, as siblings or below it."""
        head: bytes | None = None
        own: list[Node] = []
        for n in node.below:
            if n.tag == LIST_HEADER:
                if head is not None:
                    yield head, own
                head, own = n.data, [x for x in n.below if x.tag == PARA_HEADER]
            elif n.tag == PARA_HEADER and head is not None:
                own.append(n)
        if head is not None:
            yield head, own

    def _texts(self, paragraphs: list[Node]) -> str:
        return "\n".join(e.text for p in paragraphs for e in self._paragraph(p))

    def _table(self, node: Node) -> str:
        cells, captions = [], []
        for head, own in self._lists(node):
            text = self._texts(own)
            col, row, cols, rows = struct.unpack_from("<4H", head, 8) if len(head) >= 16 else (9999, 0, 0, 0)
            if col > 4096 or row > 4096:
                captions.append(f"표 설명: {text}")
            else:
                cells.append(Cell(row + 1, col + 1, text, max(1, rows), max(1, cols), complex=any(n.tag == TABLE for p in own for n in _all(p))))
        return "\n\n".join([render(cells), *captions])

    def _control(self, node: Node) -> tuple[str, list[Element]]:
        kind = node.data[:4][::-1].decode("latin-1")
        if kind == "tbl ":
            return "", [Element("table", self._table(node))]
        if kind in ("fn  ", "en  ", "tcmt"):
            k = len(self.notes)
            self.notes.append("")
            label = f"[^{ {'fn  ': 'fn', 'en  ': 'en'}.get(kind, 'cm') }{k + 1}]"
            self.notes[k] = f"{label}: " + "\n".join(self._texts(own) for _, own in self._lists(node))
            return label, []
        if kind in ("head", "foot"):
            word = "머리말" if kind == "head" else "꼬리말"
            self.side.insert(0, Element("heading", f"{word}\n\n" + "\n".join(self._texts(own) for _, own in self._lists(node)), 2))
            return f"[{word} 위치]", []
        if kind == "eqed":
            script = next((_wide(n.data, 4) for n in _all(node) if n.tag == EQUATION), "")
            return f"`[수식] {script}`", []
        if kind.startswith("%"):
            command = _wide(node.data, 9)
            return f"[{kind.strip('% ')}: {inline(command)}]" if command else "", []
        if kind == "gso ":
            picture = self._picture(node)
            boxes = [t for n in [node, *_all(node)] for _, own in self._lists(n) if (t := self._texts(own)).strip()]
            if not picture and not boxes:
                self.side.append(event("unverified", "내용을 확인하지 못한 개체"))
                return "[개체: gso]", []
            return picture + "".join(f"[도형 글상자: {t}]" for t in boxes), []
        if kind in ("secd", "cold", "pgnp", "nwno", "pghd", "pgct", "idxm", "bokm", "atno", "tdut", "form"):
            return "", []
        self.side.append(event("unverified", f"알 수 없는 개체: {kind!r}"))
        return f"[개체: {kind.strip()}]" + "\n".join(self._texts(own) for _, own in self._lists(node)), []

    def _paragraph(self, p: Node) -> list[Element]:
        controls = [n for n in p.below if n.tag == CTRL_HEADER]
        out: list[str] = []
        blocks: list[Element] = []
        k = 0
        for n in (x for x in p.below if x.tag == PARA_TEXT):
            for kind, x in tokens(n.data):
                if kind == "text":
                    out.append(inline(str(x)))
                elif kind == "ctrl" and k < len(controls):
                    text, more = self._control(controls[k])
                    out.append(text)
                    blocks += more
                    k += 1
        if k < len(controls) and any(x.tag == PARA_TEXT for x in p.below):
            self.side.append(event("unverified", "개체 수가 본문과 다름"))
        for c in controls[k:]:
            text, more = self._control(c)
            out.append(text)
            blocks += more
        text = "".join(out)
        style = p.data[10] if len(p.data) > 10 else 0
        m = _LEVEL.search(self.styles[style]) if style < len(self.styles) else None
        own = [Element("heading", text, min(int(m[1]), 6)) if m else Element("para", text)] if text.strip() else []
        return own + blocks

    def elements(self) -> Iterator[Element]:
        names = sorted((n for n in self.file if re.fullmatch(r"BodyText/Section\d+", n)), key=lambda n: int(n[16:]))
        if not names:
            raise Unreadable("no section")
        for name in names:
            yield Element("para", f"<!-- 구역: {name} -->", 0, name, {"raw": "1"})
            for p in tree(self._open(name)):
                if p.tag == PARA_HEADER:
                    for e in self._paragraph(p):
                        e.part = e.part or name
                        yield e
        for n in self.notes:
            yield Element("note", n)
        if self.flags & 0x40 or self.flags & 0x80:
            yield event("unverified", "이력이나 서명이 있음")
        for n in self.file:
            if n.startswith("BinData/") and n not in self.placed:
                yield self._asset(n)
        yield from self.side


def _all(node: Node) -> Iterator[Node]:
    for n in node.below:
        yield n
        yield from _all(n)


def inflated(data: bytes, most: int) -> bytes:
    """A packed stream's bytes; one that grows beyond the bound is refused, not cut."""
    d = zlib.decompressobj(-15)
    out = d.decompress(data, most)
    if d.unconsumed_tail:
        raise ValueError(f"more than {most} bytes")
    return out


def paragraph_texts(content: bytes, most: int = Limits().xml_bytes) -> Iterator[str]:
    """The second route to a document's text: a flat scan over text records, without the tree."""
    file = Compound(content).streams
    packed = struct.unpack_from("<I", file.get("FileHeader", bytes(40)), 36)[0] & 1
    for name, data in file.items():
        if name.startswith("BodyText/Section"):
            raw = inflated(data, most) if packed else data
            for tag, _, payload in records(raw):
                if tag == PARA_TEXT:
                    yield from (str(x) for kind, x in tokens(payload) if kind == "text" and str(x).strip())
