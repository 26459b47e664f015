"""HWPX packages: sections in the order of the spine; tables, notes, equations, pictures."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from doclattice.model import Element, Limits, Unreadable, event
from doclattice.sources.grid import Cell, inline, render
from doclattice.sources.packages import Package, attr, child, every, local

# Characters that stand for elements inside a text element.
_MARKS = {"tab": "\t", "lineBreak": "\n", "nbSpace": "\xa0", "fwSpace": "　", "hyphen": "-"}
_LAYOUT = frozenset({"secPr", "linesegarray", "colPr", "pageNum", "newNum", "ctrlMask", "bookmark", "sz", "pos", "outMargin", "inMargin", "shapeComment", "cellzoneList"})
_LEVEL = re.compile(r"(?:개요|제목)\s*(\d+)")


class Hwpx:
    def __init__(self, content: bytes, limits: Limits) -> None:
        self.package = Package(content, limits)
        self.side: list[Element] = []
        self.notes: list[str] = []
        self.placed: set[str] = set()
        container = self.package.xml("META-INF/container.xml")
        root_file = next((attr(r, "full-path") for r in every(container, "rootfile")), "") if container is not None else ""
        self.opf = root_file if root_file in self.package else "Contents/content.hpf"
        self.manifest = self.package.xml(self.opf)
        if self.manifest is None:
            raise Unreadable("the package's manifest is missing")
        base = posixpath.dirname(self.opf)
        self.files = {}
        for i in every(self.manifest, "item"):
            href = attr(i, "href")
            self.files[attr(i, "id")] = href if href in self.package else posixpath.normpath(posixpath.join(base, href))
        header = next((self.package.xml(f) for f in self.files.values() if f.endswith("header.xml")), None)
        self.levels = {attr(s, "id"): int(m[1]) for s in every(header, "style") if (m := _LEVEL.search(attr(s, "name")))} if header is not None else {}
        self.kinds = {attr(p, "id"): (attr(h, "type"), int(attr(h, "level", "0"))) for p in every(header, "paraPr") if (h := child(p, "heading")) is not None} if header is not None else {}

    def _sections(self) -> list[str]:
        spine = [self.files.get(attr(r, "idref"), "") for r in every(self.manifest, "itemref")]
        parts = [p for p in spine if re.search(r"section\d+\.xml$", p) and p in self.package]
        if not parts:
            parts = sorted((n for n in self.package.names if re.search(r"section\d+\.xml$", n) and not n.startswith("Preview/")), key=lambda n: int(re.findall(r"\d+", n)[-1]))
            if parts:
                self.side.append(event("unverified", "구역 순서를 알 수 없어 파일 이름 순서를 썼다"))
        if not parts:
            raise Unreadable("no section")
        return parts

    def _t(self, t: ET.Element) -> str:
        out = [inline(t.text or "")]
        for c in t:
            out += [_MARKS.get(local(c), "") or inline("".join(c.itertext())), inline(c.tail or "")]
        return "".join(out)

    def _picture(self, e: ET.Element, part: str) -> str:
        ref = next((attr(i, "binaryItemIDRef") for i in e.iter() if attr(i, "binaryItemIDRef")), "")
        target = self.files.get(ref, "")
        if target not in self.package:
            self.side.append(event("partial", f"그림 파일을 찾을 수 없음: {target or ref}", part))
            return ""
        name = "media/" + posixpath.basename(target)
        if target not in self.placed:
            self.placed.add(target)
            data = self.package.bytes(target)
            self.side.append(Element("asset", name, 0, target, {"sha256": hashlib.sha256(data).hexdigest(), "bytes": str(len(data))}, data))
        return f"![그림: 내용 해석 안 됨]({name})"

    def _table(self, t: ET.Element, part: str) -> str:
        cells = []
        for c in (x for row in t if local(row) == "tr" for x in row if local(x) == "tc"):
            at, span = child(c, "cellAddr"), child(c, "cellSpan")
            text = "\n".join(b.text for p in every_direct(c) for b in self._paragraph(p, part))
            cells.append(Cell(int(attr(at, "rowAddr", "0")) + 1 if at is not None else 1, int(attr(at, "colAddr", "0")) + 1 if at is not None else len(cells) + 1, text, max(1, int(attr(span, "rowSpan", "1"))) if span is not None else 1, max(1, int(attr(span, "colSpan", "1"))) if span is not None else 1, complex=any(local(x) == "tbl" for x in c.iter())))
        return render(cells, attr(t, "repeatHeader") == "1" and len(cells) > 1)

    def _inline(self, e: ET.Element, part: str) -> tuple[str, list[Element]]:
        out, blocks = [], []
        for c in e:
            tag = local(c)
            if tag == "t":
                out.append(self._t(c))
            elif tag == "tbl":
                blocks.append(Element("table", self._table(c, part), 0, part))
            elif tag in ("footNote", "endNote", "hiddenComment"):
                k = len(self.notes)
                self.notes.append("")
                label = f"[^{'fn' if tag == 'footNote' else 'en' if tag == 'endNote' else 'cm'}{k + 1}]"
                self.notes[k] = f"{label}: " + "\n".join(b.text for p in every(c, "p") for b in self._paragraph(p, part))
                out.append(label)
            elif tag == "equation":
                script = "".join(s.text or "" for s in every(c, "script"))
                out.append(f"`[수식] {script}`")
            elif tag in ("pic", "ole"):
                out.append(self._picture(c, part))
            elif tag == "fieldBegin":
                command = next((p.text or "" for p in c.iter() if local(p) == "stringParam" and attr(p, "name") == "Command"), "")
                out.append(f"[{attr(c, 'type')}: {command}]" if command else "")
            elif tag in ("header", "footer"):
                text = "\n".join(b.text for p in every(c, "p") for b in self._paragraph(p, part))
                out.append(f"[{'머리말' if tag == 'header' else '꼬리말'} 위치]")
                self.side.insert(0, Element("heading", f"{'머리말' if tag == 'header' else '꼬리말'}\n\n{text}", 2, part))
            elif tag == "drawText":
                out.append("[도형 글상자: " + "\n".join(b.text for p in every(c, "p") for b in self._paragraph(p, part)) + "]")
            elif tag in ("rect", "ellipse", "polygon", "curve", "arc", "line", "connectLine", "container", "textart"):
                text, more = self._inline(c, part)
                blocks += more
                if not text and not more and tag != "line":
                    self.side.append(event("unverified", "내용을 확인하지 못한 개체", part))
                    text = f"[개체: {tag}]"
                out.append(text)
            elif tag not in _LAYOUT:
                text, more = self._inline(c, part)
                out.append(text)
                blocks += more
        return "".join(out), blocks

    def _paragraph(self, p: ET.Element, part: str) -> list[Element]:
        text, blocks = self._inline(p, part)
        kind, depth = self.kinds.get(attr(p, "paraPrIDRef"), ("", 0))
        level = self.levels.get(attr(p, "styleIDRef"), 0) or (depth + 1 if kind == "OUTLINE" else 0)
        if not text.strip():
            return blocks
        if level:
            return [Element("heading", text, min(level, 6), part), *blocks]
        if kind in ("NUMBER", "BULLET"):
            return [Element("item", text, depth, part, {"mark": "1." if kind == "NUMBER" else "-"}), *blocks]
        return [Element("para", text, 0, part), *blocks]

    def elements(self) -> Iterator[Element]:
        for part in self._sections():
            root = self.package.xml(part)
            if root is None:
                yield event("partial", f"구역을 읽을 수 없음: {part}", part)
                continue
            yield Element("para", f"<!-- 구역: {part} -->", 0, part, {"raw": "1"})
            for p in (x for x in root if local(x) == "p"):
                yield from self._paragraph(p, part)
        for n in self.notes:
            yield Element("note", n)
        for n in self.package.names:
            if n.startswith("BinData/") and n not in self.placed:
                data = self.package.bytes(n)
                yield Element("asset", "media/" + posixpath.basename(n), 0, n, {"sha256": hashlib.sha256(data).hexdigest(), "bytes": str(len(data))}, data)
                yield event("unverified", f"본문에서 참조를 확인하지 못한 자산: {n}", n)
        yield from self.side


def every_direct(c: ET.Element) -> Iterator[ET.Element]:
    """Paragraphs of a cell, not those of tables inside it."""
    for x in c:
        if local(x) == "p":
            yield x
        elif local(x) == "subList":
            yield from every_direct(x)
