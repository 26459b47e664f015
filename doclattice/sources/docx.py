"""Word-processor packages (WordprocessingML) as elements in document order."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from doclattice.model import Element, Limits, Unreadable, event
from doclattice.sources.grid import Cell, inline, render
from doclattice.sources.packages import Package, attr, child, every, local

_LEVEL = re.compile(r"(?:heading|제목|개요|title)\s*(\d+)", re.I)
_CHANGES = {"ins": ("{+삽입:", "+}"), "del": ("{-삭제:", "-}"), "moveFrom": ("{moveFrom:", "}"), "moveTo": ("{moveTo:", "}")}
_NOTES = {"footnoteReference": "fn", "endnoteReference": "en", "commentReference": "cm"}


def _on(props: ET.Element | None, name: str) -> bool:
    e = child(props, name)
    return e is not None and attr(e, "val", "1") not in ("0", "false", "none")


class Docx:
    def __init__(self, content: bytes, limits: Limits) -> None:
        self.package = Package(content, limits)
        if "word/document.xml" not in self.package:
            raise Unreadable("word/document.xml is missing")
        self.part, self.events, self.assets = "word/document.xml", [], {}
        self.relations = self.package.relations(self.part)
        self.levels = self._levels()
        self.lists = self._lists()

    def _levels(self) -> dict[str, int]:
        """Style id → heading level."""
        root, out = self.package.xml("word/styles.xml"), {}
        for s in every(root, "style") if root is not None else ():
            name = child(s, "name")
            m = _LEVEL.search(attr(name, "val") if name is not None else "")
            outline = child(s, "pPr", "outlineLvl")
            level = int(m[1]) if m else int(attr(outline, "val", "9")) + 1 if outline is not None else 0
            if 1 <= level <= 9:
                out[attr(s, "styleId")] = min(level, 6)
        return out

    def _lists(self) -> dict[tuple[str, str], str]:
        """(list id, level) → number format: two equi-lookups, list → abstract list → level."""
        root = self.package.xml("word/numbering.xml")
        if root is None:
            return {}
        abstract = {attr(a, "abstractNumId"): {attr(v, "ilvl"): attr(child(v, "numFmt"), "val") for v in every(a, "lvl") if child(v, "numFmt") is not None} for a in root if local(a) == "abstractNum"}
        return {(attr(n, "numId"), k): v for n in root if local(n) == "num" for k, v in abstract.get(attr(child(n, "abstractNumId"), "val"), {}).items()}

    def _asset(self, rid: str) -> str | None:
        target, mode, _ = self.relations.get(rid, ("", "", ""))
        if mode == "External":
            self.events.append(event("unverified", f"외부 그림: {target}", self.part))
            return None
        if target not in self.package:
            self.events.append(event("partial", f"그림 파일을 찾을 수 없음: {target or rid}", self.part))
            return None
        name = "media/" + posixpath.basename(target)
        self.assets[name] = (self.package.bytes(target), target)
        return name

    def _graphic(self, e: ET.Element) -> str:
        boxes = [t for box in every(e, "txbxContent") for t in [self._plain(box)] if t.strip()]
        out = "".join(f"[텍스트상자: {t}]" for t in dict.fromkeys(boxes))
        alt = next((attr(d, "descr") for d in every(e, "docPr") if attr(d, "descr")), "")
        seen = set()
        for tag, mark in (("blip", "embed"), ("imagedata", "id")):
            for b in every(e, tag):
                rid = attr(b, mark) or attr(b, "link")
                if rid and rid not in seen and (name := self._asset(rid)):
                    seen.add(rid)
                    out += f"![이미지: {alt}]({name})[이미지: 내용 해석 안 됨]"
        for o in every(e, "OLEObject"):
            if name := self._asset(attr(o, "id")):
                out += f"![임베디드개체: {attr(o, 'ProgID')}]({name})"
        if not out:
            self.events.append(event("unverified", "내용을 확인하지 못한 개체", self.part))
            out = f"[도형/빈 그림틀: {alt}]"
        return out

    def _plain(self, box: ET.Element) -> str:
        return "\n".join(self._inline(p) for p in every(box, "p"))

    def _run(self, r: ET.Element) -> str:
        props = child(r, "rPr")
        text = self._inline(r)
        if not text.strip():
            return text
        if _on(props, "b"):
            text = f"**{text}**"
        if _on(props, "i"):
            text = f"*{text}*"
        if _on(props, "strike") or _on(props, "dstrike"):
            text = f"~~{text}~~"
        color, fill, mark = child(props, "color"), child(props, "shd"), child(props, "highlight")
        css = []
        if color is not None and attr(color, "val", "auto") != "auto":
            css.append(f"color:#{attr(color, 'val')}")
        if fill is not None and attr(fill, "fill", "auto") != "auto":
            css.append(f"background:#{attr(fill, 'fill')}")
        elif mark is not None:
            css.append(f"background:{attr(mark, 'val')}")
        return f'<span style="{";".join(css)}">{text}</span>' if css else text

    def _inline(self, e: ET.Element) -> str:
        out = []
        for c in e:
            tag = local(c)
            if tag in ("t", "delText", "instrText"):
                out.append(inline((c.text or "").replace("\r", "\n")))
            elif tag == "r":
                out.append(self._run(c))
            elif tag == "tab":
                out.append("\t")
            elif tag in ("br", "cr"):
                out.append("\n")
            elif tag == "noBreakHyphen":
                out.append("-")
            elif tag == "sym":
                out.append(chr(int(attr(c, "char", "F0B7"), 16)))
            elif tag == "hyperlink":
                target = self.relations.get(attr(c, "id"), ("", "", ""))[0]
                out.append(f"[{self._inline(c)}]({target or '#' + attr(c, 'anchor')})")
            elif tag in _CHANGES:
                a, z = _CHANGES[tag]
                out.append(a + self._inline(c) + z)
            elif tag in _NOTES:
                out.append(f"[^{_NOTES[tag]}{attr(c, 'id')}]")
            elif tag in ("drawing", "pict", "object"):
                out.append(self._graphic(c))
            elif tag == "AlternateContent":
                chosen = child(c, "Choice") if child(c, "Choice") is not None else child(c, "Fallback")
                out.append(self._inline(chosen) if chosen is not None else "")
            elif tag not in ("pPr", "rPr", "tblPr", "tcPr", "trPr", "sdtPr", "sdtEndPr"):
                out.append(self._inline(c))  # unknown containers keep their text
        return "".join(out)

    def _paragraph(self, p: ET.Element) -> Element | None:
        text, props = self._inline(p), child(p, "pPr")
        if not text.strip():
            return None
        style = child(props, "pStyle")
        level = self.levels.get(attr(style, "val"), 0) if style is not None else 0
        number = child(props, "numPr")
        if level:
            return Element("heading", text, level, self.part)
        if number is not None:
            depth = attr(child(number, "ilvl"), "val", "0") if child(number, "ilvl") is not None else "0"
            fmt = self.lists.get((attr(child(number, "numId"), "val") if child(number, "numId") is not None else "", depth), "bullet")
            return Element("item", text, int(depth), self.part, {"mark": "-" if fmt in ("bullet", "none") else "1."})
        return Element("para", text, 0, self.part)

    def _table(self, t: ET.Element) -> str:
        cells, header = [], False
        for r, row in enumerate((x for x in every_row(t)), 1):
            header |= r == 1 and child(row, "trPr", "tblHeader") is not None
            col = 1
            for c in (x for x in row if local(x) == "tc"):
                props = child(c, "tcPr")
                span = int(attr(child(props, "gridSpan"), "val", "1")) if child(props, "gridSpan") is not None else 1
                merge = child(props, "vMerge")
                blocks = [b.text if isinstance(b, Element) else b for b in self._blocks(c)]
                kind = "" if merge is None else "start" if attr(merge, "val") == "restart" else "go"
                cells.append(Cell(r, col, "\n".join(blocks), cols=span, complex=any(local(x) == "tbl" for x in c), merge=kind))
                col += span
        return render(cells, header)

    def _blocks(self, body: ET.Element) -> Iterator[Element]:
        for b in body:
            tag = local(b)
            if tag == "p":
                if e := self._paragraph(b):
                    yield e
            elif tag == "tbl":
                yield Element("table", self._table(b), 0, self.part)
            elif tag not in ("sectPr", "tcPr"):
                yield from self._blocks(b)

    def elements(self) -> Iterator[Element]:
        body = child(self.package.xml(self.part), "body")
        yield from self._blocks(body) if body is not None else ()
        main = self.relations
        for part, tag, label in (("word/footnotes.xml", "footnote", "fn"), ("word/endnotes.xml", "endnote", "en"), ("word/comments.xml", "comment", "cm")):
            root = self.package.xml(part)
            self.part, self.relations = part, self.package.relations(part)
            for n in root if root is not None else ():
                if local(n) == tag and attr(n, "type") not in ("separator", "continuationSeparator", "continuationNotice"):
                    who = f" ({attr(n, 'author')})" if label == "cm" and attr(n, "author") else ""
                    yield Element("note", f"[^{label}{attr(n, 'id')}]: {self._plain(n)}{who}", 0, part)
        for target, _, kind in sorted(main.values()):
            if kind in ("header", "footer") and target in self.package:
                self.part, self.relations = target, self.package.relations(target)
                root = self.package.xml(target)
                blocks = list(self._blocks(root)) if root is not None else []
                if blocks:
                    yield Element("heading", f"{'머리글' if kind == 'header' else '바닥글'}: {posixpath.basename(target)}", 2, target)
                    yield from blocks
        yield from self.events
        for name, (data, part) in self.assets.items():
            yield Element("asset", name, 0, part, {"sha256": hashlib.sha256(data).hexdigest(), "bytes": str(len(data))}, data)


def every_row(t: ET.Element) -> Iterator[ET.Element]:
    for c in t:
        if local(c) == "tr":
            yield c
        elif local(c) in ("sdt", "sdtContent", "ins"):
            yield from every_row(c)
