"""Presentation packages: slides in the order of the presentation, shapes, tables, charts, notes."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from doclattice.model import Element, Limits, Unreadable, event
from doclattice.sources.grid import Cell, inline, render
from doclattice.sources.packages import Package, attr, child, every, local, rel_id


def points(cache: ET.Element | None) -> list[str]:
    """Cached points of a chart in the order of their index; gaps are blank."""
    got = {int(attr(p, "idx", "0")): (child(p, "v").text or "") if child(p, "v") is not None else "" for p in (every(cache, "pt") if cache is not None else ())}
    return [got.get(k, "") for k in range(max(got, default=-1) + 1)]


class Pptx:
    def __init__(self, content: bytes, limits: Limits) -> None:
        self.package = Package(content, limits)
        self.show = self.package.xml("ppt/presentation.xml")
        if self.show is None:
            raise Unreadable("ppt/presentation.xml is missing")
        self.side: list[Element] = []
        self.saved: set[str] = set()

    def _text(self, e: ET.Element) -> str:
        out = []
        for p in every(e, "p"):
            line = "".join("\n" if local(x) == "br" else inline(x.text or "") for x in p.iter() if local(x) in ("t", "br"))
            out.append(line)
        return "\n".join(out).strip("\n")

    def _asset(self, part: str, rid: str) -> str | None:
        target, mode, _ = self.package.relations(part).get(rid, ("", "", ""))
        if mode == "External":
            self.side.append(event("unverified", f"외부 그림: {target}", part))
        elif target not in self.package:
            self.side.append(event("partial", f"그림 파일을 찾을 수 없음: {target or rid}", part))
        else:
            name = "media/" + posixpath.basename(target)
            if name not in self.saved:
                self.saved.add(name)
                data = self.package.bytes(target)
                self.side.append(Element("asset", name, 0, target, {"sha256": hashlib.sha256(data).hexdigest(), "bytes": str(len(data))}, data))
            return name
        return None

    def _table(self, t: ET.Element) -> str:
        cells = []
        for r, row in enumerate((x for x in t if local(x) == "tr"), 1):
            for c, cell in enumerate((x for x in row if local(x) == "tc"), 1):
                if attr(cell, "hMerge") == "1" or attr(cell, "vMerge") == "1":
                    continue
                cells.append(Cell(r, c, self._text(cell), int(attr(cell, "rowSpan", "1")), int(attr(cell, "gridSpan", "1"))))
        return render(cells, attr(child(t, "tblPr"), "firstRow") == "1" if child(t, "tblPr") is not None else False)

    def chart(self, part: str, rid: str) -> str:
        """Categories by series as a table."""
        target = self.package.relations(part).get(rid, ("",))[0]
        root = self.package.xml(target)
        if root is None:
            self.side.append(event("unverified", f"차트 조각을 읽을 수 없음: {target}", part))
            return ""
        title = "".join(t.text or "" for c in every(root, "title") for t in every(c, "t"))
        series = []
        for s in every(root, "ser"):
            name = points(child(s, "tx"))
            series.append((name[0] if name else "", points(child(s, "cat")), points(child(s, "val"))))
        n = max((max(len(c), len(v)) for _, c, v in series), default=0)
        cats = next((c for _, c, _ in series if c), [])
        at = lambda x, k: inline(x[k]) if k < len(x) else ""
        rows = ["| 구분 | " + " | ".join(inline(s) for s, _, _ in series) + " |", "|" + " --- |" * (len(series) + 1)]
        rows += ["| " + " | ".join([at(cats, k), *(at(v, k) for _, _, v in series)]) + " |" for k in range(n)]
        return f"**차트: {inline(title)}**\n\n" + "\n".join(rows)

    def _shapes(self, tree: ET.Element, part: str) -> Iterator[Element]:
        for s in tree:
            tag = local(s)
            if tag == "sp" or tag == "cxnSp":
                text = self._text(s)
                if text.strip():
                    ph = next((attr(p, "type") for p in every(s, "ph")), "")
                    yield Element("heading" if ph in ("title", "ctrTitle") else "para", text, 3, part)
            elif tag == "grpSp":
                yield from self._shapes(s, part)
            elif tag == "pic":
                alt = next((attr(d, "descr") for d in every(s, "cNvPr")), "")
                rid = next((attr(b, "embed") or attr(b, "link") for b in every(s, "blip")), "")
                if name := self._asset(part, rid):
                    yield Element("para", f"![그림: {alt}]({name})", 0, part, {"raw": "1"})
            elif tag == "graphicFrame":
                table = next(every(s, "tbl"), None)
                chart = next((c for c in every(s, "chart") if rel_id(c)), None)
                if table is not None:
                    yield Element("table", self._table(table), 0, part)
                elif chart is not None:
                    if text := self.chart(part, rel_id(chart)):
                        yield Element("table", text, 0, part)
                elif self._text(s).strip():
                    yield Element("para", self._text(s), 0, part)
                else:
                    self.side.append(event("unverified", "내용을 확인하지 못한 개체", part))
            elif tag == "AlternateContent":
                chosen = child(s, "Choice")
                yield from self._shapes(chosen, part) if chosen is not None else ()

    def elements(self) -> Iterator[Element]:
        rel = self.package.relations("ppt/presentation.xml")
        order = [rel.get(rel_id(s), ("",))[0] for s in every(self.show, "sldId")]
        if not order:
            order = sorted(n for n in self.package.names if n.startswith("ppt/slides/slide") and n.endswith(".xml"))
            yield event("unverified", "슬라이드 순서를 알 수 없음")
        for k, part in enumerate(order, 1):
            root = self.package.xml(part)
            if root is None:
                yield event("partial", f"슬라이드를 읽을 수 없음: {part}", part)
                continue
            yield Element("heading", f"슬라이드 {k} ({posixpath.basename(part)})", 2, part)
            for b in (x for bg in every(root, "bg") for x in every(bg, "blip")):
                if name := self._asset(part, attr(b, "embed")):
                    yield Element("para", f"> 슬라이드 배경 그림: ![배경]({name})", 0, part, {"raw": "1"})
            tree = next(every(root, "spTree"), None)
            yield from self._shapes(tree, part) if tree is not None else ()
            for target, _, kind in self.package.relations(part).values():
                notes = self.package.xml(target) if kind == "notesSlide" else None
                text = "\n".join(t for s in every(notes, "sp") if next((attr(p, "type") for p in every(s, "ph")), "") not in ("sldNum", "sldImg", "dt", "hdr", "ftr") for t in [self._text(s)] if t.strip()) if notes is not None else ""
                if text:
                    yield Element("heading", f"슬라이드 {k} 발표자 노트", 3, target)
                    yield Element("para", text, 0, target)
        yield from self.side
