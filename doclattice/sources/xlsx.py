"""Spreadsheet packages as sheets of cells; hidden sheets, leftovers and comments included."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator

from doclattice.model import Element, Limits, Unreadable, event
from doclattice.sources.grid import inline
from doclattice.sources.packages import Package, attr, child, every, local

_REF = re.compile(r"\$?([A-Z]+)\$?(\d+)")
WIDE, LONG = 12, 200


def place(ref: str) -> tuple[int, int]:
    """(row, column) of a cell name."""
    m = _REF.fullmatch(ref)
    if not m:
        return 0, 0
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]), col


def letters(col: int) -> str:
    out = ""
    while col:
        col, k = divmod(col - 1, 26)
        out = chr(65 + k) + out
    return out


def _shown(number: str) -> str:
    try:
        x = float(number)
    except ValueError:
        return number
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def _string(e) -> str:
    """Text of a shared or inline string, without phonetic runs."""
    return "".join((c.text or "") if local(c) == "t" else "".join(t.text or "" for t in c if local(t) == "t") for c in e if local(c) in ("t", "r"))


_REFERENCE = re.compile(r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|(?<![A-Za-z0-9_.$])(\$?)([A-Za-z]{1,3})(\$?)([0-9]{1,7})(?![A-Za-z0-9_.(])")


def shifted(formula: str, rows: int, columns: int) -> str:
    """A shared formula as a dependant cell has it: references without a dollar sign move along, texts and sheet names stay."""

    def move(m: re.Match) -> str:
        if m[2] is None:
            return m[0]
        row, col = place(m[2].upper() + m[4])
        row, col = row if m[3] else row + rows, col if m[1] else col + columns
        return f"{m[1]}{letters(col)}{m[3]}{row}" if row > 0 and col > 0 else "#REF!"

    return _REFERENCE.sub(move, formula)


class Xlsx:
    def __init__(self, content: bytes, limits: Limits) -> None:
        self.package, self.limits = Package(content, limits), limits
        self.book = self.package.xml("xl/workbook.xml")
        if self.book is None:
            raise Unreadable("xl/workbook.xml is missing")
        strings = self.package.xml("xl/sharedStrings.xml")
        self.strings = [_string(s) for s in strings if local(s) == "si"] if strings is not None else []
        self.formats = self._formats()

    def _formats(self) -> list[int]:
        """Number format of each cell style; a style behind an alternative keeps its place."""
        root = self.package.xml("xl/styles.xml")
        styles = child(root, "cellXfs")
        out = []
        for x in styles if styles is not None else ():
            e = next((y for y in x.iter() if local(y) == "xf"), None)
            out.append(int(attr(e, "numFmtId", "0")) if e is not None else 0)
        return out

    def sheets(self) -> Iterator[tuple[str, str, str]]:
        rel = self.package.relations("xl/workbook.xml")
        for s in every(self.book, "sheet"):
            yield attr(s, "name"), attr(s, "state", "visible"), rel.get(attr(s, "id"), ("", "", ""))[0]

    def cells(self, part: str) -> Iterator[tuple[int, int, str, str, str | None]]:
        """(row, column, kind, shown text, formula) of every stored cell."""
        root = self.package.xml(part)
        shared: dict[str, tuple[str, int, int]] = {}
        for c in every(root, "c") if root is not None else ():
            row, col = place(attr(c, "r"))
            kind, f, v = attr(c, "t", "n"), child(c, "f"), child(c, "v")
            value = v.text if v is not None else None
            formula = None
            if f is not None:
                formula = f.text
                if attr(f, "t") == "shared" and f.text:
                    shared[attr(f, "si")] = f.text, row, col
                elif attr(f, "t") == "shared":
                    master = shared.get(attr(f, "si"))
                    formula = shifted(master[0], row - master[1], col - master[2]) if master else "[원본에 수식 없음]"
            if kind == "s":
                k = int(value) if value and value.isdigit() else -1
                text = self.strings[k] if 0 <= k < len(self.strings) else ""
            elif kind == "inlineStr":
                text = _string(child(c, "is")) if child(c, "is") is not None else ""
            elif kind == "b":
                text = "TRUE" if value == "1" else "FALSE"
            else:
                text = "" if value is None else value if kind in ("e", "d", "str") else _shown(value)
            stored = value is not None or child(c, "is") is not None
            if kind in ("s", "inlineStr", "str") and stored and text == "":
                text = "[빈 문자열]"
            yield row, col, kind if stored else "", text, formula

    def elements(self) -> Iterator[Element]:
        left = self.limits.cells
        for name, state, part in self.sheets():
            if not part.startswith("xl/worksheets") or part not in self.package:
                yield event("unverified", f"시트를 건너뜀: {name}", part)
                continue
            root = self.package.xml(part)
            if root is None:
                yield event("unverified", f"시트를 읽을 수 없음: {name}", part)
                continue
            merged = [attr(m, "ref") for m in every(root, "mergeCell")]
            hidden = [attr(r, "r") for r in every(root, "row") if attr(r, "hidden") == "1"]
            columns = [f"{letters(int(attr(c, 'min', '1')))}:{letters(int(attr(c, 'max', '1')))}" for c in every(root, "col") if attr(c, "hidden") == "1"]
            head = f"시트: {name}" + (f" (숨김: {state})" if state != "visible" else "")
            yield Element("heading", head, 2, part)
            facts = [f"- 병합 셀: {', '.join(merged)}"] * bool(merged) + [f"- 숨김 행: {', '.join(hidden)}"] * bool(hidden) + [f"- 숨김 열: {', '.join(columns)}"] * bool(columns)
            if facts:
                yield Element("para", "\n".join(facts), 0, part, {"raw": "1"})
            under = [(place(a), place(b)) for a, _, b in (m.partition(":") for m in merged)]
            rows: dict[int, dict[int, str]] = {}
            leftovers = []
            for row, col, kind, text, formula in self.cells(part):
                if formula is not None:
                    text = f"={formula} → {text if kind else '[원본에 계산값 없음]'}"
                if not text:
                    continue
                if any(a[0] <= row <= b[0] and a[1] <= col <= b[1] and (row, col) != a for a, b in under):
                    leftovers.append(f"> - `{letters(col)}{row}`: {inline(text)}")
                    continue
                rows.setdefault(row, {})[col] = text
            for ref, note in self._comments(part):
                row, col = place(ref)
                rows.setdefault(row, {})[col] = f"{rows.get(row, {}).get(col, '')} [메모: {note}]".strip()
            used = sum(map(len, rows.values()))
            if used > left:
                yield event("partial", f"셀 한도를 넘음: {name}", part)
                for row in sorted(rows):  # whole rows only
                    if left < len(rows[row]):
                        rows = {k: v for k, v in rows.items() if k < row}
                        break
                    left -= len(rows[row])
                left = 0
            else:
                left -= used
            if rows:
                yield Element("table", self._table(rows), 0, part)
            if leftovers:
                yield Element("para", "\n".join(["> 병합 범위에 가려진 값:", *leftovers]), 0, part, {"raw": "1"})
        for n in self.package.names:
            if n.startswith("xl/media/"):
                data = self.package.bytes(n)
                yield Element("asset", "media/" + posixpath.basename(n), 0, n, {"sha256": hashlib.sha256(data).hexdigest(), "bytes": str(len(data))}, data)
            elif n.startswith("xl/externalLinks/") and n.endswith(".xml"):
                yield event("unverified", "외부 연결 정의가 있음", n)

    def _comments(self, part: str) -> Iterator[tuple[str, str]]:
        for target, _, kind in self.package.relations(part).values():
            root = self.package.xml(target) if kind == "comments" else None
            for c in every(root, "comment") if root is not None else ():
                yield attr(c, "ref"), "".join(t.text or "" for t in every(c, "t"))

    @staticmethod
    def _table(rows: dict[int, dict[int, str]]) -> str:
        width = max(max(r) for r in rows.values())
        if width > WIDE or len(rows) > LONG:
            esc = lambda x: x.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
            body = "\n".join("\t".join([str(k), *(esc(r.get(c, "")) for c in range(1, width + 1))]) for k, r in sorted(rows.items()))
            return f"```tsv\n{body}\n```"
        head = "| 행 | " + " | ".join(letters(c) for c in range(1, width + 1)) + " |"
        body = ["| " + " | ".join([str(k), *(inline(r.get(c, "")).replace("\n", "<br>") for c in range(1, width + 1))]) + " |" for k, r in sorted(rows.items())]
        return "\n".join([head, "|" + " --- |" * (width + 1), *body])
