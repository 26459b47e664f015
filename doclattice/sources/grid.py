"""Tables of documents: simple ones as Markdown tables, others cell by cell with coordinates."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Cell:
    row: int
    col: int
    text: str
    rows: int = 1
    cols: int = 1
    complex: bool = False
    merge: str = ""  # start or go, of a merge that is told row by row


def _in_cell(text: str) -> str:
    return text.replace("\n", "<br>")


def _below(text: str) -> str:
    lines = text.split("\n")
    return text.replace("\n", "\n    ") if any(x.lstrip()[:1] in ("|", ">") for x in lines) else "<br>".join(lines)


def render(cells: list[Cell], header: bool = False) -> str:
    """Markdown of a table. Without a header row in the source, columns are numbered and that is said."""
    if not cells:
        return ""
    cells = sorted(cells, key=lambda c: (c.row, c.col))
    if any(c.rows > 1 or c.cols > 1 or c.complex or c.merge for c in cells):
        out = []
        for c in cells:
            notes = [f"가로병합 {c.cols}칸"] if c.cols > 1 else []
            if c.rows > 1:
                notes.append(f"세로병합 {c.rows}칸")
            elif c.merge:
                notes.append("세로병합 시작" if c.merge == "start" else "세로병합 계속")
            out.append(f"- **R{c.row}C{c.col}**{f' ({", ".join(notes)})' if notes else ''}: {_below(c.text)}")
        return "\n".join(out)
    width = max(c.col for c in cells)
    rows: dict[int, list[str]] = {}
    for c in cells:
        rows.setdefault(c.row, [""] * width)[c.col - 1] = _in_cell(c.text)
    lines = ["| " + " | ".join(r) + " |" for _, r in sorted(rows.items())]
    rule = "|" + " --- |" * width
    if header:
        return "\n".join([lines[0], rule, *lines[1:]])
    head = "| " + " | ".join(f"열{k}" for k in range(1, width + 1)) + " |"
    return "\n".join(["> 원본에 헤더 행 표시가 없어 열 번호를 붙였다", "", head, rule, *lines])


def inline(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\|")
