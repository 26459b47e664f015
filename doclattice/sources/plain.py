"""Plain text and delimited files."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

from doclattice.model import Element, Unreadable

#: Encodings tried in this order; an encoding that is given fails hard.
ENCODINGS = ("utf-8-sig", "cp949", "utf-16")


def decode(content: bytes, encoding: str | None = None) -> tuple[str, str]:
    for name in (encoding,) if encoding else ENCODINGS:
        try:
            return content.decode(name), name
        except (UnicodeError, LookupError) as e:
            if encoding:
                raise Unreadable(f"{encoding}: {e}") from None
    raise Unreadable("the encoding can't be told")


def text_elements(content: bytes, ext: str, encoding: str | None = None) -> Iterator[Element]:
    text, name = decode(content, encoding)
    style = "CRLF" if "\r\n" in text else "CR" if "\r" in text else "LF"
    body = text.replace("\r\n", "\n").replace("\r", "\n")
    if ext != "md":
        fence = "`" * max(3, 1 + max(map(len, re.findall("`+", body)), default=0))
        body = f"{fence}text\n{body}\n{fence}"
    yield Element("para", body, 0, attrs={"raw": "1", "encoding": name, "line_ending": style})


def csv_rows(content: bytes, ext: str, encoding: str | None = None) -> list[list[str]]:
    text, _ = decode(content, encoding)
    return [row for row in csv.reader(io.StringIO(text, newline=""), delimiter="\t" if ext == "tsv" else ",")]


def csv_elements(content: bytes, ext: str, encoding: str | None = None) -> Iterator[Element]:
    """All rows as they are, ragged ones too; the header is column numbers, the first row never becomes it."""
    rows = csv_rows(content, ext, encoding)
    width = max(map(len, rows), default=0)
    cell = lambda x: x.replace("\\", "\\\\").replace("|", "\\|").replace("\r\n", "\n").replace("\n", "<br>")
    lines = ["| 행 | " + " | ".join(f"열{k}" for k in range(1, width + 1)) + " |", "|" + " --- |" * (width + 1)]
    lines += ["| " + " | ".join([str(k), *map(cell, r), *[""] * (width - len(r))]) + " |" for k, r in enumerate(rows, 1)]
    widths = sorted({len(r) for r in rows})
    if len(widths) > 1:
        lines += ["", f"> 행마다 열 수가 다르다({', '.join(map(str, widths))})"]
    yield Element("table", "\n".join(lines), 0, attrs={"row_widths": ",".join(str(len(r)) for r in rows)})
