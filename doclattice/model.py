"""Row schemas and limits that the sources share."""

from __future__ import annotations

from dataclasses import dataclass, field

ELEMENTS = "path string, ord int, part string, kind string, level int, text string, attrs map<string,string>, data binary"
PARTS = "path string, part string, ord int, data binary, error string"


@dataclass(frozen=True)
class Limits:
    """Bounds that keep one file from taking a worker down; beyond them a file fails or is partial, never cut silently."""

    file_bytes: int = 512 << 20
    zip_entries: int = 20_000
    unzipped_bytes: int = 2 << 30
    xml_bytes: int = 256 << 20
    cells: int = 2_000_000
    pages: int = 5_000


@dataclass
class Element:
    """One block, asset or event of a document, in document order.

    kinds: heading, para, item, table, note, asset, event (attrs: status, reason).
    """

    kind: str
    text: str = ""
    level: int = 0
    part: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    data: bytes | None = None


def event(status: str, reason: str, part: str = "") -> Element:
    return Element("event", reason, part=part, attrs={"status": status})


class Unreadable(Exception):
    """The file can't be read at all; carries the status of its one event."""

    def __init__(self, reason: str, status: str = "failed") -> None:
        super().__init__(reason)
        self.status = status
