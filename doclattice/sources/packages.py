"""ZIP packages: guarded opening, XML, relationships, format by content."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from doclattice.model import Limits, Unreadable

_DTD = re.compile(rb"<!\s*(?:DOCTYPE|ENTITY)", re.I)
_DRIVE = re.compile(r"^[a-zA-Z]:")


class Package:
    """A ZIP whose entries are known to be few, small and inside the package."""

    def __init__(self, content: bytes, limits: Limits) -> None:
        self.limits = limits
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise Unreadable(f"not a ZIP package: {e}") from None
        infos = self.zip.infolist()
        if len(infos) > limits.zip_entries:
            raise Unreadable(f"{len(infos)} entries; {limits.zip_entries} are allowed")
        if sum(i.file_size for i in infos) > limits.unzipped_bytes:
            raise Unreadable("unpacked size above the limit")
        for i in infos:
            name = i.filename.replace("\\", "/")
            if name.startswith("/") or _DRIVE.match(name) or ".." in name.split("/"):
                raise Unreadable(f"entry outside the package: {i.filename}")
        self.names = [i.filename for i in infos if not i.is_dir()]
        self._known = set(self.names)

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def bytes(self, name: str) -> bytes:
        return self.zip.read(name)

    def xml(self, name: str) -> ET.Element | None:
        """The part's tree; None where the part is missing or malformed. Document types are refused."""
        if name not in self:
            return None
        data = self.bytes(name)
        if len(data) > self.limits.xml_bytes:
            raise Unreadable(f"{name} is above the XML limit")
        if _DTD.search(data[:65_536]):
            raise Unreadable(f"{name} declares a document type")
        try:
            return ET.fromstring(data)
        except ET.ParseError:
            return None

    def relations(self, part: str) -> dict[str, tuple[str, str, str]]:
        """Id → (target as a package path or external address, mode, kind) of a part."""
        folder, base = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", base + ".rels"))
        out = {}
        for r in root if root is not None else ():
            target, mode = r.get("Target", ""), r.get("TargetMode", "")
            out[r.get("Id", "")] = (target if mode == "External" else resolve(part, target), mode, r.get("Type", "").rpartition("/")[2])
        return out


def resolve(part: str, target: str) -> str:
    """A relationship's target as a package path."""
    if target.startswith("/"):
        return posixpath.normpath(target.lstrip("/"))
    return posixpath.normpath(posixpath.join(posixpath.dirname(part), target))


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def attr(e: ET.Element, name: str, default: str = "") -> str:
    """An attribute by local name."""
    if name in e.attrib:
        return e.attrib[name]
    return next((v for k, v in e.attrib.items() if k.endswith("}" + name)), default)


def rel_id(e: ET.Element) -> str:
    """The relationship that an element names; not its own plain id."""
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), "")


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    """The first descendant along a path of local names."""
    for name in path:
        e = next((c for c in e if local(c) == name), None) if e is not None else None
    return e


def every(e: ET.Element, name: str):
    return (c for c in e.iter() if local(c) == name)


def detect(content: bytes) -> str | None:
    """The format that the content shows, whatever the name says."""
    if content[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        return "hwp"
    if content[:5] == b"%PDF-":
        return "pdf"
    if content[:4] != b"PK\x03\x04":
        return None
    try:
        names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
    except zipfile.BadZipFile:
        return None
    for name, fmt in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx")):
        if name in names:
            return fmt
    return "hwpx" if "mimetype" in names or any(n.endswith("content.hpf") for n in names) else None
