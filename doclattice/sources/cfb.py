"""Compound files (OLE) by their published layout: sectors, allocation tables, directory."""

from __future__ import annotations

import struct

from doclattice.model import Unreadable

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF


class Compound:
    """Streams by path, such as BodyText/Section0."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != SIGNATURE or len(content) < 512:
            raise Unreadable("not a compound file")
        self.data = content
        self.size = 1 << struct.unpack_from("<H", content, 30)[0]
        self.small = 1 << struct.unpack_from("<H", content, 32)[0]
        n_fat, first_dir = struct.unpack_from("<II", content, 44)
        self.cutoff, first_mini, _, first_more, n_more = struct.unpack_from("<IIIII", content, 56)
        heads = list(struct.unpack_from("<109I", content, 76))
        for _ in range(n_more):
            if first_more >= _END:
                break
            block = self._words(first_more)
            heads += block[:-1]
            first_more = block[-1]
        self.fat = [x for h in heads[: max(n_fat, 0)] if h < _END for x in self._words(h)]
        directory = self._chain(first_dir)
        self.mini = [x for s in [self._chain(first_mini)] for x in struct.unpack(f"<{len(s) // 4}I", s)] if first_mini < _END else []
        self.entries = [directory[k : k + 128] for k in range(0, len(directory), 128)]
        if not self.entries or len(self.entries[0]) < 128:
            raise Unreadable("no directory")
        self.pool = self._chain(struct.unpack_from("<I", self.entries[0], 116)[0])
        self.streams: dict[str, bytes] = {}
        self._walk()

    def _words(self, sector: int) -> list[int]:
        at = (sector + 1) * self.size
        raw = self.data[at : at + self.size]
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _chain(self, first: int) -> bytes:
        out, seen = [], 0
        while first < _END and first < len(self.fat):
            seen += 1
            if seen > len(self.fat):
                raise Unreadable("a chain of sectors runs in a circle")
            at = (first + 1) * self.size
            out.append(self.data[at : at + self.size])
            first = self.fat[first]
        return b"".join(out)

    def _stream(self, entry: bytes) -> bytes:
        first, size = struct.unpack_from("<IQ", entry, 116)
        if size >= self.cutoff:
            return self._chain(first)[:size]
        out, seen = [], 0
        while first < _END and first < len(self.mini):
            seen += 1
            if seen > len(self.mini):
                raise Unreadable("a chain of small sectors runs in a circle")
            out.append(self.pool[first * self.small : (first + 1) * self.small])
            first = self.mini[first]
        return b"".join(out)[:size]

    def _walk(self) -> None:
        """All entries below the root, by an own stack; the tree's colours don't matter for reading."""
        stack, seen = [(struct.unpack_from("<I", self.entries[0], 76)[0], "")], set()
        while stack:
            k, folder = stack.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            e = self.entries[k]
            length = struct.unpack_from("<H", e, 64)[0]
            name = e[: max(0, length - 2)].decode("utf-16-le", "replace")
            left, right, below = struct.unpack_from("<III", e, 68)
            stack += [(left, folder), (right, folder)]
            if e[66] == 1:
                stack.append((below, f"{folder}{name}/"))
            elif e[66] == 2:
                self.streams[folder + name] = self._stream(e)
