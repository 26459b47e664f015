"""Characters of an embedded TrueType program: what its character map and its glyph names say of each glyph.

Only what turns glyph numbers back into text is read; a table that ends early or is of another kind
tells nothing, and never more than the program's own number of glyphs is walked.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator


def tables(program: bytes) -> dict[str, bytes]:
    """Tables of a font program by their tags."""
    if len(program) < 12:
        return {}
    out = {}
    for k in range(struct.unpack_from(">H", program, 4)[0]):
        entry = program[12 + 16 * k : 28 + 16 * k]
        if len(entry) == 16:
            tag, _, at, size = struct.unpack(">4sLLL", entry)
            out[tag.decode("latin-1")] = program[at : at + size]
    return out


def _segments(sub: bytes) -> Iterator[tuple[int, int]]:
    """(character, glyph) of a map of segments (format 4)."""
    n = struct.unpack_from(">H", sub, 6)[0] // 2
    ends, starts, moves, places = (struct.unpack_from(f">{n}H", sub, at) for at in (14, 16 + 2 * n, 16 + 4 * n, 16 + 6 * n))
    for k in range(n):
        for ch in range(starts[k], min(ends[k], 0xFFFE) + 1):
            glyph = ch
            if places[k]:
                at = 16 + 6 * n + 2 * k + places[k] + 2 * (ch - starts[k])
                if at + 2 > len(sub) or not (glyph := struct.unpack_from(">H", sub, at)[0]):
                    continue
            yield ch, (glyph + moves[k]) & 0xFFFF


def _groups(sub: bytes, most: int) -> Iterator[tuple[int, int]]:
    """(character, glyph) of a map of groups (format 12)."""
    for k in range(min(struct.unpack_from(">L", sub, 12)[0], (len(sub) - 16) // 12)):
        first, last, glyph = struct.unpack_from(">LLL", sub, 16 + 12 * k)
        for ch in range(first, min(last, first + most, 0x10FFFF) + 1):
            yield ch, glyph + ch - first


def characters(program: bytes, named: Callable[[str], str]) -> dict[int, str]:
    """Glyph number to character: from the character map, else from the glyph's name."""
    t = tables(program)
    out: dict[int, str] = {}
    try:
        most = struct.unpack_from(">H", t.get("maxp", b""), 4)[0]
        cmap = t.get("cmap", bytes(4))
        for k in range(struct.unpack_from(">H", cmap, 2)[0]):
            platform, kind, at = struct.unpack_from(">HHL", cmap, 4 + 8 * k)
            if platform not in (0, 3) or platform == 3 and kind == 0:  # symbols have no characters of their own
                continue
            sub = cmap[at:]
            form = struct.unpack_from(">H", sub)[0]
            for ch, glyph in _segments(sub) if form == 4 else _groups(sub, most) if form == 12 else ():
                if 0 < glyph < most and not 0xD800 <= ch < 0xE000:
                    out.setdefault(glyph, chr(ch))
    except struct.error:
        pass
    for glyph, name in enumerate(names(t.get("post", b""))):
        if glyph not in out and (ch := named(name)) not in ("", "�"):
            out[glyph] = ch
    return out


def names(post: bytes) -> list[str]:
    """Names of the glyphs that the program spells out itself (format 2); the others are empty."""
    try:
        if struct.unpack_from(">L", post)[0] != 0x20000:
            return []
        n = struct.unpack_from(">H", post, 32)[0]
        index = struct.unpack_from(f">{n}H", post, 34)
        own, at = [], 34 + 2 * n
        while at < len(post):
            own.append(post[at + 1 : at + 1 + post[at]].decode("latin-1"))
            at += 1 + post[at]
        return [own[k - 258] if 258 <= k < 258 + len(own) else "" for k in index]
    except struct.error:
        return []
