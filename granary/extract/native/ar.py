"""ar archives: their members' names and bytes, GNU and BSD."""

from __future__ import annotations

from collections.abc import Iterator

MAGIC = b"!<arch>\n"
#: Fixed value: members that are read of one archive.
MOST_MEMBERS = 4096
_PSEUDO = {"/", "//", "/SYM64/", "__.SYMDEF", "__.SYMDEF SORTED", "__.SYMDEF_64"}


def members(data: bytes) -> Iterator[tuple[str | None, int, bytes]]:
    """(name or None where it cannot be told, place, bytes); a ValueError for a broken header
    ends the walk."""
    at, long_names, n = len(MAGIC), b"", 0
    while at + 60 <= len(data):
        head = data[at : at + 60]
        if head[58:] != b"`\n":
            raise ValueError(f"no member header at {at}")
        try:
            size = int(head[48:58].decode("ascii").strip())
        except ValueError:
            raise ValueError(f"member size at {at} cannot be read") from None
        raw, start = head[:16].decode("latin-1").rstrip(), at + 60
        body = data[start : start + size]
        if len(body) < size:
            raise ValueError(f"member at {at} is cut short")
        name: str | None = raw
        if raw == "//":
            long_names = body
        elif raw.startswith("#1/") and raw[3:].isdigit():
            k = int(raw[3:])
            name, body = body[:k].rstrip(b"\0").decode("latin-1"), body[k:]
        elif raw.startswith("/") and raw[1:].isdigit():
            end = long_names.find(b"/\n", int(raw[1:]))
            name = long_names[int(raw[1:]) : end].decode("latin-1") if 0 <= end else None
        elif raw.endswith("/") and raw not in _PSEUDO:
            name = raw[:-1]
        if name not in _PSEUDO:
            n += 1
            if n > MOST_MEMBERS:
                raise ValueError("too many members")
            yield name, at, body
        at = start + size + (size & 1)
    if at < len(data):
        raise ValueError("the last member header is cut short")
