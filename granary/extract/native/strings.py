"""What printable text in an object says: string groups, cargo paths, Go build data."""

from __future__ import annotations

import re
from bisect import bisect_right

GO_MAGIC = b"\xff Go buildinf:"
_GO_VERSION = re.compile(rb"go[0-9]+\.[0-9]+(?:\.[0-9]+)?[A-Za-z0-9.-]*")
def printable_runs(data: bytes, least: int) -> list[str]:
    return [m.group().decode("ascii") for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, data)]


def group_matches(data: bytes, groups: dict[str, list[str]], least: int, width: int) -> set[tuple[str, str]]:
    """(group, run) for every run with one of a group's literals; long runs are clipped."""
    present = {g: [x.encode() for x in lits if x.encode() in data] for g, lits in groups.items()}
    present = {g: lits for g, lits in present.items() if lits}
    found: set[tuple[str, str]] = set()
    for g, lits in present.items():
        for lit in lits:
            at = data.find(lit)
            while at >= 0:
                lo, hi = at, at + len(lit)
                while lo and 0x20 <= data[lo - 1] <= 0x7E:
                    lo -= 1
                while hi < len(data) and 0x20 <= data[hi] <= 0x7E:
                    hi += 1
                if hi - lo >= least:
                    found.add((g, data[lo:hi].decode("ascii")[:width]))
                at = data.find(lit, hi)
    return found


def nested(gap: str) -> bool:
    """Whether what lies between a registry crate's folder and a vendor folder is nothing but
    up to 16 folders, so that the vendor folder is inside the crate."""
    if not gap:
        return True
    *folders, rest = re.split(r"[/\\]", gap)
    return not rest and len(folders) <= 16 and all(0 < len(x) <= 255 and ".rs" not in x and not set(x) & set("\0\"'\n") for x in folders)


def crates(text: str, patterns: dict[str, re.Pattern[str]]) -> set[tuple[str, str | None]]:
    """(name, version) of the crates whose source paths are in the text (printable runs by line).

    A vendor folder inside a registry crate's folder is that crate's own."""
    named = lambda m: (m["name"], m["version"])
    own = list(patterns["cargo_path_regex"].finditer(text))
    ends = [m.end() for m in own]
    found = {named(m) for m in own} | {named(m) for m in patterns["cargo_git_path_regex"].finditer(text)}
    for m in patterns["cargo_vendor_path_regex"].finditer(text):
        before = bisect_right(ends, m.start()) - 1
        if before < 0 or m.start() - ends[before] > 16 * 256 or not nested(text[ends[before] : m.start()]):
            found.add(named(m))
    return found


def _uvarint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def go_version(data: bytes) -> str | None:
    """Version in an inline build-info section; None without one.  Older sections hold an
    address in place of the text; it means nothing in a file that is not loaded, so nothing
    is read from them."""
    if not data.startswith(GO_MAGIC) or len(data) <= 32 or not data[15] & 2:
        return None
    try:
        n, start = _uvarint(data, 32)
    except (IndexError, ValueError):
        return None
    text = data[start : start + n]
    return text.decode() if n == len(text) and _GO_VERSION.fullmatch(text) else None
