"""The row that every object reader fills, and names read in full or not at all."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from granary.extract.native import strings

#: Bytes that one name may have, all names of a table, and a strings pass or
#: table; places of names that are remembered.
NAME_BYTES, NAMES_BYTES, STRING_BYTES, NAMES_KEPT = 8 << 10, 8 << 20, 64 << 20, 65_536
#: Bytes that a printed name does not have; NUL ends a name.
_UNPRINTED = bytes(b for b in range(1, 256) if not 0x20 <= b <= 0x7E)


@dataclass
class Obj:
    path: str
    format: str
    vendored_path: bool = False
    from_archive: bool = False
    machine: str | None = None
    bits: int | None = None
    endian: str | None = None
    elf_type: str | None = None
    soname: str | None = None
    needed: list[str] = field(default_factory=list)
    rpath: list[str] = field(default_factory=list)
    runpath: list[str] = field(default_factory=list)
    stripped: bool | None = None
    dynsym_count: int = 0
    symtab_count: int = 0
    symbols: set[tuple[str, str, str]] = field(default_factory=set)  # group, name, binding
    strings: set[tuple[str, str]] = field(default_factory=set)
    crates: set[tuple[str, str | None]] = field(default_factory=set)
    go_version: str | None = None
    is_go: bool = False
    reasons: set[str] = field(default_factory=set)
    errors: list[tuple[str, str]] = field(default_factory=list)  # kind, message
    strings_truncated: bool = False


@dataclass
class Patterns:
    """What readers look for, from the policy."""

    exact: dict[str, list[str]]  # name -> groups
    prefixes: list[tuple[str, str]]  # prefix, group
    strings: dict[str, list[str]]
    code_strings: dict[str, list[str]]
    min_string: int = 4
    width: int = 200
    cargo: dict[str, str] = field(default_factory=dict)  # where cargo keeps sources, by layout
    crates: frozenset[str] = frozenset()  # crates that the policy names
    readers: dict[bytes, Callable] = field(default_factory=dict)  # first bytes -> reader of more formats

    @cached_property
    def beginnings(self) -> tuple[str, ...]:
        return tuple({p for p, _ in self.prefixes})

    @cached_property
    def cargo_paths(self) -> dict[str, re.Pattern[str]]:
        return {k: re.compile(v) for k, v in self.cargo.items()}

    @cached_property
    def locator(self) -> re.Pattern[bytes] | None:
        """Beginnings of names in a string table that a group may claim."""
        some = sorted({*self.beginnings, *self.exact}, key=lambda x: (-len(x), x))
        return re.compile(rb"(?<![^\0])_?(?:" + b"|".join(re.escape(x.encode()) for x in some) + rb")") if some else None

    @cached_property
    def openings(self) -> np.ndarray:
        """Which two bytes (the first one low) a name of a group can begin with."""
        out = np.zeros(1 << 16, bool)
        for x in {*self.beginnings, *self.exact}:
            b = x.encode()[:2]
            first = [b[0]] if b else range(256)
            for c in [b[1]] if len(b) > 1 else range(256):
                out[[f | c << 8 for f in first]] = True
        return out

    def likely(self, table: bytes, at: np.ndarray, abi: str = "") -> tuple[np.ndarray, bool] | None:
        """Of names at the places `at` of a string table, those that a group may claim, and
        whether all are there in full; for all names at once.  None where they have to be read
        one by one: a table with unprinted bytes, or over the bound for all names."""
        raw = np.frombuffer(table + b"\0\0", np.uint8)
        if len(table.translate(None, _UNPRINTED)) < len(table):
            return None
        ends = np.append(np.flatnonzero(raw[: len(table)] == 0), len(table))
        place, row = np.unique(at, return_inverse=True)
        inside = np.minimum(place, len(table))
        end = ends[np.searchsorted(ends, inside)]
        if int((end - inside).sum()) > NAMES_BYTES:
            return None
        there = (end < len(table)) & (end - inside <= NAME_BYTES)
        start = np.minimum(inside + (raw[inside] == ord(abi) if abi else 0), len(table))
        may = there & self.openings[raw[start] | raw[start + 1].astype(np.uint16) << 8]
        return np.flatnonzero(may[row]), bool(there.all())

    def groups_of(self, name: str) -> list[str]:
        found = list(self.exact.get(name, ()))
        if name.startswith(self.beginnings):  # most names begin with none
            found += [g for p, g in self.prefixes if name.startswith(p) and g not in found]
        return found

    def hides_a_name(self, table: bytes, read: set[str], abi: str = "") -> bool:
        """Whether a string table holds a name of a group that is not among the names read.

        Names run from one NUL to the next; the text `abi` before a name is no part of it."""
        if self.locator is None:
            return False
        clean = table.translate(None, _UNPRINTED)
        for m in self.locator.finditer(clean):
            end = clean.find(b"\0", m.start())
            name = clean[m.start() : end if end >= 0 else len(clean)].decode("ascii").removeprefix(abi)
            if name not in read and self.groups_of(name):
                return True
        return False


class Names:
    """Names of one string table by place: each of at most `NAME_BYTES`, at most `NAMES_BYTES`
    in all, and each place read once."""

    def __init__(self, table: bytes):
        self.table, self.left, self.known = table, NAMES_BYTES, {}

    def at(self, place: int) -> str | None:
        """The printable part of a name, None if it is not there in full or over the bounds."""
        if place in self.known:
            return self.known[place]
        most = min(NAME_BYTES, self.left)
        end = self.table.find(b"\0", place, place + most + 1) if 0 <= place < len(self.table) else -1
        name = None
        if end >= 0:
            self.left -= end - place
            name = self.table[place:end].translate(None, _UNPRINTED).decode("ascii")
        if len(self.known) < NAMES_KEPT:
            self.known[place] = name
        return name


def cstring(data: bytes, at: int) -> str | None:
    """A NUL-ended printable name at a place, None if it is not there in full."""
    return Names(data).at(at)


def add_symbol(o: Obj, p: Patterns, name: str, binding: str) -> bool:
    """Record a symbol for each group that claims it; whether any does."""
    groups = p.groups_of(name)
    o.symbols.update((g, name, binding) for g in groups)
    return bool(groups)


def read_strings(o: Obj, p: Patterns, data: bytes, code: bytes = b"") -> None:
    if len(data) > STRING_BYTES:
        data, o.strings_truncated = data[:STRING_BYTES], True
        o.reasons.add("strings_bytes_unread")
    o.strings |= strings.group_matches(data, p.strings, p.min_string, p.width)
    o.strings |= strings.group_matches(code[:STRING_BYTES], p.code_strings, p.min_string, p.width)
    if p.cargo and (b"cargo" in data or b"vendor" in data or b"checkouts" in data):
        o.crates |= strings.crates("\n".join(strings.printable_runs(data, p.min_string)), p.cargo_paths)


def strings_only(o: Obj, p: Patterns, data: bytes, reason: str) -> Obj:
    """All that is left for an object without readable structure."""
    o.reasons.add(reason)
    read_strings(o, p, data, data)
    return o
