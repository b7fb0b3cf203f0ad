"""ELF objects: header, dynamic section, symbol tables, strings.

Nothing that an object says of itself is taken as complete.  A table's own row count is held
against the string tables: a name there that a policy group claims and that no row led to
means rows that are not declared, or a string table put in place of the real one.  Sections
that declare more bytes than the budget are not read, compressed ones not inflated.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from granary.extract.native.common import STRING_BYTES, Names, Obj, Patterns, add_symbol, cstring, read_strings, strings_only
from granary.extract.native.strings import go_version

#: Fixed values of the format.
MACHINES = {2: "EM_SPARC", 3: "EM_386", 8: "EM_MIPS", 20: "EM_PPC", 21: "EM_PPC64", 22: "EM_S390", 40: "EM_ARM", 62: "EM_X86_64", 183: "EM_AARCH64", 243: "EM_RISCV", 258: "EM_LOONGARCH"}
TYPES = {0: "ET_NONE", 1: "ET_REL", 2: "ET_EXEC", 3: "ET_DYN", 4: "ET_CORE"}
PROGBITS, SYMTAB, STRTAB, DYNAMIC, NOBITS, DYNSYM = 1, 2, 3, 6, 8, 11
ALLOC, EXEC, COMPRESSED = 0x2, 0x4, 0x800
NEEDED, DT_STRTAB, SONAME, RPATH, RUNPATH = 1, 5, 14, 15, 29


class _Section:
    def __init__(self, f: tuple):
        self.name_at, self.type, self.flags, self.addr, self.offset, self.size, self.link, _, _, self.entsize = f
        self.name = ""


def read(data: bytes, path: str, p: Patterns, vendored: bool) -> Obj:
    o = Obj(path, "elf", vendored)
    if len(data) < 20 or data[4] not in (1, 2) or data[5] not in (1, 2):
        o.errors.append(("elf_parse_error", "the header cannot be read"))
        return strings_only(o, p, data, "elf_header_unread")
    wide, e = data[4] == 2, "<" if data[5] == 1 else ">"
    o.bits, o.endian = 64 if wide else 32, "little" if e == "<" else "big"
    try:
        kind, machine = struct.unpack_from(f"{e}HH", data, 16)
        shoff = struct.unpack_from(f"{e}Q" if wide else f"{e}I", data, 0x28 if wide else 0x20)[0]
        shentsize, shnum, shstrndx = struct.unpack_from(f"{e}HHH", data, 0x3A if wide else 0x2E)
    except struct.error:
        o.errors.append(("elf_parse_error", "the header is cut short"))
        return strings_only(o, p, data, "elf_header_unread")
    o.machine, o.elf_type = MACHINES.get(machine, f"EM_{machine}"), TYPES.get(kind, f"ET_{kind}")
    if not shoff:
        o.errors.append(("elf_parse_error", "there is no section table"))
        return strings_only(o, p, data, "elf_section_table_absent")
    form = struct.Struct(f"{e}IIQQQQIIQQ" if wide else f"{e}IIIIIIIIII")
    step = max(shentsize, form.size)
    if not shnum and shoff + form.size <= len(data):
        shnum = _Section(form.unpack_from(data, shoff)).size
    if shoff + shnum * step > len(data):
        o.errors.append(("binary_truncated", "the section table is cut short"))
        return strings_only(o, p, data, "elf_section_table_truncated")
    sections = [_Section(form.unpack_from(data, shoff + i * step)) for i in range(shnum)]
    if 0 < shstrndx < len(sections):
        names = _bytes(data, sections[shstrndx], e, wide) or b""
        for s in sections:
            s.name = cstring(names, s.name_at) or ""

    def only(t: int, name: str, reason: str) -> _Section | None:
        """The one section of a type; a section that has the usual name but another type was
        meant to be overlooked."""
        own = [s for s in sections if s.type == t]
        if len(own) > 1:
            o.reasons.add("elf_section_type_ambiguous")
        elif not own and any(s.name == name for s in sections):
            o.reasons.add(reason)
        return own[0] if len(own) == 1 else None

    dynamic = only(DYNAMIC, ".dynamic", "elf_dynamic_unread")
    dynsym = only(DYNSYM, ".dynsym", "elf_dynsym_unread")
    no_dynsym = not any(s.type == DYNSYM for s in sections) and "elf_dynsym_unread" not in o.reasons
    symtab = only(SYMTAB, ".symtab", "elf_symtab_unread")
    address = _dynamic(o, data, sections, dynamic, e, wide) if dynamic is not None else None
    read: set[str] = set()  # names that groups claim, of both tables
    if dynsym is not None:
        link = _linked(sections, dynsym)
        names = None if link is None or (address is not None and link.addr != address) else _bytes(data, link, e, wide)
        o.dynsym_count, whole = _symbols(o, p, _bytes(data, dynsym, e, wide), names, dynsym, e, wide, True, read, "elf_dynsym_unread")
        if whole and p.hides_a_name(names, read):
            o.reasons |= {"elf_dynsym_unread", "symtab_understates_rows"}
    if symtab is not None:
        link = _linked(sections, symtab)
        o.symtab_count, whole = _symbols(o, p, _bytes(data, symtab, e, wide), link and _bytes(data, link, e, wide), symtab, e, wide, no_dynsym, read, "elf_symtab_unread")
        # nothing vouches for the string table that .symtab names, so all of them are asked
        if whole and (no_dynsym or not o.reasons & {"elf_dynsym_unread", "elf_dynamic_unread"}):
            tables = [_bytes(data, s, e, wide) for s in sections if s.type == STRTAB]
            if any(t is None or p.hides_a_name(t, read) for t in tables):
                o.reasons |= {"elf_symtab_unread", "symtab_understates_rows"}
    o.stripped = symtab is None or o.symtab_count == 0
    text, code = [], []
    for s in sections:
        if s.type == PROGBITS and (s.flags & ALLOC or s.name == ".comment"):
            part = _bytes(data, s, e, wide)
            if part is None:
                o.reasons.add("elf_section_data_unread")
                part = b"" if s.flags & COMPRESSED else data[s.offset : s.offset + min(s.size, STRING_BYTES)]
            (code if s.flags & EXEC else text).append(part)
    read_strings(o, p, b"\0".join(text), b"\0".join(code))
    by_name = {s.name: s for s in sections}
    if ".go.buildinfo" in by_name or ".note.go.buildid" in by_name:
        o.is_go = True
        info = _bytes(data, by_name[".go.buildinfo"], e, wide) if ".go.buildinfo" in by_name else b""
        if info is None:
            o.reasons.add("elf_go_buildinfo_unread")
        else:
            o.go_version = go_version(info)
    if o.reasons & {"elf_dynamic_unread", "elf_dynsym_unread", "elf_symtab_unread", "elf_section_type_ambiguous", "elf_section_data_unread"}:
        o.errors.append(("elf_parse_error", ", ".join(sorted(o.reasons))))
    return o


def _bytes(data: bytes, s: _Section, e: str, wide: bool) -> bytes | None:
    """A section's bytes, inflated if need be; None over the budget or if they are not there."""
    if s.type == NOBITS or s.size > STRING_BYTES or s.offset + s.size > len(data):
        return None
    raw = data[s.offset : s.offset + s.size]
    if not s.flags & COMPRESSED:
        return raw
    try:
        kind, *_, size, _ = struct.unpack_from(f"{e}IIQQ" if wide else f"{e}III", raw)
        if kind != 1 or size > STRING_BYTES:
            return None
        inflate = zlib.decompressobj()
        out = inflate.decompress(raw[24 if wide else 12 :], size + 1)
    except (struct.error, zlib.error):
        return None
    return out if len(out) == size else None


def _linked(sections: list[_Section], s: _Section) -> _Section | None:
    """The string table that a section names."""
    return sections[s.link] if 0 < s.link < len(sections) and sections[s.link].type == STRTAB else None


def _dynamic(o: Obj, data: bytes, sections: list[_Section], s: _Section, e: str, wide: bool) -> int | None:
    """Read the dynamic section; the address that it gives for its strings."""
    table, link = _bytes(data, s, e, wide), _linked(sections, s)
    strings = link and _bytes(data, link, e, wide)
    if table is None or strings is None:
        o.reasons.add("elf_dynamic_unread")
        return None
    form = struct.Struct(f"{e}qQ" if wide else f"{e}iI")
    rows = []
    for tag, value in form.iter_unpack(table[: len(table) // form.size * form.size]):
        if tag == 0:
            break
        rows.append((tag, value))
    address = next((v for t, v in rows if t == DT_STRTAB), None)
    # the string table must be the one that the dynamic section itself names
    if address is not None and address != link.addr:
        o.reasons.add("elf_dynamic_unread")
        return address
    found: dict[int, list[str]] = {}
    names = Names(strings)
    for tag, value in rows:
        if tag in (NEEDED, SONAME, RPATH, RUNPATH):
            name = names.at(value)
            if name is None:
                o.reasons.add("elf_dynamic_unread")
            elif name:
                found.setdefault(tag, []).append(name)
    o.needed = sorted(set(found.get(NEEDED, [])))
    o.soname = found.get(SONAME, [None])[0]
    o.rpath = [x for v in found.get(RPATH, []) for x in v.split(":") if x]
    o.runpath = [x for v in found.get(RUNPATH, []) for x in v.split(":") if x]
    return address


def _symbols(o: Obj, p: Patterns, table: bytes | None, strings: bytes | None, s: _Section, e: str, wide: bool, imports: bool, read: set[str], reason: str) -> tuple[int, bool]:
    """Record a table's symbols; how many rows it has, and whether every name was found.
    Beside another table only definitions count."""
    size = 24 if wide else 16
    if table is None or strings is None or (s.entsize and s.entsize != size) or len(table) % size:
        o.reasons.add(reason)
        return (s.size // size, False) if table is None or strings is None else (0, False)
    wanted = np.dtype([("name", f"{e}u4"), ("info", "u1"), ("other", "u1"), ("index", f"{e}u2"), ("value", f"{e}u8"), ("size", f"{e}u8")])
    if not wide:
        wanted = np.dtype([("name", f"{e}u4"), ("value", f"{e}u4"), ("size", f"{e}u4"), ("info", "u1"), ("other", "u1"), ("index", f"{e}u2")])
    rows = np.frombuffer(table, wanted)
    some = np.flatnonzero(rows["name"])
    found = p.likely(strings, rows["name"][some].astype(np.int64))
    names, whole = Names(strings), True
    if found is not None:
        some, whole = some[found[0]], found[1]
    for at, info, index in zip(rows["name"][some].tolist(), rows["info"][some].tolist(), rows["index"][some].tolist(), strict=True):
        name = names.at(at)
        if name is None:
            whole = False
        elif name and p.groups_of(name):
            read.add(name)
            if info & 15 not in (3, 4) and (index or imports):  # sections and files are no symbols
                add_symbol(o, p, name, "defined" if index else "imported")
    if not whole:
        o.reasons.add(reason)
    return len(rows), whole
