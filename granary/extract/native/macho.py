"""Mach-O objects, thin and universal."""

from __future__ import annotations

import struct

import numpy as np

from granary.extract.native.common import Names, Obj, Patterns, add_symbol, cstring, read_strings, strings_only

#: Fixed values of the format.
THIN = {b"\xfe\xed\xfa\xce": (">", False), b"\xfe\xed\xfa\xcf": (">", True), b"\xce\xfa\xed\xfe": ("<", False), b"\xcf\xfa\xed\xfe": ("<", True)}
FAT = {b"\xca\xfe\xba\xbe": 20, b"\xca\xfe\xba\xbf": 32}
MACHINES = {7: "x86", 0x01000007: "x86_64", 12: "arm", 0x0100000C: "arm64", 18: "ppc", 0x01000012: "ppc64"}
SYMTAB, ID, RPATH = 0x2, 0xD, 0x8000001C
DYLIBS = {0xC, 0x80000018, 0x8000001F, 0x20, 0x80000023}  # load, weak, re-export, lazy, upward
MOST_SLICES, COMMAND_BYTES = 32, 1 << 20


def read(data: bytes, path: str, p: Patterns, vendored: bool) -> Obj:
    if data[:4] in THIN:
        return _slice(data, path, p, vendored)
    o = Obj(path, "macho", vendored)
    size = FAT[data[:4]]
    try:
        n = struct.unpack_from(">I", data, 4)[0]
        if n > MOST_SLICES:
            o.reasons.add("macho_fat_slice_unread")
        places: dict[int, int] = {}
        for i in range(min(n, MOST_SLICES)):
            f = struct.unpack_from(">IIQQ" if size == 32 else ">IIII", data, 8 + i * size)
            places.setdefault(f[2], f[3])
    except struct.error:
        o.errors.append(("macho_parse_error", "the list of slices is cut short"))
        return strings_only(o, p, data, "macho_header_unread")
    slices = []
    for at, length in places.items():
        part = data[at : at + length]
        if part[:4] not in THIN:
            o.reasons.add("macho_fat_slice_unread")
            continue
        slices.append(_slice(part, path, p, vendored))
    if not slices:
        o.errors.append(("macho_parse_error", "no slice can be read"))
        return strings_only(o, p, data, "macho_header_unread")
    first = slices[0]
    o.machine, o.bits, o.endian = first.machine, first.bits, first.endian
    o.soname = next((s.soname for s in slices if s.soname), None)
    o.needed = sorted({x for s in slices for x in s.needed})
    o.rpath = sorted({x for s in slices for x in s.rpath})
    o.stripped = all(s.stripped for s in slices)
    for s in slices:
        o.symtab_count += s.symtab_count
        o.symbols |= s.symbols
        o.strings |= s.strings
        o.crates |= s.crates
        o.reasons |= s.reasons
        o.errors += [x for x in s.errors if x not in o.errors]
    return o


def _slice(data: bytes, path: str, p: Patterns, vendored: bool) -> Obj:
    o = Obj(path, "macho", vendored)
    e, wide = THIN[data[:4]]
    head = 32 if wide else 28
    if len(data) < head:
        o.errors.append(("macho_parse_error", "the header is cut short"))
        return strings_only(o, p, data, "macho_header_unread")
    cpu, _, _, ncmds, sizeofcmds = struct.unpack_from(f"{e}iiIII", data, 4)
    o.machine, o.bits, o.endian = MACHINES.get(cpu & 0xFFFFFFFF, f"cpu_{cpu & 0xFFFFFFFF}"), 64 if wide else 32, "little" if e == "<" else "big"
    if sizeofcmds > COMMAND_BYTES:
        o.errors.append(("macho_parse_error", "load commands are too large"))
        return strings_only(o, p, data, "macho_header_unread")
    at, end, tables, ids = head, head + sizeofcmds, [], []
    for _ in range(ncmds):
        if at + 8 > min(end, len(data)):
            o.reasons.add("macho_load_command_walk_truncated")
            break
        cmd, size = struct.unpack_from(f"{e}II", data, at)
        if size < 8 or size % (8 if wide else 4) or at + size > min(end, len(data)):
            o.reasons.add("macho_load_command_walk_truncated")
            break
        body = data[at : at + size]
        if cmd in DYLIBS or cmd in (ID, RPATH):
            place = struct.unpack_from(f"{e}I", body, 8)[0]
            name = cstring(body, place) if place >= (12 if cmd == RPATH else 24) else None
            if not name:
                o.reasons.add("macho_load_command_string_unread")
            elif cmd == RPATH:
                o.rpath.append(name)
            elif cmd == ID:
                ids.append(name)
            else:
                o.needed.append(name)
        elif cmd == SYMTAB and size >= 24:
            tables.append(struct.unpack_from(f"{e}IIII", body, 8))
        at += size
    o.needed = sorted(set(o.needed))
    if len(ids) > 1 or len(tables) > 1:
        o.reasons.add("macho_load_command_ambiguous")
    o.soname = ids[0] if len(ids) == 1 else None
    if len(tables) == 1:
        _symbols(o, p, data, tables[0], e, wide)
    else:
        o.stripped = not tables
    read_strings(o, p, data, data)
    if "macho_symtab_incomplete" in o.reasons or "macho_load_command_walk_truncated" in o.reasons:
        o.errors.append(("macho_parse_error", ", ".join(sorted(o.reasons))))
    return o


def _symbols(o: Obj, p: Patterns, data: bytes, table: tuple[int, int, int, int], e: str, wide: bool) -> None:
    symoff, n, stroff, strsize = table
    size, strings = 16 if wide else 12, data[stroff : stroff + strsize]
    if symoff + n * size > len(data) or len(strings) < strsize:
        o.reasons.add("macho_symtab_incomplete")
        n = max(0, min(n, (len(data) - symoff) // size))
    kinds = np.dtype([("at", f"{e}u4"), ("kind", "u1"), ("section", "u1"), ("more", f"{e}u2"), ("value", f"{e}u8" if wide else f"{e}u4")])
    rows = np.frombuffer(data, kinds, n, symoff) if n else np.zeros(0, kinds)
    names, read = Names(strings), set()
    some = np.flatnonzero(rows["at"])
    found = p.likely(strings, rows["at"][some].astype(np.int64), "_")
    named = 0
    if found is not None:
        first = np.frombuffer(strings + b"\0", np.uint8)[np.minimum(rows["at"][some], len(strings))]
        named = int(((first != 0) & (rows["kind"][some] & 0xE0 == 0)).sum())
        if not found[1]:
            o.reasons.add("macho_symtab_incomplete")
        # aliases are looked at whatever they are called
        some = some[np.union1d(found[0], np.flatnonzero(rows["kind"][some] & 0x0E == 0x0A))]
    for at, kind, value in zip(rows["at"][some].tolist(), rows["kind"][some].tolist(), rows["value"][some].tolist(), strict=True):
        name = names.at(at)
        if name is None:
            o.reasons.add("macho_symtab_incomplete")
            continue
        if p.groups_of(name.removeprefix("_")):
            read.add(name.removeprefix("_"))
        if kind & 0xE0 or not name:  # debugging entries
            continue
        named += found is None
        add_symbol(o, p, name.removeprefix("_"), "imported" if kind & 0x0E == 0 else "defined")
        if kind & 0x0E == 0x0A and (target := names.at(value)):  # an alias of another name
            if add_symbol(o, p, target.removeprefix("_"), "imported"):
                read.add(target.removeprefix("_"))
    if "macho_symtab_incomplete" not in o.reasons and p.hides_a_name(strings, read, "_"):
        o.reasons |= {"macho_symtab_incomplete", "symtab_understates_rows"}
    o.symtab_count = n
    o.stripped = named == 0 and "macho_symtab_incomplete" not in o.reasons
