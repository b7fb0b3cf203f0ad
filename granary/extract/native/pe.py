"""PE objects: imports, exports and forwarders."""

from __future__ import annotations

import struct

from granary.extract.native.common import NAME_BYTES, Obj, Patterns, add_symbol, cstring, read_strings, strings_only

#: Fixed values of the format.
MACHINES = {0x14C: "i386", 0x8664: "amd64", 0xAA64: "arm64", 0x1C4: "armnt", 0x1C0: "arm"}
MOST_DIRECTORIES, MOST_DESCRIPTORS, MOST_THUNKS, MOST_EXPORTS = 16, 4096, 65_536, 262_144


class _Image:
    def __init__(self, data: bytes, sections: list[tuple[int, int, int, int]]):
        self.data, self.sections = data, sections

    def at(self, rva: int) -> int | None:
        """Place in the file of an address, None outside all sections' raw data."""
        for va, size, raw, raw_size in self.sections:
            if va <= rva < va + max(size, raw_size):
                off = rva - va
                return raw + off if off < raw_size else None
        return None

    def text(self, rva: int) -> str | None:
        at = self.at(rva)
        return None if at is None else cstring(self.data[: at + NAME_BYTES + 1], at)

    def unpack(self, form: str, rva: int) -> tuple | None:
        at = self.at(rva)
        if at is None or at + struct.calcsize(form) > len(self.data):
            return None
        return struct.unpack_from(form, self.data, at)


def read(data: bytes, path: str, p: Patterns, vendored: bool) -> Obj:
    o = Obj(path, "pe", vendored, endian="little")
    try:
        new = struct.unpack_from("<I", data, 0x3C)[0]
        if data[new : new + 4] != b"PE\0\0":
            raise struct.error("no PE signature")
        machine, n_sections, _, _, _, optional_size, _ = struct.unpack_from("<HHIIIHH", data, new + 4)
        optional = new + 24
        magic = struct.unpack_from("<H", data, optional)[0]
        if magic not in (0x10B, 0x20B):
            raise struct.error("unknown optional header")
        wide = magic == 0x20B
        n_dirs = min(struct.unpack_from("<I", data, optional + (108 if wide else 92))[0], MOST_DIRECTORIES)
        dirs = [struct.unpack_from("<II", data, optional + (112 if wide else 96) + 8 * i) for i in range(n_dirs)]
    except struct.error as e:
        o.errors.append(("pe_parse_error", str(e)))
        return strings_only(o, p, data, "pe_header_unread")
    o.machine, o.bits = MACHINES.get(machine, f"machine_{machine:#x}"), 64 if wide else 32
    sections, code = [], []
    for i in range(n_sections):
        at = optional + optional_size + 40 * i
        if at + 40 > len(data):
            o.reasons.add("pe_section_table_truncated")
            break
        size, va, raw_size, raw = struct.unpack_from("<IIII", data, at + 8)
        sections.append((va, size, raw, raw_size))
        if struct.unpack_from("<I", data, at + 36)[0] & 0x20000000:
            code.append(data[raw : raw + raw_size])
    image = _Image(data, sections)
    directory = lambda i: dirs[i] if i < len(dirs) else (0, 0)
    entries, needed = _imports(o, p, image, directory(1)[0], wide)
    more, forwarded = _exports(o, p, image, *directory(0))
    if directory(13)[0]:
        o.reasons.add("pe_delay_load")
    if not needed and "pe_import_incomplete" not in o.reasons:
        o.reasons.add("pe_no_import_directory")
    o.needed = sorted(needed | forwarded)
    o.symtab_count = entries + more
    text = b"\0".join(data[raw : raw + raw_size] for _, _, raw, raw_size in sections)
    read_strings(o, p, text, b"\0".join(code))
    if o.reasons & {"pe_section_table_truncated", "pe_import_incomplete", "pe_export_incomplete"}:
        o.errors.append(("pe_parse_error", ", ".join(sorted(o.reasons))))
    return o


def _imports(o: Obj, p: Patterns, image: _Image, rva: int, wide: bool) -> tuple[int, set[str]]:
    names, entries, thunks = set(), 0, 0
    for i in range(MOST_DESCRIPTORS + 1) if rva else ():
        d = image.unpack("<IIIII", rva + 20 * i)
        if d is None or i == MOST_DESCRIPTORS:
            o.reasons.add("pe_import_incomplete")
            break
        lookup, _, _, name, first = d
        if not any(d):
            break
        dll = image.text(name)
        if not dll:
            o.reasons.add("pe_import_incomplete")
            continue
        names.add(dll)
        size, top = (8, 1 << 63) if wide else (4, 1 << 31)
        at = lookup or first
        while at:
            t = image.unpack("<Q" if wide else "<I", at)
            thunks += 1
            if t is None or thunks > MOST_THUNKS:
                o.reasons.add("pe_import_incomplete")
                break
            if not t[0]:
                break
            entries += 1
            if t[0] & top:
                o.reasons.add("pe_ordinal_import")
            elif (s := image.text((t[0] & 0x7FFFFFFF) + 2)) is None:
                o.reasons.add("pe_import_incomplete")
            elif s:
                add_symbol(o, p, s, "imported")
            at += size
    return entries, names


def _exports(o: Obj, p: Patterns, image: _Image, rva: int, size: int) -> tuple[int, set[str]]:
    if not rva:
        return 0, set()
    d = image.unpack("<IIIIIIIIIII", rva)
    if d is None:
        o.reasons.add("pe_export_incomplete")
        return 0, set()
    name, n_functions, n_names, functions, names, ordinals = d[3], d[5], d[6], d[7], d[8], d[9]
    o.soname = image.text(name) or None
    if max(n_functions, n_names) > MOST_EXPORTS:
        o.reasons.add("pe_export_incomplete")
    if n_functions > n_names:
        o.reasons.add("pe_ordinal_export")
    forwarded, count = set(), 0
    for i in range(min(n_names, MOST_EXPORTS)):
        at, ordinal = image.unpack("<I", names + 4 * i), image.unpack("<H", ordinals + 2 * i)
        text = image.text(at[0]) if at else None
        f = image.unpack("<I", functions + 4 * ordinal[0]) if ordinal else None
        if text is None or f is None:
            o.reasons.add("pe_export_incomplete")
            continue
        count += 1
        if not rva <= f[0] < rva + size:
            add_symbol(o, p, text, "defined")
            continue
        dll, _, symbol = (image.text(f[0]) or "").partition(".")
        if not symbol:
            o.reasons.add("pe_export_incomplete")
            continue
        forwarded.add(f"{dll}.dll")
        if symbol.startswith("#"):
            o.reasons.add("pe_ordinal_import")
        else:
            add_symbol(o, p, symbol, "imported")
    return count, forwarded
