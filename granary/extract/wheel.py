"""All evidence of one wheel from its bytes; never raises."""

from __future__ import annotations

import fnmatch
import gc
import hashlib
import re

from granary.extract import metadata, pysource
from granary.extract.archive import UNREADABLE, Archive, Bounds
from granary.extract.native import ar, elf, macho, pe
from granary.extract.native.common import Obj, Patterns, strings_only
from granary.extract.pysource import Targets

NATIVE = re.compile(r"\.(so|dylib|pyd|dll|exe|a|lib)(\.[0-9]+)*$", re.I)
_BINARY = "path string, format string, vendored_path boolean, from_archive boolean, machine string, bits int, endian string, elf_type string, soname string, needed array<string>, rpath array<string>, runpath array<string>, stripped boolean, dynsym_count bigint, symtab_count bigint, matched_symbols array<struct<group string, name string, binding string>>, matched_strings array<struct<group string, value string>>, rust_crates array<struct<name string, version string>>, go struct<go_version string, boring_crypto boolean, markers array<string>>, symbols_truncated boolean, strings_truncated boolean, partial_analysis boolean, partial_reasons array<string>"
_META = "name string, canonical_name string, version string, tags array<string>, platform_tags array<string>, generator_raw string, generator_name string, generator_version string, requires_python string, requires_dist array<string>, requires_dist_names array<string>, root_is_purelib boolean, dist_info_dir string, record_entries bigint, record_mismatches array<string>, sbom_paths array<string>"
_ARTIFACTS = "py_files bigint, pyc_files bigint, py_files_unparsed bigint, source_available boolean, total_uncompressed_bytes bigint, skipped array<struct<path string, reason string>>, symlinks array<struct<path string, target string>>"


def _struct(ddl: str) -> str:
    """`a int, b array<...>` -> struct<a: int, b: array<...>>; only top-level commas part."""
    return "struct<" + re.sub(r"(\w+) (?=\w)", r"\1: ", ddl) + ">"


SCHEMA = ", ".join(
    [
        "sha256 string, size_bytes bigint",
        f"metadata {_struct(_META)}",
        "sbom array<struct<name: string, version: string, purl: string, source: string>>",
        f"binaries array<{_struct(_BINARY)}>",
        "py_sites array<struct<path: string, line: int, kind: string, target: string, detail: string, attrs: map<string, string>>>",
        "errors array<struct<stage: string, kind: string, path: string, message: string>>",
        f"artifacts {_struct(_ARTIFACTS)}",
    ]
)


def is_vendor(path: str, globs: list[str]) -> bool:
    return any(fnmatch.fnmatchcase(d, g) for d in path.split("/")[:-1] for g in globs)


def is_candidate(m, globs: list[str]) -> bool:
    folder, _, base = m.name.rpartition("/")
    if m.is_symlink or m.size < 64:
        return False
    bare = "." not in base
    return bool(NATIVE.search(base)) or is_vendor(m.name, globs) or (bare and (folder.rsplit("/", 1)[-1].lower() in ("bin", "lib", "lib64", "scripts", "libexec") or bool(m.mode & 0o111)))


def read_object(data: bytes, path: str, p: Patterns, vendored: bool) -> Obj:
    """By the first bytes; readers of the caller's own come before the built-in ones."""
    for magic, reader in p.readers.items():
        if data.startswith(magic):
            return reader(data, path, p, vendored)
    if data[:4] == b"\x7fELF":
        return elf.read(data, path, p, vendored)
    if data[:4] in macho.THIN or data[:4] in macho.FAT:
        return macho.read(data, path, p, vendored)
    if data[:2] == b"MZ":
        return pe.read(data, path, p, vendored)
    return strings_only(Obj(path, "unknown", vendored), p, data, "no_structural_reader")


def _objects(a: Archive, p: Patterns, globs: list[str]) -> list[Obj]:
    out: list[Obj] = []
    for name in sorted(a.members):
        if not is_candidate(a.members[name], globs) or (data := a.read(name)) is None:
            continue
        vendored = is_vendor(name, globs)
        if data[:8] != ar.MAGIC:
            out.append(read_object(data, name, p, vendored))
            continue
        seen: dict[str, int] = {}
        found = False
        try:
            for member, at, body in ar.members(data):
                if member is None:
                    a.error("ar_parse_error", name, f"no name for the member at {at}", "binary")
                    member = f"member@{at}"
                seen[member] = seen.get(member, 0) + 1
                shown = member if seen[member] == 1 else f"{member}#{seen[member]}"
                if body[:4] == b"\x7fELF" or body[:4] in macho.THIN or body[:4] in macho.FAT or body[:2] == b"MZ":
                    o = read_object(body, f"{name}({shown})", p, vendored)
                    o.from_archive = found = True
                    out.append(o)
        except ValueError as e:
            a.error("ar_parse_error", name, str(e), "binary")
            if not found:
                out.append(strings_only(Obj(name, "ar", vendored), p, data, "ar_member_table_unread"))
    return sorted(out, key=lambda o: o.path)


def _binary(o: Obj, p: Patterns, limits: dict[str, int], conv: dict) -> dict:
    symbols, truncated = _capped(sorted(o.symbols), lambda s: (s[0], s[2]), limits["max_symbols_per_binary"])
    texts, cut = _capped(sorted(o.strings), lambda s: s[0], limits["max_strings_per_binary"])
    # crates are an inventory too: those that the policy names come before all others
    crates, uncounted = _capped(sorted(o.crates, key=lambda c: (c[0], c[1] or "")), lambda c: c[0], limits["max_rust_crates_per_binary"], lambda c: c[0] in p.crates)
    markers = sorted({g for g, _ in o.strings} & {conv["go_boring_group"], conv["go_stock_group"], conv["go_fips140_group"]})
    go = {"go_version": o.go_version, "boring_crypto": conv["go_boring_group"] in markers, "markers": markers} if o.is_go or o.go_version or markers else None
    plain = {k: getattr(o, k) for k in ("path", "format", "vendored_path", "from_archive", "machine", "bits", "endian", "elf_type", "soname", "needed", "rpath", "runpath", "stripped", "dynsym_count", "symtab_count")}
    return plain | {
        "matched_symbols": [dict(zip(("group", "name", "binding"), s, strict=True)) for s in symbols],
        "matched_strings": [{"group": g, "value": v} for g, v in texts],
        "rust_crates": [{"name": n, "version": v} for n, v in crates],
        "go": go,
        "symbols_truncated": truncated,
        "strings_truncated": cut or uncounted or o.strings_truncated,
        "partial_analysis": bool(o.reasons),
        "partial_reasons": sorted(o.reasons)
    }


def _capped(items: list, key, limit: int, pinned=lambda x: False) -> tuple[list, bool]:
    """At most limit items, in order: one of every key first, pinned ones before others, then
    pinned ones, then the rest."""
    if len(items) <= limit:
        return items, False
    again: set = set()
    turn = []
    for i in sorted(range(len(items)), key=lambda i: not pinned(items[i])):
        k = key(items[i])
        turn.append((k in again, not pinned(items[i]), i))
        again.add(k)
    return [items[i] for i in sorted(i for *_, i in sorted(turn)[:limit])], True


def extract(content: bytes, filename: str, p: Patterns, t: Targets, limits: dict[str, int], conv: dict, bounds: Bounds = Bounds()) -> dict:
    """One row of `SCHEMA`.

    The collector of cycles rests meanwhile: syntax trees are many objects and no cycles, and
    to look through them again and again takes as long as to parse."""
    ran = gc.isenabled()
    gc.disable()
    try:
        return _extracted(content, filename, p, t, limits, conv, bounds)
    finally:
        if ran:
            gc.enable()


def _extracted(content: bytes, filename: str, p: Patterns, t: Targets, limits: dict[str, int], conv: dict, bounds: Bounds) -> dict:
    base = {"sha256": hashlib.sha256(content).hexdigest(), "size_bytes": len(content)}
    none = {"py_files": 0, "pyc_files": 0, "py_files_unparsed": 0, "source_available": False, "total_uncompressed_bytes": 0, "skipped": [], "symlinks": []}
    try:
        a = Archive(content, bounds)
    except UNREADABLE as e:
        return base | {"metadata": None, "sbom": [], "binaries": [], "py_sites": [], "errors": [_error("archive", "bad_zip", None, str(e))], "artifacts": none}
    try:
        meta, sbom = metadata.read(a, filename)
        objects = _objects(a, p, conv["vendor_dir_globs"])
        for o in objects:
            for kind, message in o.errors:
                a.error(kind, o.path, message, "binary")
        sites = pysource.scan(a, t)
        symlinks = [{"path": n, "target": a.target(n) or ""} for n in sorted(a.members) if a.members[n].is_symlink]
        py = sum(n.endswith(".py") and not m.is_symlink for n, m in a.members.items())
        pyc = sum(n.endswith(".pyc") for n in a.members)
        unparsed = len({e[2] for e in a.errors if e[0] == "python"})
        artifacts = {
            "py_files": py,
            "pyc_files": pyc,
            "py_files_unparsed": unparsed,
            "source_available": py - unparsed > 0 or (py == 0 and pyc == 0),
            "total_uncompressed_bytes": a.total,
            "skipped": [dict(zip(("path", "reason"), x, strict=True)) for x in sorted({(e[2], e[1]) for e in a.errors if e[0] == "archive" and e[2]})],
            "symlinks": symlinks
        }
        errors = [_error(*e) for e in sorted(set(a.errors), key=lambda e: (e[0], e[2] or "", e[1], e[3]))]
        return base | {"metadata": meta, "sbom": sbom, "binaries": [_binary(o, p, limits, conv) for o in objects], "py_sites": sites, "errors": errors, "artifacts": artifacts}
    except Exception as e:  # one bad wheel must not end the run
        return base | {"metadata": None, "sbom": [], "binaries": [], "py_sites": [], "errors": [_error("archive", "unexpected_error", None, type(e).__name__)], "artifacts": none}


def _error(stage: str, kind: str, path: str | None, message: str) -> dict:
    return {"stage": stage, "kind": kind, "path": path, "message": message}
